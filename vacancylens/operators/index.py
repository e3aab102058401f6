"""Search index tables: postings to documents, changed-row upsert, precedent filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancylens.functions.identity import composite_id, document_key
from vacancylens.functions.text import blank, either, strip


def is_precedent() -> Column:
    """Judged by the scorer itself: not screened out, not an error stub. Reads a posting's own columns."""
    why = blank("analysis.why")
    return (
        F.col("analysis").isNotNull() & ~F.coalesce(F.col("prefiltered"), F.lit(False))
        & ~why.startswith("prefilter:") & ~why.startswith("analysis_error:")
    )


def build_documents(df: DataFrame) -> DataFrame:
    """Postings to search documents: headline, verdict line, reasons, flags, text last. Empty rows drop."""
    def part(name: str) -> Column:
        return strip(blank(f"analysis.{name}"))

    title, company = strip(blank("title")), strip(blank("company"))
    text = either(strip(blank("fetched_jd")), strip(blank("email_jd_text")))
    scored = F.col("analysis").isNotNull()
    traits = F.concat_ws(" · ", F.nullif(part("employment_type"), F.lit("")), F.nullif(part("cadence"), F.lit("")),
                         F.when(F.col("analysis.is_agency"), F.lit("agency")), F.nullif(part("rate"), F.lit("")))
    fit = F.coalesce(F.col("analysis.fit_score"), F.lit(0))
    verdict = F.concat(
        F.lit("Verdict: "), either(part("verdict"), F.lit("unknown")), F.lit(" · "), fit.cast("string"),
        F.lit("/100 · tier "), either(part("tier"), F.lit("unknown")),
        F.when(traits != "", F.concat(F.lit(" · "), traits)).otherwise(F.lit("")))
    flags = F.array_join(F.filter(F.transform(F.coalesce("analysis.red_flags", F.array().cast("array<string>")), strip),
                                  lambda x: x != ""), " · ")

    def line(label: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(label), value))

    content = F.concat_ws(
        "\n", F.concat(either(title, F.lit("(untitled)")), F.lit(" — "), either(company, F.lit("(unknown company)"))),
        F.when(scored, verdict), F.when(scored, line("Why: ", part("why"))),
        F.when(scored, line("Role: ", part("role_summary"))), F.when(scored, line("Fit: ", part("meets_goals"))),
        F.when(scored, line("Red flags: ", flags)), line("JD: ", text))
    posting_id = composite_id("company", "title")
    kept = df.filter((title != "") | (company != "") | (text != ""))
    return kept.select(
        document_key(F.lit("job"), posting_id, F.lit(""), F.lit(""), F.lit(0)).alias("key"), content.alias("content"),
        F.lit("job").alias("kind"), posting_id.alias("id"), strip(blank("link")).alias("link"), company.alias("company"),
        title.alias("title"), "run", "ord", "jd_source", scored.alias("scored"),
        F.coalesce("prefiltered", F.lit(False)).alias("prefiltered"), fit.alias("fit_score"), part("verdict").alias("verdict"),
        part("tier").alias("tier"), F.coalesce("analysis.intensity", F.lit(0)).alias("intensity"),
        part("employment_type").alias("employment_type"), part("cadence").alias("cadence"),
        F.coalesce("analysis.is_agency", F.lit(False)).alias("is_agency"), part("rate").alias("rate"),
        part("why").alias("rationale"))


def changed_documents(new: DataFrame, indexed: DataFrame) -> DataFrame:
    """New or changed documents only. Only the content's hash of the indexed side is shuffled, not its text."""
    known = indexed.select("key", F.xxhash64("content").alias("old_hash"), F.lit(True).alias("known"))
    compared = new.join(known, "key", "left")
    fresh = F.col("known").isNull() | (F.col("old_hash") != F.xxhash64("content"))
    return compared.filter(fresh).drop("old_hash").withColumn(
        "change", F.when(F.col("known"), F.lit("changed")).otherwise(F.lit("new"))).drop("known")


def upsert(new: DataFrame, indexed: DataFrame) -> DataFrame:
    """Next version of the index: changed and new documents replace theirs, the rest stays."""
    fresh = changed_documents(new, indexed).drop("change")
    return indexed.join(fresh.select("key"), "key", "left_anti").unionByName(fresh, allowMissingColumns=True)
