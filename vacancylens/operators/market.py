"""Corpus measures: window, rate reality, supply splits, terms, employers, source health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.functions.dates import run_date
from vacancylens.functions.rates import extract_rate, rate_midpoint
from vacancylens.functions.text import blank, strip
from vacancylens.operators.bands import STATS, distribution
from vacancylens.operators.leader import cluster_fields, value_counts
from vacancylens.operators.windows import latest_run, posting_key

SCOPES = ("all postings", "contract", "permanent")


def _judged(name: str) -> Column:
    return F.lower(strip(blank(f"analysis.{name}")))


def posting_facts(postings: DataFrame) -> DataFrame:
    """The small columns the measures need, one row per posting (its last run).

    The columns are derived before the rows are de-duplicated, so texts are read once where they lie and never shuffled.
    """
    read = strip(blank("fetched_jd")) != ""
    is_read = (F.col("jd_source") == "full") & read
    facts = postings.select(
        posting_key().alias("posting"), "run", "ord", strip(blank("company")).alias("company"), F.coalesce(is_read, F.lit(False)).alias("is_read"),
        F.when(is_read, rate_midpoint(extract_rate("fetched_jd"))).alias("hourly"),
        _judged("employment_type").alias("employment_type"), _judged("cadence").alias("cadence"),
        F.coalesce(F.col("analysis.is_agency"), F.lit(False)).alias("is_agency"),
        F.col("analysis.red_flags").alias("red_flags"), F.col("analysis.resume_keywords").alias("resume_keywords"))
    return latest_run(facts, key=F.col("posting")).drop("posting", "ord")


def corpus_window(facts: DataFrame) -> DataFrame:
    """One row: postings, texts read, distinct runs, first and last date, inclusive days (null without dates)."""
    day = run_date("run")
    return facts.agg(
        F.count("*").alias("postings"), F.count_if("is_read").alias("jd_read"),
        F.count_distinct(F.nullif("run", F.lit(""))).alias("runs"), F.date_format(F.min(day), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max(day), "yyyy-MM-dd").alias("last_day"), (F.datediff(F.max(day), F.min(day)) + 1).alias("days"))


def rate_reality(facts: DataFrame) -> DataFrame:
    """Per scope: postings read, those stating a rate, share, distribution. The scopes overlap and none goes missing.

    One pass with conditional aggregates; hourly midpoints are half dollars within a fixed band, so the exact
    percentile's counters stay small.
    """
    inside = {"all postings": F.col("is_read"), "contract": F.col("is_read") & F.col("employment_type").startswith("contract"),
              "permanent": F.col("is_read") & (F.col("employment_type") == "permanent")}
    measures = []
    for scope in SCOPES:
        value = F.when(inside[scope], F.col("hourly"))
        figures = distribution(value)
        measures.append(F.struct(F.lit(scope).alias("scope"), F.count(value).alias("n"),
                                 F.count_if(inside[scope]).alias("total"), *figures).alias(scope.replace(" ", "_")))
    one = facts.agg(*measures)
    rows = one.select(F.explode(F.array(*[s.replace(" ", "_") for s in SCOPES])).alias("r")).select("r.*")
    share = F.when(F.col("total") > 0, F.bround(F.col("n") / F.col("total"), 4))
    return rows.select("scope", "n", "total", share.alias("share"), *STATS)


def supply_splits(facts: DataFrame) -> DataFrame:
    """(field, label, n, share) of employment type, cadence and agency. Counts combine over all three first."""
    counted = facts.groupBy("employment_type", "cadence", "is_agency").agg(F.count("*").alias("n"))
    labelled = counted.select(F.col("n"), F.explode(F.array(
        F.struct(F.lit("employment_type").alias("field"), F.when(F.col("employment_type") == "", "unknown").otherwise(F.col("employment_type")).alias("label")),
        F.struct(F.lit("cadence").alias("field"), F.when(F.col("cadence") == "", "unknown").otherwise(F.col("cadence")).alias("label")),
        F.struct(F.lit("is_agency").alias("field"), F.when(F.col("is_agency"), "agency").otherwise("direct").alias("label")))).alias("s"))
    per = labelled.groupBy("s.field", "s.label").agg(F.sum("n").alias("n"))
    total = per.groupBy("field").agg(F.sum("n").alias("total"))
    return per.join(total, "field").select("field", "label", "n", F.bround(F.col("n") / F.col("total"), 4).alias("share"))


TERM_FIELDS = ("resume_keywords", "red_flags")
EMPLOYER_FIELD = "company"


def field_counts(facts: DataFrame, fields: Sequence[str] = TERM_FIELDS, with_employers: bool = True,
                 min_term_count: int = 1, company_floor: float = fixed.COMPANY_COSINE) -> DataFrame:
    """Counts of every free-text field to cluster: (field, value, n, floor)."""
    parts = [value_counts(facts, f).filter(F.col("n") >= min_term_count).select(
        F.lit(f).alias("field"), "value", "n", F.lit(fixed.CLUSTER_COSINE).alias("floor")) for f in fields]
    if with_employers:
        named = facts.filter(F.col("company") != "").groupBy(F.col("company").alias("value")).agg(F.count("*").alias("n"))
        parts.append(named.select(F.lit(EMPLOYER_FIELD).alias("field"), "value", "n", F.lit(company_floor).alias("floor")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def term_sections(facts: DataFrame, clusters: DataFrame | None = None, fields: Sequence[str] = TERM_FIELDS,
                  top: int = fixed.TOP_TERMS, **options) -> DataFrame:
    """Clustered terms per field: (field, label, total, spellings, place, all_clusters, contributing, postings)."""
    if clusters is None:
        clusters = cluster_fields(field_counts(facts, fields, with_employers=False), **options)
    totals = clusters.filter(F.col("field").isin(*fields)).groupBy("field", "label").agg(
        F.sum("n").alias("total"), F.count("*").alias("spellings"))
    sizes = totals.groupBy("field").agg(F.count("*").alias("all_clusters"))
    # The rank limit runs before the shuffle, so a field sends at most `top` rows per task.
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("total"), "label"))
    first = totals.withColumn("place", place).filter(F.col("place") <= top)

    def carries(field: str) -> Column:
        return F.exists(F.coalesce(field, F.array().cast("array<string>")), lambda x: strip(blank(x)) != "")

    samples = facts.agg(F.count("*").alias("postings"), *[F.count_if(carries(f)).alias(f) for f in fields])
    sample = samples.select("postings", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("contributing")) for f in fields])).alias("s"))
    return first.join(sizes, "field").join(sample.select("s.field", "s.contributing", "postings"), "field").select(
        "field", "label", "total", "spellings", "place", "all_clusters", "contributing", "postings")


def employers(facts: DataFrame, clusters: DataFrame | None = None, **options) -> DataFrame:
    """Employers clustered over spellings: (name, n, is_agency, spellings); one flagged spelling flags all."""
    if clusters is None:
        clusters = cluster_fields(field_counts(facts, ()), **options)
    flags = facts.filter(F.col("company") != "").groupBy(F.col("company").alias("value")).agg(F.bool_or("is_agency").alias("flagged"))
    flagged = clusters.filter(F.col("field") == EMPLOYER_FIELD).join(flags, "value")
    return flagged.groupBy(F.col("label").alias("name")).agg(
        F.sum("n").alias("n"), F.bool_or("flagged").alias("is_agency"), F.count("*").alias("spellings"))


def top_with_total(df: DataFrame, top: int, size: str, name: str) -> DataFrame:
    """Largest rows with their place and the number of all rows. The cut is a distributed top-k, the total a count."""
    total = df.agg(F.count("*").alias("all_rows"))  # one row
    place = F.row_number().over(Window.orderBy(F.desc(size), name))  # over at most `top` rows
    return df.orderBy(F.desc(size), name).limit(top).withColumn("place", place).crossJoin(F.broadcast(total))


def spellings_shown(clusters: DataFrame, most: int = fixed.MAX_SPELLINGS) -> DataFrame:
    """Per cluster the first spellings after its label, and how many more there are."""
    others = clusters.filter(F.col("value") != F.col("label"))
    nth = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "value"))
    listed = others.withColumn("_n", nth).filter(F.col("_n") <= most).groupBy("label").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_n", F.concat("value", F.lit(" "), F.col("n").cast("string")).alias("s")))),
        lambda x: x["s"]), "; ").alias("also"))
    totals = clusters.groupBy("label").agg(F.sum("n").alias("total"), F.count("*").alias("spellings"))
    return totals.join(listed, "label", "left").select(
        "label", "total", F.coalesce("also", F.lit("")).alias("also"),
        F.greatest(F.col("spellings") - 1 - most, F.lit(0)).cast("bigint").alias("more"))


def source_health(rows: DataFrame, registry: DataFrame, is_kept: Column, source: str = "source") -> DataFrame:
    """Raw and kept rows per registered source; a source that returned nothing at all stays visible and alerts.

    registry(source, unconfigured): unconfigured is the reason a keyed source could not run, else null.
    """
    counts = rows.groupBy(source).agg(F.count("*").alias("raw"), F.count_if(is_kept).alias("kept"))
    out = registry.join(counts, source, "left").withColumn("raw", F.coalesce("raw", F.lit(0))).withColumn("kept", F.coalesce("kept", F.lit(0)))
    status = (F.when(F.col("raw") > 0, F.lit("ok")).when(F.col("unconfigured").isNotNull(), F.col("unconfigured"))
              .otherwise(F.lit("nothing returned")))
    return out.select(source, "raw", "kept", status.alias("status"),
                      ((F.col("raw") == 0) & F.col("unconfigured").isNull()).alias("alert"))


def attribution_lines(counts: DataFrame, source: str = "source") -> DataFrame:
    """Distinct attribution lines owed by the sources that returned rows, in registry order.

    counts(source, n) has one row per source, so the registry's order bounds it.
    """
    lines = F.coalesce(*[F.when(F.col(source) == s, F.struct(F.lit(fixed.SOURCE_ORDER.index(s)).alias("rank"), F.lit(line).alias("line")))
                         for s, line in fixed.ATTRIBUTION.items()])
    owed = counts.filter(F.col("n") > 0).select(lines.alias("l")).filter(F.col("l").isNotNull()).select("l.*")
    return owed.groupBy("line").agg(F.min("rank").alias("rank"))


def eval_spread(results: DataFrame, runs: Sequence[str], case: str = "case", run: str = "run", mean: str = "mean") -> DataFrame:
    """Case by run matrix of means with the spread per case; a case with one run has spread 0.

    results has one row per case and run; of repeated ones the highest mean counts.
    """
    wide = results.groupBy(case).pivot(run, list(runs)).agg(F.max(mean))
    got = F.array_compact(F.array(*[F.col(f"`{r}`") for r in runs]))
    spread = F.when(F.size(got) > 1, F.bround(F.array_max(got) - F.array_min(got), 2)).otherwise(F.lit(0.0))
    return wide.withColumn("spread", spread)


def review_gate(df: DataFrame, dimensions: Sequence[str], keywords: str = "keywords", bar: int = fixed.REVIEW_BAR) -> DataFrame:
    """Adds `passes` (every dimension at the bar) and keyword counts by status."""
    def count(status: str) -> Column:
        return F.size(F.filter(keywords, lambda k: k["status"] == status))

    return df.withColumn("passes", F.least(*[F.col(d) for d in dimensions]) >= bar).withColumn(
        "absent", count("absent")).withColumn("skills_only", count("skills_only")).withColumn(
        "in_bullet", F.size(keywords) - F.col("absent") - F.col("skills_only"))


def run_summary(jobs: DataFrame) -> DataFrame:
    """One row of counters over a scored batch."""
    scored = F.col("analysis").isNotNull()
    n, pre = F.count_if(scored), F.count_if(scored & F.col("prefiltered"))
    return jobs.agg(
        n.alias("analysed"), pre.alias("prefiltered"),
        F.when(n > 0, F.floor(pre * 100 / F.greatest(n, F.lit(1)))).otherwise(F.lit(0)).cast("bigint").alias("prefiltered_pct"),
        F.count_if(scored & F.col("analysis_errored")).alias("errored"),
        F.count_if((blank("link") != "") & (F.col("jd_source") != "full")).alias("unfetched"),
        *[F.count_if(F.col("liveness") == s).alias(f"liveness_{s}") for s in ("open", "closed", "unknown")])
