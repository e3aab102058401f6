"""The daily worklist as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancylens.functions.text import blank, either
from vacancylens.operators.pages import needs_browser, needs_manual_review
from vacancylens.operators.ranking import hours_note, hours_risk, rank_key, red_flag_text, review_reason, with_section
from vacancylens.operators.windows import ranked_within

SECTIONS = ("correspondence", "focus", "PRIMARY", "SECONDARY", "OPPORTUNISTIC", "held_back", "skipped", "errored", "unfetched", "unplaced")


_DUPLICATES = "array<struct<id:string,company:string,title:string,link:string,similarity:double,overlap:double>>"


def duplicate_text(duplicates: str = "duplicates") -> Column:
    """Absorbed postings of a row as one text, linked where they have a link; '' if it absorbed none."""
    def label(d: Column) -> Column:
        name = F.concat(either(d["title"], F.lit("Untitled")), F.lit(" @ "), either(d["company"], F.lit("unknown")))
        linked = F.when(blank(d["link"]) != "", F.concat(F.lit("["), name, F.lit("]("), d["link"], F.lit(")"))).otherwise(name)
        return F.concat(linked, F.format_string(" (similarity %.2f · JD overlap %.0f%%)", d["similarity"], d["overlap"] * 100))

    return F.array_join(F.transform(F.coalesce(F.col(duplicates).cast(_DUPLICATES), F.array().cast(_DUPLICATES)), label), "; ")


def collapsed(df: DataFrame, ord_col: str = "ord", duplicates: str = "duplicates") -> DataFrame:
    """(ord, posting, n_absorbed, absorbed): every collapse in one place, those onto skipped rows too."""
    name = F.concat(either("title", F.lit("Untitled")), F.lit(" @ "), either("company", F.lit("unknown")))
    return df.filter(F.size(F.coalesce(F.col(duplicates).cast(_DUPLICATES), F.array().cast(_DUPLICATES))) > 0).select(
        ord_col, name.alias("posting"), F.size(duplicates).alias("n_absorbed"), duplicate_text(duplicates).alias("absorbed"))


def worklist(df: DataFrame, run: str = "run", ord_col: str = "ord") -> DataFrame:
    """(run, section, position, ...): each row of each run in exactly one section, in rank order.

    `unfetched_too` marks rows that also belong on the manual list; `also_posted_as` names what a row absorbed, if the
    frame carries `duplicates`.
    """
    also = duplicate_text() if "duplicates" in df.columns else F.lit("")
    placed = with_section(df, (run,), ord_col)
    note = F.when(F.col("section").isin("held_back", "skipped"), F.concat(review_reason(), F.lit(": "), red_flag_text()))
    rows = placed.select(
        run, "section", ord_col, "company", "title", "link", "final_tier", F.col("analysis.verdict").alias("verdict"),
        F.col("analysis.fit_score").alias("fit_score"), note.otherwise(hours_note()).alias("note"),
        needs_manual_review().alias("unfetched_too"), also.alias("also_posted_as"), F.struct(hours_risk().alias("hours"), rank_key(ord_col).alias("key")).alias("_key"))
    return ranked_within(rows, (run, "section"), F.col("_key")).drop("_key")


def write_worklist(table: DataFrame, path: str, run: str = "run") -> None:
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def failure_log(df: DataFrame, ord_col: str = "ord") -> DataFrame:
    """(ord, line): tab-separated error, link and posting of every row whose page could not be read."""
    name = F.concat(blank("title"), F.lit(" @ "), blank("company"))
    return df.filter(needs_manual_review()).select(ord_col, F.concat_ws("\t", blank("fetch_error"), blank("link"), name).alias("line"))


def archive_lines(plan: DataFrame, label: str, day: str) -> DataFrame:
    """(place, mid, line): the archive list as tab-separated lines under its headings; held messages are not on it.

    plan as `mail.archive_plan` gives it. No message, no list.
    """
    rows = plan.filter(F.col("action") == "archive").select(F.lit(9).alias("place"), "mid", F.concat_ws(
        "\t", "mid", F.lit(label), either("sender", F.lit("?")), either("subject", F.lit("(no subject)")),
        F.concat(F.col("n_jobs").cast("string"), F.lit(" job(s): "), "context")).alias("line"))
    n = rows.agg(F.count("*").alias("n")).filter("n > 0")  # one row
    heads = F.array(
        F.concat(F.lit("# "), F.col("n").cast("string"), F.lit(f" message(s) to move out of the inbox into '{label}'; list of {day}")),
        F.lit("# message id, label, sender, subject, context; separated by tabs"))
    return n.select(F.posexplode(heads).alias("place", "line")).select("place", F.lit("").alias("mid"), "line").unionByName(rows)


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """Lines in order, as text files that follow each other by name."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)


def write_queue(df: DataFrame, path: str) -> None:
    """What a browser has to read, one JSON object per line."""
    df.filter(needs_browser()).select("id", "link", "company", "title", "source_platform", "jd_source", F.col("analysis.why").alias("why")).write.mode(
        "overwrite").json(path)
