"""From a source's own fields to posting rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.functions.links import normalize_link
from vacancylens.functions.text import blank, strip


def posting_text(description: Column, *, employment_type: Column | None = None, metro: Column | None = None,
                 cadence: Column | None = None, rate: Column | None = None, tech: Column | None = None,
                 attribution: Column | None = None) -> tuple[Column, Column]:
    """(text, jd_source): known facts as an ordered header, then the description; full only with a description."""
    facts = zip(fixed.HEADER_FACTS, (employment_type, metro, cadence, rate, tech, attribution))
    header = [F.when(strip(blank(v)) != "", F.concat(F.lit(f"{k}: "), strip(v), F.lit("."))) for k, v in facts if v is not None]
    body = strip(blank(description))
    text = strip(F.concat_ws(" ", *header, F.nullif(body, F.lit(""))))
    return text, F.when(body != "", F.lit("full")).otherwise(F.lit("title_only"))


def posting_columns(*, title: Column, company: Column, link: Column, source: Column, description: Column,
                    posted: Column | None = None, **facts: Column) -> list[Column]:
    """The select list every market and agency source ends with."""
    text, jd_source = posting_text(description, **facts)
    return [
        blank(link).alias("link"), strip(blank(company)).alias("company"), strip(blank(title)).alias("title"),
        source.alias("source_platform"), blank(posted if posted is not None else F.lit("")).alias("posted_hint"),
        text.alias("fetched_jd"), F.lit("").alias("email_jd_text"), jd_source.alias("jd_source"),
    ]


def board_head(title: Column, company: Column, location: Column, pay: Column, posted: Column, body: Column) -> Column:
    """Title line, location, pay and date lines where known, then the body."""
    first = F.when(company != "", F.concat(title, F.lit(" — "), company)).otherwise(title)
    head = F.concat_ws(
        "\n", F.when(strip(first) != "", first),
        F.when(location != "", F.concat(F.lit("Location: "), location)),
        F.when(pay != "", F.concat(F.lit("Compensation (employer-stated): "), pay)),
        F.when(posted != "", F.concat(F.lit("Posted: "), posted)))
    return F.concat(head, F.when(body != "", F.concat(F.lit("\n\n"), body)).otherwise(F.lit("")))


def board_rows(rows: DataFrame, *keep: str, link: Column, company: Column, title: Column, platform: str, location: Column, pay: Column,
               posted: Column, body: Column) -> DataFrame:
    """Rows of a board source: a long enough text with a body is full, anything else a snippet.

    Each step is a projection of its own that the next one reads several times, so a body is worked out once a row.
    """
    hint = F.coalesce(F.date_format(posted, "yyyy-MM-dd"), F.lit(""))
    parts = rows.select(*keep, normalize_link(strip(blank(link))).alias("link"), company.alias("company"), title.alias("title"),
                        location.alias("_location"), pay.alias("_pay"), hint.alias("posted_hint"), body.alias("_body"))
    head = board_head(F.col("title"), F.col("company"), F.col("_location"), F.col("_pay"), F.col("posted_hint"), F.col("_body"))
    texts = parts.select(*keep, "link", "company", "title", "posted_hint", head.alias("_text"), (strip(F.col("_body")) != "").alias("_told"))
    full = F.col("_told") & (F.length(strip(F.col("_text"))) >= fixed.MIN_TEXT_CHARS)
    judged = texts.select("*", full.alias("_full"))
    return judged.select(
        *keep, "link", "company", "title", F.lit(platform).alias("source_platform"), "posted_hint",
        F.when(F.col("_full"), F.col("_text")).otherwise(F.lit("")).alias("fetched_jd"),
        F.when(F.col("_full"), F.lit("")).otherwise(F.col("_text")).alias("email_jd_text"),
        F.when(F.col("_full"), F.lit("full")).otherwise(F.lit("title_only")).alias("jd_source"))
