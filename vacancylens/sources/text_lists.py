"""Hand-kept text files: link lists and skiplists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacancylens.functions.links import normalize_link
from vacancylens.functions.text import strip


def url_list(lines: DataFrame, cap: int | None = None, value: str = "value", ord_col: str = "ord") -> DataFrame:
    """Links of a list: comments off, non-links off, first of each normalised link, at most `cap` of them."""
    bare = F.btrim(strip(F.split_part(value, F.lit("#"), F.lit(1))), F.lit("<>\"'"))
    rows = lines.select(ord_col, bare.alias("url")).filter(F.lower("url").rlike("^https?://"))
    nth = F.row_number().over(Window.partitionBy(normalize_link("url")).orderBy(ord_col))
    first = rows.withColumn("_n", nth).filter(F.col("_n") == 1).drop("_n")
    return first if cap is None else first.orderBy(ord_col).limit(cap)


def skiplist_keys(files: DataFrame, text: str = "value") -> DataFrame:
    """Block keys of a skiplist: what stands before `#` on any line, where it holds a `|`."""
    lines = files.select(F.explode(F.split(text, r"\r\n|[\n\r]")).alias("line"))
    return lines.select(strip(F.split_part("line", F.lit("#"), F.lit(1))).alias("key")).filter(
        F.col("key").contains("|")).distinct()


def skiplist_rows(files: DataFrame, text: str = "value") -> DataFrame:
    """Skiplist entries with their note. Comment blocks open at a line's start and hide whole lines."""
    hidden = F.regexp_replace(text, r"(?s)(?m)^[ \t]*<!--.*?(-->[^\n]*|\z)", "")
    lines = files.select(F.explode(F.split(hidden, r"\r\n|[\n\r]")).alias("line"))
    job = strip(F.split_part("line", F.lit("#"), F.lit(1)))
    note = strip(F.regexp_extract("line", r"(?s)^[^#]*#(.*)$", 1))
    parts = F.split("job_id", r"\|")
    rows = lines.select(job.alias("job_id"), note.alias("reason")).filter(F.col("job_id").contains("|"))
    return rows.select("job_id", F.element_at(parts, 1).alias("company"), F.element_at(parts, 2).alias("title"), "reason")
