"""Date columns: tolerant parsing, epochs, run-id dates, spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacancylens.functions.text import blank, col


def iso_timestamp(c: Column | str) -> Column:
    """ISO date-time; no zone means the session's (UTC), bad text is null."""
    text = F.trim(blank(c))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))


def epoch_millis(c: Column | str) -> Column:
    return F.timestamp_millis(col(c).try_cast("bigint"))


def epoch_seconds(c: Column | str) -> Column:
    return F.timestamp_seconds(col(c).try_cast("bigint"))


def day_prefix(c: Column | str) -> Column:
    """Date in the first ten characters, null where they are no date."""
    head = F.substring(F.trim(blank(c)), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def run_date(run: Column | str) -> Column:
    """Date at the start of a run id."""
    head = F.regexp_extract(blank(run), r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.when(head != "", F.try_to_date(head, "yyyy-MM-dd"))


def inclusive_days(first: Column | str, last: Column | str) -> Column:
    """Days from first to last counting both ends; a bad date gives 0."""
    return F.coalesce(F.datediff(day_prefix(last), day_prefix(first)) + 1, F.lit(0))


def in_window(posted: Column | str, since: Column) -> Column:
    """Freshness test that keeps undated rows."""
    return col(posted).isNull() | since.isNull() | (col(posted) >= since)
