"""Dated snapshots of the measures, and the trend that is only claimed over enough of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.functions.dates import inclusive_days
from vacancylens.functions.text import blank
from vacancylens.plans.retrospective import Retrospective, metrics


def snapshot(r: Retrospective, as_of: str, rubric: Column | str) -> DataFrame:
    """One row: window figures, metric map, top terms per field. The maps are as long as the metric and term lists."""
    figures = metrics(r).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metrics"))
    top = r.terms.filter(F.col("place") <= fixed.SNAPSHOT_TERMS).groupBy("field").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "total"))).alias("m"))
    terms = top.agg(F.map_from_entries(F.collect_list(F.struct("field", "m"))).alias("terms"))
    stamp = [F.lit(fixed.SNAPSHOT_VERSION).alias("version"), F.lit(as_of).alias("as_of"),
             (F.lit(rubric) if isinstance(rubric, str) else rubric).alias("rubric")]
    return r.window.select(*stamp, "postings", "jd_read", "runs", F.col("first_day").alias("first_run"),
                           F.col("last_day").alias("last_run"), F.col("days").alias("window_days")).crossJoin(figures).crossJoin(terms)


def write_snapshot(snap: DataFrame, path: str) -> None:
    """Rewrites the snapshot of its own date and leaves the other dates."""
    snap.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(path)


def trend(snaps: DataFrame, by: Sequence[str] = (), min_snapshots: int = fixed.MIN_SNAPSHOTS, min_days: int = fixed.MIN_DAYS,
          listed: Sequence[tuple[str, str, str]] = fixed.TREND_METRICS) -> DataFrame:
    """First against last snapshot of the newest rubric; a status row always, metric rows only behind the gate.

    snaps(as_of, rubric, metrics) with optional history columns `by`. Columns: by, ok, reason, snapshots, days, first,
    last, excluded, rubrics, place, label, kind, first_value, last_value; the status row has place 0.
    """
    one = snaps.withColumn("_all", F.lit(1))
    keys = list(by) or ["_all"]
    dated = one.filter(blank("as_of") != "")
    known = blank("rubric") != ""
    heads = dated.groupBy(*keys).agg(
        F.count("*").alias("total"), F.max_by(F.when(known, F.col("rubric")), F.when(known, F.col("as_of"))).alias("current"),
        F.count_distinct(F.when(known, F.col("rubric"))).alias("rubrics"))
    if not by:
        # An empty history still answers.
        empty = one.sparkSession.range(1).select(F.lit(1).alias("_all"))
        heads = empty.join(heads, "_all", "left").withColumn("total", F.coalesce("total", F.lit(0))).withColumn(
            "rubrics", F.coalesce("rubrics", F.lit(0)))
    ends = dated.join(heads.select(*keys, "current"), keys).filter(F.col("rubric") == F.col("current")).groupBy(*keys).agg(
        F.count("*").alias("snapshots"), F.min("as_of").alias("first"), F.max("as_of").alias("last"),
        F.min_by("metrics", "as_of").alias("first_metrics"), F.max_by("metrics", "as_of").alias("last_metrics"))
    status = heads.join(ends, keys, "left").withColumn("snapshots", F.coalesce("snapshots", F.lit(0))).withColumn(
        "days", F.when(F.col("snapshots") > 0, inclusive_days("first", "last")).otherwise(F.lit(0)))
    ok = (F.col("snapshots") >= min_snapshots) & (F.col("days") >= min_days)
    need = f"; a trend needs at least {min_snapshots} of one rubric over {min_days} days"
    reason = (
        F.when(ok, F.lit(""))
        .when(F.col("snapshots") == 0, F.concat(F.lit("no comparable snapshots, "), F.col("total").cast("string"), F.lit(" without a rubric" + need)))
        .otherwise(F.concat(F.col("snapshots").cast("string"), F.lit(" comparable snapshots over "), F.col("days").cast("string"), F.lit(" days"), F.lit(need)))
    )
    excluded = F.col("total") - F.col("snapshots")
    judged = status.select(*keys, ok.alias("ok"), reason.alias("reason"), "snapshots", "days", "first", "last",
                           excluded.alias("excluded"), "rubrics", "first_metrics", "last_metrics")
    entries = [F.struct(F.lit(0).alias("place"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("kind"),
                        F.lit(None).cast("double").alias("first_value"), F.lit(None).cast("double").alias("last_value"))]
    for i, (key, label, kind) in enumerate(listed, 1):
        a, b = F.try_element_at("first_metrics", F.lit(key)), F.try_element_at("last_metrics", F.lit(key))
        entries.append(F.when(F.col("ok") & a.isNotNull() & b.isNotNull(), F.struct(
            F.lit(i).alias("place"), F.lit(label).alias("label"), F.lit(kind).alias("kind"), a.alias("first_value"), b.alias("last_value"))))
    rows = judged.withColumn("m", F.explode(F.array_compact(F.array(*entries)))).drop("first_metrics", "last_metrics")
    return rows.select("*", "m.*").drop("m", "_all")


def change_text(kind: Column | str = "kind", first: Column | str = "first_value", last: Column | str = "last_value") -> Column:
    """Signed change of a metric: shares in points, hourly rates to the cent, counts whole."""
    k, a, b = (F.col(c) if isinstance(c, str) else c for c in (kind, first, last))
    points = F.rint((b - a) * 100)
    whole = F.rint(b - a)

    def signed(value: Column, digits: int) -> Column:
        return F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("+")), F.format_number(F.abs(value), digits))

    return (F.when(k == "share", F.concat(signed(points, 0), F.lit(" pts")))
            .when(k == "hourly", signed(F.bround(b - a, 2), 2)).otherwise(signed(whole, 0)))
