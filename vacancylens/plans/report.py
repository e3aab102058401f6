"""The market report as one long table, with a row for everything that is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.operators.bands import STATS, band_flags
from vacancylens.plans.retrospective import Retrospective

NO_RATE = "no posting in this slice stated a rate"
NO_BAND = "returned no data this run — this anchor is missing, not zero"
NO_TERMS = "nothing to cluster"


def _rows(df: DataFrame, part: str, section: Column, item: Column, measures: list[str], n: Column, total: Column,
          caveat: Column, note: Column | None = None) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in measures])
    return df.select(
        F.lit(part).alias("part"), section.alias("section"), item.alias("item"), F.explode(pairs).alias("m"),
        n.cast("bigint").alias("n"), total.cast("bigint").alias("total"), caveat.alias("caveat"),
        (F.lit("") if note is None else note).alias("note")).select(
        "part", "section", "item", "m.metric", "m.value", "n", "total", "caveat", "note")


def rate_rows(rates: DataFrame) -> DataFrame:
    """Six figures per scope; a scope without a rate keeps one row that says so."""
    inbox = F.lit(fixed.INBOX_CAVEAT)
    stated = _rows(rates.filter("n > 0"), "inbox", F.lit("rate reality"), F.col("scope"), list(STATS), F.col("n"), F.col("total"), inbox)
    gap = rates.filter("n = 0").select(
        F.lit("inbox").alias("part"), F.lit("rate reality").alias("section"), F.col("scope").alias("item"), F.lit("gap").alias("metric"),
        F.lit(None).cast("double").alias("value"), F.col("n").cast("bigint").alias("n"), F.col("total").cast("bigint").alias("total"),
        inbox.alias("caveat"), F.lit(NO_RATE).alias("note"))
    return stated.unionByName(gap)


def band_rows(bands: DataFrame, expected: DataFrame) -> DataFrame:
    """Band figures per source; an expected source without a band keeps a gap row. expected(source) is the registry."""
    found = _rows(bands, "baseline", F.col("source"), F.col("occupation"), list(STATS), F.col("n"), F.col("n"), F.col("caveat"),
                  F.array_join(band_flags(), "; ")).filter(F.col("value").isNotNull())
    missing = expected.join(bands.select("source").distinct(), "source", "left_anti").select(
        F.lit("baseline").alias("part"), F.col("source").alias("section"), F.lit("").alias("item"), F.lit("gap").alias("metric"),
        F.lit(None).cast("double").alias("value"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("total"),
        F.lit("").alias("caveat"), F.lit(NO_BAND).alias("note"))
    return found.unionByName(missing)


SECTIONS = ("split employment_type", "split cadence", "terms resume_keywords", "terms red_flags", "employers direct", "employers agency")


def gap_rows(rows: DataFrame, sections: Sequence[str]) -> DataFrame:
    """One row for every expected section of the inbox that has none: nothing to cluster is not the same as no section."""
    wanted = rows.sparkSession.createDataFrame([(s,) for s in sections], "section string")
    return wanted.join(rows.select("section").distinct(), "section", "left_anti").select(
        F.lit("inbox").alias("part"), "section", F.lit("").alias("item"), F.lit("gap").alias("metric"), F.lit(None).cast("double").alias("value"),
        F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("total"), F.lit(fixed.INBOX_CAVEAT).alias("caveat"), F.lit(NO_TERMS).alias("note"))


def report(r: Retrospective, bands: DataFrame, expected: DataFrame, sections: Sequence[str] = SECTIONS) -> DataFrame:
    """All sections: rates, splits, terms, employers, bands, and a gap row for every one of them that is empty."""
    inbox = F.lit(fixed.INBOX_CAVEAT)
    splits = _rows(r.splits, "inbox", F.concat(F.lit("split "), "field"), F.col("label"), ["n", "share"], F.col("n"), F.col("n"), inbox)
    terms = _rows(r.terms, "inbox", F.concat(F.lit("terms "), "field"), F.col("label"), ["total", "spellings"],
                  F.col("contributing"), F.col("postings"), inbox, F.concat(F.lit("top "), F.col("place").cast("string"), F.lit(" of "), F.col("all_clusters").cast("string")))
    employers = _rows(r.employers, "inbox", F.when(F.col("is_agency"), F.lit("employers agency")).otherwise(F.lit("employers direct")),
                      F.col("name"), ["n", "spellings"], F.col("n"), F.col("n"), inbox)
    found = splits.unionByName(terms).unionByName(employers)
    return rate_rows(r.rates).unionByName(found).unionByName(gap_rows(found, sections)).unionByName(band_rows(bands, expected))


def write_report(table: DataFrame, as_of: str, path: str) -> None:
    """Rewrites the report of its own date and leaves the other dates."""
    table.withColumn("as_of", F.lit(as_of)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(path)
