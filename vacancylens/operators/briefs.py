"""Cached entity briefs: upsert under the company's key, alias rows, answers section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.functions.identity import cache_key
from vacancylens.functions.text import blank, either, strip


def brief_rows(briefs: DataFrame, today: str) -> DataFrame:
    """Cache rows of new briefs: the brief under its company's key, and an alias where it was asked for under another.

    briefs(company, target, researched, markdown).
    """
    keyed = briefs.withColumn("key", cache_key(either("company", "target"))).withColumn("asked", cache_key(either("target", "company")))
    stamp = either("researched", F.lit(today))
    own = keyed.select("key", F.lit("").alias("alias"), blank("company").alias("company"), either("target", "company").alias("target"),
                       stamp.alias("researched"), blank("markdown").alias("markdown"))
    alias = keyed.filter("asked <> key").select(
        F.col("asked").alias("key"), F.col("key").alias("alias"), F.lit("").alias("company"), blank("target").alias("target"),
        stamp.alias("researched"), F.lit("").alias("markdown"))
    return own.unionByName(alias)


def upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Next version of the cache; the later row of a key wins, a fresh one over an old one."""
    both = cache.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)), allowMissingColumns=True)
    newest = Window.partitionBy("key").orderBy(F.desc("_fresh"), F.desc("researched"), F.col("alias"), F.col("markdown"))
    return both.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") == 1).drop("_n", "_fresh")


def with_answers(markdown: Column | str, answers: Column | str, today: str) -> Column:
    """The brief with its answers section replaced; blank answers change nothing."""
    text, body = blank(markdown), strip(blank(answers))
    before = F.rtrim(F.split_part(text, F.lit(fixed.ANSWERS_HEADING), F.lit(1)), F.lit(" \t\n\r"))
    section = F.concat(before, F.lit(f"\n\n{fixed.ANSWERS_HEADING} ({today}, from its own web search)\n\n"), body, F.lit("\n"))
    return F.when(body == "", text).otherwise(section)
