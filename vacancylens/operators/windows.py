"""Row choice: first wins, latest run wins, caps per source, usable rows, term filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.functions.identity import composite_id
from vacancylens.functions.links import legacy_link_key, link_identity, normalize_link
from vacancylens.functions.text import UNICODE_NOCASE, blank, col, either
from vacancylens.session import cut


def _first_in_order(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """One row per key. The rank limit also runs before the shuffle, so a hot key sends one row per task."""
    ranked = df.withColumn("_key", key)
    nth = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    return ranked.withColumn("_nth", nth).filter(F.col("_nth") == 1).drop("_key", "_nth")


def dedup_key(link: Column | str = "link", posting_id: Column | str = "id", legacy: bool = False) -> Column:
    """Key of a candidate: its canonical link, else its id.

    `legacy` drops the whole query of the link instead, which merges every posting whose id is a parameter.
    """
    by_link = legacy_link_key(link) if legacy else link_identity(link)
    return either(by_link, posting_id)


def first_wins(df: DataFrame, rank: str = "channel_rank", ord_col: str = "ord", legacy: bool = False) -> DataFrame:
    """Candidates deduplicated across channels: lowest channel rank, then input order."""
    return _first_in_order(df, dedup_key(legacy=legacy), F.col(rank), F.col(ord_col))


def posting_key() -> Column:
    """Key of a posting across runs: its normalised link, else company and title."""
    return either(normalize_link(F.trim(blank("link"))), composite_id("company", "title"))


def latest_run(df: DataFrame, run: str = "run", ord_col: str = "ord", key: Column | None = None) -> DataFrame:
    """One row per posting; the last run that saw it wins."""
    return _first_in_order(df, posting_key() if key is None else key, F.col(run).desc(), F.col(ord_col).desc())


def newest_per_key(df: DataFrame, key: str, run: str = "run", ord_col: str = "ord") -> DataFrame:
    """One row per key, from its latest run. Run this before an upsert: two runs of one key would flip it."""
    return _first_in_order(df, F.col(key), F.col(run).desc(), F.col(ord_col).desc())


def first_per_key(df: DataFrame, key: str, ord_col: str = "ord") -> DataFrame:
    return _first_in_order(df, F.col(key), F.col(ord_col))


def cap_per_source(df: DataFrame, cap: int, source: str = "source", posted: str = "posted", ord_col: str = "ord") -> DataFrame:
    """Newest `cap` rows of each source, undated rows last."""
    order = Window.partitionBy(source).orderBy(F.col(posted).desc_nulls_last(), ord_col)
    return df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= cap)


def ranked_within(df: DataFrame, groups: Sequence[str], order: Column, position: str = "position") -> DataFrame:
    """Adds the position of each row inside its group, for groups of any size. `order` must be distinct in a group.

    Rows are range-partitioned by group and order; positions inside a partition plus the counts of the partitions before
    it give the rank. No task holds more than one range, even where one group is a third of the table.
    """
    keys = list(groups)
    placed = cut(df.withColumn("_order", order).repartitionByRange(*keys, "_order").withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_range", *keys).orderBy("_order"))
    return placed.join(offsets, [*keys, "_range"]).withColumn(position, (local + F.col("_before")).cast("bigint")).drop(
        "_order", "_range", "_before")


def usable(df: DataFrame, link: str = "link", title: str = "title") -> DataFrame:
    return df.filter((F.length(blank(link)) > 0) & (F.length(blank(title)) > 0))


def matching_terms(df: DataFrame, text: str, terms_by_source: Mapping[str, Sequence[str]], source: str = "source") -> DataFrame:
    """One row per row and listed term of its source that the text contains; the lists are fixed and short."""
    low = F.lower(blank(text))
    tests = [F.when((F.col(source) == name) & low.contains(term), F.lit(term))
             for name, terms in terms_by_source.items() for term in terms]
    return df.withColumn("term", F.explode(F.array_compact(F.array(*tests))))


def is_developer_role(text: Column | str, source: Column | str) -> Column:
    """Does a slug or title carry one of its source's developer terms?"""
    low, test = F.lower(blank(text)), F.lit(False)
    for name, terms in fixed.DEV_TERMS.items():
        for term in terms:
            test = test | ((col(source) == name) & low.contains(term))
    return test


def is_attributed(source: Column | str, text: Column | str) -> Column:
    """Rows of a source under an attribution duty carry its line; other rows pass."""
    owed = F.coalesce(*[F.when(col(source) == name, F.lit(line)) for name, line in fixed.ATTRIBUTION.items()])
    return owed.isNull() | blank(text).contains(owed)


def forbidden_hits(df: DataFrame, text: str, rules: Sequence[tuple[str, str, str, bool]], is_prose: Column) -> DataFrame:
    """One row per document and firing rule. A rule is (name, pattern, why, prose only)."""
    tests = []
    for name, pattern, why, prose_only in rules:
        hit = F.col(text).rlike(UNICODE_NOCASE + pattern)
        tests.append(F.when(hit & is_prose if prose_only else hit, F.struct(F.lit(name).alias("rule"), F.lit(why).alias("why"))))
    hits = df.withColumn("_hit", F.explode(F.array_compact(F.array(*tests))))
    return hits.select("*", "_hit.rule", "_hit.why").drop("_hit")
