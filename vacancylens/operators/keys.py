"""Key tables: seen keys, block lists, applied records, late text, enrichment, aliases, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.functions.identity import composite_id
from vacancylens.functions.links import normalize_link, url_key
from vacancylens.functions.text import blank, either, filled, strip


def seen_keys(batch: DataFrame) -> DataFrame:
    """Distinct keys a scored batch leaves behind: ids, absorbed ids, link keys. Errored rows leave none."""
    absorbed = F.transform(F.coalesce("duplicates", F.array().cast("array<struct<id:string>>")), lambda d: d["id"])
    keys = F.array_compact(F.concat(F.array(F.col("id"), url_key("link")), absorbed))
    return batch.filter(~F.coalesce("analysis_errored", F.lit(False))).select(F.explode(keys).alias("key")).distinct()


def new_keys(keys: DataFrame, seen: DataFrame) -> DataFrame:
    """Keys not seen before. Null keys never match and never stay."""
    return keys.filter(F.col("key").isNotNull()).distinct().join(seen, "key", "left_anti")


def applied_records(rows: DataFrame) -> DataFrame:
    """Normalised applied rows: unknown confidence is low, keys are recomputed, empty rows drop."""
    level = F.lower(either("confidence", F.lit("high")))
    kept = rows.filter((blank("company") != "") | (blank("title") != "") | (blank("url") != ""))
    return kept.select(
        F.coalesce(F.col("row").cast("int"), F.lit(0)).alias("row"),
        *[blank(c).alias(c) for c in ("apply_date", "company", "title", "city", "url")],
        F.when(level.isin("high", "medium", "low"), level).otherwise(F.lit("low")).alias("confidence"),
        blank("note").alias("note"), composite_id("company", "title", "city").alias("composite_key"),
        F.coalesce(url_key("url"), F.lit("")).alias("url_key"))


def applied_keys(records: DataFrame) -> DataFrame:
    """Distinct block keys of the trusted applied records."""
    by_name = (F.col("title") != "") & ((F.col("company") != "") | (F.col("city") != ""))
    keys = F.array_compact(F.array(F.when(by_name, F.col("composite_key")), filled("url_key")))
    trusted = records.filter(F.col("confidence").isin("high", "medium"))
    return trusted.select(F.explode(keys).alias("key")).distinct()


def applied_summary(records: DataFrame) -> DataFrame:
    """One row: records, distinct block keys, auto-blocked and held counts."""
    trusted = F.col("confidence").isin("high", "medium")
    counts = records.agg(F.count("*").alias("records"), F.count_if(trusted).alias("auto_blocked"),
                         F.count_if(~trusted).alias("held_for_review"))
    keys = applied_keys(records).agg(F.count("*").alias("block_keys"))
    return counts.crossJoin(keys)  # one row by one row


def blocked_keys(*tables: DataFrame) -> DataFrame:
    """Union of key tables, each with a `key` column."""
    out = tables[0].select("key")
    for other in tables[1:]:
        out = out.unionByName(other.select("key"))
    return out.distinct()


def drop_blocked(df: DataFrame, blocked: DataFrame) -> DataFrame:
    """Rows whose id and link key are both free. Two anti joins: an OR would become a nested loop."""
    by_id = df.join(blocked.select(F.col("key").alias("id")), "id", "left_anti")
    keyed = by_id.withColumn("_url_key", url_key("link"))
    return keyed.join(blocked.select(F.col("key").alias("_url_key")), "_url_key", "left_anti").drop("_url_key")


def resolved_keys(candidates: DataFrame, resolved_ids: DataFrame, key: str = "link_key") -> DataFrame:
    """Keys of the candidates whose id is scored, absorbed or blocked."""
    return candidates.join(resolved_ids.select(F.col("key").alias("id")).distinct(), "id", "left_semi").select(key).distinct()


def merge_late_text(df: DataFrame, texts: DataFrame) -> DataFrame:
    """Posting texts that arrived later: long enough ones replace, errored rows are also due for scoring.

    texts(id, late_text), one row per id.
    """
    joined = df.join(texts, "id", "left")
    late = strip(F.col("late_text"))
    merged = F.coalesce(F.length(late) >= fixed.MIN_TEXT_CHARS, F.lit(False))
    return (joined.withColumn("rescore", merged | F.coalesce("analysis_errored", F.lit(False)))
            .withColumn("fetched_jd", F.when(merged, late).otherwise(F.col("fetched_jd")))
            .withColumn("jd_source", F.when(merged, F.lit("full")).otherwise(F.col("jd_source"))).drop("late_text"))


def hydrate(df: DataFrame, fields: DataFrame, default_platform: str = "email") -> DataFrame:
    """Fill company, title and platform of linked rows that lack one; fields present stay.

    fields(link, found_company, found_title, found_platform), one row per link.
    """
    bare = (blank("link") != "") & ((blank("company") == "") | (blank("title") == ""))
    # Complete rows get no join key, so they are not looked up.
    joined = df.withColumn("_k", F.when(bare, F.col("link"))).join(
        fields.withColumnRenamed("link", "_k"), "_k", "left")
    out = joined
    for name in ("company", "title"):
        out = out.withColumn(name, F.when(F.col("_k").isNotNull(), either(name, strip(blank(f"found_{name}")))).otherwise(F.col(name)))
    platform = either("source_platform", strip(blank("found_platform")), F.lit(default_platform))
    out = out.withColumn("source_platform", F.when(F.col("_k").isNotNull(), platform).otherwise(F.col("source_platform")))
    return out.drop("_k", "found_company", "found_title", "found_platform")


def resolve_alias(entries: DataFrame, probes: DataFrame) -> DataFrame:
    """Follow an entry's alias once; an alias to a missing entry is a miss.

    entries(key, alias, ...); probes(key).
    """
    hop = probes.join(entries.select("key", "alias"), "key").select(
        F.col("key").alias("asked"), either("alias", "key").alias("key"))
    return hop.join(entries.filter(blank("alias") == "").drop("alias"), "key")


def within_ttl(cache: DataFrame, probes: DataFrame, max_age: int = fixed.CACHE_TTL_DAYS, key: str = "key",
               at: str = "today", stamp: str = "researched") -> DataFrame:
    """Latest cached row of each probe not older than the limit and not from the future.

    probes(key, today). Days are cut into stretches of the limit's length and a probe looks into its own and the one
    before, so a hot key is spread over its stretches and never meets its whole history. Of several rows of one key and
    day, the one with the smallest hash of its values counts.
    """
    stretch = max_age + 1
    origin = F.lit("1970-01-01").cast("date")
    others = [c for c in cache.columns if c not in (key, stamp)]
    once = cache.select(key, stamp).distinct() if not others else cache.groupBy(key, stamp).agg(
        F.min_by(F.struct(*others), F.xxhash64(*others)).alias("_row")).select(key, stamp, "_row.*")
    kept = once.withColumn("_stretch", F.floor(F.datediff(F.col(stamp), origin) / stretch))
    own = F.floor(F.datediff(F.col(at), origin) / stretch)
    asked = probes.select(key, at).distinct().withColumn("_stretch", F.explode(F.array(own, own - 1)))
    hits = asked.join(kept, [key, "_stretch"]).withColumn("age_days", F.datediff(F.col(at), F.col(stamp)))
    hits = hits.filter(F.col("age_days").between(0, max_age)).drop("_stretch")
    latest = Window.partitionBy(key, at).orderBy(F.col(stamp).desc())
    return hits.withColumn("_n", F.row_number().over(latest)).filter(F.col("_n") == 1).drop("_n")


def link_novelty(df: DataFrame, page: str, order: str, link: Column) -> DataFrame:
    """Distinct links with the first page that shows them and that page's count of new links."""
    first = df.select(link.alias("link"), page, order).groupBy("link").agg(
        F.min(F.struct(F.col(page).alias("page"), F.col(order).alias("pos"))).alias("first"))
    return first.select("link", "first.page", "first.pos")
