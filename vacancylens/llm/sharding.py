"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancylens.llm.common import saved, uniform

SHARDS = 24
SEED = 20_011
BLOCK_BITS = 15


def rendezvous(key: Column, weights: Sequence[float], seed: int = SEED) -> Column:
    """The shard of a key: every shard draws a number for the key, scaled by its weight, and the highest draw wins.

    With weight w and a uniform number u the draw is -w / ln(u), which wins with a chance in proportion to w. A key's
    draw on one shard does not depend on the others, so a further shard takes keys only into itself and a raised weight
    moves keys only towards it. Ties go to the smaller shard. A null key is a key like any other.
    """
    if not weights or min(weights) < 0 or not max(weights) > 0 or not all(map(math.isfinite, weights)):
        raise ValueError("shard weights must be finite, not negative, and one must be above zero")
    name = F.coalesce(key.cast("string"), F.lit("\u0000null"))
    draws = [
        F.struct((F.lit(float(w)) / -F.log((uniform(F.lit(seed), F.lit(i), name) + 2.0**-54))).alias("draw"), F.lit(-i).alias("i"))
        for i, w in enumerate(weights) if w > 0
    ]
    return (-F.array_max(F.array(*draws))["i"]).cast("int")


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, key: str = "doc_id", text: str = "text",
          grown_weights: Sequence[float] | None = None, seed: int = SEED) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard): where every record goes, and its gapless place there.

    `size` is the UTF-8 bytes of the text plus 8, and `grown_shard` the place under `grown_weights` (one more shard of
    weight 1 if not given). The key alone decides the shard. A null text has no bytes and the checksum of an empty
    text; a null key and repeated rows are records like any other; an empty table gives an empty result. Other
    columns are not read.

    Slots are counted in blocks of at most 2^15 records of the written narrow table: block counts are summed per shard
    and a record is only ranked inside its block, so that no task sees a whole shard.
    """
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    records = saved(docs.select(
        F.col(key).alias("key"),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body).alias("text_crc32"),
        rendezvous(F.col(key), weights, seed).alias("shard"),
        rendezvous(F.col(key), grown_weights or [*weights, 1.0], seed).alias("grown_shard"),
    ), "shard-records")
    placed = records.withColumn("row", F.monotonically_increasing_id()).withColumn("block", F.shiftright("row", BLOCK_BITS))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "block").agg(F.count("*").alias("n")).select(
        "shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("row"))
    return placed.join(starts, ["shard", "block"]).select(
        F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("start") + inside - 1).alias("slot"), "grown_shard")
