"""Exact set-similarity self-join by prefix filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancylens.session import cut


def similar_pairs(sets: DataFrame, threshold: float, measure: str = "jaccard", key: str = "id", tokens: str = "tokens",
                  apart: str | None = None) -> DataFrame:
    """All pairs of sets at or above a threshold: (a, b, shared, size_a, size_b, score), each pair once.

    `sets` has one row per key and a distinct token array. Tokens are ordered by how many sets hold them, rarest
    first. A set needs only its first n - ceil(t*n) + 1 tokens in the index: two similar sets must share one of those.
    Tokens held by a single set count for the prefix but never reach the join, so sets that resemble nothing drop out
    before it. Frequent tokens stand last and fall outside most prefixes; what skew remains is a plain equi-join on a
    token, which adaptive execution splits. `apart` names a column that must differ within a pair.

    measure: `jaccard` |A∩B|/|A∪B|, `overlap` |A∩B|/min(|A|,|B|).
    """
    if measure not in ("jaccard", "overlap"):
        raise ValueError(f"unknown measure {measure!r}")
    extra = [] if apart is None else [apart]
    # Empty sets drop out after `explode_outer`: a test of the array itself, asked for or inferred from `explode`, would be
    # pushed down to where the tokens are made and work them out a second time.
    base = sets.select(key, *extra, tokens, F.size(tokens).alias("n"))
    long = base.select(key, *extra, "n", F.explode_outer(tokens).alias("token")).filter(F.col("token").isNotNull())
    common = long.groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df") > 1)
    # One array per set, no longer than the set itself, holding only tokens that some other set holds too. It is read
    # four times below, so it is written once.
    ranked = cut(long.join(common, "token").groupBy(key, *extra, "n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("ranked")))
    needed = F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9))
    unique = F.col("n") - F.size("ranked")
    prefix = F.greatest(F.col("n") - needed + 1 - unique, F.lit(0)).cast("int")

    def side(name: str, part) -> DataFrame:
        return ranked.select(
            F.col(key).alias(name), F.col("n").alias(f"n_{name}"), *[F.col(c).alias(f"{c}_{name}") for c in extra],
            F.explode(part).alias("token"))

    short = side("s", F.slice("ranked", F.lit(1), prefix))
    other = side("l", F.slice("ranked", F.lit(1), prefix) if measure == "jaccard" else F.col("ranked"))
    ordered = (F.col("n_s") < F.col("n_l")) | ((F.col("n_s") == F.col("n_l")) & (F.col("s") < F.col("l")))
    fits = F.col("n_s") >= F.lit(threshold) * F.col("n_l") - F.lit(1e-9) if measure == "jaccard" else F.lit(True)
    differ = F.lit(True) if apart is None else F.col(f"{apart}_s") != F.col(f"{apart}_l")
    candidates = short.join(other, "token").filter(ordered & fits & differ).select("s", "l").distinct()

    left = ranked.select(F.col(key).alias("s"), F.col("n").alias("n_s"), F.col("ranked").alias("ranked_s"))
    right = ranked.select(F.col(key).alias("l"), F.col("n").alias("n_l"), F.col("ranked").alias("ranked_l"))
    both = candidates.join(left, "s").join(right, "l").withColumn("shared", F.size(F.array_intersect("ranked_s", "ranked_l")))
    base_size = (F.col("n_s") + F.col("n_l") - F.col("shared")) if measure == "jaccard" else F.least("n_s", "n_l")
    score = F.col("shared") / base_size
    swap = F.col("s") > F.col("l")

    def pick(x: str, y: str):
        return F.when(swap, F.col(y)).otherwise(F.col(x))

    return both.withColumn("score", score).filter(F.col("score") >= F.lit(threshold) - F.lit(1e-12)).select(
        pick("s", "l").alias("a"), pick("l", "s").alias("b"), "shared", pick("n_s", "n_l").alias("size_a"),
        pick("n_l", "n_s").alias("size_b"), "score")
