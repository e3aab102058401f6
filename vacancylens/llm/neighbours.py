"""Approximate nearest neighbours by collision counting over sorted single projections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacancylens.llm.common import saved, ship
from vacancylens.llm.vectors import TILE_QUERIES, finite, matrix, tiles

K = 10
PROJECTIONS = 64
WIDTH = 2.719
THRESHOLD = 0.66
GROWTH = 1.5
RANGE_ROWS = 4096
SAMPLE = 4096
SEED = 9


def _projections(width: int, count: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, count))


def near_in_range(query_rows, queries, limits, rows, ids, vectors, k: int = K, projections: int = PROJECTIONS):
    """(query place, candidate id, distance) arrays: the k nearest found of a range for each query.

    Each projection holds the range's rows in sorted order. A window around the query's own projection is `WIDTH` times
    the radius wide; rows inside count a collision, and rows with collisions in `THRESHOLD` of the projections are
    verified by their distance. Virtual rehashing widens the windows by `GROWTH` until the kth distance lies within the
    radius or the radius reaches the query's limit, a distance within which k rows are known; without a limit every
    row is verified.
    """
    directions = _projections(vectors.shape[1], projections)
    placed, asked = vectors @ directions, queries @ directions
    order = np.argsort(placed, axis=0, kind="stable")
    lines = np.take_along_axis(placed, order, 0)
    need = int(np.ceil(THRESHOLD * projections))
    slack = 1e-9 * (1 + np.abs(placed).max(initial=0))
    active = np.arange(len(queries))
    radius = np.where(np.isfinite(limits), limits / GROWTH**4, np.inf)
    results: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    while len(active):
        half = radius[active] * WIDTH / 2 + slack
        low = np.stack([np.searchsorted(lines[:, i], asked[active, i] - half, "left") for i in range(projections)], 1)
        high = np.stack([np.searchsorted(lines[:, i], asked[active, i] + half, "right") for i in range(projections)], 1)
        going = []
        for n, q in enumerate(active):
            hits = np.bincount(np.concatenate([order[a:b, i] for i, (a, b) in enumerate(zip(low[n], high[n]))]), minlength=len(rows))
            near = np.flatnonzero((hits >= need) & (rows != query_rows[q]))
            distance = np.sqrt(((vectors[near] - queries[q]) ** 2).sum(1))
            best = np.lexsort((ids[near], distance))[:k]
            results[q] = ids[near[best]], distance[best]
            done = radius[q] >= limits[q] or (len(best) == k and distance[best[-1]] <= radius[q])
            if not done:
                going.append(q)
        active = np.array(going, np.int64)
        radius[active] = np.minimum(radius[active] * GROWTH, limits[active])
    at = np.concatenate([np.full(len(i), q) for q, (i, _) in results.items()]) if results else np.zeros(0, np.int64)
    found = np.concatenate([i for i, _ in results.values()]) if results else np.zeros(0, np.int64)
    distance = np.concatenate([d for _, d in results.values()]) if results else np.zeros(0)
    keep = distance <= limits[at]
    return at[keep], found[keep], distance[keep]


def search(table: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, every: int = 100) -> DataFrame:
    """(query_id, rank, key, score): the k nearest rows found by Euclidean distance, ties to smaller keys.

    Queries are the rows whose key is divisible by `every`; candidates are all rows but the query's own. Vectors that are
    null, zero, or hold a null or non-finite component take no part, nor do rows with a null key. Shorter vectors are
    filled up with zeros. Rows that share a key are queries and candidates of their own. An empty table, or one
    without queries, gives an empty result. Other columns are not read. `score` is the distance of the original vectors.

    Every row is indexed: rows are dealt by a hash to ranges of bounded size, each with its own sorted projections, and a
    range meets each group of queries in one task. A first pass over a bounded number of rows gives every query a distance
    within which k rows lie; no window has to grow beyond it.
    """
    ship(table.sparkSession)
    kind = table.schema[key].dataType
    doubles = F.col(vector).cast("array<double>")
    rows = table.filter(F.col(key).isNotNull() & finite(doubles) & F.exists(doubles, lambda x: x != 0)).select(
        F.col(key).cast("long").alias("id"), doubles.alias("vector"))
    rows = saved(rows, "near-rows").withColumn("row", F.monotonically_increasing_id())
    sizes = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("id") % every == 0).alias("queries")).first()
    ranges, groups = max(1, -(-sizes["rows"] // RANGE_ROWS)), max(1, -(-sizes["queries"] // TILE_QUERIES))
    placed = rows.withColumn("part", F.pmod(F.xxhash64("row", F.lit(SEED)), F.lit(ranges))).withColumn("block", F.lit(0).cast("long"))
    queries = rows.filter(F.col("id") % every == 0)

    def run(tile: pa.Table) -> pa.Table:
        role = tile["role"].to_numpy(zero_copy_only=False)
        q, c = tile.filter(pa.array(role)), tile.filter(pa.array(~role))
        at, ids, distance, q_rows, q_ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(q) and len(c):
            wide = max(matrix(q["vector"]).shape[1], matrix(c["vector"]).shape[1])
            limits = q["bound"].to_numpy(zero_copy_only=False)
            q_rows, q_ids = q["row"].to_numpy(), q["id"].to_numpy()
            at, ids, distance = near_in_range(q_rows, matrix(q["vector"], wide), np.where(np.isnan(limits), np.inf, limits),
                                              c["row"].to_numpy(), c["id"].to_numpy(), matrix(c["vector"], wide), k)
        return pa.table({"query_row": pa.array(q_rows[at], pa.int64()), "query_id": pa.array(q_ids[at], pa.int64()),
                         "id": pa.array(ids, pa.int64()), "score": pa.array(distance, pa.float64())})

    def scored(candidates: DataFrame, asked: DataFrame, parts: int) -> DataFrame:
        return tiles(candidates, asked, parts, groups).groupBy("part", "group").applyInArrow(run, "query_row long, query_id long, id long, score double")

    best = Window.partitionBy("query_row").orderBy("score", "id")
    sample = placed.orderBy(F.xxhash64("row", F.lit(SEED + 1))).limit(SAMPLE).withColumn("part", F.lit(0).cast("long"))
    limits = scored(sample, queries.withColumn("bound", F.lit(None).cast("double")), 1).withColumn(
        "rank", F.row_number().over(best)).filter(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("bound"))
    asked = saved(queries.join(limits, "row", "left").select("row", "id", "bound", "vector"), "near-queries")
    return scored(placed, asked, ranges).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        F.col("query_id").cast(kind).alias("query_id"), "rank", F.col("id").cast(kind).alias(key), "score")
