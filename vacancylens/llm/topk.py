"""Exact top-k search by integer inner product, with block-at-a-time pruning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacancylens.llm.common import saved, ship
from vacancylens.llm.vectors import TILE_QUERIES, finite, matrix, tiles

K = 5
BLOCK = 256
RANGE_BLOCKS = 16
PIVOTS = 64
FITS = 2.0**62
SAMPLE = 4096
EXACT = float(1 << 52)


def exact(queries: np.ndarray, rows: np.ndarray) -> bool:
    """Whether doubles hold every inner product of the two exactly."""
    return np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, queries.shape[1]) < EXACT


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued rows: in doubles where they stay exact, else in whole numbers of any size."""
    if exact(queries, rows):
        return queries @ rows.T
    whole = np.vectorize(int, otypes=[object])
    return whole(queries).dot(whole(rows).T)


def best_of_range(query_rows, query_ids, queries, floors, rows, ids, blocks, vectors, k: int = K):
    """The k best rows of a range for each query, as (query place, candidate id, score) arrays, and the share of scored pairs.

    Blocks are bounded by the sum over components of the query's weight times the block's maximum, or its minimum under a
    negative weight. Each query takes blocks from the highest bound down and stops where the bound falls below its kth
    score or its `floors`, a score that k rows are known to reach. A query's own row, by row number, does not count.
    """
    order = np.lexsort((rows, ids, blocks))
    rows, ids, vectors, blocks = rows[order], ids[order], vectors[order], blocks[order]
    starts = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1])))
    ends = np.concatenate((starts[1:], [len(rows)]))
    top, low = np.maximum.reduceat(vectors, starts, axis=0), np.minimum.reduceat(vectors, starts, axis=0)
    bounds = np.maximum(queries, 0) @ top.T + np.minimum(queries, 0) @ low.T
    turn = np.argsort(-bounds, axis=1, kind="stable")
    nq = len(queries)
    score = np.full((nq, k), -np.inf, dtype=float if exact(queries, vectors) else object)
    found = np.full((nq, k), np.iinfo(np.int64).max)
    least = floors.astype(float).copy()
    scored = 0
    for step in range(len(starts)):
        b = turn[:, step]
        bound = bounds[np.arange(nq), b]
        open_queries = np.flatnonzero(bound + 1e-12 * np.abs(bound) + 1e-9 >= least)
        if not len(open_queries):
            break
        for block in np.unique(b[open_queries]):
            who = open_queries[b[open_queries] == block]
            part = slice(starts[block], ends[block])
            s = products(queries[who], vectors[part])
            s = s.astype(score.dtype)
            s[query_rows[who][:, None] == rows[part][None, :]] = -np.inf
            scored += s.size
            here = np.argsort(-s, axis=1, kind="stable")[:, :k]
            all_s = np.concatenate((score[who], np.take_along_axis(s, here, 1)), 1)
            all_i = np.concatenate((found[who], ids[part][here]), 1)
            for i, w in enumerate(who):
                best = np.lexsort((all_i[i], -all_s[i].astype(float)))[:k] if all_s.dtype != object else sorted(range(all_s.shape[1]), key=lambda j: (-all_s[i, j], all_i[i, j]))[:k]
                score[w], found[w] = all_s[i, best], all_i[i, best]
            least[who] = np.maximum(least[who], score[who, k - 1].astype(float))
    hit = (score > -np.inf) & (score.astype(float) >= floors[:, None])
    at, rank = np.nonzero(hit)
    return at, found[at, rank], score[at, rank], scored / max(1, nq * len(rows))


def search(table: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, every: int = 50, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, key, score): the k rows with the highest inner product of floor(scale * x), ties to smaller keys.

    Queries are the rows whose key is divisible by `every`; candidates are all rows but the query's own. Vectors that are
    null or hold a null or non-finite component take no part, nor do rows with a null key, nor vectors whose integer form
    has a squared length of 2^62 or more, as their products need not fit a long. Vectors of unlike length
    are filled up with zeros. Rows that share a key are queries and candidates of their own. An empty table, or one
    without queries, gives an empty result. Other columns are not read.

    Rows lie in cells by their nearest of at most 64 pivots, so that a block's components lie close together and its bound
    is tight. A cell is cut into blocks by a hash, ranges hold a fixed number of blocks, and each range meets each
    group of queries in a task of bounded size. A first pass over a bounded number of rows only gives every query a score
    that k rows reach, which later passes use as a floor; results do not depend on it.
    """
    spark = table.sparkSession
    ship(table.sparkSession)
    kind = table.schema[key].dataType
    rows = table.filter(F.col(key).isNotNull() & finite(F.col(vector).cast("array<double>"))).select(
        F.col(key).cast("long").alias("id"),
        F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(F.lit(scale) * x).cast("double")).alias("vector"))
    rows = rows.filter(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x) < FITS)
    rows = saved(rows, "topk-rows").withColumn("row", F.monotonically_increasing_id())
    pivots = [r["vector"] for r in rows.select("vector", F.xxhash64("id", "row").alias("h")).orderBy("h").limit(PIVOTS).collect()]
    width = max(map(len, pivots), default=0)
    corners = np.array([[*p, *[0.0] * (width - len(p))] for p in pivots]) if pivots else np.zeros((1, 0))

    def cell_of(batches):
        for batch in batches:
            x = matrix(batch.column("vector"), width)[:, :width]
            near = ((corners**2).sum(1)[None, :] - 2 * x @ corners.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=[*batch.schema.names, "cell"])

    placed = saved(rows.mapInArrow(cell_of, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])), "topk-cells")
    cells = sorted((r["cell"], -(-r["n"] // BLOCK)) for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect())
    base, total = [], 0
    for cell, n in cells:
        base.append((cell, n, total))
        total += n
    firsts = spark.createDataFrame(base, "cell int, blocks long, base long")
    ranges = max(1, -(-total // RANGE_BLOCKS))
    placed = placed.join(F.broadcast(firsts), "cell").withColumn("block", F.col("base") + F.pmod(F.xxhash64("row"), F.col("blocks")))
    placed = placed.withColumn("part", F.floor(F.col("block") / RANGE_BLOCKS))
    queries = placed.filter(F.col("id") % every == 0)
    groups = max(1, -(-queries.count() // TILE_QUERIES))

    def run(tile: pa.Table) -> pa.Table:
        role = tile["role"].to_numpy(zero_copy_only=False)
        q, c = tile.filter(pa.array(role)), tile.filter(pa.array(~role))
        cols = {n: pa.array([], t) for n, t in (("query_row", pa.int64()), ("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64()))}
        if len(q) and len(c):
            wide = max(matrix(q["vector"]).shape[1], matrix(c["vector"]).shape[1])
            floors = q["bound"].to_numpy(zero_copy_only=False)
            q_rows, q_ids = q["row"].to_numpy(), q["id"].to_numpy()
            at, ids, score, _ = best_of_range(q_rows, q_ids, matrix(q["vector"], wide), np.where(np.isnan(floors), -np.inf, floors),
                                              c["row"].to_numpy(), c["id"].to_numpy(), c["block"].to_numpy(), matrix(c["vector"], wide), k)
            cols = {"query_row": pa.array(q_rows[at]), "query_id": pa.array(q_ids[at]), "id": pa.array(ids), "score": pa.array([int(s) for s in score], pa.int64())}
        return pa.table(cols)

    def scored(candidates: DataFrame, asked: DataFrame, parts: int) -> DataFrame:
        both = tiles(candidates.select("row", "id", "part", "block", "vector"), asked.select("row", "id", "bound", "vector"), parts, groups)
        return both.groupBy("part", "group").applyInArrow(run, "query_row long, query_id long, id long, score long")

    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "id")
    sample = placed.orderBy(F.xxhash64("id", "row", F.lit(1))).limit(SAMPLE).withColumn("part", F.lit(0).cast("long"))
    floors = scored(sample, queries.withColumn("bound", F.lit(None).cast("double")), 1).withColumn(
        "rank", F.row_number().over(best)).filter(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").cast("double").alias("bound"))
    asked = saved(queries.join(floors, "row", "left").select("row", "id", "bound", "vector"), "topk-queries")
    return scored(placed, asked, ranges).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        F.col("query_id").cast(kind).alias("query_id"), "rank", F.col("id").cast(kind).alias(key), "score")


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as w from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) as bigint) as score
  from v q, v c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
"""
