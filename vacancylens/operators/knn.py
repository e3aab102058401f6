"""Nearest neighbours by cosine and diverse re-ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vacancylens import fixed
from vacancylens.session import cut, ship

# Numbers of one block, of queries or of corpus: bounds what a task holds, and how often a row is sent.
BLOCK_VALUES = 1 << 23
MAX_PIVOTS = 4096
SLICE = 256
TILE = 4096
SLACK = 1e-9


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _units(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    """The vectors at length one, in double precision; a zero vector stays zero."""
    m = _matrix(column, rows).astype(np.float64)
    length = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(length == 0, 1.0, length)


def _plain(df: DataFrame, vector: str) -> Column:
    """Vectors travel in the type they come in, which for counts and single precision is half as wide, and are scaled where they are used."""
    narrow = (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType)
    return F.col(vector) if isinstance(df.schema[vector].dataType.elementType, narrow) else F.col(vector).cast("array<double>")


def _distances(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (m * m).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2.0 * m @ centres.T))


@dataclass
class Cells:
    """What all tasks know: pivots, and per label and cell how many members there are and how far from the pivot.

    Label None stands for members of any label. Blocks are runs of cells that lie side by side, or shares of one large
    cell; `block` and `shares` give a cell's first block and into how many it is cut.
    """

    pivots: np.ndarray
    near: dict
    far: dict
    count: dict
    block: np.ndarray
    shares: np.ndarray

    def assign(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = _distances(m, self.pivots)
        cell = d.argmin(1)
        return cell, d[np.arange(len(m)), cell]

    def reach(self, d: np.ndarray, label: object, need: int) -> np.ndarray:
        """Within which distance each query surely has `need` members: whole cells, nearest far ends first."""
        if label not in self.count:
            return np.full(len(d), np.inf)
        ends = d + self.far[label][None, :]
        ends[:, self.count[label] == 0] = np.inf
        order = ends.argsort(axis=1)
        enough = np.cumsum(self.count[label][order], axis=1) >= need
        bound = np.where(enough.any(axis=1), np.take_along_axis(ends, order, 1)[np.arange(len(d)), enough.argmax(axis=1)], np.inf)
        # A zero vector has cosine 0 at distance 1, a unit vector at the square root of 2.
        return np.where(bound < 1.0, bound, np.maximum(bound, 2.0 ** 0.5))

    def may_hold(self, d: np.ndarray, label: object, bound: np.ndarray) -> np.ndarray:
        """Which cells can hold a member within each query's bound."""
        if label not in self.count:
            return np.zeros(d.shape, bool)
        least = np.maximum(d - self.far[label][None, :], self.near[label][None, :] - d)
        return (least <= bound[:, None] + SLACK) & (self.count[label] > 0)[None, :]


def _survey(placed: DataFrame, pivots: np.ndarray, block_rows: int) -> Cells:
    """Counts and radii per cell and label: at most pivots x labels rows come to the driver."""
    def spread(value: float) -> np.ndarray:
        return np.full(len(pivots), value)

    near, far, count = {None: spread(np.inf)}, {None: spread(-np.inf)}, {None: spread(0)}
    for r in placed.groupBy("cell", "label").agg(F.min("far").alias("lo"), F.max("far").alias("hi"), F.count("*").alias("n")).collect():
        for label in {None, r["label"]}:
            near.setdefault(label, spread(np.inf)), far.setdefault(label, spread(-np.inf)), count.setdefault(label, spread(0))
            near[label][r["cell"]] = min(near[label][r["cell"]], r["lo"])
            far[label][r["cell"]] = max(far[label][r["cell"]], r["hi"])
            count[label][r["cell"]] += r["n"]
    centred = pivots - pivots.mean(axis=0)
    along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0] if len(pivots) > 1 else np.zeros(1)
    block, shares = np.zeros(len(pivots), np.int64), np.ones(len(pivots), np.int64)
    at, held = 0, 0
    for cell in along.argsort(kind="stable"):
        n = int(count[None][cell])
        if held and held + n > block_rows:
            at, held = at + 1, 0
        block[cell], shares[cell] = at, max(1, -(-n // block_rows))
        at, held = (at + shares[cell], 0) if shares[cell] > 1 else (at, held + n)
    return Cells(pivots, near, far, count, block, shares)


def _top(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest entries of each row, ties to the smaller column, -inf left out; best first."""
    if sim.shape[1] > k:
        kth = -np.partition(-sim, k - 1, axis=1)[:, k - 1]
        row, column = np.nonzero((sim >= kth[:, None]) & (sim > -np.inf))
    else:
        row, column = np.nonzero(sim > -np.inf)
    order = np.lexsort((column, -sim[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _codes(*sides: list) -> list[np.ndarray]:
    """Values as numbers, equal where the values are; null is -1."""
    known: dict = {}
    return [np.array([-1 if x is None else known.setdefault(x, len(known)) for x in side], np.int64) for side in sides]


def _best(a: np.ndarray, b: np.ndarray, low: np.ndarray, k: int, barred) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, similarity) of the k best columns of b per row of a at or above its floor `low`, ties to the smaller column.

    Single precision rules out what lies under the k-th best so far by more than its error; the rest is computed in
    double precision. barred(rows, columns) marks pairs that may not meet.
    """
    margin = np.float32(2e-7 * a.shape[1] + 1e-6)
    a32, low = a.astype(np.float32), low.copy()
    row, column, sim = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for at in range(0, len(b), TILE):
        tile = b[at:at + TILE]
        rough = a32 @ tile.astype(np.float32).T
        floor = low.astype(np.float32)
        fresh = np.flatnonzero(np.isneginf(low))
        if len(fresh):
            part = rough[fresh]
            part[barred(fresh[:, None], np.arange(at, at + len(tile))[None, :])] = -np.inf
            rough[fresh] = part
            if len(tile) > k:
                floor[fresh] = -np.partition(-part, k - 1, axis=1)[:, k - 1] - margin
        near = (rough >= (floor - margin)[:, None]) & (rough > -np.inf)
        if not near.any():
            continue
        if near.sum() > 8 * k * len(a):
            exact = np.round(a @ tile.T, 9)
            exact[~near | barred(np.arange(len(a))[:, None], np.arange(at, at + len(tile))[None, :])] = -np.inf
            i, j = _top(exact, k)
            s = exact[i, j]
        else:
            i, j = np.nonzero(near)
            free = ~barred(i, j + at)
            i, j = i[free], j[free]
            s = np.round(np.einsum("ij,ij->i", a[i], tile[j]), 9)
        row, column, sim = np.concatenate([row, i]), np.concatenate([column, j + at]), np.concatenate([sim, s])
        order = np.lexsort((column, -sim, row))
        row, column, sim = row[order], column[order], sim[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, column, sim, place = row[place < k], column[place < k], sim[place < k], place[place < k]
        full = place == k - 1
        low[row[full]] = np.maximum(low[row[full]], sim[full] - SLACK)
    return row, column, sim


def _product(cells: Broadcast, k: int, skip_self: bool, kinds: pa.Schema):
    """The k best of one corpus block for every query of one query block, within each query's bound."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        right = right.sort_by("id")
        known, b = cells.value, _units(right["v"], right.num_rows)
        a, bound = _units(left["v"], left.num_rows), left["bound"].to_numpy()
        ids, names = right["id"], left["id"]
        own, keys = _codes(left["apart"].to_pylist(), right["apart"].to_pylist())
        me, them = _codes(names.to_pylist(), ids.to_pylist()) if skip_self else (None, None)
        wants, labels = (np.array(side["label"].to_pylist(), dtype=object) for side in (left, right))
        inside, where = np.unique(right["cell"].to_numpy(), return_inverse=True)
        near, far = known.near[None][inside], known.far[None][inside]
        low = np.where(np.isfinite(bound), 1.0 - bound * bound / 2.0 - SLACK, -np.inf)
        out: list[tuple] = []
        for want in set(wants.tolist()):
            mine = np.flatnonzero(wants == want)
            fits = np.ones(len(labels), bool) if want is None else labels == want
            # Queries that lie side by side share the cells they can reach.
            home = np.concatenate([_distances(a[mine[at:at + SLICE]], known.pivots[inside]).argmin(1) for at in range(0, len(mine), SLICE)])
            mine = mine[home.argsort(kind="stable")]
            for at in range(0, len(mine), SLICE):
                here = mine[at:at + SLICE]
                d = _distances(a[here], known.pivots[inside])
                reached = (np.maximum(d - far[None, :], near[None, :] - d) <= bound[here, None] + SLACK).any(axis=0)
                columns = np.flatnonzero(fits & reached[where])
                if not len(columns):
                    continue

                def barred(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                    rows, cols = here[i], columns[j]
                    same = (own[rows] == keys[cols]) & (own[rows] >= 0)
                    return same | (me[rows] == them[cols]) if skip_self else same

                i, j, sim = _best(a[here], b[columns], low[here], k, barred)
                out.append((here[i], columns[j], sim))
        if not out:
            return kinds.empty_table()
        i, j, sim = (np.concatenate(c) for c in zip(*out))
        return pa.Table.from_arrays([names.take(pa.array(i)).cast(kinds.types[0]).combine_chunks(), ids.take(pa.array(j)).cast(kinds.types[1]).combine_chunks(),
                                     pa.array(sim, kinds.types[2])], schema=kinds)

    return run


def nearest(queries: DataFrame, corpus: DataFrame, k: int = fixed.RETRIEVE_FETCH_K, key: str = "id", vector: str = "embedding",
            max_pivots: int = MAX_PIVOTS, skip_self: bool = True, label: str | None = None, apart: str | None = None,
            block_rows: int | None = None) -> DataFrame:
    """Exact top-k neighbours by cosine: (query, neighbour, similarity, rank). Ties go to the smaller key.

    `label` names a column of both sides: a query meets members of its own label only, one without a label meets all.
    `apart` names a column in which query and neighbour must differ. Both are tested before ranking.

    A metric join in two phases. About sqrt(n) corpus vectors are pivots, each vector lies in the cell of its nearest
    one, and cells that lie side by side form blocks of bounded size; a cell beyond that is cut into several. Queries are
    put into blocks by home cell. First every query block meets its home block, which gives each query a true k-th
    similarity; counts and radii per cell and label give another bound. Then a query block meets each corpus block where
    some query's bound reaches a cell with members of its label, and inside it only such cells are read, in single
    precision first. Only blocks are paired, so a row is sent at most once per block of the other side. Blocks are as
    few as keep all cores busy, up to what a task may hold. Pivots and cell radii, at most `max_pivots` vectors and
    `max_pivots` times labels rows, are all that goes through the driver.
    """
    spark, kind = corpus.sparkSession, corpus.schema[key].dataType
    ship(spark)

    def read(df: DataFrame) -> DataFrame:
        extra = [(F.col(c) if c else F.lit(None)).cast("string").alias(n) for n, c in (("label", label), ("apart", apart))]
        return cut(df.select(F.col(key).alias("id"), _plain(df, vector).alias("v"), *extra))

    base, asked = read(corpus), read(queries)
    size, n_asked = base.count(), asked.count()
    found_schema = T.StructType([T.StructField("query", queries.schema[key].dataType), T.StructField("neighbour", kind), T.StructField("similarity", T.DoubleType())])
    if not size or not n_asked:
        return spark.createDataFrame([], T.StructType([*found_schema.fields, T.StructField("rank", T.IntegerType())]))
    chosen = base.orderBy(F.xxhash64("id"), "id").select("v").limit(max(1, min(max_pivots, int(size ** 0.5)))).toArrow()
    pivots = np.unique(_units(chosen["v"], chosen.num_rows), axis=0)
    # Three pairs of blocks for each core.
    wanted = int(np.ceil(np.sqrt(3 * spark.sparkContext.defaultParallelism)))
    block_rows = block_rows or min(max(SLICE, BLOCK_VALUES // max(1, pivots.shape[1])), max(SLICE, -(-max(size, n_asked) // wanted)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, far = [], []
            m = _units(batch["v"], batch.num_rows)
            for at in range(0, batch.num_rows, 1024):
                d = _distances(m[at:at + 1024], pivots)
                cells.append(d.argmin(1))
                far.append(d.min(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(cells), pa.int32()), pa.array(np.concatenate(far))],
                                             schema=batch.schema.append(pa.field("cell", pa.int32())).append(pa.field("far", pa.float64())))

    def with_cell(df: DataFrame) -> DataFrame:
        return df.mapInArrow(assign, T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())]))

    placed = cut(with_cell(base))
    survey = _survey(placed, pivots, block_rows)
    cells = spark.sparkContext.broadcast(survey)
    # A cell's first block and its shares, at most one row per pivot.
    table = spark.createDataFrame([(i, int(b), int(s)) for i, (b, s) in enumerate(zip(survey.block, survey.shares))], "cell int, first long, shares long")
    share = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("shares"))).alias("block")
    members = cut(placed.join(F.broadcast(table), "cell").select("id", "v", "label", "apart", "cell", "far", share))
    homed = with_cell(asked).join(F.broadcast(table), "cell").select("id", "v", "label", "apart", share)
    crowd = homed.groupBy("block").agg(F.count("*").alias("n"))  # one row per block at most
    homed = cut(homed.join(F.broadcast(crowd), "block").select(
        "id", "v", "label", "apart", "block", F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("n") / block_rows)).cast("int").alias("part")))

    kinds = to_arrow_schema(found_schema)

    def meet(asking: DataFrame, pairs: DataFrame) -> DataFrame:
        """asking(home, part, ...) against members(block, ...) for pairs(home, part, block), of which there are blocks x blocks at most."""
        pairs = F.broadcast(pairs)
        left = asking.join(pairs, ["home", "part"]).select("home", "part", "block", "id", "v", "label", "apart", "bound")
        right = members.join(pairs, "block").select(
            F.col("home").alias("r_home"), F.col("part").alias("r_part"), F.col("block").alias("r_block"), "id", "v", "label", "apart", "cell", "far")
        return left.groupBy("home", "part", "block").cogroup(right.groupBy("r_home", "r_part", "r_block")).applyInArrow(
            _product(cells, k, skip_self, kinds), found_schema)

    asking = homed.withColumnRenamed("block", "home")
    first = cut(meet(asking.withColumn("bound", F.lit(float("inf"))), asking.select("home", "part").distinct().withColumn("block", F.col("home"))))
    kth = first.groupBy(F.col("query").alias("id")).agg(F.count("*").alias("n"), F.min("similarity").alias("least"))
    true_bound = F.when(F.col("n") >= k, F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * (F.col("least") - SLACK)))).otherwise(F.lit(float("inf")))
    need = k + int(skip_self) if apart is None else None

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cells.value
        ends = known.block + known.shares
        for batch in batches:
            m, bound = _units(batch["v"], batch.num_rows), batch["bound"].to_numpy()
            labels = np.array(batch["label"].to_pylist(), dtype=object)
            home, part = batch["home"].to_numpy(), batch["part"].to_numpy()
            met: set[tuple] = set()
            for at in range(0, batch.num_rows, SLICE):
                here = np.arange(at, min(at + SLICE, batch.num_rows))
                d = _distances(m[here], known.pivots)
                for want in set(labels[here].tolist()):
                    mine = np.flatnonzero(labels[here] == want)
                    limit = bound[here[mine]]
                    if need is not None:
                        # To a zero vector all are alike, however far.
                        ranked = m[here[mine]].any(axis=1)
                        limit = np.where(ranked, np.minimum(limit, known.reach(d[mine], want, need)), limit)
                    reached = known.may_hold(d[mine], want, limit)
                    own = np.stack([home[here[mine]], part[here[mine]]], axis=1)
                    for h, p in np.unique(own, axis=0).tolist():
                        for c in np.flatnonzero(reached[(own == (h, p)).all(axis=1)].any(axis=0)):
                            met.update((h, p, b) for b in range(known.block[c], ends[c]) if b != h)
            yield pa.RecordBatch.from_pydict({"home": [x[0] for x in met], "part": [x[1] for x in met], "block": [x[2] for x in met]},
                                             pa.schema([("home", pa.int64()), ("part", pa.int32()), ("block", pa.int64())]))

    bounded = cut(asking.join(kth.select("id", true_bound.alias("bound")), "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))))
    pairs = cut(bounded.mapInArrow(visits, "home long, part int, block long").distinct())
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return first.unionByName(meet(bounded, pairs)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mmr(candidates: DataFrame, corpus: DataFrame, k: int = fixed.RETRIEVE_K, weight: float = fixed.RETRIEVE_LAMBDA,
        key: str = "id", vector: str = "embedding") -> DataFrame:
    """k diverse neighbours per query out of its candidates: (query, neighbour, place).

    The first is the most similar; each next one maximises weight * similarity - (1 - weight) * its closeness to those
    chosen. A query's candidates are the fetch_k rows of `nearest`, so a group is small by construction.
    """
    kind = candidates.schema["neighbour"].dataType
    joined = candidates.select("query", "neighbour", "similarity", "rank").join(
        corpus.select(F.col(key).alias("neighbour"), _plain(corpus, vector).alias("v")), "neighbour")
    schema = T.StructType([T.StructField("query", candidates.schema["query"].dataType), T.StructField("neighbour", kind),
                           T.StructField("place", T.IntegerType())])

    def choose(group: pa.Table) -> list[int]:
        m, sim = _units(group["v"], group.num_rows), group["similarity"].to_numpy()
        among = m @ m.T
        chosen = [0]
        while len(chosen) < min(k, len(m)):
            gain = np.round(weight * sim - (1 - weight) * among[:, chosen].max(axis=1), 9)
            gain[chosen] = -np.inf
            chosen.append(int(gain.argmax()))
        return chosen

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries lie together, best candidate first; the last one of a batch waits for the next."""
        def done(rows: pa.Table, ends: list) -> pa.RecordBatch:
            at, place = [], []
            for start, end in zip(ends[:-1], ends[1:]):
                chosen = choose(rows.slice(start, end - start))
                at += [start + c for c in chosen]
                place += range(1, len(chosen) + 1)
            took = rows.select(["query", "neighbour"]).take(pa.array(at, pa.int64())).combine_chunks()
            return pa.RecordBatch.from_arrays([*(took[c].combine_chunks().cast(t) for c, t in zip(("query", "neighbour"), kinds.types)), pa.array(place, pa.int32())], schema=kinds)

        left: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if left is None else pa.concat_tables([left, rows]).combine_chunks()
            names = rows["query"].to_pylist()
            starts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
            if len(starts) > 1:
                yield done(rows, starts)
            left = rows.slice(starts[-1]) if starts else left
        if left is not None and left.num_rows:
            yield done(left, [0, left.num_rows])

    kinds = to_arrow_schema(schema)
    return joined.repartition("query").sortWithinPartitions("query", "rank").mapInArrow(pick, schema)


def retrieve(queries: DataFrame, corpus: DataFrame, k: int = fixed.RETRIEVE_K, fetch_k: int = fixed.RETRIEVE_FETCH_K,
             weight: float = fixed.RETRIEVE_LAMBDA, key: str = "id", vector: str = "embedding", where=None,
             skip_self: bool = True, label: str | None = None, apart: str | None = None) -> DataFrame:
    """Retrieval as a table function: (query, neighbour, place). Filters run before ranking, so they never cost a query
    its neighbours: `where` is the same for all queries, `label` and `apart` differ by query (see `nearest`)."""
    pool = corpus if where is None else corpus.filter(where)
    return mmr(nearest(queries, pool, fetch_k, key, vector, skip_self=skip_self, label=label, apart=apart), pool, k, weight, key, vector)
