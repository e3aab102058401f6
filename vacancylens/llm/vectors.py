"""Vector tables for the two searches: valid rows, ranges of bounded size, and tiles of queries against a range."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE_QUERIES = 2048


def finite(vector: Column) -> Column:
    """True for a vector that is neither null nor holds a null or non-finite component."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """A list column as a matrix; shorter vectors are filled up with zeros."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(rows, pa.ChunkedArray):
        rows = pa.concat_arrays(rows.chunks) if rows.num_chunks else pa.array([], rows.type)
    sizes = np.diff(rows.offsets.to_numpy()) if len(rows) else np.zeros(0, np.int64)
    values = rows.flatten().to_numpy(zero_copy_only=False)
    width = max(int(sizes.max(initial=0)), width or 0)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width).astype(float)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def tiles(candidates: DataFrame, queries: DataFrame, ranges: int, query_groups: int) -> DataFrame:
    """Rows of all tiles (part, group): every range of candidates beside every group of queries.

    candidates(row, id, part, block, vector) and queries(row, id, bound, vector). A stated query set against all rows,
    in blocks: a candidate is sent once per query group and a query once per range.
    """
    c = candidates.select(F.lit(False).alias("role"), "row", "id", "block", F.lit(None).cast("double").alias("bound"), "vector", "part",
                          F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1))).alias("group"))
    q = queries.select(F.lit(True).alias("role"), "row", "id", F.lit(None).cast("long").alias("block"), "bound", "vector",
                       F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ranges - 1).cast("long"))).alias("part"),
                       F.pmod(F.xxhash64("row"), F.lit(query_groups)).cast("int").alias("group"))
    return c.unionByName(q)
