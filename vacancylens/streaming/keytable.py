"""A table of keys that grows for ever, in hash buckets with Bloom filters: a batch opens only what may hold its keys."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacancylens.session import ship

BUCKETS = 64
GENERATIONS = 8
BITS_PER_KEY = 10
HASHES = 7


def _positions(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """The bits of every key: steps of an odd second hash from the first."""
    steps = np.arange(HASHES, dtype=np.uint64)
    return (h1.view(np.uint64)[:, None] + steps * (h2.view(np.uint64) | np.uint64(1))[:, None]) % np.uint64(bits)


def _bloom(rows: pa.Table) -> pa.Table:
    """One filter for the keys of one bucket and generation."""
    bits = max(64, BITS_PER_KEY * rows.num_rows)
    marks = np.zeros(bits, bool)
    marks[_positions(rows["h1"].to_numpy(), rows["h2"].to_numpy(), bits).ravel()] = True
    return pa.table({"bucket": rows["bucket"][:1], "gen": rows["gen"][:1], "bits": pa.array([bits], pa.int64()),
                     "marks": pa.array([np.packbits(marks).tobytes()], pa.binary())})


def _possible(asked: pa.Table, blooms: pa.Table) -> pa.Table:
    """The keys of one bucket with the generations whose filter has them."""
    h1, h2 = asked["h1"].to_numpy(), asked["h2"].to_numpy()
    keys, gens, found = asked["key"].to_pylist(), [], []
    for gen, bits, marks in zip(*(blooms[c].to_pylist() for c in ("gen", "bits", "marks"))):
        held = np.unpackbits(np.frombuffer(marks, np.uint8), count=bits).astype(bool)
        hits = np.flatnonzero(held[_positions(h1, h2, bits)].all(axis=1)) if len(h1) else []
        gens += [gen] * len(hits)
        found += [keys[i] for i in hits]
    bucket = asked["bucket"][0].as_py() if asked.num_rows else 0
    return pa.table({"key": pa.array(found, pa.string()), "bucket": pa.array([bucket] * len(found), pa.int32()), "gen": pa.array(gens, pa.string())})


class KeyTable:
    """Rows by key under a folder, in `buckets` parts by the key's hash; every batch adds a generation to the parts it
    touches, with a Bloom filter of some ten bits a key.

    A batch asks the filters of its own buckets and opens only the generations that may hold one of its keys. A
    generation is named for its batch, so that a batch that runs again replaces what it wrote and never sees it. Parts
    with many generations are merged into one, written whole before the old ones go: between the two a row stands twice,
    which readers of the newest row per key do not notice. `schema` has a string column `key`; others are free. The
    number of buckets is fixed when a folder is first written.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str = "key string", buckets: int = BUCKETS, generations: int = GENERATIONS):
        self.spark, self.path, self.buckets, self.generations = spark, path.rstrip("/"), buckets, generations
        self.schema = T.StructType.fromDDL(schema)
        self.opened: list[tuple[int, str]] = []

    def _read(self, part: str, schema: T.StructType) -> DataFrame:
        full = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("gen", T.StringType())])
        try:
            return self.spark.read.schema(full).parquet(f"{self.path}/{part}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], full)

    def _rows(self) -> DataFrame:
        return self._read("rows", self.schema)

    def _filters(self) -> DataFrame:
        return self._read("filters", T.StructType.fromDDL("bits long, marks binary"))

    def _hashed(self, df: DataFrame) -> DataFrame:
        hashed = df.withColumn("h1", F.xxhash64("key")).withColumn("h2", F.xxhash64(F.lit(1), "key"))
        return hashed.withColumn("bucket", F.pmod("h1", F.lit(self.buckets)).cast("int"))

    @staticmethod
    def _of(pairs: list[tuple[int, str]]) -> Column:
        """Which folders: partition columns only, so that all others stay closed."""
        by_gen: dict[str, list[int]] = {}
        for bucket, gen in pairs:
            by_gen.setdefault(gen, []).append(bucket)
        return reduce(Column.__or__, [(F.col("gen") == g) & F.col("bucket").isin(b) for g, b in sorted(by_gen.items())])

    def known(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """The table's rows of the given keys, without those of the batch itself. keys(key)."""
        ship(self.spark)
        asked = self._hashed(keys.select(F.col("key").cast("string").alias("key")).filter(F.col("key").isNotNull()).distinct()).persist()
        touched = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # one row per bucket at most
        filters = self._filters().filter(F.col("bucket").isin(touched) & (F.col("gen") != _batch(batch_id)))
        possible = asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_possible, "key string, bucket int, gen string").persist()
        self.opened = sorted((r["bucket"], r["gen"]) for r in possible.select("bucket", "gen").distinct().collect())
        asked.unpersist()
        if not self.opened:
            return self.spark.createDataFrame([], self.schema)
        held = self._rows().filter(self._of(self.opened))
        return held.join(possible, ["key", "bucket", "gen"], "left_semi").select(self.schema.names)

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Add a batch's rows, then merge parts that have too many generations."""
        ship(self.spark)
        self._write(rows.select(self.schema.names), _batch(batch_id))
        self._merge(batch_id)

    def _write(self, rows: DataFrame, name: str) -> None:
        def put(part: str, df: DataFrame) -> None:
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "gen").parquet(f"{self.path}/{part}")

        put("rows", self._hashed(rows.withColumn("gen", F.lit(name))).repartition("bucket").select(*self.schema.names, "bucket", "gen"))
        # The filters are made from what was written, so that the batch is not computed again.
        written = self._hashed(self._rows().filter(F.col("gen") == name).select("key")).withColumn("gen", F.lit(name))
        put("filters", written.select("bucket", "gen", "h1", "h2").groupBy("bucket", "gen").applyInArrow(
            _bloom, "bucket int, gen string, bits long, marks binary"))

    def _merge(self, batch_id: int) -> None:
        """Merge what earlier batches wrote; the batch's own generation stays apart until it is committed."""
        if batch_id < self.generations:
            return
        earlier = self._filters().filter((F.col("gen") != _batch(batch_id)) & (F.col("gen") != _merged(batch_id)))
        many = earlier.select("bucket", "gen").distinct().groupBy("bucket").agg(F.collect_set("gen").alias("gens")).filter(F.size("gens") >= self.generations).collect()
        old = [(r["bucket"], g) for r in many for g in r["gens"]]  # buckets x generations at most
        if not old:
            return
        held = self._rows().filter(self._of(old)).select(self.schema.names).distinct()
        self._write(held, _merged(batch_id))
        jvm = self.spark._jvm
        for part in ("filters", "rows"):
            for bucket, gen in old:
                where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}/bucket={bucket}/gen={gen}")
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def _batch(batch_id: int) -> str:
    return f"b{batch_id}"


def _merged(batch_id: int) -> str:
    return f"m{batch_id}"
