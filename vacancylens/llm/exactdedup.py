"""Exact dedup over an index of cuckoo filters: live digests come and go, hits are verified, full filters are resized."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacancylens.llm.common import join_groups, saved, ship

SHARD_KEYS = 1 << 14
FIRST_BUCKETS = 64
SLOTS = 4
KICKS = 200
FULL = 0.95
CHUNK = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = f"""with norm as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as body from documents),
  groups as (select body, max(doc_id) as keep_id, count(*) as group_size from norm group by body)
  select doc_id, keep_id, group_size, row_number() over (partition by body order by doc_id desc nulls last) = 1 as kept,
    sha256(body) as text_sha256 from norm join groups using (body)"""


def mark_of(digest: bytes) -> int:
    """The 16-bit fingerprint of a digest; zero marks a free slot."""
    return int.from_bytes(digest[:2], "little") or 1


class CuckooShard:
    """The live digests of one shard: a cuckoo filter, and for every slot the stored key its fingerprint stands for.

    A fingerprint lies in one of two buckets, each found from the other and the fingerprint alone. A fingerprint that
    matches is only a hit: the stored key of its slot decides. A digest is held once, so deleting it frees its own slot.
    When no slot is found after a number of kicks, or too few are free, the buckets double and all stored keys are
    placed again.
    """

    def __init__(self, buckets: int = FIRST_BUCKETS):
        self.keys: dict[int, bytes] = {}
        self._clear(buckets)
        self.false_hits = 0

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.marks = [0] * (buckets * SLOTS)
        self.keys = {}

    def _home(self, digest: bytes) -> int:
        return int.from_bytes(digest[2:10], "little") & (self.buckets - 1)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 >> 7) & (self.buckets - 1)

    def slot(self, digest: bytes) -> int:
        """The slot of a live digest, or -1."""
        mark, home = mark_of(digest), self._home(digest)
        for bucket in (home, self._other(home, mark)):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.marks[at] == mark:
                    if self.keys[at] == digest:
                        return at
                    self.false_hits += 1
        return -1

    def _place(self, digest: bytes) -> bytes | None:
        """Put a digest into a slot, moving others to their other buckets; the digest left over, if any."""
        mark = mark_of(digest)
        bucket = self._home(digest)
        for kick in range(KICKS):
            for b in (bucket, self._other(bucket, mark)):
                for at in range(b * SLOTS, b * SLOTS + SLOTS):
                    if not self.marks[at]:
                        self.marks[at], self.keys[at] = mark, digest
                        return None
            at = self._other(bucket, mark) * SLOTS + kick % SLOTS
            out, out_mark = self.keys[at], self.marks[at]
            self.marks[at], self.keys[at] = mark, digest
            digest, mark, bucket = out, out_mark, self._other(at // SLOTS, out_mark)
        return digest

    def add(self, digest: bytes) -> None:
        """Insert a digest that is not live."""
        over: bytes | None = digest
        if len(self.keys) + 1 <= FULL * len(self.marks):
            over = self._place(digest)
        if over is not None:
            self.resize([*self.keys.values(), over])

    def resize(self, keys: list[bytes]) -> None:
        """Double the buckets, more than once if need be, and place the stored keys again."""
        buckets = self.buckets
        while True:
            buckets *= 2
            self._clear(buckets)
            if all(self._place(k) is None for k in keys):
                return

    def remove(self, digest: bytes) -> bool:
        at = self.slot(digest)
        if at >= 0:
            self.marks[at] = 0
            del self.keys[at]
        return at >= 0

    def restore(self, slots: list[int], digests: list[bytes], buckets: int) -> None:
        self._clear(buckets)
        for at, digest in zip(slots, digests):
            self.marks[at], self.keys[at] = mark_of(digest), digest

    def filter_bytes(self) -> bytes:
        return np.array(self.marks, "<u2").tobytes()


def maybe(filter_bytes: bytes, digest: bytes) -> bool:
    """Whether a shard's filter alone holds the fingerprint of a digest."""
    marks = np.frombuffer(filter_bytes, "<u2").reshape(-1, SLOTS)
    mark, home = mark_of(digest), int.from_bytes(digest[2:10], "little") & (len(marks) - 1)
    other = home ^ (mark * 0x5BD1E995 >> 7) & (len(marks) - 1)
    return bool((marks[home] == mark).any() or (marks[other] == mark).any())


@dataclass(frozen=True)
class Index:
    """A version of the index, as written tables.

    `rows` has one row per live document (key, row, digest, shard), `entries` one per live digest with its slot, number
    of documents and the document that stays, `filters` one per shard. An update writes new tables (some 60 bytes a
    live document, never texts) and leaves the version before as it was, so that a run that is repeated starts from it.
    """

    rows: DataFrame
    entries: DataFrame
    filters: DataFrame
    shards: int


def digest_of(text: Column) -> Column:
    """SHA-256 of a text with A-Z in lower case; null counts as empty. Equal digests are taken for equal texts."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), 256))


def narrow(docs: DataFrame, shards: int, key: str, text: str, first_row: int) -> DataFrame:
    rows = docs.select(F.col(key).alias("key"), (F.monotonically_increasing_id() + first_row).alias("row"), digest_of(F.col(text)).alias("digest"))
    return rows.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def _entry_schema(key: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("slot", T.IntegerType()), T.StructField("buckets", T.IntegerType()),
        T.StructField("digest", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("keep", key),
        T.StructField("keep_row", T.LongType()), T.StructField("filter", T.BinaryType())])


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (key, row): the larger key, null last, then the smaller row."""
    if a[0] is None or b[0] is None:
        return b if a[0] is None and b[0] is not None else a if b[0] is None and a[0] is not None else min(a, b, key=lambda x: x[1])
    return max(a, b, key=lambda x: (x[0], -x[1]))


def _combine(types: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fold the rows of a split that share a digest, so that a group of copies sends a few rows per split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def flush() -> pa.RecordBatch:
            rows = [(s, d, n, k, r) for (s, d), (n, (k, r)) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], schema=types)

        for batch in batches:
            for shard, digest, key, row in zip(*(batch[c].to_pylist() for c in ("shard", "digest", "key", "row"))):
                have = held.get((shard, digest))
                held[shard, digest] = [1, (key, row)] if have is None else [have[0] + 1, _better(have[1], (key, row))]
            if len(held) >= CHUNK:
                yield flush()
        if held:
            yield flush()

    return run


def _combined(rows: DataFrame) -> DataFrame:
    key = rows.schema["key"].dataType
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("digest", T.BinaryType()),
                           T.StructField("n", T.LongType()), T.StructField("top", key), T.StructField("top_row", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    return rows.mapInArrow(_combine(to_arrow_schema(schema)), schema)


def _load(stored: pa.Table) -> tuple[CuckooShard, dict[bytes, list]]:
    shard, held = CuckooShard(), {}
    if stored.num_rows:
        digests = stored["digest"].to_pylist()
        shard.restore(stored["slot"].to_pylist(), digests, stored["buckets"][0].as_py())
        held = {d: [n, (k, r)] for d, n, k, r in zip(digests, *(stored[c].to_pylist() for c in ("size", "keep", "keep_row")))}
    return shard, held


def _dump(number: int, shard: CuckooShard, held: dict[bytes, list], schema: pa.Schema) -> pa.Table:
    rows = [(number, at, shard.buckets, d, held[d][0], *held[d][1], None) for at, d in shard.keys.items()]
    rows.append((number, -1, shard.buckets, None, None, None, None, shard.filter_bytes()))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _number(left: pa.Table, right: pa.Table) -> int:
    return (left if left.num_rows else right)["shard"][0].as_py()


def _inserting(schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(batch: pa.Table, stored: pa.Table) -> pa.Table:
        shard, held = _load(stored)
        for digest, n, key, row in zip(*(batch[c].to_pylist() for c in ("digest", "n", "top", "top_row"))):
            if shard.slot(digest) < 0:
                shard.add(digest)
                held[digest] = [n, (key, row)]
            else:
                held[digest] = [held[digest][0] + n, _better(held[digest][1], (key, row))]
        return _dump(_number(batch, stored), shard, held, schema)

    return run


def _deleting(schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left_over: pa.Table, stored: pa.Table) -> pa.Table:
        shard, held = _load(stored)
        for digest, n, key, row in zip(*(left_over[c].to_pylist() for c in ("digest", "n", "top", "top_row"))):
            if n:
                held[digest] = [n, (key, row)]
            else:
                shard.remove(digest)
        return _dump(_number(left_over, stored), shard, held, schema)

    return run


def _update(rows: DataFrame, batch: DataFrame, entries: DataFrame | None, shards: int, step: Callable) -> Index:
    from pyspark.sql.pandas.types import to_arrow_schema
    spark, schema = rows.sparkSession, _entry_schema(rows.schema["key"].dataType)
    stored = spark.createDataFrame([], schema) if entries is None else entries.withColumn("filter", F.lit(None).cast("binary"))
    written = saved(batch.groupBy("shard").cogroup(stored.groupBy("shard")).applyInArrow(step(to_arrow_schema(schema)), schema), "dedup-entries")
    return Index(rows, written.filter("slot >= 0").drop("filter"), written.filter("slot < 0").select("shard", "filter"), shards)


def insert(docs: DataFrame, index: Index | None = None, key: str = "doc_id", text: str = "text", shard_keys: int = SHARD_KEYS) -> Index:
    """The index with all rows of docs(key, text) as live documents; a new index if none is given.

    A new index has a shard for every `shard_keys` rows; a shard that grows later resizes its filter. Digests are spread
    over shards evenly, and copies are folded in every split before they are sent, so no shard depends on how often a
    text occurs. A null text counts as empty; null keys and repeated rows are documents like any other; an empty table
    gives an empty index; other columns are not read; whole texts are hashed.
    """
    ship(docs.sparkSession)
    shards = index.shards if index else max(1, -(-docs.count() // shard_keys))
    start = (index.rows.agg(F.max("row")).first()[0] or 0) + 1 if index else 0
    fresh = saved(narrow(docs, shards, key, text, start), "dedup-rows")
    rows = saved(index.rows.unionByName(fresh), "dedup-rows") if index else fresh
    return _update(rows, _combined(fresh), index.entries if index else None, shards, _inserting)


def delete(index: Index, keys: DataFrame, key: str = "doc_id") -> Index:
    """The index without the documents of the keys. Where the document that stays goes, the next one takes its place; the
    digest of the last one leaves its filter. Unknown and null keys change nothing."""
    ship(keys.sparkSession)
    gone = keys.select(F.col(key).alias("key")).distinct()
    left = saved(index.rows.join(gone, "key", "left_anti"), "dedup-rows")
    hit = index.rows.join(gone, "key", "left_semi").select("shard", "digest").distinct()
    order = F.struct(F.col("key").alias("top"), (-F.col("row")).alias("row"))
    now = left.groupBy("shard", "digest").agg(F.count("*").alias("n"), F.max(order).alias("best"))
    batch = hit.join(now, ["shard", "digest"], "left").select(
        "shard", "digest", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "best.top", (-F.col("best.row")).alias("top_row"))
    return _update(left, batch, index.entries, index.shards, _deleting)


def lookup(index: Index, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest, hit, live) per row of docs: what the filters say, and what is so.

    Filters are asked first, a few bytes a digest; only hits are verified against the entries.
    """
    ship(docs.sparkSession)
    rows = saved(narrow(docs, index.shards, key, text, 0), "dedup-asked")

    def ask(batch: pa.Table, filters: pa.Table) -> pa.Table:
        bits = filters["filter"][0].as_py() if filters.num_rows else b""
        hits = [bool(bits) and maybe(bits, d) for d in batch["digest"].to_pylist()]
        return pa.table({"shard": batch["shard"], "digest": batch["digest"], "hit": pa.array(hits, pa.bool_())})

    distinct = rows.select("shard", "digest").distinct()
    asked = distinct.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInArrow(ask, "shard int, digest binary, hit boolean")
    hits = asked.filter("hit").join(index.entries.select("shard", "digest", F.lit(True).alias("live")), ["shard", "digest"], "left")
    counts = rows.groupBy("shard", "digest").agg(F.count("*").alias("n"))
    known = counts.join(hits, ["shard", "digest"], "left").select(
        "digest", "n", F.coalesce("hit", F.lit(False)).alias("hit"), F.coalesce("live", F.lit(False)).alias("live"))
    return join_groups(rows.select(F.col("key").alias(key), "digest"), known, "digest", "n").drop("n")


def resolve(index: Index, key: str = "doc_id") -> DataFrame:
    """(key, keep_id, group_size, kept, digest) of every live document.

    Of equal texts the row with the largest key stays, null last; of rows that share that key too, one. Entries of
    large groups are fewer than a fixed number and are sent to the rows; the rest is joined by digest.
    """
    entries = index.entries.select("digest", F.col("size").alias("group_size"), F.col("keep").alias("keep_id"), "keep_row")
    rows = join_groups(index.rows.select("key", "row", "digest"), entries, "digest", "group_size")
    return rows.select(F.col("key").alias(key), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")
