"""SimHash near-duplicates: fingerprints meet at the anchor points of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancylens.llm.common import saved, ship, unused
from vacancylens.operators.graph import components

SHINGLE = 3
DISTANCE = 3
HASH_SEED = 42
CROWD = 256
CROWD_BLOCK = 2048
CHUNK = 1 << 16


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text as a signed number.

    Words are runs of anything but ASCII white space, A-Z in lower case; a bit is 1 if it is set in over half of the
    XXH64 hashes of the word shingles, repeats included. A text with fewer words is one shingle; none gives zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle or None], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, set_in = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(starts[at: at + CHUNK].tolist(), ends[at: at + CHUNK].tolist())], "<u8")
        set_in += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * set_in > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """`fingerprint_of` as a column."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_of(t, shingle) for t in texts], dtype="int64")

    return run(text)


class Anchors:
    """Anchor points for all pairs of 64-bit values within a distance.

    The bits are cut into parts so that two values within the distance differ by one bit at most in some part. In a part,
    the words of the longest Hamming code that fits are the anchors: every value lies within radius one of exactly one.
    Of two values that differ by at most one bit there, the second lies within radius two of the first one's anchor, so
    a value visits all anchors within two and is at home at the nearest: 1 + (length - 1) / 2 of them at most.
    """

    def __init__(self, distance: int = DISTANCE):
        self.parts = distance // 2 + 1
        self.width = 64 // self.parts
        self.order = (self.width + 1).bit_length() - 1
        self.length = (1 << self.order) - 1

    def _part(self, value: Column, part: int) -> Column:
        return F.shiftrightunsigned(value, part * self.width).bitwiseAND(F.lit((1 << self.length) - 1))

    def _syndrome(self, word: Column) -> Column:
        """Which position is off the code: the exclusive or of the numbers of the set bits, counted from 1."""
        total = F.lit(0)
        for k in range(self.order):
            mask = sum(1 << (p - 1) for p in range(1, self.length + 1) if p >> k & 1)
            total = total + F.shiftleft(F.bit_count(word.bitwiseAND(F.lit(mask))) % 2, k)
        return total

    def split(self, value: Column) -> Column:
        """Per part: its number, the home anchor, and the word with its syndrome."""
        parts = []
        for p in range(self.parts):
            word = self._part(value, p).cast("long")
            parts.append(F.struct(F.lit(p).alias("part"), word.alias("word"), self._syndrome(word).cast("int").alias("off")))
        return F.array(*parts)

    @staticmethod
    def _flip(word: Column, position: Column) -> Column:
        return word.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), position - 1))

    def home(self, word: Column, off: Column) -> Column:
        return F.when(off == 0, word).otherwise(self._flip(word, off))

    def visited(self, word: Column, off: Column) -> Column:
        """All anchors within radius two: the home, and each pair of positions that together mend the word."""
        firsts = F.filter(F.sequence(F.lit(1), F.lit(self.length)), lambda i: (i.bitwiseXOR(off) > i))
        pairs = F.transform(firsts, lambda i: self._flip(self._flip(word, i), i.bitwiseXOR(off)))
        return F.when(off == 0, F.array(word)).otherwise(F.concat(F.array(self.home(word, off)), pairs))


def _crowd_links(distance: int):
    """Links inside one block of a crowded anchor, as (member, smallest member of its group): a tree, never all pairs."""

    def run(rows: pa.Table) -> pa.Table:
        values, home = rows["value"].to_numpy(), rows["home"].to_numpy(zero_copy_only=False)
        here, guests = np.unique(values[home]), np.unique(values)
        label = np.arange(len(guests))
        for value in here:
            near = np.bitwise_count((guests ^ value).view(np.uint64)) <= distance
            groups = np.unique(label[near])
            if len(groups) > 1:
                label[np.isin(label, groups)] = groups[0]
        linked = label != np.arange(len(guests))
        return pa.table({"a": guests[linked], "b": guests[label[linked]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def links(values: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of values(value) within the distance.

    Values are distinct. At an anchor with few visitors every pair within the distance is an edge. A crowded anchor is cut
    into blocks of home values and visitors of bounded size, and each block gives the edges of a spanning forest of its
    pairs; nothing is left out.
    """
    anchors = Anchors(distance)
    parts = values.select("value", F.explode(anchors.split(F.col("value"))).alias("p")).select("value", "p.part", "p.word", "p.off")
    home = parts.select("part", anchors.home(F.col("word"), F.col("off")).alias("anchor"), "value")
    visit = parts.select("part", F.explode(anchors.visited(F.col("word"), F.col("off"))).alias("anchor"), "value")
    cell = ["part", "anchor"]
    crowded = saved(visit.groupBy(*cell).agg(F.count("*").alias("guests")).filter(F.col("guests") > CROWD), "simhash-crowded")

    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    few = home.join(crowded, cell, "left_anti").withColumnRenamed("value", "a").join(
        visit.withColumnRenamed("value", "b"), cell).filter((F.col("a") != F.col("b")) & near).select("a", "b")

    blocks = F.ceil(F.col("guests") / CROWD_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("value"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    at_home = home.join(crowded.withColumn("blocks", blocks), cell).select(
        *cell, "value", F.lit(True).alias("home"), own.alias("i"), F.explode(every).alias("j"))
    guests = visit.join(crowded.withColumn("blocks", blocks), cell).select(
        *cell, "value", F.lit(False).alias("home"), F.explode(every).alias("i"), own.alias("j"))
    many = at_home.unionByName(guests).groupBy(*cell, "i", "j").applyInArrow(_crowd_links(distance), "a long, b long")
    return few.unionByName(many)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(key, fingerprint, component_id, text_hash, group) of every row: documents linked through fingerprints within the distance.

    Equal fingerprints meet once, as one value with the smallest key. `fingerprint` is a signed number and `component_id`
    the smallest key reachable. A null, empty or blank text has fingerprint zero, linked like any other; null keys are
    no smallest key unless a component has no other; equal rows are rows of their own; whole texts are read, in chunks of
    hashes; an empty table gives an empty result. Other columns are not read. `group` tells components apart and `text_hash` the rows
    of a repeated key.
    """
    ship(docs.sparkSession)
    rows = saved(docs.select(F.col(key).alias("key"), fingerprint(F.col(text), shingle).alias("value"), F.xxhash64(text).alias("text_hash")), "simhash-rows")
    firsts = saved(rows.groupBy("value").agg(F.min("key").alias("first")), "simhash-values")
    found = saved(links(firsts.select("value"), distance), "simhash-links")
    groups = components(found).select(F.col("node").alias("value"), F.col("component").alias("group"))
    member = firsts.join(groups, "value", "left").withColumn("group", F.coalesce("group", "value"))
    lowest = member.groupBy("group").agg(F.min("first").alias("component_id"))
    named = member.join(lowest, "group").select("value", "component_id", "group")
    return rows.join(named, "value").select(F.col("key").alias(key), F.col("value").alias("fingerprint"), "component_id", "text_hash", "group")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The documents, one row of each component: the smallest key, null last, then the smallest hash of its text.

    Of rows that share key and text one stays. Null, empty and blank texts are one component; whole texts are read; an
    empty table gives an empty result, and columns of any name pass unchanged.
    """
    own, digest = unused(docs, "_key", "_hash")
    groups = near_duplicates(docs, key, text, shingle, distance)
    place = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "text_hash")
    kept = groups.groupBy("group").agg(F.min(place).alias("k")).select(F.col("k.key").alias(own), F.col("k.text_hash").alias(digest))
    rows = docs.withColumn(digest, F.xxhash64(text)).withColumn(own, F.col(key))
    rows = rows.join(kept, rows[own].eqNullSafe(kept[own]) & (rows[digest] == kept[digest]), "left_semi")
    return rows.dropDuplicates([own, digest]).select(docs.columns)


def hexadecimal(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))
