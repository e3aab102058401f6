"""Texts as sets of their word runs, worked out where the texts lie, and exact joins that shuffle few of the runs.

A run of words is a 64-bit number. Sets are ordered by number, runs that many texts hold stand last, and a set's first
few runs decide which others it can resemble; only those are shuffled. Whole sets are sent for candidate pairs alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from hashlib import md5
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vacancylens import fixed
from vacancylens.functions.text import blank
from vacancylens.session import cut, ship

SIZE = fixed.SHINGLE_WORDS
CHUNK = 1 << 20
# A run is common when this many texts of a stretch hold it; stretches are runs by number. At most MOST_COMMON go through the driver.
STRETCH, COMMON, MOST_COMMON = 1 << 22, 4, 1 << 16
# Rows of 64 bits in a table that tells which rows may matter.
MAX_WORDS = 1 << 20
# Bytes of whole sets that a task compares at once.
BUCKET = 1 << 25
# Pairs at one run that a task compares at once; runs with more are few, by that many pairs each.
CROWD = 1 << 17
# Share of a contained set's runs that is indexed beyond what must be, so that a single common run makes no candidate.
BEYOND = 0.02
# Longer words are hashed one by one.
LONG_WORD = 64
LOWEST, SPAN = -(1 << 63), 1 << 64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_ALNUM = np.zeros(256, bool)
_ALNUM[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True
_LETTER = _mixed(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_PLACE = _mixed(np.arange(257, 257 + SIZE, dtype=np.uint64) * _GOLDEN) | np.uint64(1)


class Runs(NamedTuple):
    """Some rows of a batch: from row `at` on, the key of each row's words and its distinct runs, ascending."""

    at: int
    keys: list[str]
    start: np.ndarray
    tokens: np.ndarray

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.start)


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)])


def _word_hashes(raw: np.ndarray, inside: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    if not len(lengths):
        return np.zeros(0, np.uint64)
    begins = _ends(lengths)[:-1]
    place = np.arange(int(lengths.sum())) - np.repeat(begins, lengths)
    power = np.cumprod(np.full(int(lengths.max()), _GOLDEN, np.uint64))
    return _mixed(np.add.reduceat(_LETTER[raw[inside]] * power[place], begins))


def _words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes lie in words, where words start and end, and the first word of each row."""
    inside = _ALNUM[raw]
    filled = bounds[:-1] < bounds[1:]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    opens, closes = bounds[:-1][filled], bounds[1:][filled] - 1
    first[opens], last[closes] = inside[opens], inside[closes]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return inside, starts, ends, np.searchsorted(starts, bounds)


def _runs(raw: np.ndarray, bounds: np.ndarray, at: int) -> Runs:
    inside, starts, ends, word = _words(raw, bounds)
    n_words = np.diff(word)

    between = np.ones(len(starts), bool)
    between[word[1:][n_words > 0] - 1] = False
    kept = inside.copy()
    kept[ends[between]] = True
    flat = np.where(inside, raw, np.uint8(32))[kept].tobytes()
    cuts = _ends(kept)[bounds].tolist()
    keys = [md5(flat[a:b], usedforsecurity=False).hexdigest() for a, b in zip(cuts[:-1], cuts[1:])]

    hashes = _word_hashes(raw, inside, ends - starts)
    n_runs = np.maximum(n_words - (SIZE - 1), 0)
    begin = _ends(n_runs)
    index = np.arange(begin[-1]) + np.repeat(word[:-1] - begin[:-1], n_runs)
    runs = np.zeros(len(index), np.uint64)
    for k in range(SIZE):
        runs += hashes[index + k] * _PLACE[k]
    runs = _mixed(runs).view(np.int64)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        runs[a:b].sort()
    fresh = np.ones(len(runs), bool)
    fresh[1:] = runs[1:] != runs[:-1]
    fresh[begin[:-1][n_runs > 0]] = True
    return Runs(at, keys, _ends(fresh)[begin], runs[fresh])


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The bytes of some rows at a time, where each row starts in them, and the first row."""
    texts = texts.cast(pa.large_string())
    _, places, data = texts.buffers()
    bounds = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, "right")) - 1)
        yield raw[bounds[at]:bounds[end]], bounds[at:end + 1] - bounds[at], at
        at = end


def runs_of(texts: pa.Array) -> Iterator[Runs]:
    """The runs of lower-cased texts, some rows at a time."""
    for piece in _pieces(texts):
        yield _runs(*piece)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


_CRC = _crc_table()


def _crc32(code: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC32 of each word: letter by letter for all that have one more, long words by themselves."""
    order = np.argsort(-np.minimum(lengths, LONG_WORD + 1).astype(np.int8), kind="stable")
    begins, lengths = begins[order], lengths[order]
    short = int(np.count_nonzero(lengths > LONG_WORD))
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(min(LONG_WORD, int(lengths.max(initial=0)))):
        live = int(np.searchsorted(-np.minimum(lengths, LONG_WORD + 1), -k))
        crc[short:live] = _CRC[(crc[short:live] ^ code[begins[short:live] + k]) & 0xFF] ^ (crc[short:live] >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(short):
        crc[i] = zlib.crc32(code[begins[i]:begins[i] + lengths[i]].tobytes())
    out = np.empty(len(order), np.uint32)
    out[order] = crc
    return out


def counts_of(texts: pa.Array, dim: int) -> pa.Array:
    """Word counts per bucket of lower-cased texts."""
    out = []
    for raw, bounds, _ in _pieces(texts):
        inside, starts, ends, word = _words(raw, bounds)
        rows, lengths = len(bounds) - 1, ends - starts
        bucket = _crc32(raw[inside], _ends(lengths)[:-1], lengths).astype(np.int64) % dim
        row = np.repeat(np.arange(rows), np.diff(word))
        out.append(np.bincount(row * dim + bucket, minlength=rows * dim))
    flat = np.concatenate(out) if out else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dim, pa.int32()), pa.array(flat, pa.int32()))


def word_counts(c: Column | str, dim: int = fixed.EMBED_DIM) -> Column:
    """`bucket_counts`, many texts at a time."""
    if spark := SparkSession.getActiveSession():
        ship(spark)
    counted = F.arrow_udf(lambda texts: counts_of(texts, dim), T.ArrayType(T.IntegerType()))
    return counted(F.lower(blank(c)))


def mapped(texts: DataFrame, produced: str, make: Callable[[Runs], list]) -> DataFrame:
    """texts(text, ...) with columns made of the text's runs in place of the text: one array per column of `produced`."""
    ship(texts.sparkSession)
    carried = [f for f in texts.schema.fields if f.name != "text"]
    schema = T.StructType([*carried, *T._parse_datatype_string(produced).fields])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs_of(batch["text"]):
                kept = [batch[f.name].slice(part.at, len(part.keys)) for f in carried]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip([*kept, *make(part)], kinds.types)], schema=kinds)

    return texts.mapInArrow(run, schema)


def _lists(start: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(values, pa.int64()))


def lowered(text: str) -> Column:
    return F.lower(blank(text)).alias("text")


def keyed_texts(texts: DataFrame) -> DataFrame:
    """texts(text, ...) with `text_key`, the digest of the text's words in order, and `n`, its number of distinct runs."""
    return mapped(texts, "text_key string, n int", lambda r: [pa.array(r.keys, pa.string()), pa.array(r.n, pa.int32())])


def run_sets(texts: DataFrame) -> DataFrame:
    """texts(text, ...) with the text's distinct runs as `tokens`, ascending."""
    return mapped(texts, "tokens array<bigint>", lambda r: [_lists(r.start, r.tokens)])


def common_runs(texts: DataFrame) -> np.ndarray:
    """Runs that many texts hold, as far as stretches of the texts show it; what is found sets an order and no result."""
    ship(texts.sparkSession)
    kinds = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def often(tokens: list[np.ndarray]) -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(tokens), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token[n >= COMMON]), pa.array(n[n >= COMMON], pa.int64())], schema=kinds)

        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for part in runs_of(batch["text"]):
                held.append(part.tokens)
                size += len(part.tokens)
                if size >= STRETCH:
                    yield often(held)
                    held, size = [], 0
        if held:
            yield often(held)

    counts = texts.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return np.sort(counts.orderBy(F.desc("n"), "token").limit(MOST_COMMON).select("token").toArrow()["token"].to_numpy())


def _among(tokens: np.ndarray, known: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """Which tokens are known; the gate, a table by their first 22 bits, spares most of them the search."""
    found = gate[(tokens >> 42) + (1 << 21)]
    at = np.flatnonzero(found)
    place = np.minimum(np.searchsorted(known, tokens[at]), max(len(known) - 1, 0))
    found[at] = known[place] == tokens[at] if len(known) else False
    return found


def _gate(known: np.ndarray) -> np.ndarray:
    gate = np.zeros(1 << 22, bool)
    gate[(known >> 42) + (1 << 21)] = True
    return gate


def _prefix_size(n, threshold: float, beyond: float):
    """How many of a set's runs must be indexed, and some more."""
    return np.minimum(n, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1 + np.floor(beyond * n).astype(np.int64))


def _prefix_column(n: str, threshold: float, beyond: float) -> Column:
    c = F.col(n)
    return F.least(c, c - F.ceil(F.lit(threshold) * c - F.lit(1e-9)) + 1 + F.floor(F.lit(beyond) * c))


def _prefixes(texts: DataFrame, threshold: float, beyond: float, common: np.ndarray) -> DataFrame:
    """(row, text_key, n, tokens): of each text with runs, those that stand first."""
    known = texts.sparkSession.sparkContext.broadcast(common)

    def first(r: Runs) -> list:
        runs = known.value
        n = r.n
        place = np.arange(len(r.tokens)) - np.repeat(r.start[:-1], n)
        late = _among(r.tokens, runs, _gate(runs))
        if late.any():
            before = _ends(~late)
            early = before[:-1] - np.repeat(before[r.start[:-1]], n)
            place = np.where(late, np.repeat(before[r.start[1:]] - before[r.start[:-1]], n) + place - early, early)
        own = place < np.repeat(_prefix_size(n, threshold, beyond), n)
        return [pa.array(r.keys, pa.string()), pa.array(n, pa.int32()), _lists(_ends(own)[r.start], r.tokens[own])]

    return mapped(texts, "text_key string, n int, tokens array<bigint>", first).filter("n > 0")


def _one_each(sets: DataFrame) -> DataFrame:
    """One row per text, under a number for its key."""
    w = Window.partitionBy("id").orderBy("row")
    return sets.withColumn("id", F.xxhash64("text_key")).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def _bits(wanted: DataFrame, number: str, count: int) -> tuple[DataFrame, int]:
    """A table (word, bits) of the numbers present, by their remainder, in at most MAX_WORDS rows."""
    words = 1 << max(6, min(MAX_WORDS.bit_length() - 1, (count // 4 + 1).bit_length()))
    bit = F.pmod(number, F.lit(words * 64))
    return wanted.select(F.floor(bit / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int")).alias("bit")).groupBy(
        "word").agg(F.bit_or("bit").alias("bits")), words


def perhaps_in(df: DataFrame, number: Column, wanted: DataFrame, count: int | None = None) -> DataFrame:
    """Rows of df whose number is in wanted(number), and a few others: what is not wanted is left out before any shuffle.

    The table of bits that tells is bounded, so it can be sent to every task.
    """
    bits, words = _bits(wanted, "number", wanted.count() if count is None else count)
    bit = F.pmod(number, F.lit(words * 64))
    held = df.withColumn("_bit", bit).join(
        F.broadcast(bits.withColumnsRenamed({"word": "_word", "bits": "_bits"})), F.floor(F.col("_bit") / 64).cast("int") == F.col("_word"))
    return held.filter(F.getbit("_bits", F.pmod("_bit", F.lit(64)).cast("int")) == 1).drop("_bit", "_word", "_bits")


def _meeting(own: DataFrame, other: DataFrame, differ: Column) -> DataFrame:
    """(s, l, n_s, n_l, m, home): pairs of sets with a token in common, how many they have, and the smallest."""
    short = own.select(F.col("id").alias("s"), F.col("n").alias("n_s"), F.explode("tokens").alias("token"))
    long = other.select(F.col("id").alias("l"), F.col("n").alias("n_l"), F.explode("tokens").alias("token"))
    ordered = (F.col("n_s") < F.col("n_l")) | ((F.col("n_s") == F.col("n_l")) & (F.col("s") < F.col("l")))
    return short.hint("merge").join(long.hint("merge"), "token").filter(ordered & differ).groupBy("s", "l", "n_s", "n_l").agg(
        F.count("*").alias("m"), F.min("token").alias("home"))


def _compared(pairs: DataFrame, texts: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, shared) by text key for pairs(s, l, home) of ids, of which s is the smaller set.

    Whole sets are made again for texts of these pairs only. Pairs that meet at the same run go to the same task, so sets
    of a crowd are sent to few tasks, once each; tasks are as many as bound what one holds, and a crowd of many pairs is
    cut into squares.
    """
    spark = texts.sparkSession
    ids = pairs.select(F.explode(F.array("s", "l")).alias("id")).distinct()
    wanted = cut(ids.join(sets.select("id", "row", "n"), "id"))
    total = wanted.agg(F.count("*").alias("n"), F.sum("n").alias("tokens")).first()
    buckets = max(spark.sparkContext.defaultParallelism, -(-8 * int(total["tokens"] or 0) // BUCKET), -(-pairs.count() // (4 * CROWD)))
    whole = _one_each(mapped(perhaps_in(texts, F.col("row"), wanted.select(F.col("row").alias("number")), total["n"]), "text_key string, tokens array<bigint>",
                             lambda r: [pa.array(r.keys, pa.string()), _lists(r.start, r.tokens)])).select("id", "text_key", "tokens")
    crowds = pairs.groupBy("home").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("home", F.ceil(F.sqrt(F.col("n") / CROWD)).alias("sides"))
    side = [F.pmod(F.xxhash64(F.col(c), F.lit(i)), F.coalesce("sides", F.lit(1))) for i, c in enumerate("sl")]
    dealt = pairs.join(F.broadcast(crowds), "home", "left").select("s", "l", F.pmod(F.xxhash64("home", *side), F.lit(buckets)).cast("int").alias("bucket"))
    members = dealt.select(F.col("bucket").alias("in"), F.explode(F.array("s", "l")).alias("id")).distinct().join(whole, "id")
    kinds = pa.schema([("a", pa.string()), ("b", pa.string()), ("n_a", pa.int32()), ("n_b", pa.int32()), ("shared", pa.int32())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        order = np.argsort(right["id"].to_numpy(), kind="stable")
        ids, lists = right["id"].to_numpy()[order], pa.concat_arrays(right["tokens"].chunks)
        start, flat = lists.offsets.to_numpy()[:-1][order], lists.values.to_numpy()
        size = np.diff(lists.offsets.to_numpy())[order]
        by = np.lexsort((left["s"].to_numpy(), left["l"].to_numpy()))
        s, l = (np.searchsorted(ids, left[c].to_numpy()[by]) for c in ("s", "l"))
        edges = np.flatnonzero(np.concatenate([[True], l[1:] != l[:-1], [True]]))
        shared = np.zeros(len(s), np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            large = flat[start[l[a]]:start[l[a]] + size[l[a]]]
            # Some of the smaller sets at a time, about as much as the larger one can have beside it.
            step = max(1, CHUNK // max(1, int(size[s[a:b]].max())))
            for at in range(a, b, step):
                mine = s[at:min(b, at + step)]
                small = np.concatenate([flat[start[i]:start[i] + size[i]] for i in mine])
                place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                shared[at:at + len(mine)] = np.add.reduceat((large[place] == small).astype(np.int64), _ends(size[mine])[:-1])
        names = pa.concat_arrays(right["text_key"].chunks)
        return pa.Table.from_arrays([*(names.take(pa.array(order[x])) for x in (s, l)), *(pa.array(x, pa.int32()) for x in (size[s], size[l], shared))], schema=kinds)

    return dealt.groupBy("bucket").cogroup(members.groupBy("in")).applyInArrow(compare, "a string, b string, n_a int, n_b int, shared int")


def alike(texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score): all pairs of different texts, by text key, whose sets of runs have a Jaccard similarity of `threshold` or more.

    texts(row, text): lower-cased texts under a number that tells rows apart as a rule. Two such sets share one of the
    first n - ceil(t*n) + 1 runs of each in any order that holds for all sets. How many of those they share bounds
    the rest; what is left is compared whole.
    """
    firsts = cut(_one_each(_prefixes(texts, threshold, 0.0, common_runs(texts))))
    met = _meeting(firsts, firsts, F.col("n_s") >= F.lit(threshold) * F.col("n_l") - F.lit(1e-9))
    beyond = F.greatest(F.col("n_s") - _prefix_column("n_s", threshold, 0.0), F.col("n_l") - _prefix_column("n_l", threshold, 0.0))
    need = F.lit(threshold / (1 + threshold)) * (F.col("n_s") + F.col("n_l")) - F.lit(1e-6)
    pairs = cut(met.filter(F.col("m") + beyond >= need).select("s", "l", "home"))
    score = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    return _compared(pairs, texts, firsts).select("a", "b", score.alias("score")).filter(F.col("score") >= F.lit(threshold) - F.lit(1e-12))


def contained(texts: DataFrame, threshold: float, common: np.ndarray | None = None) -> DataFrame:
    """(a, b, score): all pairs of different texts that share `threshold` or more of the runs of the smaller set, each pair once.

    texts(row, text) as for `alike`. The smaller set is found by its first n - ceil(t*n) + 1 runs and some more. Numbers
    are spread evenly, so those are small ones as a rule; of a larger set go only runs as small, and such as a table
    of bits says that a smaller set may be found by.
    """
    spark = texts.sparkSession
    firsts = cut(_one_each(_prefixes(texts, threshold, BEYOND, common_runs(texts) if common is None else common)))
    share = 1.5 * (1 - threshold + BEYOND)
    bound = LOWEST + int(share * SPAN) if share < 1 else None
    if bound is None:
        sent = lambda r: np.ones(len(r.tokens), bool)
    else:
        far = cut(firsts.select(F.explode("tokens").alias("number")).filter(F.col("number") >= F.lit(bound)))
        bits, words = _bits(far, "number", far.count())
        rows = bits.toArrow()
        table = np.zeros(words, np.int64)
        table[rows["word"].to_numpy()] = rows["bits"].to_numpy()
        known = spark.sparkContext.broadcast(table)

        def sent(r: Runs) -> np.ndarray:
            bit = r.tokens & (words * 64 - 1)
            return (r.tokens < bound) | ((known.value[bit >> 6] >> (bit & 63)) & 1).astype(bool)

    def probes(r: Runs) -> list:
        own = sent(r)
        return [pa.array(r.keys, pa.string()), pa.array(r.n, pa.int32()), _lists(_ends(own)[r.start], r.tokens[own])]

    # A copy that gets past the table counts what a text shares twice, which makes a candidate at most.
    one = perhaps_in(texts, F.col("row"), firsts.select(F.col("row").alias("number")), firsts.count())
    others = mapped(one, "text_key string, n int, tokens array<bigint>", probes).filter("n > 0").withColumn("id", F.xxhash64("text_key"))
    met = _meeting(firsts, others, F.lit(True))
    rest = F.col("n_s") - _prefix_column("n_s", threshold, BEYOND)
    pairs = cut(met.filter(F.col("m") + rest >= F.lit(threshold) * F.col("n_s") - F.lit(1e-9)).select("s", "l", "home"))
    score = F.col("shared") / F.col("n_a")
    return _compared(pairs, texts, firsts).select("a", "b", score.alias("score")).filter(F.col("score") >= F.lit(threshold) - F.lit(1e-12))
