"""Language-model scoring by cross-entropy difference between a target and a background n-gram model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacancylens.llm.common import saved, ship, word_codes

BLOCK_CHARS = 4 << 20
PART_CHARS = 16 << 20
MIX = 0.5
ADD = 0.5


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


START = int(_mixed(np.array([1], np.uint64))[0]) & ~1


@dataclass
class _Tokens:
    """The words of a block's texts, in order, and its distinct keys.

    Words stand between ASCII white space, A-Z in lower case, and are known by a 64-bit hash. The lowest bit tells words (0)
    from pairs (1). The first word of a text follows a start mark.
    """

    per_text: np.ndarray  # words of each text
    text_no: np.ndarray  # the text of each word
    word: np.ndarray  # the number of each word
    before: np.ndarray  # the number of the word before it; the start mark has the one behind all words
    pair: np.ndarray  # the number of the pair that it ends
    keys: np.ndarray  # distinct keys of words, pairs and the start mark, sorted
    word_place: np.ndarray  # where the keys of numbered words and, last, of the start mark stand
    pair_place: np.ndarray  # where those of numbered pairs stand

    def own(self, number: np.ndarray, size: int) -> np.ndarray:
        """How often the numbered thing at each place stands in the same text."""
        cell, _ = pd.factorize(self.text_no * size + number)
        return np.bincount(cell)[cell]


def _tokens(texts: pa.Array) -> _Tokens:
    """The same words, numbers and keys in every pass; only distinct words and pairs are hashed and sorted."""
    word, names, per_text = word_codes(pc.ascii_lower(texts))
    word, size = word.astype(np.int64), len(names)
    hashes = pd.util.hash_array(names.to_numpy(zero_copy_only=False).astype(object), categorize=False) & ~np.uint64(1)
    hashes = np.append(hashes, np.uint64(START))
    before = np.concatenate((np.full(min(len(word), 1), size), word[:-1]))
    before[(np.cumsum(per_text) - per_text)[per_text > 0]] = size
    pair, cells = pd.factorize(before * (size + 1) + word)
    pairs = _mixed(hashes[cells // (size + 1)] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[cells % (size + 1)]) | np.uint64(1)
    keys, place = np.unique(np.concatenate((hashes, pairs)), return_inverse=True)
    return _Tokens(per_text, np.repeat(np.arange(len(per_text)), per_text), word, before, pair, keys, place[:size + 1], place[size + 1:])


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key. Parts are equal ranges of keys."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _squeezed(values: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed: the high bytes of small numbers take next to nothing."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def _numbers(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def _blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(block, payload, chars): the documents as compressed blocks of about `BLOCK_CHARS`, so that each pass sees the same ones."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, size
            table = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            row = pa.RecordBatch.from_arrays([pa.array([f"{part}-{number}"]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([size])],
                                             names=["block", "payload", "chars"])
            number, held, size = number + 1, [], 0
            return row

        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, names=["key", "text"])
            first = 0
            for i, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
                size += n or 0
                if size >= BLOCK_CHARS:
                    held.append(batch.slice(first, i + 1 - first))
                    first = i + 1
                    yield flush()
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if held:
            yield flush()

    return saved(docs.select(key, F.col(text).cast("string")).mapInArrow(gather, "block string, payload binary, chars long"), "lm-blocks")


def score(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", mix: float = MIX, add: float = ADD) -> DataFrame:
    """(key, tokens, target_loss, background_loss, score): cross entropies per token and their difference.

    target(key) names the documents of the target model; the background model holds all documents. Both are bigram models,
    interpolated with unigrams at `mix`, over one vocabulary, all words of the corpus, with `add` given to every word. A
    document is scored by what the other documents hold: its own counts are taken off both models. A low score means a
    document more like the target.

    A document without words has no losses and no score (null); null keys are scored and are never target; repeated keys are
    documents of their own, all target if the key is; an empty table gives an empty result, and without targets that model
    knows the vocabulary alone. Other columns are not read.

    Counts grow with the corpus and are never gathered in one place: each block of documents sends the distinct words and
    pairs that it holds, with its counts, to the parts of the key space; a part adds them up and answers each block. Keys
    travel as gaps between sorted keys, and all numbers compressed by byte planes.
    """
    ship(docs.sparkSession)
    blocks = _blocks(docs, key, text)
    parts = max(1, -(-(blocks.agg(F.sum("chars")).first()[0] or 0) // PART_CHARS))
    kind = docs.schema[key].dataType

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys = _unpack(payload.as_py())["key"].combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(np.arange(len(keys), dtype=np.int32)), keys], names=["block", "place", "key"])

    named = blocks.select("block", "payload").mapInArrow(keys_of, T.StructType([
        T.StructField("block", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("key", kind)]))
    marks = named.join(target.select(F.col(key).alias("key")).distinct(), "key", "left_semi").groupBy("block").agg(F.collect_list("place").alias("chosen"))
    marked = saved(blocks.select("block").join(marks, "block", "left"), "lm-marks")

    def requests(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = {"block": [], "part": [], "keys": [], "all": [], "chosen": []}
        for name, payload in zip(left["block"].to_pylist(), left["payload"]):
            seen = _tokens(_unpack(payload.as_py())["text"].combine_chunks())
            flags = np.zeros(len(seen.per_text), bool)
            flags[right["chosen"][0].as_py() or []] = True
            picked, place = flags[seen.text_no], np.concatenate((seen.word_place, seen.pair_place))
            every, some = (np.bincount(place, weights=np.concatenate((
                np.bincount(seen.word[kept], minlength=len(seen.word_place) - 1), [texts], np.bincount(seen.pair[kept], minlength=len(seen.pair_place)))))
                for kept, texts in ((slice(None), len(flags)), (picked, flags.sum())))
            keys, part = seen.keys, _part_of(seen.keys, parts)
            for p, a, b in _runs(part):
                for column, value in zip(rows, (name, p, _squeezed(np.diff(keys[a:b], prepend=np.uint64(0))), _squeezed(every[a:b].astype("<u4")), _squeezed(some[a:b].astype("<u4")))):
                    rows[column].append(value)
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(rows.items(), (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))})

    asked = blocks.select("block", "payload").groupBy("block").cogroup(marked.groupBy("block")).applyInArrow(
        requests, "block string, part long, keys binary, all binary, chosen binary")

    def answer(rows: pa.Table) -> pa.Table:
        keys = [np.cumsum(_numbers(k.as_py(), "<u8"), dtype=np.uint64) for k in rows["keys"]]
        at, known = pd.factorize(np.concatenate(keys))
        sums = [np.bincount(at, weights=np.concatenate([_numbers(k.as_py(), "<u4") for k in rows[c]])) for c in ("all", "chosen")]
        word = (known & np.uint64(1) == 0) & (known != np.uint64(START))
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        back = [[_squeezed(s.astype("<u8")) for s in np.split(total[at], cuts)] for total in sums]
        facts = [int(word.sum()), *(float(total[word].sum()) for total in sums)]
        return pa.table({"block": rows["block"].combine_chunks(), "part": rows["part"].combine_chunks(), "all": pa.array(back[0], pa.binary()), "chosen": pa.array(back[1], pa.binary()),
                         **{n: pa.array([v] * len(rows), t) for n, v, t in zip(("vocabulary", "all_tokens", "chosen_tokens"), facts, (pa.int64(), pa.float64(), pa.float64()))}})

    answers = saved(asked.groupBy("part").applyInArrow(
        answer, "block string, part long, all binary, chosen binary, vocabulary long, all_tokens double, chosen_tokens double"), "lm-answers")
    whole = answers.groupBy("part").agg(F.first("vocabulary").alias("v"), F.first("all_tokens").alias("a"), F.first("chosen_tokens").alias("c")).agg(
        F.sum("v").alias("v"), F.sum("a").alias("a"), F.sum("c").alias("c")).first()
    vocabulary, totals = float(whole["v"] or 0), (float(whole["a"] or 0), float(whole["c"] or 0))

    schema = T.StructType([T.StructField(key, kind), T.StructField("tokens", T.LongType()), T.StructField("target_loss", T.DoubleType()),
                           T.StructField("background_loss", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def losses(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        chosen = next((c for c in right["marks"].to_pylist() if c), [])
        right = right.filter(pc.is_valid(right["part"])).sort_by("part")
        for payload in left["payload"]:
            docs_of = _unpack(payload.as_py())
            seen = _tokens(docs_of["text"].combine_chunks())
            per_text, text_no = seen.per_text, seen.text_no
            own_word = seen.own(seen.word, len(seen.word_place))
            own_pair = seen.own(seen.pair, len(seen.pair_place))
            own_ahead = np.where(seen.before == len(seen.word_place) - 1, 1, np.roll(own_word, 1))  # the start mark stands once
            flags = np.zeros(len(per_text), bool)
            flags[chosen] = True
            loss = []
            for column, total, mine in (("chosen", totals[1], flags[text_no]), ("all", totals[0], np.ones(len(text_no), bool))):
                count = np.concatenate([_numbers(b.as_py(), "<u8") for b in right[column]]).astype(float)
                word, ahead, pair = (np.maximum(count[place][number] - own * mine, 0) for place, number, own in (
                    (seen.word_place, seen.word, own_word), (seen.word_place, seen.before, own_ahead), (seen.pair_place, seen.pair, own_pair)))
                single = (word + add) / (total - per_text[text_no] * mine + add * max(vocabulary, 1))
                both = np.where(ahead > 0, pair / np.maximum(ahead, 1), 0)
                weight = np.where(ahead > 0, mix, 0)
                p = -np.log(weight * both + (1 - weight) * single)
                sums = np.bincount(text_no, weights=p, minlength=len(per_text))
                loss.append(np.divide(sums, per_text, out=np.full(len(per_text), np.nan), where=per_text > 0))
            columns = [pa.array(x, pa.float64(), mask=per_text == 0) for x in (loss[0], loss[1], loss[0] - loss[1])]
            out.append(pa.table([docs_of["key"], pa.array(per_text), *columns], names=schema.names))
        return pa.concat_tables(out)

    replies = answers.select("block", "part", "all", "chosen", F.lit(None).cast("array<int>").alias("marks")).unionByName(marked.select(
        "block", F.lit(None).cast("long").alias("part"), F.lit(None).cast("binary").alias("all"), F.lit(None).cast("binary").alias("chosen"), F.col("chosen").alias("marks")))
    return blocks.select("block", "payload").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(losses, schema)


def _runs(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, first, end) of the runs of equal numbers."""
    if len(part):
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield int(part[a]), int(a), int(b)
