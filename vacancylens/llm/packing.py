"""Packing of tokenised documents into fixed-length sequences: dominance reduction, then best fit."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacancylens.llm.common import saved, ship, word_codes

LENGTH = 4096
END_ID = 1
GROUP_PIECES = 16_384
CACHE_PARTS = 250_000
BATCH_BYTES = 4 << 20
MARK = np.array([0xFFFFFFFF], "<u4")  # no id; stands for the blank behind a chunk
PLAIN = re.compile(r"[\x00-\xff]*")
# How the tokenizer cuts lower-case chunks of Latin-1 characters into parts, here with blanks between the chunks.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºßà-öø-ÿ]+|[0-9²³¹¼-¾]|[^0-9a-zªµºßà-öø-ÿ²³¹¼-¾\x85\xa0 ]+| ")

_encoders: dict[str, Callable[[pa.Array | list[str | None]], list[bytes]]] = {}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the numbered stretches of a pool, one behind the other; where each begins, and where the last one ends)."""
    took = sizes[number]
    upto = np.concatenate(([0], np.cumsum(took)))
    return pool[np.repeat(starts[number] - upto[:-1], took) + np.arange(upto[-1])], upto


def encoder(path: str) -> Callable[[pa.Array | list[str | None]], list[bytes]]:
    """A function from texts to their ids, as little-endian unsigned 32-bit numbers, by the tokenizer file at `path`.

    The tokenizer never joins characters across white space, so a text's ids are those of its white-space-free chunks, and
    a chunk of Latin-1 characters has those of its parts, which go to the vocabulary's model, all new ones in one call.
    Other chunks, and those that might hold a special token, take the tokenizer's whole way. Chunks are worked out once
    for all texts of a call. Ids of parts and of other chunks stay in two bounded generations, which a Python worker
    keeps from task to task: when the younger one is full it becomes the older one, and what is read is young again.
    """
    if path not in _encoders:
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        by_model = Tokenizer(tokenizer.model)
        by_model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        letters = {b: "".join(_byte_letters()[c] for c in chr(b).encode()) for b in range(256) if chr(b) != " "}
        closes = np.zeros(1 + max(tokenizer.get_vocab().values()), bool)  # ids that stand at the end of a part, and only there
        closes[[i for name, i in tokenizer.get_vocab().items() if name.endswith(tokenizer.model.end_of_word_suffix)]] = True
        young: dict[str, bytes] = {}
        old: dict[str, bytes] = {}

        def ids_of(names: list[str], whole: set[str]) -> list[bytes]:
            nonlocal young, old
            if len(young) > CACHE_PARTS:
                young, old = {}, young
            young[" "] = MARK.tobytes()
            held = list(map(young.get, names))
            absent = [n for n, ids in zip(names, held) if ids is None]
            if not absent:
                return held
            fresh = {n: old[n] for n in absent if n in old}
            others = [n for n in absent if n in whole and n not in fresh] if whole else []
            fresh.update(zip(others, [np.array(f.ids, "<u4").tobytes() for f in tokenizer.encode_batch_fast(others, add_special_tokens=False)]))
            new = [n for n in absent if n not in fresh]
            if new:
                ids = np.array(by_model.encode_batch_fast([" ".join(new).translate(letters)], add_special_tokens=False)[0].ids, "<u4")
                ends = (4 * np.flatnonzero(closes[ids]) + 4).tolist()
                if len(ends) != len(new):
                    raise ValueError(f"{path}: parts of words do not end in ids of their own")
                data = ids.tobytes()
                fresh.update(zip(new, [data[a:b] for a, b in zip([0, *ends], ends)]))
            young.update(fresh)
            return [fresh[n] if ids is None else ids for n, ids in zip(names, held)]

        def encode(texts: pa.Array | list[str | None]) -> list[bytes]:
            number, chunks, per_text = word_codes(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
            joined = pc.binary_join(pa.ListArray.from_arrays([0, len(chunks)], chunks), " ")[0].as_py() + " " * (len(chunks) > 0)
            order, whole = None, []
            if "<|" in joined or not PLAIN.fullmatch(joined):
                names = joined.split(" ")[:-1]
                odd = np.array(["<|" in c or not PLAIN.fullmatch(c) for c in names])
                order, whole = np.argsort(odd, kind="stable"), [c for c, o in zip(names, odd) if o]
                joined = "".join([c + " " for c, o in zip(names, odd) if not o])
            parts = pa.array(PARTS.findall(joined.lower()) + [n for c in whole for n in (c, " ")], pa.string()).dictionary_encode()
            known = ids_of(parts.dictionary.to_numpy(zero_copy_only=False).tolist(), set(whole))
            lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
            pool, _ = _gathered(np.frombuffer(b"".join(known), "<u4"), np.cumsum(lengths) - lengths, lengths, parts.indices.to_numpy())
            ends = np.flatnonzero(pool == MARK)
            starts = np.concatenate(([0], ends + 1))[:-1]
            if order is not None:
                starts[order], ends[order] = starts.copy(), ends.copy()
            data, upto = _gathered(pool, starts, ends - starts, number)
            data, cuts = data.tobytes(), (4 * upto[np.concatenate(([0], np.cumsum(per_text)))]).tolist()
            return [data[a:b] for a, b in zip(cuts, cuts[1:])]

        _encoders[path] = encode
    return _encoders[path]


def _encoded(encode: Callable[[pa.Array], list[bytes]], texts: pa.Array) -> Iterator[bytes]:
    """The ids of all texts, a bounded number of bytes at a time, or one text."""
    group = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)) // BATCH_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        yield from encode(texts.slice(a, b - a))


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH,
           end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]): every document's ids and the end id, cut only where over `length`.

    A null text is an empty one, whose only id is the end id. Equal rows give equal pieces each.
    """
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
        + ([T.StructField("ids", T.BinaryType())] if with_ids else []))
    ending = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            took, rows = [], {"piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
            for i, ids in enumerate(_encoded(encode, batch.column(1))):
                ids += ending
                for n, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at: at + 4 * length]
                    took.append(i)
                    for name, value in (("piece", n), ("start", at // 4), ("length", len(part) // 4), ("ids_crc32", zlib.crc32(part))):
                        rows[name].append(value)
                    if with_ids:
                        rows["ids"].append(part)
            arrays = [batch.column(0).take(pa.array(took, pa.int64())), pa.array(rows["piece"], pa.int32()),
                      *(pa.array(rows[c], pa.int64()) for c in ("start", "length", "ids_crc32"))]
            if with_ids:
                arrays.append(pa.array(rows["ids"], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    ship(docs.sparkSession)
    return docs.select(key, text).mapInArrow(cut, schema)


def place(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every item, by dominance reduction and best fit.

    The reduction of Martello and Toth fixes a bin for good where its items are at least as good as any other company
    for its largest item: an item that fills the bin; an item and a partner that fill it exactly; the largest item and
    its largest fitting partner (or none) where no two others fit beside it, or where that partner is at least as long
    as any two that fit where no three do. What is left is packed best fit, longest first: each item goes where the
    least room stays.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    order = np.argsort(sizes, kind="stable")
    queues: dict[int, list[int]] = {}
    for i in order[::-1]:
        queues.setdefault(int(sizes[i]), []).append(int(i))
    count = 0

    def fix(*lengths: int) -> None:
        nonlocal count
        at = 0
        for n in lengths:
            i = queues[n].pop()
            bins[i], offsets[i] = count, at
            at += n
            if not queues[n]:
                del queues[n]
        count += 1

    for n in sorted(queues, reverse=True):
        while n in queues and n == room:
            fix(n)
        while n in queues and n < room and room - n in queues and (2 * n != room or len(queues[n]) > 1):
            fix(n, room - n)

    def company(n: int) -> tuple[int, ...] | None:
        """The company that dominates all others for the longest item, if this can be told."""
        left = room - n
        lengths = sorted(k for k in queues if k <= left)
        small = [k for k in lengths for _ in range(min(3, len(queues[k]) - (k == n)))][:3]
        if not small:
            return ()
        single = max(k for k in lengths if len(queues[k]) - (k == n) > 0)
        if len(small) < 2 or sum(small[:2]) > left:
            return (single,)
        if len(small) < 3 or sum(small) > left:
            pair = 0
            for a in lengths:
                at = bisect_right(lengths, left - a) - 1
                while at >= 0 and lengths[at] == a and len(queues[a]) - (a == n) < 2:
                    at -= 1
                if at >= 0:
                    pair = max(pair, a + lengths[at])
            if single >= pair:
                return (single,)
        return None

    while queues:
        longest = max(queues)
        found = company(longest)
        if found is None:
            break
        fix(longest, *found)

    # Best fit: open bins by the room left, and one number whose bits say which rooms are there.
    open_bins: dict[int, list[tuple[int, int]]] = {}
    rooms = 0
    for n in sorted(queues, reverse=True):
        for i in queues[n]:
            fitting = rooms >> n
            if fitting:
                left = n + (fitting & -fitting).bit_length() - 1
                b, at = open_bins[left].pop()
                if not open_bins[left]:
                    rooms ^= 1 << left
            else:
                left, b, at = room, count, 0
                count += 1
            bins[i], offsets[i] = b, at
            left -= n
            if left:
                open_bins.setdefault(left, []).append((b, at + n))
                rooms |= 1 << left
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH,
         end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset): where every piece of every document stands.

    Pieces are dealt at random, by their row in the written table of pieces, to groups of about `group_pieces`, and each
    group is packed by itself, which costs at most one unfilled sequence per group. Null and empty texts are pieces of one
    id; equal rows are packed each; a text over `length` ids gives full pieces and a last one; an empty table gives an
    empty result. Other columns are not read.
    """
    cut = saved(pieces(docs, tokenizer, key, text, length, end_id), "pack-pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fill(group: pa.Table) -> pa.Table:
        bins, offsets = place(group["length"].to_numpy(), length)
        number = group["group"][0].as_py() if len(group) else 0
        return group.drop_columns(["group"]).append_column("sequence_id", pa.array(bins + (number << 32))).append_column("offset", pa.array(offsets))

    return cut.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long")).groupBy(
        "group").applyInArrow(fill, schema)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH,
              end_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids): the token sequences themselves, for documents with keys of their own."""
    ids = pieces(docs, tokenizer, key, text, length, end_id, with_ids=True).select(key, "piece", "ids")
    return packed.join(ids, [key, "piece"]).groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda all_ids, p: F.concat(all_ids, p["ids"])).alias("ids"))
