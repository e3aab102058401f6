"""Language identification: scripts narrow the candidates, Viterbi over per-word scores labels spans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancylens.llm.common import crc32_text, ship, uniform

NONE = "und"
TRAIN_DOCS = 3000
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
SWITCH = 8.0
SCALE = 0.5
FOREIGN = -1000.0
SCRIPT_SHARE = 0.01
CHUNK = 1 << 20

# First code points of script ranges. Code points before a range's end that are no letters do not matter.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x07C0, "other"), (0x0860, "arabic"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "odia"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
    (0x1800, "mongolian"), (0x18B0, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1D00, "latin"),
    (0x1F00, "greek"), (0x2000, "latin"), (0x2C00, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"),
    (0x2E00, "other"), (0x3040, "kana"), (0x3100, "bopomofo"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"),
    (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"),
    (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"), (0x30000, "han"), (0x40000, "other"),
)
SCRIPT_NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """(lower-case code point of a letter and 0 of anything else, number of its script) for every code point."""
    lower = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            small = ch.lower()
            lower[c] = ord(small) if len(small) == 1 else c
    starts = np.array([s for s, _ in SCRIPTS])
    number = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS], np.int8)
    return lower, number[np.searchsorted(starts, np.arange(0x110000), side="right") - 1]


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")


def _grams(seq: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, places, buckets): hashed character n-grams of the words of a sequence with 0 between words.

    An n-gram reaches back from its place, stops at the blank before the word and may end at the blank after it.
    """
    padded = np.concatenate((np.zeros(max(ORDERS), np.uint32), seq))
    n, at = len(seq), max(ORDERS)
    back = [padded[at - k: at - k + n] for k in range(max(ORDERS))]
    for k in range(2, len(back)):
        back[k] = np.where(back[k - 1] == 0, 0, back[k])
    inside = back[0] != 0
    ending = ~inside & (back[1] != 0) if len(back) > 1 else np.zeros_like(inside)
    h = np.zeros(n, np.uint32)
    for order in range(1, max(ORDERS) + 1):
        h = (h ^ back[order - 1]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if order in ORDERS:
            places = np.flatnonzero(inside if order == 1 else inside | ending)
            yield order, places, ((h[places] * np.uint32(0x85EBCA77)) >> np.uint32(16)).astype(np.int64)


def gram_counts(points: np.ndarray) -> np.ndarray:
    """Counts by order and bucket, flat."""
    out = np.zeros(len(ORDERS) * BUCKETS, np.int64)
    seq = _letters()[0][np.minimum(points, 0x10FFFF)]
    for order, _, buckets in _grams(seq):
        at = ORDERS.index(order) * BUCKETS
        out[at: at + BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
    return out


@dataclass
class Languages:
    names: list[str] = field(default_factory=list)
    logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # (order and bucket, language)
    uses: np.ndarray = field(default_factory=lambda: np.zeros((0, len(SCRIPT_NAMES)), bool))

    def words(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, scores) of a text's words, which are runs of letters; long texts are read in chunks."""
        lower, script_of = _letters()
        found = []
        at = 0
        while at < len(points):
            end = min(at + CHUNK, len(points))
            if end < len(points):  # cut after the last blank of the chunk, if it has one
                blanks = np.flatnonzero(lower[points[at:end]] == 0)
                end = at + int(blanks[-1]) + 1 if len(blanks) else end
            seq = np.concatenate((lower[points[at:end]], np.zeros(1, np.uint32)))
            inside = seq != 0
            starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
            ends = np.flatnonzero(~inside & np.concatenate(([False], inside[:-1])))
            if len(starts):
                total = np.zeros((len(starts), len(self.names)), np.float32)
                for order, places, buckets in _grams(seq):
                    rows = self.logs[ORDERS.index(order) * BUCKETS + buckets]
                    total += np.add.reduceat(rows, np.searchsorted(places, starts), axis=0)
                total *= SCALE
                allowed = self.uses[:, script_of[points[at + starts]]].T
                total[~allowed & allowed.any(1, keepdims=True)] += FOREIGN
                found.append((starts + at, ends + at, total))
            at = end
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(self.names)), np.float32)
        return tuple(np.concatenate(x) for x in zip(*found))

    def label(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text the (start, end, language number) of its words, along the best path of all texts at once."""
        parts = [self.words(code_points(t)) for t in texts]
        sizes = np.array([len(p[0]) for p in parts], np.int64)
        if not self.names or not sizes.sum():
            return [(s, e, np.zeros(len(s), np.int64)) for s, e, _ in parts]
        scores = np.concatenate([p[2] for p in parts])
        order = np.argsort(-sizes, kind="stable")
        firsts = (np.cumsum(sizes) - sizes)[order]
        sizes_down = sizes[order]
        active = np.searchsorted(-sizes_down, -np.arange(sizes_down[0]), side="left")
        value = np.zeros((len(texts), len(self.names)))
        came = np.empty(scores.shape, np.int16)
        stay = np.arange(len(self.names), dtype=np.int16)
        for t, n in enumerate(active):
            rows, now = firsts[:n] + t, value[:n]
            best = now.argmax(1)
            top = now[np.arange(n), best][:, None] - SWITCH
            moved = (top > now) & (t > 0)
            came[rows] = np.where(moved, best[:, None], stay)
            value[:n] = np.where(moved, top, now) + scores[rows]
        path = np.empty(len(scores), np.int64)
        state = value.argmax(1)
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            rows = firsts[:n] + t
            path[rows] = state[:n]
            state[:n] = came[rows, state[:n]]
        cuts = np.cumsum(sizes)[:-1]
        return [(p[0], p[1], x) for p, x in zip(parts, np.split(path, cuts))]


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    group, held = [], 0
    for t in texts:
        if group and held + len(t or "") > CHUNK:
            yield group
            group, held = [], 0
        group.append(t)
        held += len(t or "")
    if group:
        yield group


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    return crc32_text(key) % folds == fold


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = TRAIN_DOCS) -> Languages:
    """Count hashed n-grams and scripts per language over about `per_language` documents of each, chosen by the key's hash.

    Only rows outside the held-out fold with a text and a language count. Tasks send sparse counts, which Spark adds up; the
    driver gets languages x orders x buckets numbers at most.
    """
    ship(docs.sparkSession)
    known = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("key")))
    numbers = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(numbers)
    if not names:
        return Languages()
    share = F.element_at(F.create_map(*[F.lit(v) for n in names for v in (n, min(1.0, per_language / numbers[n]))]), F.col("lang"))
    sample = known.filter(uniform(F.lit("language"), F.col("key")) < share)
    width, grams = len(SCRIPT_NAMES), len(ORDERS) * BUCKETS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, script_of = _letters()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column(0), batch.column(1).to_pylist()):
                points = code_points(t.as_py())
                row = sums.setdefault(name, np.zeros(grams + width, np.int64))
                row[:grams] += gram_counts(points)
                row[grams:] += np.bincount(script_of[points[lower[points] != 0]], minlength=width)
        for name, row in sums.items():
            cells = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(row[cells])],
                                             names=["lang", "cell", "n"])

    counts = sample.select("text", "lang").mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    names = [n for n in names if n in set(counts["lang"])]
    table = np.zeros((len(names), grams + width))
    for i, name in enumerate(names):
        own = counts[counts["lang"] == name]
        table[i, own["cell"]] = own["n"]
    logs = np.zeros((grams, len(names)), np.float32)
    for k in range(len(ORDERS)):
        part = table[:, k * BUCKETS: (k + 1) * BUCKETS] + 0.3
        logs[k * BUCKETS: (k + 1) * BUCKETS] = np.log(part / part.sum(1, keepdims=True)).T
    letters = table[:, grams:]
    return Languages(names, logs, letters >= SCRIPT_SHARE * np.maximum(letters.sum(1, keepdims=True), 1))


def _spans(starts: np.ndarray, ends: np.ndarray, path: np.ndarray, names: list[str]) -> list[dict]:
    if not len(path) or not names:
        return []
    turns = np.concatenate(([0], np.flatnonzero(np.diff(path)) + 1))
    lasts = np.concatenate((turns[1:], [len(path)])) - 1
    return [{"start": int(starts[a]), "end": int(ends[b]), "lang": names[path[a]]} for a, b in zip(turns, lasts)]


def identify(text: Column, model: Languages) -> Column:
    """struct(lang_pred, score, spans) of whole texts.

    `spans` are the runs of words with one label, by character places of the text; `lang_pred` is the language with most
    letters along the path and `score` its share of them. A null text, one without a letter, or a model without languages
    gives `und` and 0, and no spans. Ties go to the first name.
    """

    @F.pandas_udf("lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for group in _groups(texts.tolist()):
                for starts, ends, path in model.label(group):
                    if not len(starts) or not model.names:
                        rows.append((NONE, 0.0, []))
                        continue
                    held = np.bincount(path, weights=ends - starts, minlength=len(model.names))
                    best = int(held.argmax())
                    rows.append((model.names[best], float(held[best] / held.sum()), _spans(starts, ends, path, model.names)))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "spans"])

    return run(text)


def languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score, spans) of every row; only the text is an input of a prediction.

    Equal texts get equal predictions. A null key is in the fold of the empty text; an empty table gives an empty result.
    """
    model = train(docs, key, text, lang)
    return docs.select(key, held_out(F.col(key)).alias("held_out"), identify(F.col(text), model).alias("found")).select(key, "held_out", "found.*")
