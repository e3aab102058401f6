"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancylens.llm.common import crc32_text, ship

TRAIN_DOCS = 4000
TRAIN_LINES = 64
CHUNK_BYTES = 2 << 20
ROUNDS = 200
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "blank": b" \t\x0b\x0c\r",
    "stop": b".,;:?'\"()-", "shout": b"!", "bar": b"|", "mark": b"#$%&*@^~<>{}[]\\/=+_`", "lead": bytes(range(0xC0, 0x100)), "trail": bytes(range(0x80, 0xC0)),
}
OWN = ("length", "words", "upper", "digit", "blank", "stop", "shout", "bar", "mark", "lead", "word_length", "capitals", "odd_words",
       "distinct", "most", "repeated", "begins_upper", "ends_stop", "is_blank")
NEIGHBOUR = ("length", "upper", "stop", "shout", "bar", "mark", "distinct", "repeated", "is_blank")
FEATURES = len(OWN) + 2 * len(NEIGHBOUR) + 2


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, line lengths in bytes, lines per text) of all lines of the texts, in order; an empty text is one line."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    stops = np.flatnonzero(buffer == 10)
    starts = np.concatenate(([0], stops[:-1] + 1))
    length = (stops - starts).astype(np.float64)
    per_text = np.array([t.count(b"\n") + 1 for t in texts], np.int64)

    def tally(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (sums[stops] - sums[starts]).astype(np.float64)

    member = {}
    for name, chars in CLASSES.items():
        lookup = np.zeros(256, bool)
        lookup[list(chars)] = True
        member[name] = lookup[buffer]
    count = {name: tally(mask) for name, mask in member.items()}
    blank = member["blank"] | (buffer == 10)
    begins = ~blank & np.concatenate(([True], blank[:-1]))
    count["words"], count["capitals"] = tally(begins), tally(begins & member["upper"])
    odd = member["mark"] | member["bar"] | member["shout"]
    count["odd_words"] = tally(odd & np.concatenate((blank[1:], [True])))

    distinct, most, repeated = np.ones(len(starts)), np.zeros(len(starts)), np.zeros(len(starts))
    at = 0
    for text in texts:
        seen: dict[bytes, int] = {}
        for line in text.split(b"\n"):
            words = line.split()
            if words:
                distinct[at] = len(set(words)) / len(words)
                most[at] = words.count(words[-1]) / len(words)
                if line in seen:
                    repeated[at] = repeated[seen[line]] = 1
                seen[line] = at
            at += 1
    full = np.maximum(length, 1)
    words = np.maximum(count["words"], 1)
    own = {
        "length": np.log1p(length), "words": np.log1p(count["words"]), "upper": count["upper"] / np.maximum(count["upper"] + count["lower"], 1),
        **{k: count[k] / full for k in ("digit", "blank", "stop", "shout", "bar", "mark", "lead")},
        "word_length": np.log1p((length - count["blank"] - count["trail"]) / words), "capitals": count["capitals"] / words,
        "odd_words": count["odd_words"] / words, "distinct": distinct, "most": most, "repeated": repeated,
        "begins_upper": member["upper"][starts].astype(float), "ends_stop": member["stop"][np.maximum(stops - 1, 0)].astype(float),
        "is_blank": (count["words"] == 0).astype(float),
    }
    firsts = np.cumsum(per_text) - per_text
    lasts = firsts + per_text - 1
    around = np.stack([own[k] for k in NEIGHBOUR], 1)
    before, after = np.roll(around, 1, 0), np.roll(around, -1, 0)
    before[firsts], after[lasts] = 0, 0
    edges = np.zeros((len(starts), 2))
    edges[firsts, 0], edges[lasts, 1] = 1, 1
    return np.concatenate([np.stack([own[k] for k in OWN], 1), before, after, edges], 1), length, per_text


def _by_step(per_text: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[int, np.ndarray]]]:
    """Texts with most lines first, and for every step the lines at that place of the texts that still have one."""
    order = np.argsort(-per_text, kind="stable")
    firsts = (np.cumsum(per_text) - per_text)[order]
    sizes = per_text[order]
    active = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")
    return firsts, ((t, firsts[:n] + t) for t, n in enumerate(active))


def forward_backward(scores: np.ndarray, moves: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginal of a good line, summed marginals of the four moves, log partition up to the lines' own constants).

    scores: log odds that a line is good by itself. moves: log weight of (label, next label), bad before good. All texts
    advance together, one line a step; numbers are scaled at every step, so that long chains neither vanish nor overflow.
    """
    good = 1 / (1 + np.exp(-np.clip(scores, -500, 500)))
    emit = np.stack([1 - good, good], 1) + 1e-300
    weight = np.exp(moves)
    alpha, beta, scale = np.empty_like(emit), np.ones_like(emit), np.empty(len(emit))
    _, steps = _by_step(per_text)
    steps = list(steps)
    for t, rows in steps:
        a = emit[rows] * (alpha[rows - 1] @ weight if t else 0.5)
        scale[rows] = a.sum(1)
        alpha[rows] = a / scale[rows, None]
    pairs = np.zeros((2, 2))
    for t, rows in reversed(steps):
        if t:
            onward = emit[rows] * beta[rows]
            back = onward @ weight.T
            joint = alpha[rows - 1][:, :, None] * weight[None] * onward[:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            beta[rows - 1] = back / back.sum(1, keepdims=True)
    both = alpha * beta
    return both[:, 1] / both.sum(1), pairs, np.log(scale)


@dataclass
class Crf:
    """Weights of the lines' features, of the moves between labels, and of the step from lines to a document."""

    centre: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    spread: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    bias: float = 0.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    tilt: tuple[float, float] = (0.0, 1.0)

    def document_evidence(self, texts: list[bytes]) -> np.ndarray:
        """Log odds of the length-weighted mean of the lines' marginals, per text."""
        features, length, per_text = line_features(texts)
        scores = ((features - self.centre) / self.spread) @ self.weights + self.bias
        marginal, _, _ = forward_backward(scores, self.moves, per_text)
        firsts = np.cumsum(per_text) - per_text
        mean = np.add.reduceat(marginal * (length + 1), firsts) / np.add.reduceat(length + 1, firsts)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """A quality between 0 and 1 per text. Texts are read in chunks of bounded size."""
        out = np.empty(len(texts))
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) <= CHUNK_BYTES):
                held += len(texts[end])
                end += 1
            out[at:end] = 1 / (1 + np.exp(-(self.tilt[0] + self.tilt[1] * self.document_evidence(texts[at:end]))))
            at = end
        return out


def fit(features: list[np.ndarray], lengths: list[np.ndarray], labels: np.ndarray, rounds: int = ROUNDS, pull: float = 1e-3) -> Crf:
    """Train by gradient steps on the conditional likelihood of the line labels, a document's label standing for its lines.

    Every document weighs the same, whatever its number of lines. Without both labels the model gives one half, or
    the only label's side.
    """
    if len(labels) == 0 or labels.min() == labels.max():
        rate = (labels.sum() + 1) / (len(labels) + 2) if len(labels) else 0.5
        return Crf(tilt=(float(np.log(rate / (1 - rate))), 0.0))
    per_text = np.array([len(f) for f in features], np.int64)
    x, length = np.concatenate(features), np.concatenate(lengths)
    y = np.repeat(labels.astype(float), per_text)
    weight = np.repeat(1 / per_text, per_text) / len(labels)
    model = Crf(centre=x.mean(0), spread=x.std(0) + 1e-6)
    x = (x - model.centre) / model.spread
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (per_text[labels == label] - 1).sum()
    theta = np.zeros(x.shape[1] + 5)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, bias, moves = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)
        marginal, pairs, _ = forward_backward(x @ w + bias, moves, per_text)
        error = (marginal - y) * weight
        slope = np.concatenate([x.T @ error + pull * w, [error.sum()], ((pairs - seen) / max(1, seen.sum()) + 0.05 * moves).ravel()])
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    model.weights, model.bias, model.moves = theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2)
    marginal, _, _ = forward_backward(x @ model.weights + model.bias, model.moves, per_text)
    firsts = np.cumsum(per_text) - per_text
    mean = np.clip(np.add.reduceat(marginal * (length + 1), firsts) / np.add.reduceat(length + 1, firsts), 1e-6, 1 - 1e-6)
    evidence = np.log(mean / (1 - mean))
    a, b = 0.0, 1.0
    for _ in range(50):  # Newton steps of a logistic fit, held back by a small pull
        p = 1 / (1 + np.exp(-(a + b * evidence)))
        d = p - labels
        g = np.array([d.sum() + 0.1 * a, (d * evidence).sum() + 0.1 * (b - 1)])
        h = p * (1 - p)
        H = np.array([[h.sum() + 0.1, (h * evidence).sum()], [(h * evidence).sum(), (h * evidence**2).sum() + 0.1]])
        move = np.linalg.solve(H, g)
        a, b = a - float(np.clip(move[0], -1, 1)), b - float(np.clip(move[1], -1, 1))
    model.tilt = (a, max(b, 0.0))
    return model


def held_out(key: Column, folds: int = 3, fold: int = 1) -> Column:
    return crc32_text(key) % folds == fold


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          most_docs: int = TRAIN_DOCS, most_lines: int = TRAIN_LINES) -> Crf:
    """Fit on a sample of the labelled documents outside the held-out fold.

    The sample is bounded: `most_docs` keys, the first by a hash, one label each (a key with both labels is left out),
    and of every document a run of at most `most_lines` lines, from a place that the key's hash gives. Null keys and
    labels are no training data.
    """
    ship(docs.sparkSession)
    marks = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).filter(
        ~held_out(F.col("key"))).groupBy("key").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other")
    chosen = marks.orderBy(F.xxhash64("key"), "key").limit(most_docs).select("key", "y")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], {"x": [], "length": []}
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                x, length, _ = line_features([_encoded(t.as_py())])
                at = 0 if len(x) <= most_lines else zlib.crc32(str(k).encode()) % (len(x) - most_lines + 1)
                keys.append(k)
                out["x"].append(x[at: at + most_lines].astype("<f4").tobytes())
                out["length"].append(length[at: at + most_lines].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out["x"], pa.binary()), pa.array(out["length"], pa.binary()), batch.column(2)],
                                             names=["key", "x", "length", "y"])

    schema = f"key {rows.schema['key'].dataType.simpleString()}, x binary, length binary, y int"
    one_each = rows.mapInArrow(extract, schema).groupBy("key").agg(F.min(F.struct("x", "length", "y")).alias("r"))
    sample = one_each.select("key", "r.*").toPandas().sort_values("key")
    return fit([np.frombuffer(b, "<f4").reshape(-1, FEATURES).astype(float) for b in sample["x"]],
               [np.frombuffer(b, "<f4").astype(float) for b in sample["length"]], sample["y"].to_numpy())


def score(text: Column, model: Crf) -> Column:
    """The quality of whole texts, between 0 and 1. A null or empty text is one empty line."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score([_encoded(t) for t in texts]), dtype="float64")

    return run(text)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(key, held_out, score, predicted) of every row of the documents.

    Labels, language, source and key are no inputs of a score, so equal texts get equal scores. A null key is in the fold
    of the empty text; an empty table gives an empty result; without labels every score is one half.
    """
    model = train(docs, labels, key, text, label)
    return docs.select(key, held_out(F.col(key)).alias("held_out"), score(F.col(text), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
