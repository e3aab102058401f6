"""Clusters of free-text values around their most frequent spelling."""

from __future__ import annotations

import collections
import logging
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacancylens import fixed
from vacancylens.functions.text import char_ngrams, col, shingle_hashes, strip, words
from vacancylens.functions.vectors import hash_embed, unit
from vacancylens.operators.graph import first_wins
from vacancylens.operators.setjoin import similar_pairs
from vacancylens.session import cut, ship

log = logging.getLogger(__name__)

def value_counts(df: DataFrame, value: Column | str) -> DataFrame:
    """Counts of a text or list-of-text column: (value, n). Blank values do not count."""
    c = col(value)
    kind = df.select(c.alias("v")).schema["v"].dataType.typeName()
    one = df.select(F.explode(c).alias("value")) if kind == "array" else df.select(c.alias("value"))
    trimmed = one.select(strip(F.col("value")).alias("value")).filter(F.coalesce(F.col("value") != "", F.lit(False)))
    return trimmed.groupBy("value").agg(F.count("*").alias("n"))


def field_values(df: DataFrame, field: str) -> Column:
    """A field of the posting itself, else of its judgment."""
    if field in df.columns:
        return F.col(field)
    return F.col(f"analysis.{field}")


BATCH = 4096
BLOCK = 512
SLACK = 1e-12
_LED = "field string, value string, n long, seed string, similarity double"


class Seeds:
    """Leaders in order of priority, ready to be asked which of them a value resembles first."""

    def __init__(self, vectors: np.ndarray, grams: list[np.ndarray], containment: float):
        self.vectors, self.containment = vectors, containment
        self.sizes = np.array([len(g) for g in grams], np.int64)
        flat = np.concatenate(grams) if grams else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.owners = np.repeat(np.arange(len(grams)), self.sizes)[order]
        self.keys, starts = np.unique(flat[order], return_index=True)
        self.bounds = np.append(starts, len(flat))

    def _containing(self, grams: np.ndarray) -> int | None:
        """The first leader where the smaller of the two gram sets lies in the other."""
        if not len(self.keys):
            return None
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        at = at[self.keys[at] == grams]
        if not len(at):
            return None
        met = np.bincount(np.concatenate([self.owners[self.bounds[i]:self.bounds[i + 1]] for i in at]))
        enough = (met > 0) & (met / np.maximum(np.minimum(self.sizes[: len(met)], len(grams)), 1) >= self.containment - SLACK)
        return int(enough.argmax()) if enough.any() else None

    def first(self, vectors: np.ndarray, floor: np.ndarray, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Per value the place of the first leader it resembles, or -1, and their dot product."""
        places, dots = np.full(len(vectors), -1), np.zeros(len(vectors))
        for at in range(0, len(vectors) if len(self.sizes) else 0, BLOCK):
            part = slice(at, at + BLOCK)
            sims = vectors[part] @ self.vectors.T
            close = sims >= floor[part, None] - SLACK
            best = np.where(close.any(axis=1), close.argmax(axis=1), -1)
            for i, g in enumerate(grams[part]):
                found = self._containing(g) if len(g) else None
                if found is not None and (best[i] < 0 or found < best[i]):
                    best[i] = found
            places[part] = best
            dots[part] = np.where(best >= 0, sims[np.arange(len(best)), np.maximum(best, 0)], 0.0)
        return places, dots


def _columns(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    def lists(name: str) -> tuple[np.ndarray, np.ndarray]:
        column = rows[name].combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()

    flat, _ = lists("v")
    grams, ends = lists("grams")
    return flat.reshape(rows.num_rows, -1), rows["floor"].to_numpy(), [np.unique(grams[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def _led(rows: pa.Table, seeds: list, dots: np.ndarray) -> pa.Table:
    return pa.table({"field": rows["field"], "value": rows["value"], "n": rows["n"].cast(pa.int64()), "seed": pa.array(seeds, pa.string()),
                     "similarity": pa.array(dots, pa.float64())})


def _leaders(containment: float):
    """The sequential rule over one batch of a field: a value joins the first leader it resembles or becomes one."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n", "descending"), ("value", "ascending")])
        vectors, floor, grams = _columns(rows)
        values, own, found = rows["value"].to_pylist(), np.full(rows.num_rows, -1), []
        dots = np.zeros(rows.num_rows)
        for at in range(0, rows.num_rows, BLOCK):
            part = slice(at, min(at + BLOCK, rows.num_rows))
            places, dots[part] = Seeds(vectors[found], [grams[i] for i in found], containment).first(vectors[part], floor[part], grams[part])
            own[part] = [found[p] if p >= 0 else -1 for p in places]
            fresh: list[int] = []
            holders = collections.defaultdict(list)
            for i in range(part.start, part.stop):
                if own[i] >= 0:
                    continue
                sims = vectors[fresh] @ vectors[i] if fresh else np.empty(0)
                near = np.flatnonzero(sims >= floor[i] - SLACK)
                best = fresh[near[0]] if len(near) else None
                met = collections.Counter(h for g in grams[i].tolist() for h in holders.get(g, ()))
                inside = [h for h, c in met.items() if c / min(len(grams[h]), len(grams[i])) >= containment - SLACK]
                best = min([*inside, *([] if best is None else [best])], default=None)
                if best is None:
                    own[i], dots[i] = i, float(vectors[i] @ vectors[i] > 0)
                    fresh.append(i)
                    for g in grams[i].tolist():
                        holders[g].append(i)
                else:
                    own[i], dots[i] = best, vectors[best] @ vectors[i]
            found += fresh
        return _led(rows, [values[i] for i in own], dots)

    return run


def _followers(leaders: Broadcast, containment: float):
    """Later values against one batch's leaders, field by field; null where none is resembled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {f: (names, Seeds(v, g, containment)) for f, (names, v, g) in leaders.value.items()}
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            names, vectors, floor, grams = rows["field"].to_numpy(), *_columns(rows)
            seeds, dots = np.full(rows.num_rows, None), np.zeros(rows.num_rows)
            for field in set(names.tolist()) & set(known):
                here = np.flatnonzero(names == field)
                spelt, asked = known[field]
                places, dots[here] = asked.first(vectors[here], floor[here], [grams[i] for i in here])
                seeds[here] = [spelt[p] if p >= 0 else None for p in places]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seeds.tolist(), pa.string()), pa.array(dots)],
                                             schema=batch.schema.append(pa.field("seed", pa.string())).append(pa.field("similarity", pa.float64())))

    return run


def cluster_fields(counts: DataFrame, containment: float = fixed.CLUSTER_CONTAINMENT, min_count: int = 1,
                   embedding: Column | None = None, batch: int = BATCH) -> DataFrame:
    """(field, label, value, n, similarity): each value filed under the most frequent spelling of its field it resembles.

    counts(field, value, n, floor), with `floor` the cosine of the field. Values go from the most frequent outward, ties
    by spelling. A value joins a leader at the floor or when the character 4-grams of the shorter lie in the longer.
    `embedding` gives unit vectors for `value`; the default is the deterministic bag of words. Everything here runs on
    distinct values, after counting, and all fields share the rounds.

    A round takes the first `batch` open values in that order. They are settled one after the other in a task per field;
    all later values are then held against the batch's leaders where they lie, and those that resemble one are settled
    too, by the earliest. No pair of values is ever written: work grows with values times leaders, not with pairs, so
    thousands of spellings of one thing cost one leader. What is sent around is one batch of leaders, at most `batch`
    vectors and gram sets; rounds are as many as batches of leaders and values that resemble nothing before them.
    """
    spark = counts.sparkSession
    ship(spark)
    kept = counts.filter(F.col("n") >= min_count)
    grams = F.transform(char_ngrams("value"), lambda g: F.xxhash64(g))
    left = cut(kept.select("field", "value", F.col("n").cast("long").alias("n"), F.col("floor").cast("double").alias("floor"),
                           (hash_embed("value") if embedding is None else unit(embedding)).alias("v"), grams.alias("grams")))
    empty = spark.createDataFrame([], _LED)
    settled, rounds = [empty], 0
    follows = T.StructType([*left.schema.fields, T.StructField("seed", T.StringType()), T.StructField("similarity", T.DoubleType())])
    while True:
        order = [F.desc("n"), "value", "field"]
        first = cut(left.orderBy(*order).limit(batch))
        n = first.count()
        if not n:
            break
        rounds += 1
        led = cut(first.groupBy("field").applyInArrow(_leaders(containment), _LED))
        settled.append(led)
        if n < batch:
            break
        heads = first.join(led.filter("seed = value").select("field", "value"), ["field", "value"]).orderBy(*order).toArrow()
        found = {}
        for field in set(heads["field"].to_pylist()):
            rows = heads.filter(pc.equal(heads["field"], field))
            vectors, _, sets = _columns(rows)
            found[field] = (rows["value"].to_pylist(), vectors, sets)
        leaders = spark.sparkContext.broadcast(found)
        rest = left.join(first.select("field", "value"), ["field", "value"], "left_anti")
        tried = cut(rest.mapInArrow(_followers(leaders, containment), follows))
        settled.append(tried.filter(F.col("seed").isNotNull()).select("field", "value", "n", "seed", "similarity"))
        left = tried.filter(F.col("seed").isNull()).select(left.columns)
    log.info("clusters settled after %d rounds", rounds)
    return cut(reduce(DataFrame.unionByName, settled)).select(
        "field", F.col("seed").alias("label"), "value", "n", F.bround("similarity", 4).alias("similarity"))


def cluster_values(counts: DataFrame, threshold: float = fixed.CLUSTER_COSINE, **options) -> DataFrame:
    """(label, value, n, similarity) of one field. counts(value, n); see `cluster_fields`."""
    one = counts.withColumn("field", F.lit("")).withColumn("floor", F.lit(threshold))
    return cluster_fields(one, **options).drop("field")


def keep_first(items: DataFrame, group: str, ord_col: str, text: str, n: int = fixed.QUESTION_WORDS,
               threshold: float = fixed.QUESTION_OVERLAP) -> DataFrame:
    """Ordered lists without near repeats: an item drops when it overlaps a kept earlier one of its group.

    Items too short for a word n-gram always stay. The group is part of each token, so groups never meet.
    """
    keyed = items.select(group, ord_col, text, F.struct(F.col(group), F.col(ord_col)).alias("node"))
    grams = F.transform(shingle_hashes(words(text), n), lambda g: F.xxhash64(F.col(group).cast("string"), g))
    sets = keyed.select(F.col("node").alias("id"), grams.alias("tokens"))
    pairs = similar_pairs(sets, threshold, "overlap")
    edges = pairs.select(F.least("a", "b").alias("hi"), F.greatest("a", "b").alias("lo"))
    nodes = keyed.select("node", F.col(f"node.{ord_col}").alias("priority"))
    kept = first_wins(nodes, edges).filter(F.col("node") == F.col("leader")).select(
        F.col(f"node.{group}").alias(group), F.col(f"node.{ord_col}").alias(ord_col))
    return items.join(kept, [group, ord_col], "left_semi")
