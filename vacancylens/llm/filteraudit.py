"""Audit of how filters overlap: count-weighted decision diagrams of failure masks, reordered level by level."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancylens.llm.common import saved, ship

WORD = r"[^\x20\x09-\x0D]+"
Counts = tuple[int, ...]


def conditions(text: Column) -> dict[str, Column]:
    """Failure conditions of a text: few words, repeated words, capitals, marks."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


class Diagram:
    """A decision diagram from failure masks to count vectors: level by level a filter's pass and fail branch.

    Equal nodes are one node. A node's weight is the sum of the counts below it, so the fail branch along the all-pass
    path weighs what that step removes.
    """

    def __init__(self, order: str, leaves: Mapping[int, Counts], letters: str):
        self.order = list(order)
        self.low: list[int] = []
        self.high: list[int] = []
        self.weight: list[Counts] = []
        self.known: dict[tuple, int] = {}
        nothing = (0,) * len(next(iter(leaves.values())))
        bits = [1 << letters.index(x) for x in order]

        def build(level: int, mask: int) -> int:
            if level == len(bits):
                return self._leaf(leaves.get(mask, nothing))
            return self._node(build(level + 1, mask), build(level + 1, mask | bits[level]))

        self.root = build(0, 0)

    def _leaf(self, counts: Counts) -> int:
        return self._add(("leaf", counts), -1, -1, counts)

    def _node(self, low: int, high: int) -> int:
        return self._add((low, high), low, high, None)

    def _add(self, key: tuple, low: int, high: int, weight: Counts | None) -> int:
        at = self.known.get(key)
        if at is None:
            at = self.known[key] = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.weight.append(weight or tuple(a + b for a, b in zip(self.weight[low], self.weight[high])))
        return at

    def swap(self, level: int) -> None:
        """Exchange a level with the one below: the two middle grandchildren of its nodes change places."""
        done: dict[int, int] = {}

        def walk(node: int, depth: int) -> int:
            if node not in done:
                low, high = self.low[node], self.high[node]
                if depth < level:
                    done[node] = self._node(walk(low, depth + 1), walk(high, depth + 1))
                else:
                    done[node] = self._node(self._node(self.low[low], self.low[high]), self._node(self.high[low], self.high[high]))
            return done[node]

        self.root = walk(self.root, 0)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[str, Counts, Counts]]:
        """Along the all-pass path: each filter, what it removes and what it leaves."""
        node = self.root
        for letter in self.order:
            yield letter, self.weight[self.high[node]], self.weight[self.low[node]]
            node = self.low[node]


def plain_changes(n: int) -> Iterator[int]:
    """Adjacent exchanges that lead through all orders of n items, each order once."""
    if n < 2:
        return
    down = True
    for inner in [*plain_changes(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if inner is not None:
            yield inner + 1 if down else inner
        down = not down


def part_audit(letters: str, leaves: Mapping[int, Counts]) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique, good lost, toxic lost, shapley) for all orders of one part."""
    diagram = Diagram(letters, leaves, letters)
    found = [("".join(diagram.order), list(diagram.steps()))]
    for level in plain_changes(len(letters)):
        diagram.swap(level)
        found.append(("".join(diagram.order), list(diagram.steps())))
    fails, alone, credit = {}, {}, dict.fromkeys(letters, 0)
    for _, steps in found:
        fails[steps[0][0]] = steps[0][1][0]
        alone[steps[-1][0]] = steps[-1][1][0]
        for letter, removed, _ in steps:
            credit[letter] += removed[0]
    return [
        (order, i, kept[0], removed[0], fails[x] - removed[0], alone[x], removed[1], removed[2], credit[x])
        for order, steps in found for i, (x, removed, kept) in enumerate(steps, 1)
    ]


def mask_counts(docs: DataFrame, labels: DataFrame, failures: Callable[[Column], Mapping[str, Column]] = conditions,
                repeat: str = "E", key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, str]:
    """(part, mask, n, good, toxic) with at most one row per part and mask, and the letters of the mask's bits, lowest first.

    `failures` gives conditions of a text by letter; `repeat` is the letter of texts that a smaller key holds too. Texts
    are compared by SHA-256. Copies fold to one row per part, label and text before a text's smallest key is looked for.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rules = failures(F.col("body"))
    letters = "".join(rules) + repeat
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(rules.values())), F.lit(0))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(source), F.lit("")).alias("part"), body.alias("body")).select(
        "key", "part", F.unhex(F.sha2("body", 256)).alias("digest"), bits.cast("int").alias("mask"))
    folded = rows.groupBy("key", "part", "digest", "mask").agg(F.count("*").alias("n"))
    named = labels.groupBy(F.col(key).alias("key")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).withColumn("spread", F.lit(0).cast("long"))
    # Null keys match no label; they are spread so that they do not meet in one task.
    folded = folded.withColumn("spread", F.when(F.col("key").isNull(), F.xxhash64("digest")).otherwise(0))
    labelled = folded.join(named, ["key", "spread"], "left").select(
        "key", "part", "digest", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    lowest = F.min(F.when(F.col("key").isNotNull(), F.struct("key", "n")))
    texts = labelled.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("unkeyed"), lowest.alias("low"))
    first = texts.groupBy("digest").agg(F.min("low.key").alias("first"))
    keeps = F.col("unkeyed") + F.when(F.col("low.key") == F.col("first"), F.col("low.n")).otherwise(0)
    split = texts.join(first, "digest").select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("mask"), keeps.alias("n")),
            F.struct((F.col("mask") + (1 << len(rules))).alias("mask"), (F.col("n") - keeps).alias("n")))).alias("s"))
    counts = split.filter("s.n > 0").groupBy("part", "s.mask").agg(
        F.sum("s.n").alias("n"), F.sum(F.when(F.col("good"), F.col("s.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("s.n")).otherwise(0)).alias("toxic"))
    return counts, letters


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per part, order of the filters and step: what the step keeps and removes, and how much others would have.

    See `mask_counts` for the options. A part is a source; null and the empty source are one part. Null texts are empty;
    a null key repeats no text and no text repeats it; rows that share a key and a text repeat no smaller key; labels
    that disagree about a key count as 1 where one says so. Whole texts are read; an empty table gives no rows; other
    columns are not read. A part comes to its task as at most one row per mask; n filters give n! orders, so keep to 7.
    """
    ship(docs.sparkSession)
    counts, letters = mask_counts(docs, labels, **options)

    def run(rows: pa.Table) -> pa.Table:
        leaves = {m: (n, g, t) for m, n, g, t in zip(*(rows[c].to_pylist() for c in ("mask", "n", "good", "toxic")))}
        columns = list(zip(*part_audit(letters, leaves)))
        names = [f.split()[0] for f in AUDIT.split(", ")][1:]
        kinds = [pa.string(), pa.int32()] + [pa.int64()] * 7
        out = {"part": pa.array([rows["part"][0].as_py()] * len(columns[0]), pa.string())}
        return pa.table(out | {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})

    return saved(counts, "audit-masks").groupBy("part").applyInArrow(run, AUDIT)


ORACLE_SQL = """with base as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as body,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
  lab as (select doc_id, max(coalesce(quality = 1, false)::int) as good, max(coalesce(toxic = 1, false)::int) as toxic from labels group by doc_id),
  m as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, (len(ws) < 200)::int as a,
    (100 * len(list_distinct(ws)) < 50 * len(ws))::int as b,
    (100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body))::int as c,
    regexp_matches(body, '[#$%&*|]')::int as d, coalesce(doc_id > min(doc_id) over (partition by body), false)::int as e
    from base left join lab using (doc_id)),
  v as (select part, [a, b, c, d, e] as f, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by all),
  l(i) as (values (1), (2), (3), (4), (5)),
  o as (select [p.i, q.i, r.i, s.i, t.i] as ord from l p, l q, l r, l s, l t
    where p.i <> q.i and p.i <> r.i and p.i <> s.i and p.i <> t.i and q.i <> r.i and q.i <> s.i and q.i <> t.i and r.i <> s.i and r.i <> t.i and s.i <> t.i),
  st as (select ord, array_to_string(list_transform(ord, lambda x: substr('ABCDE', x, 1)), '') as filter_order, step, ord[step] as x,
    ord[1:step - 1] as before from o, (select unnest([1, 2, 3, 4, 5]) as step)),
  z as (select part, filter_order, step, x, n, good, toxic, f[x] = 1 as fails,
    list_sum(list_transform(before, lambda y: f[y])) > 0 as gone, list_sum(f) = 1 as once from v, st),
  r as (select part, filter_order, step, x, sum(case when not fails and not coalesce(gone, false) then n else 0 end)::bigint as kept,
    sum(case when fails and not coalesce(gone, false) then n else 0 end)::bigint as removed,
    sum(case when fails and coalesce(gone, false) then n else 0 end)::bigint as redundant,
    sum(case when fails and once then n else 0 end)::bigint as unique_fails,
    sum(case when fails and not coalesce(gone, false) then good else 0 end)::bigint as good_lost,
    sum(case when fails and not coalesce(gone, false) then toxic else 0 end)::bigint as toxic_lost
    from z group by part, filter_order, step, x)
  select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) over (partition by part, x))::bigint as shapley from r"""
