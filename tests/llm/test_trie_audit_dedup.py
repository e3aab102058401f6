"""Prefix trie, filter audit and exact dedup against brute force and over odd tables."""

import collections
import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from vacancylens.llm import exactdedup, filteraudit, prefixtrie
from vacancylens.llm.common import join_groups

TURNS = "conv_id long, turn long, role string, text string, conv string, part string, id string, len int, container int"
DOCS = "doc_id long, text string, source string, key string, row int, digest string, shard int, mask int, part int, body string, n int"
LABELS = "doc_id long, quality int, toxic int, key string, good int"


def node_table(rows):
    """Brute force over all prefixes; equal turn numbers are ordered by the operator's id."""
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            convs[c].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [x[2] for x in sorted(t)] for c, t in convs.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c % 100 if c >= 0 else -(-c % 100))
        seqs[c] = own.get(base, [])[:h] + turns[h:]
    members, ends, kids = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
            if d:
                kids[tuple(s[:d - 1])].add(tuple(s[:d]))
        ends[tuple(s)].append(c)
    out = {}
    for k in sorted(members, key=len, reverse=True):
        below = [out[x] for x in kids[k]]
        saved = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(b[6] for b in below)
        text = ",".join(map(str, sorted(ends.get(k, []))))
        out[k] = (min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(below),
                  sum(b[5] for b in below) or 1, saved, hashlib.sha256(text.encode()).hexdigest())
    return sorted(out.values(), key=str)


def turn_frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "p", "i", 1, 2) for r in rows], TURNS)


def random_turns(seed, convs, words, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 350), convs):
        n = rng.choice([1, 2, 3, 6, longest])
        rows += [(c, i, rng.choice(["user", "bot"]) if i > 3 else "user", rng.choice(words)) for i in range(n)]
    return rows


@pytest.mark.parametrize("limit, window", [(1, 1), (5, 2), (40, 8), (1 << 13, 8)])
def test_trie_equals_all_prefixes(spark, limit, window):
    rows = random_turns(limit, 60, ["a", "bb", "ccc"], 12)
    stem = [(c, i, "user", "same") for c in (700, 800, 901, 902, 903) for i in range(20)]
    rows += stem + [(800, 20, "bot", "x"), (903, 20, "bot", "y"), (903, 21, "bot", "z")]
    got = prefixtrie.conversation_trie(turn_frame(spark, rows), limit, window).select(prefixtrie.OUT)
    assert sorted((tuple(r) for r in got.collect()), key=str) == node_table(rows)


def test_trie_over_odd_tables(spark):
    rows = [(0, None, None, None), (0, None, "user", None), (0, 1, "user", "b"), (0, 1, "user", "b"), (0, 1, "user", "a"), (None, 1, "user", "lost"),
            (1, 0, "", ""), (2, 5, "user", "long " * 50_000), (100, 0, "user", "☃"), (-7, 3, "user", "b"), (5, 0, "a", "1:b"), (6, 0, "", "a1:b")]
    for limit in (1, 1000):
        got = prefixtrie.conversation_trie(turn_frame(spark, rows), limit)
        assert sorted((tuple(r) for r in got.collect()), key=str) == node_table(rows)
    assert not prefixtrie.conversation_trie(turn_frame(spark, rows).limit(0)).collect()


def test_trie_folds_copies_and_deep_stems(spark):
    """A group of copies is one sequence, and a stem far longer than the window takes few rounds."""
    rows = [(c, i, "user", f"t{i}") for c in range(7, 1000, 100) for i in range(300)]
    got = prefixtrie.conversation_trie(turn_frame(spark, rows), limit=10, window=1)
    assert sorted((tuple(r) for r in got.collect()), key=str) == node_table(rows)


FAILS = {
    "A": lambda w, t: len(w) < 200, "B": lambda w, t: 100 * len(set(w)) < 50 * len(w),
    "C": lambda w, t: 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": lambda w, t: any(c in "#$%&*|" for c in t),
}


def audit_table(docs, labels):
    good, toxic = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    rows = collections.defaultdict(list)
    for d, t, s in docs:
        t = t or ""
        w = t.encode().split()
        failing = {x for x, f in FAILS.items() if f(w, t)} | ({"E"} if d is not None and d > first[t] else set())
        rows[s or ""].append((failing, d in good, d in toxic))
    out = []
    for part, members in rows.items():
        steps, credit = [], collections.Counter()
        for order in itertools.permutations("ABCDE"):
            for i, x in enumerate(order):
                before = set(order[:i])
                here = [m for m in members if x in m[0] and not m[0] & before]
                credit[x] += len(here)
                steps.append((part, "".join(order), i + 1, sum(not m[0] & (before | {x}) for m in members), len(here),
                              sum(x in m[0] and bool(m[0] & before) for m in members), sum(m[0] == {x} for m in members),
                              sum(m[1] for m in here), sum(m[2] for m in here), x))
        out += [(*s[:-1], credit[s[-1]]) for s in steps]
    return sorted(out)


def odd_docs():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "one two", "A B C D", "x" * 3 + " | y", "w " * 300, " ".join(f"v{i}" for i in range(250)),
             "nbsp joins   words", "Long text " * 60_000, "É" * 90 + "AB"]
    rows = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice([None, "", "a", "b"])) for _ in range(120)]
    return rows + rows[:10]


def test_audit_equals_brute_force(spark):
    docs = odd_docs()
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (3, 1, 1), (None, 1, 1), (5, 0, None)]
    frame = spark.createDataFrame([(*d, "k", 1, "d", 2, 3, 4, "b", 5) for d in docs], DOCS)
    marks = spark.createDataFrame([(*x, "k", 1) for x in labels], LABELS)
    got = filteraudit.audit(frame, marks)
    assert sorted(tuple(r) for r in got.collect()) == audit_table(docs, labels)
    assert not filteraudit.audit(frame.limit(0), marks).collect()
    assert filteraudit.audit(frame, marks.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_plain_changes_reach_every_order():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in filteraudit.plain_changes(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n)))) == 1 + sum(1 for _ in filteraudit.plain_changes(n))


def test_diagram_shares_nodes_and_swaps_exactly():
    rng = random.Random(5)
    for _ in range(20):
        leaves = {m: (rng.randrange(3), 0, rng.randrange(2)) for m in rng.sample(range(32), 9)}
        diagram = filteraudit.Diagram("ABCDE", leaves, "ABCDE")
        for level in [rng.randrange(4) for _ in range(30)]:
            diagram.swap(level)
            fresh = filteraudit.Diagram("".join(diagram.order), leaves, "ABCDE")
            assert list(diagram.steps()) == list(fresh.steps())
    assert len(filteraudit.Diagram("ABCDE", {0: (1, 0, 0)}, "ABCDE").low) <= 2 + 2 * 5


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def dedup_table(docs):
    groups = collections.defaultdict(list)
    for d, t in docs:
        groups[lowered(t)].append(d)
    out = []
    for text, keys in groups.items():
        known = [k for k in keys if k is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        stays = False
        for k in keys:
            kept = k == keep and not stays
            stays = stays or kept
            out.append((k, keep, len(keys), kept, sha))
    return sorted(out, key=str)


def dedup_frame(spark, docs):
    return spark.createDataFrame([(d, t, "s", "k", 1, "d", 2, 3, 4, "b", 5) for d, t in docs], DOCS)


def dedup_rows(index):
    rows = exactdedup.resolve(index).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")))
    return sorted((tuple(r) for r in rows.collect()), key=str)


def test_index_inserts_deletes_and_looks_up(spark):
    rng = random.Random(9)
    texts = [None, "", "Abc", "aBC", "É", "é", "long " * 100_000, *(f"text {i}" for i in range(300))]
    docs = [(rng.choice([None, *range(400)]), rng.choice(texts)) for _ in range(500)]
    docs += [(k, "copies") for k in range(1000, 1400)] + docs[:20]
    one, two = docs[::2], docs[1::2]
    index = exactdedup.insert(dedup_frame(spark, one), shard_keys=64)
    assert dedup_rows(index) == dedup_table(one)
    both = exactdedup.insert(dedup_frame(spark, two), index)
    assert dedup_rows(both) == dedup_table(docs) and dedup_rows(index) == dedup_table(one)
    gone = {k for k, t in docs if k is not None and (k % 3 == 0 or t == "Abc")} | {1398, 1399}
    rest = [(k, t) for k, t in docs if k not in gone]
    left = exactdedup.delete(both, spark.createDataFrame([(k,) for k in [*gone, None, 99_999]], "doc_id long"))
    assert dedup_rows(left) == dedup_table(rest)
    live = {hashlib.sha256(lowered(t).encode()).digest() for _, t in rest}
    asked = exactdedup.lookup(left, dedup_frame(spark, docs + [(1, "never seen")])).collect()
    assert len(asked) == len(docs) + 1 and all(r["live"] == (bytes(r["digest"]) in live) for r in asked)
    assert all(r["hit"] for r in asked if r["live"]) and sum(r["hit"] and not r["live"] for r in asked) < 10
    again = exactdedup.insert(dedup_frame(spark, [d for d in docs if d[0] in gone]), left)
    assert dedup_rows(again) == dedup_table(docs)


def test_index_over_an_empty_table(spark):
    empty = exactdedup.insert(dedup_frame(spark, []))
    assert dedup_rows(empty) == []
    assert dedup_rows(exactdedup.insert(dedup_frame(spark, [(1, "a")]), empty)) == dedup_table([(1, "a")])


def test_shard_resizes_from_stored_keys_and_verifies_hits():
    shard = exactdedup.CuckooShard(2)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(4000)]
    for k in keys:
        assert shard.slot(k) < 0
        shard.add(k)
    assert shard.buckets * exactdedup.SLOTS >= 4000 and all(shard.slot(k) >= 0 for k in keys)
    bits = shard.filter_bytes()
    assert all(exactdedup.maybe(bits, k) for k in keys)
    twin = keys[7][:10] + bytes(22)  # same fingerprint and buckets, another key
    assert exactdedup.maybe(bits, twin) and shard.slot(twin) < 0 and shard.false_hits
    shard.add(twin)
    assert shard.remove(keys[7]) and shard.slot(twin) >= 0 and shard.slot(keys[7]) < 0 and not shard.remove(keys[7])
    for k in keys[8:]:
        assert shard.remove(k)
    assert not any(exactdedup.maybe(shard.filter_bytes(), k) for k in keys[3000:]) and len(shard.keys) == 8


def test_join_groups_with_one_key_for_most_rows(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = join_groups(rows, groups, "k", "n").collect()
    assert len(got) == 5000 and all(r["n"] == (4000 if r["k"] == 0 else 1) for r in got)


def test_columns_of_any_name_pass_unchanged(spark, sf):
    """Extra columns with the names that the operators use inside, in any case."""
    from vacancylens.llm import linededup, mixing, simhash

    names = ["_key", "_hash", "_shard", "_SHARDS", "_source", "_size", "_words", "_time", "_spot", "_part", "_doc", "_drop", "_text", "_key_"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60").repartition(2)
    wide = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names])
    for operator in (simhash.one_of_each, linededup.drop_repeated_lines, lambda d: mixing.draw(d, mixing.allocate(d))):
        plain, clashing = operator(docs), operator(wide)
        assert set(names) <= set(clashing.columns)
        got = clashing.collect()
        assert all(r[n] == f"{n}:{r['doc_id']}" for r in got for n in names)
        keep = [c for c in plain.columns if c in docs.columns]
        assert sorted(map(str, clashing.select(keep).collect())) == sorted(map(str, plain.select(keep).collect()))


def test_vectors_beyond_a_long_take_no_part(spark):
    from vacancylens.llm import topk

    rows = [(0, [1e17, 1.0]), (1, [3.0, 1.0]), (2, [1e300, 0.0]), (50, [1.0, -2.0]), (3, [-4e6, 4e6])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(50, 1, 1, 65536), (50, 2, 3, 256 * 256 * -12_000_000)]
