"""Similarity operators against brute force and against known groups."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vacancylens.functions.text import shingle_hashes, words
from vacancylens.operators import company, graph, knn, leader, neardup, setjoin
from vacancylens.operators.setjoin import similar_pairs


def embed(t):
    v = np.zeros(64)
    for w in re.findall("[a-z0-9]+", t.lower()):
        v[zlib.crc32(w.encode()) % 64] += 1
    n = np.linalg.norm(v)
    return v / n if n else v


def grams(t, n=5):
    w = re.findall("[a-z0-9]+", t.lower())
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize("measure,threshold", [("jaccard", 0.8), ("jaccard", 0.5), ("overlap", 0.25), ("overlap", 0.9)])
def test_similar_pairs_are_exact(spark, measure, threshold):
    rng = random.Random(7)
    sets = []
    for i in range(120):
        base = set(rng.sample(range(60), rng.randint(1, 25))) if i % 3 or not sets else set(rng.choice(sets))
        if i % 3 == 0:
            base ^= set(rng.sample(range(60), rng.randint(0, 3)))
        sets.append(base or {1})
    want = set()
    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        both = len(a & b)
        score = both / len(a | b) if measure == "jaccard" else both / min(len(a), len(b))
        if score >= threshold:
            want.add((i, j))
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id int, tokens array<int>")
    assert {(r["a"], r["b"]) for r in similar_pairs(df, threshold, measure).collect()} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(chain, "a int, b int")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("seed", range(3))
def test_first_wins_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(150)}
    leaders, want = [], {}
    for v in range(n):
        led = [s for s in leaders if (s, v) in edges]
        want[v] = led[0] if led else v
        if not led:
            leaders.append(v)
    nodes = spark.range(n).selectExpr("id as node", "id as priority")
    out = graph.first_wins(nodes, spark.createDataFrame(list(edges), "hi long, lo long"))
    assert {r["node"]: r["leader"] for r in out.collect()} == want


def brute_groups(jobs):
    """Near-duplicate groups by comparing every pair."""
    live = [i for i, j in enumerate(jobs) if len(j[2]) >= 500 and not j[3]]
    parent = {i: i for i in live}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def norm(t):
        return " ".join(re.sub("[^a-z0-9 ]", " ", t.lower()).split())

    for i, j in itertools.combinations(live, 2):
        a, b = jobs[i], jobs[j]
        cos = float(embed(f"{a[1]}\n{a[2]}") @ embed(f"{b[1]}\n{b[2]}"))
        ga, gb = grams(a[2]), grams(b[2])
        ok = ga and gb and len(ga & gb) / len(ga | gb) >= 0.8
        if cos >= 0.95 and ok and (norm(a[0]) != norm(b[0]) or norm(a[1]) == norm(b[1])):
            parent[root(i)] = root(j)
    out = {}
    for i in live:
        out.setdefault(root(i), []).append(i)
    return {frozenset(g) for g in out.values()}


def near_dup_jobs():
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=100)) for _ in range(6)]
    jobs = []
    for n in range(90):
        words = texts[n % 6].split()
        for _ in range(rng.choice([0, 0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        title = rng.choice(["dev", "lead dev", " ".join(rng.choices(vocabulary, k=40)), "dev"])
        jobs.append((rng.choice(["acme", "beta", "gamma", "acme"]), title, " ".join(words), n % 17 == 0))
    return jobs + [("acme", "short", "too short", False), ("x", "symbols", "§ " * 400, False), ("y", "symbols", "§ " * 400, False)]


def test_near_duplicates_equal_brute_force(spark):
    """Many names on one text, long titles that fail the cosine, edits that chain: the pivots must lose nothing."""
    jobs = near_dup_jobs()
    df = spark.createDataFrame([(i, *j) for i, j in enumerate(jobs)], "ord int, company string, title string, jd_text string, from_correspondence boolean")
    rows = neardup.with_survivor(df).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["survivor"], set()).add(r["ord"])
    assert {frozenset(g) for g in groups.values()} == brute_groups(jobs)
    for survivor, members in groups.items():
        assert survivor == min(members, key=lambda i: (-len(jobs[i][2]), i))


@pytest.mark.parametrize("block", [7, 8192])
def test_a_text_under_thousands_of_names_gives_linear_edges(spark, block):
    """Long titles that fail the cosine among names that pass; the components equal those of all pairs."""
    rng, few = random.Random(8), block == 7
    body = " ".join(rng.choices([f"word{i}" for i in range(300)], k=120))
    other = " ".join([*body.split()[:-1], "tail"])
    long = [" ".join(rng.choices([f"t{i}" for i in range(40)], k=60)) for _ in range(30)]
    n = 120 if few else 5000
    jobs = [(f"c{rng.randrange(n // 4)}", long[i % 30] if i % 3 == 0 else f"dev {i % (n // 3)}", body if i % 2 else other, False) for i in range(n)]
    jobs += [("solo", f"only {i}", body.replace("word1 ", "x "), False) for i in range(3)]
    df = spark.createDataFrame([(i, *j) for i, j in enumerate(jobs)], "ord int, company string, title string, jd_text string, from_correspondence boolean")
    prepared = neardup.cut(neardup.prepare(df))
    reps = neardup.cut(neardup.classes(prepared))
    edges = neardup.class_edges(reps, neardup.text_pairs(df, prepared), block=block)
    assert edges.count() <= (60 if few else 6) * reps.count()
    if few:
        groups = {}
        for r in neardup.with_survivor(df).collect():
            groups.setdefault(r["component"], set()).add(r["ord"])
        assert {frozenset(g) for g in groups.values()} == brute_groups(jobs)
        whole = neardup.class_edges(reps, neardup.text_pairs(df, prepared))
        assert {tuple(sorted(g)) for g in linked(edges)} == {tuple(sorted(g)) for g in linked(whole)}


def linked(edges):
    groups = {}
    for r in graph.components(edges).collect():
        groups.setdefault(r["component"], set()).add(r["node"])
    return groups.values()


def test_one_company_two_titles_stay_apart(spark):
    body = " ".join(f"w{i}" for i in range(150))
    df = spark.createDataFrame([(0, "acme", "Dev", body, False), (1, "acme", "Lead", body, False)], "ord int, company string, title string, jd_text string, from_correspondence boolean")
    assert {r["survivor"] for r in neardup.with_survivor(df).collect()} == {0, 1}


def test_collapse_keeps_every_posting(spark):
    jobs = near_dup_jobs()
    df = spark.createDataFrame([(i, *j, f"id{i}", "") for i, j in enumerate(jobs)], "ord int, company string, title string, jd_text string, from_correspondence boolean, id string, link string")
    survivors, absorbed = neardup.collapse(df)
    kept, lost = {r["ord"] for r in survivors.collect()}, {r["ord"] for r in absorbed.collect()}
    assert kept | lost == set(range(len(jobs))) and not kept & lost
    listed = neardup.with_duplicates(survivors, absorbed).collect()
    assert sum(len(r["duplicates"] or []) for r in listed) == len(lost)


def brute_clusters(counts, threshold=0.82):
    values = sorted(counts, key=lambda v: (-counts[v], v))

    def chars(v):
        s = re.sub("[^a-z0-9]+", "", v.lower())
        return set() if len(s) < 10 else {s[i:i + 4] for i in range(len(s) - 3)}

    def close(a, b):
        ga, gb = chars(a), chars(b)
        short, long = (ga, gb) if len(ga) <= len(gb) else (gb, ga)
        return float(embed(a) @ embed(b)) >= threshold - 1e-12 or bool(short) and len(short & long) / len(short) >= 0.9

    out, left = {}, values
    while left:
        seed = left[0]
        for v in [v for v in left if v == seed or close(seed, v)]:
            out[v] = seed
        left = [v for v in left if v not in out]
    return out


def test_clusters_equal_the_sequential_rule(spark):
    counts = {"Permanent role, not contract": 235, "Permanent, not contract": 110, "Likely permanent, not contract": 20, "remotevibecodingjobs.com": 235,
              "remotevibecodingjobs": 133, "vibe-coding": 115, "Node.js": 218, "Node": 78, "NodeJS": 12, "Next.js": 88, "No equity": 9, "Equity-heavy comp": 9, "###": 3, "!!": 3}
    rng = random.Random(1)
    for _ in range(60):
        counts[" ".join(rng.choices(["permanent", "role", "contract", "rate", "remote", "travel", "stack", "gap"], k=rng.randint(1, 5)))] = rng.randint(1, 30)
    df = spark.createDataFrame(list(counts.items()), "value string, n long")
    got = leader.cluster_values(df).collect()
    assert {r["value"]: r["label"] for r in got} == brute_clusters(counts)
    assert sum(r["n"] for r in got) == sum(counts.values())
    again = leader.cluster_values(df.repartition(3)).collect()
    assert {(r["value"], r["label"]) for r in again} == {(r["value"], r["label"]) for r in got}


@pytest.mark.parametrize("batch", [1, 7, 30])
def test_clusters_are_the_same_in_any_batch(spark, batch):
    rng = random.Random(batch)
    counts = {" ".join(rng.choices(["permanent", "role", "contract", "rate", "remote", "travel", "stack", "###"], k=rng.randint(1, 4))): rng.randint(1, 9) for _ in range(60)}
    rows = [(f, v, n, floor) for f, floor in (("a", 0.82), ("b", 0.88)) for v, n in counts.items() if f == "a" or n > 3]
    got = leader.cluster_fields(spark.createDataFrame(rows, "field string, value string, n long, floor double"), batch=batch).collect()
    for field, floor in (("a", 0.82), ("b", 0.88)):
        assert {r["value"]: r["label"] for r in got if r["field"] == field} == brute_clusters({v: n for f, v, n, _ in rows if f == field}, floor)
    assert leader.cluster_fields(spark.createDataFrame([], "field string, value string, n long, floor double")).collect() == []


def test_thousands_of_spellings_cost_one_leader(spark):
    """20,000 near-equal values: two rounds, no pairs."""
    words = "senior platform engineer remote contract position with travel and weekend cover in region"
    near = spark.range(20_000).select(F.lit("f").alias("field"), F.concat(F.lit(words + " "), F.hex("id")).alias("value"), (20_000 - F.col("id")).alias("n"), F.lit(0.82).alias("floor"))
    got = leader.cluster_fields(near, batch=1000).groupBy("label").count().collect()
    assert [(r["label"], r["count"]) for r in got] == [(words + " 0", 20_000)]


def test_keep_first(spark):
    items = [("g", 1, "is the role still open at acme corp today"), ("g", 2, "is the role still open at acme corp now"), ("g", 3, "who owns it"), ("g", 4, "who owns it"), ("h", 1, "is the role still open at acme corp today")]
    out = leader.keep_first(spark.createDataFrame(items, "g string, pos int, t string"), "g", "pos", "t")
    assert {(r["g"], r["pos"]) for r in out.collect()} == {("g", 1), ("g", 3), ("g", 4), ("h", 1)}


def nearest_by_force(m, k, allowed):
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    unit = m / np.where(norms == 0, 1, norms)
    sim = np.round(unit @ unit.T, 9)
    sim[~allowed] = -np.inf
    return {q: [j for j in sorted(range(len(m)), key=lambda j: (-sim[q, j], j))[:k] if sim[q, j] > -np.inf] for q in range(len(m))}


def neighbours(found):
    got = {}
    for r in found.collect():
        got.setdefault(r["query"], []).append((r["rank"], r["neighbour"]))
    return {q: [n for _, n in sorted(v)] for q, v in got.items()}


@pytest.mark.parametrize("hot", [False, True])
def test_nearest_equals_brute_force(spark, hot):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 8)) + 3 * rng.normal(size=(6, 8))[rng.integers(0, 6, 300)]
    m[290:] = 0
    if hot:
        m[:120] = m[0]
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "id long, embedding array<double>")
    assert neighbours(knn.nearest(df, df, 5, block_rows=40)) == nearest_by_force(m, 5, ~np.eye(300, dtype=bool))


@pytest.mark.parametrize("share", [0.01, 0.5])
def test_filtered_nearest_equals_brute_force(spark, share):
    """Queries of one label, of any, and of one that no member has; neighbours must differ in their key."""
    rng = np.random.default_rng(11)
    m = rng.normal(size=(400, 6)) + 4 * rng.normal(size=(8, 6))[rng.integers(0, 8, 400)]
    label = np.where(rng.random(400) < share, "rare", "rest").astype(object)
    want = np.array([("rare", "rest", None, "none")[i % 4] for i in range(400)], dtype=object)
    key = np.array([f"k{i % 150}" for i in range(400)], dtype=object)
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(m)]
    corpus = spark.createDataFrame([(*r, l, o) for r, l, o in zip(rows, label, key)], "id long, embedding array<double>, label string, own string")
    asked = spark.createDataFrame([(*r, l, o) for r, l, o in zip(rows, want, key)], "id long, embedding array<double>, label string, own string")
    allowed = ((want[:, None] == label[None, :]) | (want[:, None] == None)) & (key[:, None] != key[None, :])  # noqa: E711
    got = neighbours(knn.nearest(asked, corpus, 7, label="label", apart="own", block_rows=50))
    assert got == {q: n for q, n in nearest_by_force(m, 7, allowed).items() if n}


def test_rows_are_sent_once_per_block_of_the_other_side(spark, monkeypatch):
    """50,000 vectors in 100 far groups: exact, and most block pairs are ruled out."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(100, 16))
    m = centre[rng.integers(0, 100, 50_000)] + 0.02 * rng.normal(size=(50_000, 16))
    df = spark.createDataFrame(pa.table({"id": np.arange(50_000), "embedding": list(m)}))
    asked, pairs = df.filter("id % 25 = 0"), []
    kept = knn.cut
    monkeypatch.setattr(knn, "cut", lambda d: pairs.append(kept(d)) or pairs[-1])
    got = neighbours(knn.nearest(asked, df, 10, block_rows=1000))
    met = pairs[-1]
    assert met.columns == ["home", "part", "block"]
    copies = met.groupBy("home", "part").count().agg(F.max("count"), F.avg("count")).first()
    assert copies[0] <= 75 and copies[1] < 25
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 50_000, 2500):
        sim = np.round(unit[q] @ unit.T, 9)
        sim[q] = -np.inf
        assert got[q] == sorted(np.argsort(-sim, kind="stable")[:10].tolist(), key=lambda j: (-sim[j], j))


def test_mmr_prefers_variety(spark):
    corpus = [(1, [1.0, 0.0, 0.0]), (2, [0.99, 0.14, 0.0]), (3, [0.6, 0.0, 0.8]), (4, [0.98, 0.2, 0.0])]
    df = spark.createDataFrame(corpus, "id long, embedding array<double>")
    query = spark.createDataFrame([(9, [1.0, 0.05, 0.0])], "id long, embedding array<double>")
    got = [r["neighbour"] for r in knn.retrieve(query, df, k=2, weight=0.3).orderBy("place").collect()]
    assert got == [1, 3]
    assert [r["neighbour"] for r in knn.retrieve(query, df, k=2, weight=1.0).orderBy("place").collect()] == [1, 2]
    assert knn.retrieve(query, df, where=F.col("id") > 99).count() == 0


def test_matching_keys_equal_brute_force(spark):
    names = ["genesis10", "genesis10staffing", "acme", "acmeology", "beta", "thebetagroup", "gamma12345", "xgamma12345y", "gamma", "12345"]

    def same(a, b):
        s, l = sorted((a, b), key=len)
        return a == b or (len(s) >= 5 and s in l)

    p = spark.createDataFrame([(n,) for n in names], "probe_key string")
    e = spark.createDataFrame([(n,) for n in names], "entry_key string")
    assert {(r[0], r[1]) for r in company.matching_keys(p, e).collect()} == {(a, b) for a in names for b in names if same(a, b)}


def test_same_text_under_another_name(spark):
    rng = random.Random(2)
    body = " ".join(rng.choices([f"w{i}" for i in range(200)], k=80))
    other = " ".join(rng.choices([f"z{i}" for i in range(200)], k=80))
    rows = [(1, "Genesis10", body), (2, "Acme Inc", body + " extra words at the end here"), (3, "Genesis10 Staffing", body), (4, "Beta", other), (5, "Acme", other[: len(other) // 2] + " " + body[:50])]
    got = company.same_text(spark.createDataFrame(rows, "ord int, company string, jd_text string")).collect()

    def over(a, b):
        return len(grams(a) & grams(b)) / min(len(grams(a)), len(grams(b)))

    best = {(r["company_key"], r["other_key"]): r["overlap"] for r in got}
    assert best[("genesis10", "acme")] == round(over(body, rows[1][2]), 2)
    assert ("genesis10", "genesis10staffing") not in best
    assert best[("beta", "acme")] == pytest.approx(round(over(other, rows[4][2]), 2))
    assert math.isclose(best[("acme", "genesis10")], best[("genesis10", "acme")])


def test_precedents_are_real_judgments_of_other_postings(spark):
    from vacancylens.operators import precedents

    doc = "key string, content string, kind string, id string, scored boolean, prefiltered boolean, rationale string, title string, company string, verdict string, fit_score int, tier string, is_agency boolean, employment_type string, cadence string, rate string"
    base = ("job", True, False, "fits well", "Dev", "acme", "FIT", 70, "PRIMARY", False, "contract", "", "")

    def row(key, own, text="spark engineer remote", **other):
        kind, scored, pre, why, *rest = base
        return (key, text, other.get("kind", kind), own, other.get("scored", scored), other.get("pre", pre), other.get("why", why), *rest)

    docs = spark.createDataFrame([row("a", "acme|dev|"), row("b", "beta|dev|"), row("c", "c|c|", scored=False), row("d", "d|d|", pre=True),
                                  row("e", "e|e|", why="prefilter: x"), row("f", "f|f|", why="analysis_error: y"), row("g", "g|g|", kind="note")], doc)
    jobs = spark.createDataFrame([(1, "Dev", "acme", "spark engineer"), (2, "", "", ""), (3, "Dev", "gamma", "spark")], "ord long, title string, company string, jd_text string")
    got = {(r["query"], r["key"]) for r in precedents.find(jobs, docs).collect()}
    assert got == {(1, "b"), (3, "a"), (3, "b")}
    texts = {r["ord"]: r["precedents"] for r in precedents.with_precedents(jobs, docs, opening="Past", closing="End").collect()}
    assert texts[2] == "" and texts[1] == "Past\n1. Dev @ acme — FIT 70/100 · PRIMARY · contract\n   why: fits well\nEnd"


def test_precedents_read_documents_once_and_send_narrow_vectors(spark, monkeypatch):
    """documents were worked out three times, texts went through the shuffle, vectors travelled as doubles."""
    from vacancylens.catalog import precedents as catalog
    from vacancylens.operators import precedents

    read, written = spark.sparkContext.accumulator(0), []
    flags = "true as scored, false as prefiltered, 'fits' as rationale, 'Dev' as title, 'acme' as company, 'FIT' as verdict, 70 as fit_score"
    docs = spark.range(40).selectExpr("concat('k', id) as key", "concat('spark engineer ', id % 7, ' remote') as content", "'job' as kind", "concat('own', id) as id", *flags.split(", "))

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    jobs = spark.createDataFrame([(i, "Dev", "gamma", f"spark engineer {i}") for i in range(5)], "ord long, title string, company string, jd_text string")
    kept = knn.cut
    monkeypatch.setattr(knn, "cut", lambda d: written.append(d) or kept(d))
    assert precedents.find(jobs, docs.mapInArrow(counted, docs.schema)).count() == 15
    assert read.value == 40
    assert {d.schema["v"].dataType.simpleString() for d in written if "v" in d.columns} == {"array<int>"}
    asked, known = catalog._asked_and_known(spark, "/root/testdata/sf0.001")
    plan = known._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Window [")[0] and "content" not in known.columns and precedents.VECTOR in known.columns


def test_company_grams_are_never_broadcast(spark):
    probes = spark.createDataFrame([("building",), ("acme42",), ("zzzzz99",), ("acme",)], "probe_key string")
    entries = spark.createDataFrame([("thebuilding0001",), ("building0001",), ("acme42group",), ("acme",), ("ilding",)], "entry_key string")
    out = company.matching_keys(probes, entries)
    assert "BroadcastHashJoin [gram" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [("acme", "acme"), ("acme42", "acme42group"), ("building", "building0001"),
                                                 ("building", "ilding"), ("building", "thebuilding0001")]


def test_tokens_are_worked_out_once_per_pass(spark):
    items = spark.createDataFrame([(1, 1, "a b c d e"), (1, 2, "A b c d e"), (1, 3, "a b"), (1, 4, "a b"), (2, 1, "a b c d e"), (2, 2, None)], "g int, pos int, s string")
    seen, cut = [], setjoin.cut

    def watched(df):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    setjoin.cut = watched
    try:
        got = leader.keep_first(items.repartition(2), "g", "pos", "s").collect()
    finally:
        setjoin.cut = cut
    assert sorted((r["g"], r["pos"]) for r in got) == [(1, 1), (1, 3), (1, 4), (2, 1), (2, 2)]
    assert not any("Filter" in line and "regexp_extract_all" in line for line in seen[0].splitlines())


def test_hashes_of_runs_tell_runs_apart(spark):
    text = "a b c d e f a b c d e ab c d e"
    w = text.split()
    for n in (1, 2, 3, 4, 5, 7):
        row = spark.createDataFrame([(text, "a b"), ("", None)], "t string, u string").repartition(1).select(
            *[F.size(shingle_hashes(words(c), n)).alias(c) for c in ("t", "u")]).collect()
        want = lambda x: len({tuple(x[i:i + n]) for i in range(len(x) - n + 1)})
        assert sorted(map(tuple, row)) == sorted([(want(w), want(["a", "b"])), (0, 0)])


def test_best_of_a_block_equals_brute_force():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(40, 8)), rng.normal(size=(9000, 8))
    b[100:6000] = b[100]  # many ties, over a tile's end
    a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (a, b))
    a[3] = 0
    b[7000] = 0
    sim = np.round(a @ b.T, 9)
    own = np.arange(9000) % 40
    sim[own[None, :] == np.arange(40)[:, None]] = -np.inf
    i, j, s = knn._best(a, b, np.full(40, -np.inf), 10, lambda rows, columns: own[columns] == rows)
    for row in range(40):
        order = np.lexsort((np.arange(9000), -sim[row]))[:10]
        assert j[i == row].tolist() == order.tolist() and np.allclose(s[i == row], sim[row][order])


def test_rows_are_sent_to_few_blocks(spark):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(4000, 8)))], "id int, embedding array<double>")
    blocks, cut = [], knn.cut

    def watched(df):
        out = cut(df)
        if {"cell", "block"} <= set(df.columns):
            blocks.append(out.select("block").distinct().count())
        return out

    knn.cut = watched
    try:
        got = knn.nearest(v, v, 3).filter("query < 5").collect()
    finally:
        knn.cut = cut
    assert blocks and blocks[0] <= 2 * np.sqrt(3 * spark.sparkContext.defaultParallelism) - 2
    m = np.array([r["embedding"] for r in v.orderBy("id").collect()])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(5):
        sim = m @ m[q]
        sim[q] = -9
        assert [r["neighbour"] for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == np.argsort(-sim)[:3].tolist()
