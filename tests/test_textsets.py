"""Texts as sets of word runs: against the column functions, and joins against brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from vacancylens.functions.text import shingle_hashes, words
from vacancylens.functions.vectors import bucket_counts
from vacancylens.operators import company, neardup, textsets


def grams(t, n=5):
    w = re.findall("[a-z0-9]+", t.lower())
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "ord int, raw string").select(
        F.xxhash64("ord").alias("row"), F.col("raw"), textsets.lowered("raw"))


def test_keys_and_runs_are_those_of_the_words(spark):
    odd = ["", None, "...", "one", "a b c d", "a b c d e", "a-b_c d,e  f", " a b c d e a b c d e ", "été 12 İstanbul Kelvin x y z é w v u",
           "x" * 3000 + " b c d e f", "日本 a b\nc\td\re 日本", "a b c d e", "A B C D E!"]
    rng = random.Random(1)
    odd += [" ".join(rng.choices(["aa", "b", "c1", "dé", "e;f", "-"], k=rng.randint(0, 60))) for _ in range(60)]
    rows = frame(spark, odd)
    got = textsets.keyed_texts(rows).withColumns({
        "want_key": F.md5(F.array_join(words("raw"), " ")), "want_n": F.size(shingle_hashes(words("raw")))}).collect()
    assert len(got) == len(odd)
    assert all(r["text_key"] == r["want_key"] and r["n"] == r["want_n"] for r in got)
    sets = {r["raw"]: r["tokens"] for r in textsets.run_sets(rows).collect()}
    assert all(x == sorted(set(x)) for x in sets.values())
    assert sets["a b c d e"] == sets["A B C D E!"] and len({tuple(x) for x in sets.values() if x}) == len({frozenset(grams(t or "")) for t in odd} - {frozenset()})


def test_word_counts_are_those_of_the_columns(spark):
    odd = ["", None, "a", "A b C", "été İstanbul Kelvin", "x" * 64 + " " + "y" * 65 + " z" * 70, "日本 a b\nc\td", "q" * 5000, "a-b_c d,e  f"]
    rows = spark.createDataFrame([(x,) for x in odd], "raw string").select(
        textsets.word_counts("raw", 7).alias("v"), bucket_counts("raw", 7).alias("w"), textsets.word_counts("raw").alias("x"), bucket_counts("raw").alias("y")).collect()
    assert all(r["v"] == r["w"] and r["x"] == r["y"] for r in rows) and sum(map(sum, (r["v"] for r in rows))) > 80


def corpus(seed):
    rng = random.Random(seed)
    line = " ".join(rng.choices([f"c{i}" for i in range(30)], k=30))
    texts = []
    for i in range(70):
        if i % 3 == 2:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(99)}"
            w = w[rng.randint(0, len(w) // 2):] if i % 2 else w
        else:
            w = rng.choices([f"w{j}" for j in range(3000)], k=rng.choice([5, 9, 40, 150]))
        texts.append(" ".join(w) + (" " + line if i % 4 else ""))
    return texts + texts[:5] + [line]


@pytest.mark.parametrize("measure,threshold", [("alike", 0.8), ("alike", 0.3), ("contained", 0.9), ("contained", 0.5), ("contained", 0.25)])
def test_joins_are_exact(spark, monkeypatch, measure, threshold):
    monkeypatch.setattr(textsets, "CHUNK", 700)
    texts = corpus(int(threshold * 100))
    rows = frame(spark, texts)
    keys = {r["raw"]: r["text_key"] for r in textsets.keyed_texts(rows).collect()}
    want = {}
    for a, b in itertools.combinations(sorted(set(texts)), 2):
        x, y = grams(a), grams(b)
        if x and y:
            score = len(x & y) / (len(x | y) if measure == "alike" else min(len(x), len(y)))
            if score >= threshold:
                want[frozenset((keys[a], keys[b]))] = score
    got = getattr(textsets, measure)(rows.select("row", "text"), threshold).collect()
    assert want and len(got) == len(want)
    assert {frozenset((r["a"], r["b"])): r["score"] for r in got} == pytest.approx(want)


def test_few_runs_of_texts_are_indexed(spark):
    """What decides which texts meet must not be all their runs, which would fill the disk as texts grow."""
    rng = random.Random(3)
    rows = frame(spark, [" ".join(rng.choices([f"w{i}" for i in range(9999)], k=400)) for _ in range(40)]).select("row", "text")
    common = textsets.common_runs(rows)
    first = textsets._prefixes(rows, 0.8, 0.0, common).agg(F.sum(F.size("tokens")), F.sum("n")).first()
    assert 0 < first[0] <= 0.21 * first[1]


def test_settled_companies_are_not_compared_again(spark, monkeypatch):
    """Best overlaps of a pair of companies are found without pairs of texts that overlap less."""
    rng = random.Random(4)
    shared = " ".join(rng.choices([f"w{i}" for i in range(300)], k=80))
    half = shared.split()[:40]
    rows = [(i, f"Firm{i % 3:05d}", " ".join(half + [f"x{i}y{j}" for j in range(60)])) for i in range(30)]
    rows += [(100 + i, f"Firm{i:05d}", shared) for i in range(3)]
    seen, whole = [], company.contained
    monkeypatch.setattr(company, "contained", lambda *a: seen.append(a[1]) or whole(*a))
    df = spark.createDataFrame(rows, "ord int, company string, jd_text string")
    best = {(r["company_key"], r["other_key"]): (r["ord"], r["other_ord"]) for r in company.same_text(df).collect()}
    assert len(best) == 6 and all(a >= 100 and b >= 100 for a, b in best.values())
    assert seen == [1.0]
    lone = [*rows, (200, "Lone Wolf", " ".join(half + [f"z{j}" for j in range(40)]))]
    seen.clear()
    df = spark.createDataFrame(lone, "ord int, company string, jd_text string")
    got = {(r["company_key"], r["other_key"]): r["overlap"] for r in company.same_text(df).collect()}
    assert got["lonewolf", "firm00000"] == round(len(grams(lone[-1][2]) & grams(lone[-4][2])) / min(len(grams(lone[-1][2])), len(grams(lone[-4][2]))), 2)
    assert len(got) == 12 and seen == [1.0, 0.8, 0.25]


def test_near_duplicates_are_joined_by_few_runs(spark, monkeypatch):
    """Near-duplicates take the join that indexes a fifth of a text's runs, and compare survivors by runs, not by words."""
    rng = random.Random(5)
    base = rng.choices([f"w{i}" for i in range(900)], k=150)
    rows = [(i, f"Firm {i}", "Dev", " ".join(base if i % 2 else rng.choices(base, k=150)), "", "") for i in range(12)]
    df = spark.createDataFrame(rows, "ord int, company string, title string, jd_text string, link string, id string").withColumn("from_correspondence", F.lit(False))
    asked, whole = [], neardup.alike
    monkeypatch.setattr(neardup, "alike", lambda *a: asked.append(a[1]) or whole(*a))
    _, absorbed = neardup.collapse(df)
    assert {(r["ord"], r["survivor"], r["overlap"], r["similarity"]) for r in absorbed.collect()} == {(i, 1, 1.0, 1.0) for i in (3, 5, 7, 9, 11)}
    assert asked == [0.8]


def test_precedents_count_words_in_batches(spark):
    """The search's vectors are made many texts at a time, documents and questions alike."""
    from vacancylens.operators import precedents

    docs = spark.createDataFrame([("job:a", "a b c a", 1), ("job:b", None, 2)], "key string, content string, n int")
    got = precedents.embedded(docs)
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()
    want = docs.withColumn("_vector", bucket_counts("content")).drop("content")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
