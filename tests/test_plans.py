"""Retrospective, snapshots, trend, keys and streams."""

import statistics

import pytest
from pyspark.sql import functions as F

from vacancylens.catalog.sinks import keyword_scorer
from vacancylens.operators import bands, hooks, index, keys, market
from vacancylens.plans import retrospective, snapshots
from vacancylens.streaming import feed


def test_retrospective_adds_up(spark, sf):
    from vacancylens.catalog.views import postings

    r = retrospective.build(postings(spark, sf))
    window = r.window.first()
    splits = r.splits.collect()
    for field in ("employment_type", "cadence", "is_agency"):
        assert sum(s["n"] for s in splits if s["field"] == field) == window["postings"]
    rates = {x["scope"]: x for x in r.rates.collect()}
    assert set(rates) == set(market.SCOPES) and rates["all postings"]["total"] == window["jd_read"]
    named = r.employers.agg(F.sum("n")).first()[0]
    assert named <= window["postings"]


@pytest.mark.parametrize("values", [[], [5.0], [1.0, 2.0], [3.0, 1.0, 2.0, 2.0], [float(i * i % 97) for i in range(500)], [7.0] * 30 + [1e6], [float(i) for i in range(4000)] + [1e12]])
def test_exact_percentiles(spark, values):
    df = spark.createDataFrame([("g", v) for v in values] + [("other", 1.0)], "g string, v double")
    got = {r["g"]: r for r in bands.exact_percentiles(df, ["g"], "v", buckets=8).collect()}
    if not values:
        assert "g" not in got
        return
    r = got["g"]
    assert r["median"] == round(statistics.median(values), 2) and r["mean"] == round(statistics.fmean(values), 2) and r["n"] == len(values)
    if len(values) == 1:
        assert r["p10"] is None and r["p90"] is None
    else:
        cuts = statistics.quantiles(values, n=100, method="inclusive")
        assert [r[p] for p in ("p10", "p25", "p75", "p90")] == pytest.approx([round(cuts[i - 1], 2) for i in (10, 25, 75, 90)])


def snaps(spark, rows):
    return spark.createDataFrame([(a, r, {"postings": p}) for a, r, p in rows], "as_of string, rubric string, metrics map<string,double>")


@pytest.mark.parametrize("rows,ok,n,excluded", [
    ([], False, 0, 0), ([("2024-01-01", "", 1.0)], False, 0, 1), ([("2024-01-01", "a", 1.0), ("2024-02-01", "a", 2.0), ("2024-03-01", "a", 5.0)], True, 3, 0),
    ([("2024-01-01", "a", 1.0), ("2024-02-01", "a", 2.0), ("2024-02-20", "a", 5.0)], False, 3, 0), ([("2024-01-01", "a", 1.0), ("2024-02-01", "b", 2.0), ("2024-05-01", "b", 5.0)], False, 2, 1),
])
def test_trend_gate(spark, rows, ok, n, excluded):
    out = snapshots.trend(snaps(spark, rows)).orderBy("place").collect()
    assert out[0]["place"] == 0 and out[0]["ok"] is ok and out[0]["snapshots"] == n and out[0]["excluded"] == excluded
    assert len(out) == (2 if ok else 1)
    if ok:
        assert (out[1]["first_value"], out[1]["last_value"]) == (1.0, 5.0)


def test_bands_refuse_silent_rows(spark):
    df = spark.createDataFrame([("a ceiling", "x", True, False), ("", "x", False, False), ("plain", "x", True, False)], "caveat string, attribution string, is_ceiling boolean, is_predicted boolean")
    clean, broken = bands.quarantine(df, bands.BAND_RULES)
    assert clean.count() == 1 and broken.count() == 2
    with pytest.raises(Exception, match="ceiling not stated"):
        bands.enforce(df.filter("caveat = 'plain'"), bands.BAND_RULES).collect()


def test_errored_rows_leave_no_key(spark):
    df = spark.createDataFrame([("a|b|", "https://x/1", False, [("d1|",)]), ("c|d|", "", True, None), ("e|f|", "", None, None)], "id string, link string, analysis_errored boolean, duplicates array<struct<id:string>>")
    assert {r["key"] for r in keys.seen_keys(df).collect()} == {"a|b|", "url:https://x/1", "d1|", "e|f|"}


def test_drop_blocked_needs_both_keys_free(spark):
    df = spark.createDataFrame([("a", "https://x/1"), ("b", "https://x/2"), ("c", "")], "id string, link string")
    blocked = spark.createDataFrame([("a",), ("url:https://x/2",)], "key string")
    assert [r["id"] for r in keys.drop_blocked(df, blocked).collect()] == ["c"]


def test_alias_follows_one_hop(spark):
    entries = spark.createDataFrame([("a", "b"), ("b", ""), ("c", "a"), ("d", "gone")], "key string, alias string")
    got = {r["asked"]: r["key"] for r in keys.resolve_alias(entries, entries.select("key")).collect()}
    assert got == {"a": "b", "b": "b"}


def test_ttl(spark):
    cache = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-10"), ("a", "2024-02-01")], "key string, d string").selectExpr("key", "cast(d as date) as researched")
    probes = spark.createDataFrame([("a", d) for d in ("2023-12-31", "2024-01-01", "2024-01-12", "2024-01-24", "2024-01-25")], "key string, d string").selectExpr("key", "cast(d as date) as today")
    got = {str(r["today"]): str(r["researched"]) for r in keys.within_ttl(cache, probes).collect()}
    assert got == {"2024-01-01": "2024-01-01", "2024-01-12": "2024-01-10", "2024-01-24": "2024-01-10"}


def test_scorer_failures_stay_in_their_row(spark):
    df = spark.createDataFrame([(1, "x" * 7), (2, "x" * 60)], "ord int, scorer_text string")
    rows = {r["ord"]: r for r in hooks.score(df, keyword_scorer).collect()}
    assert rows[1]["analysis_errored"] and rows[1]["analysis"]["verdict"] == "SKIP" and rows[2]["analysis"]["verdict"] == "FIT"


def test_plugged_embedder(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "")], "id int, t string")
    rows = {r["id"]: r["embedding"] for r in hooks.embed(df, lambda: lambda ts: [[float(len(t)), 0.0] for t in ts], "t", "id").collect()}
    assert rows == {1: [1.0, 0.0], 2: [0.0, 0.0]}


def test_index_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("k1", "a"), ("k2", "b")], "key string, content string")
    new = spark.createDataFrame([("k2", "B"), ("k3", "c"), ("k1", "a")], "key string, content string")
    assert {(r["key"], r["change"]) for r in index.changed_documents(new, old).collect()} == {("k2", "changed"), ("k3", "new")}
    merged = index.upsert(new, old)
    assert {(r["key"], r["content"]) for r in merged.collect()} == {("k1", "a"), ("k2", "B"), ("k3", "c")}
    assert index.changed_documents(new, merged).count() == 0


def test_seen_stream_over_three_runs(spark, tmp_path):
    base = str(tmp_path)
    for part, rows in enumerate([[(1, "a"), (2, "b"), (3, "a")], [(4, "b"), (5, "c")], [(6, "a")]]):
        spark.createDataFrame(rows, "ord long, key string").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("ord long, key string").parquet(f"{base}/in")
        feed.drop_seen(stream, f"{base}/keys", f"{base}/out", f"{base}/cp").awaitTermination()
    assert sorted((r["ord"], r["key"], r["batch"]) for r in spark.read.parquet(f"{base}/out").collect()) == [(1, "a", 0), (2, "b", 0), (5, "c", 1)]


def test_index_stream_writes_only_changes(spark, tmp_path):
    base = str(tmp_path)
    schema = "key string, content string, run string, ord long"
    for rows in ([("k", "v1", "1", 1), ("m", "x", "1", 2)], [("k", "v1", "2", 1), ("m", "y", "2", 2)], [("m", "y", "3", 2)]):
        df = spark.createDataFrame(rows, schema)
        df.write.mode("append").parquet(f"{base}/in")
        feed.index_feed(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/index", f"{base}/cp", df.schema).awaitTermination()
    assert sorted((r["key"], r["content"], r["batch"]) for r in spark.read.parquet(f"{base}/index").collect()) == [("k", "v1", 0), ("m", "x", 0), ("m", "y", 1)]


def test_daily_table_holds_open_days(spark, tmp_path):
    base = str(tmp_path)
    for rows in ([("2024-01-01 10:00:00",), ("2024-01-02 09:00:00",)], [("2024-01-02 11:00:00",), (None,), ("2024-01-03 00:30:00",)]):
        spark.createDataFrame(rows, "t string").selectExpr("cast(t as timestamp) as ts").write.mode("append").parquet(f"{base}/in")
        totals = feed.daily_totals(spark.readStream.schema("ts timestamp").parquet(f"{base}/in"), "ts", F.count("*").alias("n"))
        feed.keep_daily(totals, f"{base}/out", f"{base}/cp").awaitTermination()
    got = spark.read.parquet(f"{base}/out").select(F.col("as_of").cast("string"), "n").collect()
    assert sorted(map(tuple, got)) == [("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-03", 1)]


def test_links_are_kept_unless_capped(spark):
    from vacancylens.operators import mail

    body = " ".join(f"https://boards.greenhouse.io/acme/jobs/{i}" for i in range(1000, 1300))
    df = spark.createDataFrame([("d", body)], "doc string, body string")
    assert mail.classify_links(df, "doc", "body").count() == 300
    assert mail.classify_links(df, "doc", "body", cap=200).count() == 200


def test_first_wins_settles_long_chains(spark):
    from vacancylens.operators.graph import first_wins

    nodes = spark.createDataFrame([(i, i) for i in range(6)], "node int, priority int")
    edges = spark.createDataFrame([(i, i + 1) for i in range(5)], "hi int, lo int")
    got = {r["node"]: r["leader"] for r in first_wins(nodes, edges).collect()}
    assert got == {i: i - i % 2 for i in range(6)}


def test_labels_that_read_alike_are_one_metric(spark):
    from vacancylens.plans import retrospective as retro

    none = "field string, label string, total long, spellings long, place int, all_clusters long, contributing long, postings long"
    r = retro.Retrospective(
        window=spark.createDataFrame([(4, 4)], "postings long, jd_read long"),
        rates=spark.createDataFrame([], "scope string, n long, total long, share double, " + ", ".join(f"{s} double" for s in retro.STATS)),
        splits=spark.createDataFrame([("employment_type", "Full-time", 2, 0.5), ("employment_type", "Full time", 1, 0.25)], "field string, label string, n long, share double"),
        terms=spark.createDataFrame([], none), employers=spark.createDataFrame([], "name string, n long, is_agency boolean, spellings long"))
    got = {m["key"]: m["value"] for m in retro.metrics(r).collect()}
    assert got["count_employment_type_full_time"] == 3 and got["share_employment_type_full_time"] == 0.75


def test_worklist_shows_what_a_row_absorbed(spark):
    from vacancylens.plans import worklist

    kind = "ord long, title string, company string, duplicates array<struct<id:string,company:string,title:string,link:string,similarity:double,overlap:double>>"
    rows = [(1, "Dev", "acme", [("i", "beta", "Lead", "https://x/1", 0.981, 0.9), ("j", "", None, None, 1.0, 0.835)]), (2, "Solo", "x", []), (3, "", "", None)]
    got = {r["ord"]: r for r in worklist.collapsed(spark.createDataFrame(rows, kind)).collect()}
    assert set(got) == {1} and got[1]["n_absorbed"] == 2 and got[1]["posting"] == "Dev @ acme"
    assert got[1]["absorbed"] == "[Lead @ beta](https://x/1) (similarity 0.98 · JD overlap 90%); Untitled @ unknown (similarity 1.00 · JD overlap 84%)"


def test_archive_list_is_empty_without_messages(spark):
    from vacancylens.plans import worklist

    plan = spark.createDataFrame([("m", "s", "t", 1, "c", "hold", "r")], "mid string, sender string, subject string, n_jobs long, context string, action string, reason string")
    assert worklist.archive_lines(plan, "done", "2024-01-01").count() == 0
    lines = worklist.archive_lines(plan.withColumn("action", F.lit("archive")), "done", "2024-01-01").orderBy("place").collect()
    assert [r["line"] for r in lines][2] == "m\tdone\ts\tt\t1 job(s): c" and lines[0]["line"].startswith("# 1 message(s)")
