"""Streams over several runs: cached results, seen keys, late rows, source alerts."""

import datetime as dt
import time

from pyspark.sql import functions as F

from vacancylens.streaming import cache, feed, keytable

PROBES = "key string, at timestamp, entry boolean, value string"


def day(n, hour=12):
    return dt.datetime(2024, 1, n, hour)


def land(spark, base, rows, schema=PROBES):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(schema).parquet(f"{base}/in")


def answers(spark, base):
    return sorted(((r["key"], r["today"].day, r["researched"] and r["researched"].day, r["age_days"], r["value"], r["asked"])
                   for r in spark.read.parquet(f"{base}/out").collect()), key=str)


def run_cache(spark, base, rows, **options):
    stream = land(spark, base, rows)
    assert cache.run_cached(cache.cached(stream, **options), f"{base}/out", f"{base}/cp").awaitTermination(120)


def test_cached_results_answer_until_they_run_out(spark, tmp_path):
    base = str(tmp_path)
    run_cache(spark, base, [("a", day(1), True, "one"), ("a", day(1, 13), True, "two"), ("a", day(1), False, None), ("b", day(1), True, "b1"),
                            ("c", day(2), False, None), (None, day(1), True, "x"), ("d", None, False, None), ("a", day(1, 9), False, "")], max_age=3)
    assert answers(spark, base) == sorted([("a", 1, 1, 0, "two", 2), ("c", 2, None, None, None, 1)], key=str)
    # A new run goes on from the checkpoint; the newest entry counts, an older day still answers its own probes.
    run_cache(spark, base, [("a", day(4), False, None), ("a", day(5), True, "five"), ("a", day(4), True, "four"), ("b", day(5), False, None)], max_age=3)
    assert answers(spark, base)[-3:] == sorted([("a", 1, 1, 0, "two", 2), ("a", 4, 4, 0, "four", 1), ("b", 5, None, None, None, 1), ("c", 2, None, None, None, 1)], key=str)[-3:]
    assert {r["key"] for r in cache.live_keys(spark, f"{base}/cp").collect()} >= {"a"}
    # Days later the watermark has passed every entry: the state is gone, and the probe misses.
    run_cache(spark, base, [("z", day(20), True, "new")], max_age=3)
    run_cache(spark, base, [("a", day(21), False, None), ("z", day(21), False, None)], max_age=3)
    assert {r["key"] for r in cache.live_keys(spark, f"{base}/cp").collect()} == {"z"}
    assert ("a", 21, None, None, None, 1) in answers(spark, base) and ("z", 21, 20, 1, "new", 1) in answers(spark, base)


def test_late_probes_and_entries_of_later_days(spark, tmp_path):
    base = str(tmp_path)
    run_cache(spark, base, [("a", day(10), True, "ten"), ("a", day(9), True, "nine"), ("a", day(9), False, None), ("a", day(8), False, None)], max_age=3, late_days=2)
    run_cache(spark, base, [("a", day(9), False, None), ("a", day(10, 20), True, "later"), ("a", day(12), False, None)], max_age=3, late_days=2)
    assert answers(spark, base) == sorted([("a", 8, None, None, None, 1), ("a", 9, 9, 0, "nine", 1), ("a", 9, 9, 0, "nine", 1), ("a", 12, 10, 2, "later", 1)], key=str)


def test_store_drops_keys_by_its_own_clock(spark, tmp_path):
    base = str(tmp_path)

    def run(rows, wanted):
        stream = cache.cached(land(spark, base, rows), clock="processing", ttl_ms=2000)
        running = cache.run_cached(stream, f"{base}/out", f"{base}/cp", every="1 second")
        try:
            for _ in range(60):
                time.sleep(1)
                if running.lastProgress and len(answers(spark, base)) == wanted:
                    break
        finally:
            running.stop()

    run([("a", day(1), True, "one"), ("a", day(2), False, None)], 1)
    time.sleep(3)
    run([("a", day(2), False, None)], 2)
    assert answers(spark, base) == sorted([("a", 2, 1, 1, "one", 1), ("a", 2, None, None, None, 1)], key=str)


def keys_of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def test_a_batch_opens_only_folders_that_may_hold_its_keys(spark, tmp_path):
    path = str(tmp_path / "seen")
    table = keytable.KeyTable(spark, path, buckets=16, generations=4)
    first = [f"k{i}" for i in range(400)]
    assert table.known(keys_of(spark, "k1"), 0).count() == 0
    table.append(keys_of(spark, *first), 0)
    table.known(keys_of(spark, *[f"new{i}" for i in range(20)]), 1)
    assert len(table.opened) <= 2  # false hits of the filters, out of 16 folders
    known = table.known(keys_of(spark, "k7", "new1"), 1)
    assert [r["key"] for r in known.collect()] == ["k7"] and len(table.opened) <= 2
    files = table._rows().filter(table._of(table.opened)).select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r["f"].rsplit("/", 1)[0] for r in files}) == len(table.opened)
    # A batch never sees what it wrote itself, and writing it again changes nothing.
    for _ in range(2):
        table.append(keys_of(spark, "x", "y"), 1)
    assert table.known(keys_of(spark, "x", "k1"), 1).count() == 1
    assert sorted(r["key"] for r in table.known(keys_of(spark, "x", "k1", None), 2).collect()) == ["k1", "x"]


def test_many_generations_are_merged(spark, tmp_path):
    table = keytable.KeyTable(spark, str(tmp_path / "seen"), buckets=2, generations=3)
    for batch in range(8):
        table.append(keys_of(spark, *[f"b{batch}-{i}" for i in range(30)]), batch)
    gens = {r["bucket"]: r["n"] for r in table._filters().groupBy("bucket").agg(F.countDistinct("gen").alias("n")).collect()}
    assert set(gens) == {0, 1} and max(gens.values()) <= 4
    everything = keys_of(spark, *[f"b{b}-{i}" for b in range(8) for i in range(30)])
    assert table.known(everything, 99).select("key").distinct().count() == 240
    assert table.known(everything, 7).select("key").distinct().count() == 210


def test_index_reads_hashes_not_texts(spark, tmp_path):
    base, schema = str(tmp_path), "key string, content string, run string, ord long"
    for run, rows in enumerate([[("k", "v1"), ("m", "x")], [("k", "v1"), ("m", "y")], [("k", "v2"), ("m", "y")], [("k", "v1")]]):
        df = spark.createDataFrame([(*r, str(run), i) for i, r in enumerate(rows)], schema)
        df.write.mode("append").parquet(f"{base}/in")
        feed.index_feed(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/index", f"{base}/cp", df.schema).awaitTermination(120)
    got = sorted((r["key"], r["content"], r["batch"]) for r in spark.read.parquet(f"{base}/index").collect())
    assert got == [("k", "v1", 0), ("k", "v1", 3), ("k", "v2", 2), ("m", "x", 0), ("m", "y", 1)]
    assert "content" not in spark.read.parquet(f"{base}/index-versions/rows").columns


def test_landed_payloads_open_only_the_folders_asked_for(spark, tmp_path):
    from vacancylens.sources import payloads

    for name, lines in (("a", ["1", "é"]), ("b", ["x"]), ("c", [])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "one.json").write_text("".join(f"{x}\n" for x in lines), encoding="utf-8")
    (tmp_path / "a" / "two.json").write_text("last line without end")
    (tmp_path / "a" / "_SUCCESS").write_text("no payload")
    payloads.register(spark)
    rows = spark.read.format(payloads.FORMAT).load(str(tmp_path))
    got = sorted((r["source"], r["file"].rsplit("/", 1)[1], r["ord"], r["body"]) for r in rows.collect())
    assert got == [("a", "one.json", 0, "1"), ("a", "one.json", 1, "é"), ("a", "two.json", 0, "last line without end"), ("b", "one.json", 0, "x")]
    reader = payloads.PayloadReader(f"file://{tmp_path}")
    assert len(reader.partitions()) == 4
    assert list(reader.pushFilters([payloads.EqualTo(("source",), "a"), payloads.EqualTo(("body",), "1")])) == [payloads.EqualTo(("body",), "1")]
    assert len(reader.partitions()) == 2
    assert rows.filter("source in ('b', 'c')").count() == 1
    assert "source" in rows.filter("source = 'a'")._jdf.queryExecution().executedPlan().toString()


def test_a_source_that_returns_nothing_raises_an_alert(spark, tmp_path):
    from vacancylens.streaming import health

    listener = health.SourceListener(spark, {"a": None, "b": None, "k": "no key"}, str(tmp_path / "health"))
    assert listener.rows(3, {"raw_0": 5, "kept_0": 0, "raw_1": 0, "kept_1": 0, "raw_2": 0, "kept_2": 0}) == [
        (3, "a", 5, 0, "ok", False), (3, "b", 0, 0, "nothing returned", True), (3, "k", 0, 0, "no key", False)]


def test_late_rows_go_and_undated_rows_stay(spark, tmp_path):
    base, schema = str(tmp_path), "key string, posted timestamp, ord long"
    landings = [[("a", day(10), 1), ("a", day(10), 2), ("old", day(1), 3), ("u", None, 4)],
                [("late", day(5), 5), ("near", day(9), 6), ("a", day(10), 7), ("u", None, 8), ("v", None, 9)], [("a", day(20), 10)]]
    for rows in landings:
        stream = feed.fresh(land(spark, base, rows, schema), F.lit(day(2)))
        feed.drop_seen(stream, f"{base}/keys", f"{base}/out", f"{base}/cp", buckets=2).awaitTermination(120)
    assert sorted(r["key"] for r in spark.read.parquet(f"{base}/out").collect()) == ["a", "near", "u", "v"]
