"""Queries that replay a driver table as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacancylens.catalog.keys import identified
from vacancylens.catalog.registry import query
from vacancylens.catalog.rules import JD
from vacancylens.catalog.sinks import keyword_scorer
from vacancylens.catalog.views import run_sql, table, with_views
from vacancylens.operators import hooks
from vacancylens.session import run_dir
from vacancylens.streaming import cache, feed, health


def _finish(q):
    q.awaitTermination()


@query("stream_seen", "select user_id, event_type, min(row(event_id % 3, event_id))[2] as ord from events group by user_id, event_type")
def stream_seen(spark, sf):
    """The events in three landings, a run after each; a user and event type is let through once, by its first landing."""
    base = run_dir(spark, "seen")
    landed = table(spark, sf, "events").select(F.col("event_id").alias("ord"), "user_id", "event_type", F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"))
    for part in range(3):
        landed.filter(F.col("ord") % 3 == part).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(landed.schema).parquet(f"{base}/in")
        _finish(feed.drop_seen(stream, f"{base}/keys", f"{base}/out", f"{base}/checkpoint", buckets=16))
    return spark.read.parquet(f"{base}/out").select("user_id", "event_type", "ord")


@query("stream_score", with_views(f""" select run, count(*) as n, count(*) filter (length({JD}) % 10 = 7) as errored from postings group by run""", "postings"))
def stream_score(spark, sf):
    """The postings as a feed, one run per batch; errored rows leave no seen key."""
    base = run_dir(spark, "score")
    rows = identified(spark, sf).select("ord", "run", "id", "link", F.expr(JD).alias("scorer_text"))
    rows.repartition("run").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/in")

    def scorer(batch):
        return batch.drop("scorer_text").join(hooks.score(batch, keyword_scorer), "ord")

    _finish(feed.score_feed(stream, scorer, f"{base}/state", f"{base}/seen", f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/state").groupBy("run").agg(F.count("*").alias("n"), F.count_if("analysis_errored").alias("errored"))


@query("daily_snapshots", """select strftime(ts, '%Y-%m-%d') as as_of, count(*) as n, count(*) filter (event_type = 'error') as errors from events
  where ts is not null group by 1""")
def daily_snapshots(spark, sf):
    """Daily totals of all days, those still open included."""
    base = run_dir(spark, "daily")
    schema = table(spark, sf, "events").schema
    events = feed.read_table(spark, sf, "events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    totals = feed.daily_totals(events, "ts", F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    _finish(feed.keep_daily(totals, f"{base}/out", f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/out").select(F.col("as_of").cast("string").alias("as_of"), "n", "errors")


@query("ttl_cache_stream", """with c as (select user_id, cast(ts as date) as day, max(struct_pack(ts := ts, props := props)).props as props from events
    where event_type = 'view' group by all),
  q as (select user_id, cast(ts as date) as today, count(*) as asked from events where event_type = 'error' group by all),
  h as (select q.user_id, today, asked, max(day) as day from q left join c on c.user_id = q.user_id and datediff('day', day, today) between 0 and 3 group by all)
  select h.user_id::varchar as key, strftime(today, '%Y-%m-%d') as today, strftime(h.day, '%Y-%m-%d') as researched,
    datediff('day', h.day, today)::int as age_days, props as value, asked from h left join c on c.user_id = h.user_id and c.day = h.day""")
def ttl_cache_stream(spark, sf):
    """The events landing ten days at a time, a restarted run for each: views are results that live for three days, errors
    are probes."""
    base = run_dir(spark, "cache")
    events = table(spark, sf, "events").filter(F.col("event_type").isin("view", "error")).select(
        F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "view").alias("entry"),
        F.col("props").alias("value"))
    for low, high in ((1, 10), (11, 20), (21, 31)):
        events.filter(F.dayofmonth("at").between(low, high)).write.mode("append").parquet(f"{base}/in")
        landed = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        _finish(cache.run_cached(cache.cached(landed, max_age=3), f"{base}/out", f"{base}/checkpoint"))
    out = spark.read.parquet(f"{base}/out")
    return out.select("key", F.date_format("today", "yyyy-MM-dd").alias("today"), F.date_format("researched", "yyyy-MM-dd").alias("researched"),
                      "age_days", "value", "asked")


_LANDED = """select concat('k', cast(cast(floor(doc_id / 9) as bigint) % 60 as varchar(20))) as key, doc_id as ord, cast(doc_id % 3 as varchar(20)) as run,
  case when doc_id % 4 = 0 then text else concat('unchanged ', cast(doc_id % 2 as varchar(20))) end as content from documents"""


@query("index_stream", f"""with l as ({_LANDED}), n as (select * from l qualify row_number() over (partition by key, run order by ord desc) = 1),
  c as (select *, lag(content) over (partition by key order by run) as before from n)
  select key, run, ord, sha256(content) as hash from c where before is null or before <> content""")
def index_stream(spark, sf):
    """Documents landing in three runs: of each run only the new and changed ones are indexed."""
    base = run_dir(spark, "index")
    landed = run_sql(spark, _LANDED, sf, "documents")
    for run in range(3):
        landed.filter(F.col("run") == str(run)).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(landed.schema).parquet(f"{base}/in")
        _finish(feed.index_feed(stream, f"{base}/index", f"{base}/checkpoint", landed.schema))
    return spark.read.parquet(f"{base}/index").select("key", "run", "ord", "hash")


# The events in three landings of ten days. Every 50th is undated; of the first five days, some come only with the second
# landing, days too late; of the tenth day, some come then too, late but within two days, and others come twice.
_DAY = "extract(day from ts)"


@query("late_rows", f"""select event_id, event_id % 50 <> 7 as dated from events where event_id % 50 = 7 or ({_DAY} >= 2 and not (event_id % 50 = 3 and {_DAY} <= 5))""")
def late_rows(spark, sf):
    """Rows from the second day on, once each: undated ones stay, those behind the watermark go."""
    base = run_dir(spark, "late")
    day = F.dayofmonth("ts")
    events = table(spark, sf, "events").select("event_id", F.col("event_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    held = (F.col("event_id") % 50 == 3) & ((day <= 5) | (day == 10))
    again = (day == 10) & (F.col("event_id") % 10 == 0) | (F.col("event_id") % 100 == 7) & (day <= 10)
    landings = [(day <= 10) & ~held, day.between(11, 20) | held | again, day > 20]
    for when in landings:
        landed = events.filter(when).select("event_id", "key", F.when(F.col("event_id") % 50 != 7, F.col("ts")).alias("ts"))
        landed.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(landed.schema).parquet(f"{base}/in")
        inside = feed.fresh(stream, F.lit("2024-01-02").cast("timestamp"), time="ts")
        _finish(feed.drop_seen(inside, f"{base}/keys", f"{base}/out", f"{base}/checkpoint", ord_col="event_id", buckets=16))
    return spark.read.parquet(f"{base}/out").select("event_id", F.col("ts").isNotNull().alias("dated"))


_SOURCES = {"view": None, "click": None, "signup": None, "purchase": None, "ghost": None, "keyed": "skipped: no key"}


@query("source_rot_stream", f"""with r(source, reason) as (values {', '.join(f"('{k}', {'null' if v is None else repr(v)})" for k, v in _SOURCES.items())}),
  e as (select event_type as source, event_id % 3 as batch, value from events where not (event_type = 'signup' and event_id % 3 = 1)),
  c as (select b.batch, r.source, reason, count(e.batch) as raw, count(*) filter (e.source = 'click' and value > 20 or e.source <> 'click' and value > 1000000) as kept
    from r cross join (values (0), (1), (2)) b(batch) left join e on e.source = r.source and e.batch = b.batch group by all)
  select batch::bigint as batch, source, raw, kept, case when raw > 0 then 'ok' else coalesce(reason, 'nothing returned') end as status, raw = 0 and reason is null as alert from c""")
def source_rot_stream(spark, sf):
    """Events of four sources in three landings, one of them without any row of one source; two more sources are registered."""
    base = run_dir(spark, "health")
    events = table(spark, sf, "events").select(F.col("event_type").alias("source"), "value", "event_id")
    is_kept = F.when(F.col("source") == "click", F.col("value") > 20).otherwise(F.col("value") > 1_000_000)
    listener = health.SourceListener(spark, _SOURCES, f"{base}/health")
    spark.streams.addListener(listener)
    try:
        for part in range(3):
            landed = events.filter((F.col("event_id") % 3 == part) & ~((F.col("source") == "signup") & (F.lit(part) == 1)))
            landed.write.mode("append").parquet(f"{base}/in")
            stream = health.observed(spark.readStream.schema(landed.schema).parquet(f"{base}/in"), _SOURCES, is_kept)
            running = stream.writeStream.format("parquet").option("path", f"{base}/out").option(
                "checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
            health.run_watched(running, listener)
    finally:
        spark.streams.removeListener(listener)
    return spark.read.schema(health.HEALTH).parquet(f"{base}/health")
