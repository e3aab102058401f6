"""Queries that write a table and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacancylens.catalog import twin as t
from vacancylens.catalog.keys import ID, archive_plan, identified
from vacancylens.catalog.registry import SQL, query
from vacancylens import fixed
from vacancylens.catalog.rules import JD
from vacancylens.catalog.views import postings, postings_flat, table, with_views
from vacancylens.operators import hooks, rules
from vacancylens.plans import snapshots, worklist
from vacancylens.session import run_dir
from vacancylens.sources import states


@query("snk_state_roundtrip", with_views(""" select run, count(*) as n, count(*) filter (scored) as scored, sum(length(fetched_jd))::bigint as chars,
  count(*) filter (run = '2024-01-02-090000' and ord % 4 = 1) as rewritten from postings where run <> '2024-01-02-090000' or ord % 4 = 1 group by run""", "postings"))
def snk_state_roundtrip(spark, sf):
    """Every run is written, then one run again with half of its rows: the second write replaces that run only."""
    path = run_dir(spark, "states")
    rows = postings(spark, sf).drop("posted_hint")
    states.write_states(rows, path)
    states.write_states(rows.filter((F.col("run") == "2024-01-02-090000") & (F.col("ord") % 4 == 1)).withColumn("final_tier", F.lit("PRIMARY")), path)
    back = states.read_states(spark, path)
    return back.groupBy("run").agg(
        F.count("*").alias("n"), F.count_if(F.col("analysis").isNotNull()).alias("scored"), F.sum(F.length("fetched_jd")).alias("chars"),
        F.count_if(F.col("final_tier") == "PRIMARY").alias("rewritten"))


@query("snk_snapshot", """with d as (select strftime(ts, '%Y-%m-%d') as as_of, count(*) as n from events group by 1) select as_of, case when as_of = '2024-01-05' then -1 else n end as n from d""")
def snk_snapshot(spark, sf):
    path = run_dir(spark, "snapshots")
    days = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("as_of")).agg(F.count("*").alias("n"))
    snapshots.write_snapshot(days, path)
    snapshots.write_snapshot(days.filter("as_of = '2024-01-05'").withColumn("n", F.lit(-1).cast("bigint")), path)
    return spark.read.parquet(path).select(F.date_format("as_of", "yyyy-MM-dd").alias("as_of"), "n")


def keyword_scorer():
    """A scorer as a user would plug one in; it fails on some texts, as a remote one does."""
    def judge(text: str) -> dict:
        if len(text) % 10 == 7:
            raise RuntimeError("spend cap")
        fit = len(text) % 101
        return {"tier": "PRIMARY", "fit_score": fit, "intensity": 3, "verdict": "FIT" if fit >= 50 else "SKIP", "why": "by length"}

    return judge


@query("score_hook", with_views(f""" select ord, case when length({JD}) % 10 = 7 then 0 else length({JD}) % 101 end::int as fit_score, case when length({JD}) % 10 = 7 or length({JD}) % 101 < 50 then 'SKIP' else 'FIT' end as verdict,
  case when length({JD}) % 10 = 7 then 'analysis_error: spend cap' else 'by length' end as why, length({JD}) % 10 = 7 as analysis_errored from postings""", "postings"))
def score_hook(spark, sf):
    rows = postings_flat(spark, sf).select("ord", F.expr(JD).alias("scorer_text"))
    return hooks.score(rows, keyword_scorer).select("ord", "analysis.fit_score", "analysis.verdict", "analysis.why", "analysis_errored")


@query("failure_log", with_views(""" select fetch_error || chr(9) || link || chr(9) || title || ' @ ' || company as line from postings where link <> '' and jd_source <> 'full'""", "postings"))
def failure_log(spark, sf):
    """The log of pages that could not be read, written as text and read back."""
    path = run_dir(spark, "failures")
    worklist.write_lines(worklist.failure_log(postings(spark, sf)), path, "ord")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("queue_json", with_views(f""" select {ID} as id, link, company, title, source_platform, jd_source, why from postings where scored and verdict <> 'SKIP' and link <> ''
  and jd_source <> 'full' and not {t.contains_any('link', fixed.NOT_BROWSER_FETCHABLE)}""", "postings"))
def queue_json(spark, sf):
    """The browser's queue, written as JSON and read back."""
    path = run_dir(spark, "queue")
    worklist.write_queue(identified(spark, sf), path)
    return spark.read.schema("id string, link string, company string, title string, source_platform string, jd_source string, why string").json(path)


@query("archive_list", f"""with p as ({SQL['archive_plan']}), a as (select * from p where action = 'archive')
  select mid || chr(9) || 'triaged' || chr(9) || coalesce(nullif(sender, ''), '?') || chr(9) || coalesce(nullif(subject, ''), '(no subject)') || chr(9) || n_jobs || ' job(s): ' || context as line from a
  union all select '# ' || count(*) || ' message(s) to move out of the inbox into ''triaged''; list of 2024-01-07' from a having count(*) > 0
  union all select '# message id, label, sender, subject, context; separated by tabs' from a having count(*) > 0""")
def archive_list(spark, sf):
    """The archive list with its headings, written as text and read back."""
    path = run_dir(spark, "archive")
    worklist.write_lines(worklist.archive_lines(archive_plan(spark, sf), "triaged", "2024-01-07"), path, "place", "mid")
    return spark.read.text(path).select(F.col("value").alias("line"))
