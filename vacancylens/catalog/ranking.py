"""Queries over ranking and the worklist."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.catalog import twin as t
from vacancylens.catalog.registry import query
from vacancylens.catalog.views import postings, with_views
from vacancylens.operators import ranking, windows
from vacancylens.plans import worklist as plan

AGENCIES, PLATFORMS = ("src3", "src7"), ("toptal", "src11")
_HAY = "lower(company || ' ' || source_platform)"
TIER = f"""(case when not scored then 'OPPORTUNISTIC' when verdict <> 'SKIP' and (is_agency or {t.contains_any(_HAY, AGENCIES)}) and employment_type in ('contract', 'contract-to-hire', 'cth', '', 'unknown') then 'PRIMARY'
  when {t.contains_any(_HAY, PLATFORMS)} then 'SECONDARY' else tier end)"""
KEYS = """case final_tier when 'PRIMARY' then 0 when 'SECONDARY' then 1 else 2 end,
  case when not scored then 3 when verdict = 'STRONG_FIT' then 0 when verdict = 'FIT' then 1 when verdict = 'LOW_FIT' then 2 else 3 end,
  case when scored then intensity else 5 end, -(case when scored then fit_score else 0 end), case when jd_source = 'full' then 0 else 1 end, ord"""
HELD = "(scored and trim(held_back_reason) <> '')"
RISK = f"(scored and intensity >= 4 and not {HELD})"
TELL = "coalesce(nullif(array_to_string(list_filter(string_split(red_flags_text, '|'), lambda x: x <> ''), '; '), ''), why)"
TIERED = f", p as materialized (select *, {TIER} as final_tier from postings)"
SECTIONED = TIERED + f""", b as (select *, case when from_correspondence and scored then 'correspondence' when analysis_errored then 'errored' when {HELD} then 'held_back'
    when scored and verdict = 'SKIP' then 'skipped' when scored and verdict in ('STRONG_FIT', 'FIT') then 'candidate' when scored and final_tier in ('PRIMARY', 'SECONDARY', 'OPPORTUNISTIC') then final_tier
    when link <> '' and jd_source <> 'full' then 'unfetched' else 'unplaced' end as base from p),
  f as (select *, row_number() over (partition by run, base order by {RISK}, {KEYS}) as fr from b),
  s as materialized (select *, case when base <> 'candidate' then base when fr <= 5 then 'focus' when final_tier in ('PRIMARY', 'SECONDARY', 'OPPORTUNISTIC') then final_tier else 'unplaced' end as section from f)"""


def tiered(spark, sf):
    return postings(spark, sf).withColumn("final_tier", ranking.final_tier(AGENCIES, PLATFORMS))


@query("final_tier", with_views(TIERED + " select ord, final_tier from p", "postings"))
def final_tier(spark, sf):
    return tiered(spark, sf).select("ord", "final_tier")


@query("rank_order", with_views(TIERED + f" select run, ord, row_number() over (partition by run order by {KEYS}) as position from p", "postings"))
def rank_order(spark, sf):
    rows = tiered(spark, sf).select("run", "ord", ranking.rank_key().alias("_key"))
    return windows.ranked_within(rows, ("run",), F.col("_key")).select("run", "ord", "position")


@query("hours_risk", with_views(f""" select ord, {HELD} as held_back, {RISK} as risk, case when {RISK} then 'hours (int' || intensity || '): ' || {TELL} else '' end as note from postings""", "postings"))
def hours_risk(spark, sf):
    return postings(spark, sf).select("ord", ranking.is_held_back().alias("held_back"), ranking.hours_risk().alias("risk"), ranking.hours_note().alias("note"))


@query("worklist_sections", with_views(SECTIONED + " select ord, section from s", "postings"))
def worklist_sections(spark, sf):
    return ranking.with_section(tiered(spark, sf)).select("ord", "section")


@query("worklist_table", with_views(SECTIONED + f""" select run, section, row_number() over (partition by run, section order by {RISK}, {KEYS}) as position, ord, final_tier,
    case when scored then verdict end as verdict, case when section in ('held_back', 'skipped') then coalesce(nullif(trim(held_back_reason), ''), {t.q(fixed.UNGROUPED_REASON)}) || ': ' || {TELL}
      when {RISK} then 'hours (int' || intensity || '): ' || {TELL} else '' end as note, link <> '' and jd_source <> 'full' as unfetched_too from s""", "postings"))
def worklist_table(spark, sf):
    return plan.worklist(tiered(spark, sf)).select("run", "section", "position", "ord", "final_tier", "verdict", "note", "unfetched_too")


@query("reason_groups", with_views(f""", g as (select coalesce(nullif(trim(held_back_reason), ''), {t.q(fixed.UNGROUPED_REASON)}) as reason, count(*) as n from postings
    where scored and ({HELD} or verdict = 'SKIP') group by 1)
  select reason, n, cast(row_number() over (order by reason = {t.q(fixed.UNGROUPED_REASON)}, n desc, reason) as int) as place from g""", "postings"))
def reason_groups(spark, sf):
    review = postings(spark, sf).filter(F.col("analysis").isNotNull() & (ranking.is_held_back() | (F.col("analysis.verdict") == "SKIP")))
    return ranking.reason_groups(review)


@query("liveness_targets", with_views(TIERED + f" select ord from p where link <> '' and scored and verdict <> 'SKIP' order by {KEYS} limit 60", "postings"))
def liveness_targets(spark, sf):
    return ranking.liveness_targets(tiered(spark, sf)).select("ord")
