"""Queries over the corpus measures, bands, snapshots and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.catalog import twin as t
from vacancylens.catalog.keys import LATEST
from vacancylens.catalog.registry import query
from vacancylens.catalog.similarity import KEYWORDS, leader_sql
from vacancylens.catalog.views import postings, run_sql, table, with_views
from vacancylens.operators import bands, leader, market
from vacancylens.plans import report, retrospective, snapshots
from vacancylens.session import run_dir

FACTS = f""", uni as materialized ({LATEST}), facts as materialized (select *, jd_source = 'full' and trim(fetched_jd) <> '' as is_read,
    case when jd_source = 'full' and trim(fetched_jd) <> '' then {t.midpoint(t.rate('fetched_jd'))} end as hourly,
    case when scored then lower(trim(employment_type)) else '' end as et, case when scored then lower(trim(cadence)) else '' end as cad,
    scored and is_agency as agency from uni)"""
SCOPES = {"all postings": "is_read", "contract": "is_read and starts_with(et, 'contract')", "permanent": "is_read and et = 'permanent'"}
RATES = " union all ".join(f"""select '{s}' as scope, count(case when {c} then hourly end) as n, count(*) filter (where {c}) as total,
  case when count(*) filter (where {c}) > 0 then round_even(count(case when {c} then hourly end) / count(*) filter (where {c}), 4) end as share,
  {t.stats('hourly', c)} from facts""" for s, c in SCOPES.items())
SPLITS = """select field, label, n, round_even(n / sum(n) over (partition by field), 4) as share from (
  select 'employment_type' as field, coalesce(nullif(et, ''), 'unknown') as label, count(*) as n from facts group by all
  union all select 'cadence', coalesce(nullif(cad, ''), 'unknown'), count(*) from facts group by all
  union all select 'is_agency', case when agency then 'agency' else 'direct' end, count(*) from facts group by all)"""
WINDOW = """select count(*) as postings, count(*) filter (is_read) as jd_read, count(distinct run) as runs, min(run)[:10] as first_day,
  max(run)[:10] as last_day, cast(datediff('day', min(run)[:10]::date, max(run)[:10]::date) + 1 as int) as days from facts"""


def facts(spark, sf):
    return market.posting_facts(postings(spark, sf))


@query("rate_reality", with_views(FACTS + " " + RATES, "postings"))
def rate_reality(spark, sf):
    return market.rate_reality(facts(spark, sf))


@query("supply_splits", with_views(FACTS + " " + SPLITS, "postings"))
def supply_splits(spark, sf):
    return market.supply_splits(facts(spark, sf))


@query("corpus_window", with_views(FACTS + " " + WINDOW, "postings"))
def corpus_window(spark, sf):
    return market.corpus_window(facts(spark, sf))


_PRICE = "case when l_quantity > 1 then l_extendedprice end"


@query("percentiles", f"select l_returnflag, l_linestatus, count({_PRICE}) as n, {t.stats(_PRICE)} from lineitem group by l_returnflag, l_linestatus")
def percentiles(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.expr(_PRICE).alias("price"))
    return bands.exact_percentiles(rows, ["l_returnflag", "l_linestatus"], "price")


# Rate rows: every line item is one priced category of a schedule.
RATE_ROWS = """select l_returnflag as term, l_extendedprice as current_price, cast(l_quantity as int) % 15 as min_years_experience,
  case l_linenumber % 3 when 0 then 'Bachelors' when 1 then 'Masters' else '' end as education_level,
  case when l_linestatus = 'O' then 'Contractor' else 'Customer' end as worksite from lineitem"""
_NOTE = ("contract ceiling bill rates This band was truncated at 1,000 of the schedule's rows, which arrive cheapest-first, "
         "so it understates the true median.")


@query("band_ceiling", f"""with r as ({RATE_ROWS}) select term as occupation, count(current_price) as n, {t.stats('current_price')},
  case when count(*) >= 1000 then {t.q(_NOTE)} else 'contract ceiling bill rates' end as caveat, 'schedule' as attribution, true as is_ceiling from r group by term""")
def band_ceiling(spark, sf):
    return bands.ceiling_bands(run_sql(spark, RATE_ROWS, sf, "lineitem"), max_rows=1000)


_KEPT = "coalesce(min_years_experience, 0) >= 5 and education_level = 'Masters' and worksite = 'Contractor' and term <> 'N'"


@query("band_filtered", f"""with r as ({RATE_ROWS}) select term as occupation, count(case when {_KEPT} then current_price end) as n, {t.stats('current_price', _KEPT)} from r group by term""")
def band_filtered(spark, sf):
    where = bands.matches(5, "Masters", "Contractor") & (F.col("term") != "N")
    return bands.ceiling_bands(run_sql(spark, RATE_ROWS, sf, "lineitem"), where=where).select("occupation", "n", *bands.STATS)


# Wage series: every part names an occupation, nations are areas; observations derive from the parts' prices.
_OCC = "select distinct p_type as occupation, lpad(cast(length(p_type) * 1000 + ascii(p_type) as varchar(20)), 6, '0') as code from part"
_AREA = "select n_name as area, case when n_nationkey % 2 = 0 then 'N' else 'S' end as kind, lpad(cast(n_nationkey as varchar(20)), 7, '0') as area_code from nation"
_OBS = """select concat('OEU', kind, area_code, '000000', code, dt) as series_id, nth, cast(2024 - nth as varchar(20)) as year,
  case when (n_nationkey + cast(dt as int)) % 7 = 0 then '-' else concat(cast(n_nationkey + 1 as varchar(20)), ',', lpad(cast(cast(dt as int) * 10 + nth as varchar(20)), 3, '0')) end as value
  from (select distinct n_nationkey, case when n_nationkey % 2 = 0 then 'N' else 'S' end as kind, lpad(cast(n_nationkey as varchar(20)), 7, '0') as area_code from nation) a
  cross join (select distinct lpad(cast(length(p_type) * 1000 + ascii(p_type) as varchar(20)), 6, '0') as code from part) o
  cross join (values ('03'), ('04'), ('06'), ('07'), ('08'), ('09'), ('10'), ('13')) d(dt) cross join (values (0), (1)) n(nth)"""
_WANTED = " union all ".join(f"select occupation, area, '{u}' as unit, '{m}' as measure, concat('OEU', kind, area_code, '000000', code, '{d}') as series_id from occ cross join area"
                             for u, table_ in (("hour", fixed.WAGE_HOURLY), ("year", fixed.WAGE_ANNUAL)) for m, d in table_.items())


@query("band_wage_pivot", f"""with occ as ({_OCC}), area as ({_AREA}), obs as ({_OBS}), w as ({_WANTED}),
    g as (select occupation, area, unit, measure, try_cast(replace(value, ',', '') as double) as v, year from w join obs using (series_id) where nth = 0)
  select occupation, area, unit, {', '.join(f"max(v) filter (measure = '{m}') as {m}" for m in bands.STATS)}, 'OEWS ' || max(year) || ' annual estimates' as period
  from g where v is not null group by occupation, area, unit""")
def band_wage_pivot(spark, sf):
    return bands.wage_bands(run_sql(spark, _OCC, sf, "part"), run_sql(spark, _AREA, sf, "nation"), run_sql(spark, _OBS, sf, "nation", "part"))


def _values(column):
    return f"select trim(x) as value, count(*) as n from (select unnest(string_split({column}, '|')) as x from facts where scored) where trim(x) <> '' group by trim(x)"


def _terms_sql(field, column):
    return f"""select '{field}' as field, label, total, spellings, cast(place as int) as place, all_clusters,
      (select count(*) from facts where scored and trim(replace({column}, '|', '')) <> '') as contributing, (select count(*) from facts) as postings
    from (with recursive {leader_sql(_values(column))}, tot as (select label, sum(n)::bigint as total, count(*) as spellings from clus group by label)
      select *, row_number() over (order by total desc, label) as place, count(*) over () as all_clusters from tot) x where place <= 30"""


TERMS = _terms_sql("resume_keywords", "keywords_text") + " union all " + _terms_sql("red_flags", "red_flags_text")
EMPLOYERS = f"""select * from (with recursive named as (select trim(company) as value, count(*) as n, bool_or(agency) as flagged from facts where trim(company) <> '' group by trim(company)),
  {leader_sql('select value, n from named', 0.88)} select label as name, sum(clus.n)::bigint as n, bool_or(flagged) as is_agency, count(*) as spellings from clus join named using (value) group by label) e"""


@query("term_sections", with_views(FACTS + " " + TERMS, "postings"))
def term_sections(spark, sf):
    return market.term_sections(facts(spark, sf))


@query("employers", with_views(FACTS + " " + EMPLOYERS, "postings"))
def employers(spark, sf):
    return market.employers(facts(spark, sf))


@query("top_with_total", with_views(f""", {leader_sql(KEYWORDS)}, tot as (select label, sum(n)::bigint as total, count(*) as spellings from clus group by label),
    o as (select clus.*, row_number() over (partition by label order by n desc, value) as k from clus where value <> label),
    a as (select label, string_agg(value || ' ' || n, '; ' order by k) as also from o where k <= 8 group by label),
    p as (select *, row_number() over (order by total desc, label) as place, count(*) over () as all_rows from tot)
  select label, total, coalesce(also, '') as also, cast(greatest(spellings - 9, 0) as bigint) as more, cast(place as int) as place, all_rows
  from p left join a using (label) where place <= 30""", "postings"))
def top_with_total(spark, sf):
    clusters = leader.cluster_values(leader.value_counts(postings(spark, sf), "analysis.resume_keywords"))
    shown = market.spellings_shown(clusters)
    return market.top_with_total(shown, 30, "total", "label")


def _measures(source, section, item, *names):
    return " union all ".join(f"select {section} as section, {item} as item, '{m}' as measure, {m}::double as value from {source}" for m in names)


_RANKED = "(select *, row_number() over (partition by is_agency order by n desc, name) as place from e)"


@query("market_retrospective", with_views(FACTS + f""", w as ({WINDOW}), r as ({RATES}), s as ({SPLITS}), tm as ({TERMS}), e as ({EMPLOYERS}), re as (select * from {_RANKED} where place <= 20)
  {_measures('w', "'window'", "'all'", 'postings', 'jd_read', 'runs', 'days')} union all {_measures('r', "'rates'", 'scope', 'n', 'total', 'share', *bands.STATS)}
  union all {_measures('s', "'split ' || field", 'label', 'n', 'share')} union all {_measures('tm', "'terms ' || field", 'label', 'total', 'spellings', 'place')}
  union all {_measures('re', "case when is_agency then 'employers agency' else 'employers direct' end", 'name', 'n', 'spellings', 'place')}""", "postings"))
def market_retrospective(spark, sf):
    return retrospective.long_table(retrospective.build(postings(spark, sf)))


# The registry of sources against the sources that postings came from; two of them send nothing here.
_REG = "(values ('linkedin', null), ('indeed', null), ('greenhouse', null), ('toptal', null), ('lever', null), ('jsearch', 'skipped — set RAPIDAPI_KEY')) r(source, unconfigured)"


def _registry(spark):
    return spark.createDataFrame([("linkedin", None), ("indeed", None), ("greenhouse", None), ("toptal", None), ("lever", None),
                                  ("jsearch", fixed.KEYED_SOURCES["jsearch"])], "source string, unconfigured string")


_HEALTH = f"""select r.source, count(p.ord) as raw, count(*) filter (p.ord is not null and (posted_hint = '' or posted_hint >= '2024-01-15')) as kept,
  case when count(p.ord) > 0 then 'ok' else coalesce(max(unconfigured), 'nothing returned') end as status,
  count(p.ord) = 0 and max(unconfigured) is null as alert from {_REG} left join postings p on p.source_platform = r.source group by r.source"""


@query("source_health", with_views(" " + _HEALTH, "postings"))
def source_health(spark, sf):
    rows = postings(spark, sf).withColumn("source", F.col("source_platform"))
    return market.source_health(rows, _registry(spark), (F.col("posted_hint") == "") | (F.col("posted_hint") >= "2024-01-15"))


@query("zero_sources", with_views(f" select source, status from ({_HEALTH}) where raw = 0", "postings"))
def zero_sources(spark, sf):
    return source_health(spark, sf).filter("raw = 0").select("source", "status")


@query("attribution", f"""with c as (select case doc_id % 4 when 0 then 'remotive' when 1 then 'adzuna' when 2 then 'apex' else 'jsearch' end as source, count(*) as n from documents group by 1)
  select distinct line, rank from c join (values ('adzuna', 0, {t.q(fixed.ATTRIBUTION['adzuna'])}), ('himalayas', 9, {t.q(fixed.ATTRIBUTION['himalayas'])}),
    ('remotive', 10, {t.q(fixed.ATTRIBUTION['remotive'])})) a(source, rank, line) using (source) where n > 0""")
def attribution(spark, sf):
    source = F.expr("case doc_id % 4 when 0 then 'remotive' when 1 then 'adzuna' when 2 then 'apex' else 'jsearch' end")
    return market.attribution_lines(table(spark, sf, "documents").groupBy(source.alias("source")).agg(F.count("*").alias("n")))


@query("eval_spread", """with m as (select l_suppkey as "case", l_returnflag as run, round_even(avg(l_quantity), 2) as mean from lineitem where l_suppkey % 7 <> 0 or l_returnflag = 'A' group by all)
  select "case", max(mean) filter (run = 'A') as "A", max(mean) filter (run = 'N') as "N", max(mean) filter (run = 'R') as "R",
    case when count(*) > 1 then round_even(max(mean) - min(mean), 2) else 0 end as spread from m group by "case" """)
def eval_spread(spark, sf):
    kept = table(spark, sf, "lineitem").filter((F.col("l_suppkey") % 7 != 0) | (F.col("l_returnflag") == "A"))
    means = kept.groupBy(F.col("l_suppkey").alias("case"), F.col("l_returnflag").alias("run")).agg(F.bround(F.avg("l_quantity"), 2).alias("mean"))
    return market.eval_spread(means, ["A", "N", "R"])


@query("review_gate", """with r as (select doc_id, 1 + doc_id % 5 as a, 3 + doc_id % 3 as b, 4 + doc_id % 2 as c, 5 - cast(floor(n_chars / 100) as bigint) % 2 as d,
    [case when text like '%the%' then 'bullet' else 'absent' end, case when text like '%and%' then 'bullet' else 'skills_only' end, case when text like '%que%' then 'bullet' else 'absent' end] as k from documents)
  select doc_id, least(a, b, c, d) >= 4 as passes, cast(len(list_filter(k, lambda x: x = 'absent')) as int) as absent, cast(len(list_filter(k, lambda x: x = 'skills_only')) as int) as skills_only,
    cast(len(list_filter(k, lambda x: x = 'bullet')) as int) as in_bullet from r""")
def review_gate(spark, sf):
    def keyword(word, miss):
        return F.struct(F.lit(word).alias("keyword"), F.when(F.col("text").contains(word), F.lit("bullet")).otherwise(F.lit(miss)).alias("status"))

    rows = table(spark, sf, "documents").select(
        "doc_id", (1 + F.col("doc_id") % 5).alias("a"), (3 + F.col("doc_id") % 3).alias("b"), (4 + F.col("doc_id") % 2).alias("c"),
        (5 - F.floor(F.col("n_chars") / 100) % 2).alias("d"),
        F.array(keyword("the", "absent"), keyword("and", "skills_only"), keyword("que", "absent")).alias("keywords"))
    return market.review_gate(rows, ["a", "b", "c", "d"]).select("doc_id", "passes", "absent", "skills_only", "in_bullet")


@query("run_summary", with_views(""" select count(*) filter (scored) as analysed, count(*) filter (scored and prefiltered) as prefiltered,
  cast(floor(count(*) filter (scored and prefiltered) * 100 / count(*) filter (scored)) as bigint) as prefiltered_pct, count(*) filter (scored and analysis_errored) as errored,
  count(*) filter (link <> '' and jd_source <> 'full') as unfetched, count(*) filter (ord % 3 = 0) as liveness_open, count(*) filter (ord % 3 = 1) as liveness_closed,
  count(*) filter (ord % 3 = 2) as liveness_unknown from postings""", "postings"))
def run_summary(spark, sf):
    state = F.expr("case ord % 3 when 0 then 'open' when 1 then 'closed' else 'unknown' end")
    return market.run_summary(postings(spark, sf).withColumn("liveness", state))


# Snapshots: one per month and order priority; the rubric changes once, except for one priority where it never settles.
SNAPS = """select o_orderpriority as desk, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as as_of,
    case when o_orderpriority = '5-LOW' then '' when o_orderpriority = '4-NOT SPECIFIED' then strftime(date_trunc('month', o_orderdate), '%m') when o_orderdate < timestamp '1997-01-01' then 'r1' else 'r2' end as rubric,
    count(*)::double as postings, round_even(avg(o_totalprice), 2) as rate_median_contract, case when o_orderpriority = '1-URGENT' then null
      else round_even(count(*) filter (o_orderstatus = 'F') / count(*), 4) end as share_cadence_remote
  from orders group by desk, as_of, rubric"""


def monthly(spark, sf):
    month = F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM-dd")
    rubric = (F.when(F.col("o_orderpriority") == "5-LOW", F.lit("")).when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.date_format("o_orderdate", "MM"))
              .when(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp"), F.lit("r1")).otherwise(F.lit("r2")))
    grouped = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("desk"), month.alias("as_of"), rubric.alias("rubric"))
    one = grouped.agg(F.count("*").alias("n"), F.bround(F.avg("o_totalprice"), 2).alias("price"),
                      F.bround(F.count_if(F.col("o_orderstatus") == "F") / F.count("*"), 4).alias("f"))
    entries = F.array_compact(F.array(
        F.struct(F.lit("postings").alias("key"), F.col("n").cast("double").alias("value")),
        F.struct(F.lit("rate_median_contract").alias("key"), F.col("price").alias("value")),
        F.when(F.col("desk") != "1-URGENT", F.struct(F.lit("share_cadence_remote").alias("key"), F.col("f").alias("value")))))
    return one.select("desk", "as_of", "rubric", F.map_from_entries(entries).alias("metrics"))


_TREND = f"""with s as ({SNAPS}), h as (select desk, count(*) as total, max(as_of) filter (rubric <> '') as newest, count(distinct rubric) filter (rubric <> '') as rubrics from s group by desk),
  c as (select h.desk, arg_max(rubric, as_of) filter (rubric <> '') as current from s join h using (desk) group by h.desk),
  e as (select s.desk, count(*) as snapshots, min(as_of) as first, max(as_of) as last, min_by(struct_pack(p := postings, r := rate_median_contract, f := share_cadence_remote), as_of) as a,
    max_by(struct_pack(p := postings, r := rate_median_contract, f := share_cadence_remote), as_of) as b from s join c on s.desk = c.desk and s.rubric = c.current group by s.desk),
  j as (select h.desk, total, rubrics, coalesce(snapshots, 0) as snapshots, first, last, a, b, coalesce(datediff('day', first::date, last::date) + 1, 0) as days from h left join e using (desk)),
  k as (select *, snapshots >= 3 and days >= 60 as ok from j),
  m as (select desk, ok, 0 as place, null as label, null as kind, null::double as first_value, null::double as last_value from k
    union all select desk, ok, 1, 'Postings scored', 'count', a.p, b.p from k where ok
    union all select desk, ok, 6, 'Median stated rate — contract', 'hourly', a.r, b.r from k where ok and a.r is not null and b.r is not null
    union all select desk, ok, 10, 'Remote share of the inbox', 'share', a.f, b.f from k where ok and a.f is not null and b.f is not null)"""


@query("trend_gated", _TREND + """ select desk, m.ok, case when m.ok then '' when snapshots = 0 then 'no comparable snapshots, ' || total || ' without a rubric; a trend needs at least 3 of one rubric over 60 days'
    else snapshots || ' comparable snapshots over ' || days || ' days; a trend needs at least 3 of one rubric over 60 days' end as reason, snapshots, cast(days as int) as days, first, last,
    total - snapshots as excluded, rubrics, place, label, kind, first_value, last_value from k join m using (desk)""")
def trend_gated(spark, sf):
    return snapshots.trend(monthly(spark, sf), by=["desk"])


@query("metric_delta", _TREND + """ select desk, place, kind, case kind when 'share' then printf('%+d pts', cast(round_even((last_value - first_value) * 100, 0) as bigint))
    when 'hourly' then printf('%s%s', case when last_value - first_value < 0 then '-' else '+' end, format('{:,.2f}', abs(round_even(last_value - first_value, 2))))
    else printf('%s%s', case when last_value - first_value < 0 then '-' else '+' end, format('{:,}', abs(cast(last_value - first_value as bigint)))) end as change from m where place > 0""")
def metric_delta(spark, sf):
    rows = snapshots.trend(monthly(spark, sf), by=["desk"]).filter("place > 0")
    return rows.select("desk", "place", "kind", snapshots.change_text().alias("change"))


_METRIC_ROWS = f"""r as ({RATES}), s as ({SPLITS}), w as ({WINDOW}), m as (
  select 'postings' as key, postings::double as value from w union all select 'jd_read', jd_read from w
  union all select 'rate_n_' || replace(scope, ' ', '_'), n from r union all select 'rate_total_' || replace(scope, ' ', '_'), total from r
  union all select 'rate_share_' || replace(scope, ' ', '_'), share from r
  {' '.join(f"union all select 'rate_{x}_' || replace(scope, ' ', '_'), {x} from r" for x in bands.STATS)}
  union all select 'share_' || field || '_' || trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_'), share from s
  union all select 'count_' || field || '_' || trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_'), n from s)"""


_ALL_METRICS = f"""{_METRIC_ROWS}, e as ({EMPLOYERS}), am as (select * from m union all
    select 'employers_who_s_hiring_direct', count(*) filter (not is_agency) from e union all select 'employers_who_s_hiring_agencies', count(*) filter (is_agency) from e)"""


@query("snapshot_metrics", with_views(FACTS + f", {_ALL_METRICS} select key, round(sum(value), 4) as value from am where value is not null group by key", "postings"))
def snapshot_metrics(spark, sf):
    snap = snapshots.snapshot(retrospective.build(postings(spark, sf)), "2024-01-07", "abc")
    return snap.select(F.explode("metrics").alias("key", "value")).select("key", F.round("value", 4).alias("value"))


@query("snapshot_terms", with_views(FACTS + f", tm as ({TERMS}) select field, label, total::bigint as total from tm where place <= {fixed.SNAPSHOT_TERMS}", "postings"))
def snapshot_terms(spark, sf):
    """The leading terms of every field as the snapshot keeps them."""
    snap = snapshots.snapshot(retrospective.build(postings(spark, sf)), "2024-01-07", "abc")
    return snap.select(F.explode("terms").alias("field", "m")).select("field", F.explode("m").alias("label", "total"))


_LONG_STATS = " union all ".join(f"select 'inbox' as part, 'rate reality' as section, scope as item, '{x}' as metric, {x} as value, n, total, '' as note from r where n > 0" for x in bands.STATS)
_BAND_STATS = " union all ".join(f"select 'baseline', 'calc', occupation, '{x}', {x}, n, n, {t.q(fixed.CEILING_FLAG)} from b where {x} is not null" for x in bands.STATS)


def _long(source, section, item, n, total, note, *measures):
    return " ".join(f"union all select 'inbox', {section}, {item}, '{m}', {m}::double, {n}, {total}, {note} from {source}" for m in measures)


@query("report_long", with_views(FACTS + f""", r as ({RATES}), b as (select term as occupation, count(current_price) as n, {t.stats('current_price')} from ({RATE_ROWS}) group by term),
    s as ({SPLITS}), tm as ({TERMS}), e as ({EMPLOYERS}), gaps as (select * from (values ('split employment_type'), ('split cadence'), ('terms resume_keywords'), ('terms red_flags'), ('terms none')) g(section)),
    present as (select 'split ' || field as section from s union select 'terms ' || field from tm)
  {_LONG_STATS} union all select 'inbox', 'rate reality', scope, 'gap', null, n, total, {t.q(report.NO_RATE)} from r where n = 0
  {_long('s', "'split ' || field", 'label', 'n', 'n', "''", 'n', 'share')}
  {_long('tm', "'terms ' || field", 'label', 'contributing', 'postings', "'top ' || place || ' of ' || all_clusters", 'total', 'spellings')}
  {_long('e', "case when is_agency then 'employers agency' else 'employers direct' end", 'name', 'n', 'n', "''", 'n', 'spellings')}
  union all select 'inbox', section, '', 'gap', null, 0, 0, {t.q(report.NO_TERMS)} from gaps where section not in (select section from present)
  union all {_BAND_STATS} union all select 'baseline', 'bls', '', 'gap', null, 0, 0, {t.q(report.NO_BAND)}""", "postings"))
def report_long(spark, sf):
    """The whole report with its gap rows, written for its date and read back; the second baseline sends nothing here."""
    found = bands.ceiling_bands(run_sql(spark, RATE_ROWS, sf, "lineitem")).withColumn("source", F.lit("calc")).withColumn("is_predicted", F.lit(False))
    expected = spark.createDataFrame([("calc",), ("bls",)], "source string")
    rows = report.report(retrospective.build(postings(spark, sf)), found, expected, (*report.SECTIONS, "terms none"))
    path = run_dir(spark, "report")
    report.write_report(rows, "2024-01-07", path)
    return spark.read.parquet(path).select("part", "section", "item", "metric", "value", "n", "total", "note")
