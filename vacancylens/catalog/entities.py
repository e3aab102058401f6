"""Queries over entity history, the search index and cached briefs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.catalog import twin as t
from vacancylens.catalog.keys import APPLIED, LATEST, RECORDS, applied
from vacancylens.catalog.registry import query
from vacancylens.catalog.similarity import DUP_SQL, dup_postings
from vacancylens.catalog.views import companies, postings, run_sql, table, with_views
from vacancylens.functions.identity import company_key
from vacancylens.operators import briefs, company, index, pages, windows

PROBES = """select distinct concat(case s_suppkey % 3 when 0 then 'Building ' when 1 then 'Machinery ' else 'The Furniture ' end, lpad(cast(s_suppkey as varchar(20)), 9, '0'),
  case s_suppkey % 4 when 0 then ' Corp' when 1 then ' of Texas' else '' end) as probe from supplier union select distinct c_mktsegment as probe from customer"""


def _same(a: str, b: str) -> str:
    short = f"case when length({a}) <= length({b}) then {a} else {b} end"
    long = f"case when length({a}) <= length({b}) then {b} else {a} end"
    return f"({a} <> '' and {b} <> '' and ({a} = {b} or (length({short}) >= 5 and contains({long}, {short}))))"


@query("same_company", with_views(f""", p as (select distinct {t.company_key('probe')} as probe_key from ({PROBES})), e as (select distinct {t.company_key('company')} as entry_key from companies)
  select probe_key, entry_key from p join e on {_same('probe_key', 'entry_key')}""", "companies"))
def same_company(spark, sf):
    probes = run_sql(spark, PROBES, sf, "supplier", "customer")
    return company.matching_keys(probes.select(company_key("probe").alias("probe_key")),
                                 companies(spark, sf).select(company_key("company").alias("entry_key")))


_ASKED = "select distinct source as probe from documents union select distinct case doc_id % 4 when 0 then 'LinkedIn Corp' when 1 then 'indeed' else 'Greenhouse, Inc.' end from documents"
_SITE = "regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '[^a-z0-9]', '', 'g')"


@query("applied_hits", f"""with applied as ({APPLIED}), records as ({RECORDS}), p as (select probe, {t.company_key('probe')} as k from ({_ASKED})),
    m as (select probe, row, {_same('k', t.company_key('company'))} as by_name, length(k) >= 5 and contains({_SITE}, k) as by_url from p cross join records)
  select probe, row, case when by_name then 'company' else 'url' end as matched_on from m where by_name or by_url""")
def applied_hits(spark, sf):
    return company.applied_hits(run_sql(spark, _ASKED, sf, "documents"), applied(spark, sf)).select("probe", "row", "matched_on")


# Skiplist lines, fifty parts to a file; every tenth line opens a comment that the second next closes.
SKIP_LINES = """select cast(floor(p_partkey / 50) as bigint) as file, p_partkey as pos, case p_partkey % 10 when 3 then '<!-- example lines' when 5 then 'end of it | -->'
  when 7 then '# heading' else concat('src', cast(p_partkey % 20 as varchar(20)), '|', p_name, '|', case when p_partkey % 4 = 0 then 'dallas' else '' end, '  # note ', cast(p_partkey as varchar(20))) end as line from part"""


def skip_files(spark, sf):
    lines = run_sql(spark, SKIP_LINES, sf, "part")
    return lines.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("value"))


_VISIBLE = f"""s as ({SKIP_LINES}), e as (select *, trim(split_part(line, '#', 1)) as job_id, trim(substr(line, strpos(line, '#') + 1)) as reason from s where pos % 10 not in (3, 4, 5, 7)),
  r as (select job_id, split_part(job_id, '|', 1) as company, split_part(job_id, '|', 2) as title, reason from e)"""


@query("src_skiplist", f"with {_VISIBLE} select job_id, company, title, reason from r")
def src_skiplist(spark, sf):
    from vacancylens.sources.text_lists import skiplist_rows
    return skiplist_rows(skip_files(spark, sf))


@query("skiplist_keys", f"with s as ({SKIP_LINES}) select distinct trim(split_part(line, '#', 1)) as key from s where contains(split_part(line, '#', 1), '|')")
def skiplist_keys(spark, sf):
    from vacancylens.sources.text_lists import skiplist_keys as read
    return read(skip_files(spark, sf))


@query("skiplist_hits", f"""with {_VISIBLE}, p as (select probe, {t.company_key('probe')} as k from ({_ASKED}))
  select probe, job_id, reason from p join r on {_same('k', t.company_key('r.company'))}""")
def skiplist_hits(spark, sf):
    return company.skiplist_hits(run_sql(spark, _ASKED, sf, "documents"), src_skiplist(spark, sf)).select("probe", "job_id", "reason")


@query("same_text_other_name", f"""with d as ({DUP_SQL}), k as materialized (select ord, {t.company_key('company')} as key, {t.words('jd_text')} as w from d),
    sh as materialized (select ord, key, {t.shingles('w')} as s from k where len(w) >= 5 and key <> ''), g as (select ord, unnest(s) as x from sh),
    n as (select ord, key, len(s) as n from sh),
    o as (select a.ord as ord, b.ord as other_ord, count(*) as i from g a join g b on a.x = b.x and a.ord <> b.ord group by a.ord, b.ord),
    m as (select na.key as company_key, nb.key as other_key, o.ord, o.other_ord, i / least(na.n, nb.n) as score from o join n na on na.ord = o.ord join n nb on nb.ord = o.other_ord
      where not {_same('na.key', 'nb.key')} and i / least(na.n, nb.n) >= 0.25),
    r as (select *, row_number() over (partition by company_key, other_key order by score desc, other_ord, ord) as place from m)
  select company_key, other_key, round_even(score, 2) as overlap, ord, other_ord from r where place = 1""")
def same_text_other_name(spark, sf):
    return company.same_text(dup_postings(spark, sf))


@query("scored_history", with_views(f""", k as (select *, {t.company_key('company')} as company_key, lower(title) as title_key from postings)
  select company_key, title_key, min_by(case when scored then verdict else '~' end, run || lpad(ord::varchar, 12, '0')) as verdict, min(run)[:10] as first_seen, max(run)[:10] as last_seen
  from k group by all""", "postings"))
def scored_history(spark, sf):
    rows = postings(spark, sf).withColumn("company_key", company_key("company"))
    return company.scored_history(rows, ["company_key"]).select(
        "company_key", "title_key", F.coalesce("verdict", F.lit("~")).alias("verdict"), "first_seen", "last_seen")


# Evidence: four hundred employers, of which some have a page, a board, a shared text, or nothing.
_EMP = "select doc_id, text, n_chars, concat('Firm ', cast(doc_id % 400 as varchar(20)), case when doc_id % 400 % 37 = 1 then ' Staffing' else '' end) as company from documents"
_PAGE = "concat(text, case when doc_id % 17 = 0 then ' We place people.' else '' end)"
_MARK = lambda x: t.first_contained(f"lower({x})", fixed.AGENCY_MARKERS)


@query("employer_class", f"""with e as ({_EMP}), pg as (select company, doc_id as ord, 'https://x/' || doc_id as url, {_PAGE} as text from e where doc_id % 400 % 5 < 2),
    bd as (select company, min('https://b/' || company) as url, 'Our Client needs' as text from e where doc_id % 400 % 7 = 3 group by company),
    st as (select company, 'Other' as other, max(n_chars % 75 + 25) / 100.0::double as overlap from e where doc_id % 400 % 11 = 4 group by company),
    ev as (select distinct company, 0 as l, 0.0::double as n, 'agency' as employer, 'the name itself reads as an agency ("' || {_MARK('company')} || '")' as why from e where {_MARK('company')} is not null
      union all select company, 1, ord, 'agency', url || ' says "' || {_MARK('text')} || '"' from pg where {_MARK('text')} is not null
      union all select company, 2, 0, 'agency', url || ' says "' || {_MARK('text')} || '"' from bd where {_MARK('text')} is not null
      union all select company, 3, -overlap, 'agency', 'the same JD is in your corpus under ' || other || ' (' || cast(floor(overlap * 100) as bigint) || '% phrase overlap) — one req, more than one poster' from st
      union all select company, 4, ord, 'direct', 'nothing on ' || url || ' reads as agency language — probable direct employer, on one page''s evidence' from pg
      union all select distinct company, 5, 0, 'undetermined', 'nothing was read that says who the employer actually is' from e),
    r as (select *, row_number() over (partition by company order by l, n) as k from ev)
  select company, employer, why from r where k = 1""")
def employer_class(spark, sf):
    e = run_sql(spark, _EMP, sf, "documents")
    bucket = F.col("doc_id") % 400
    pg = e.filter(bucket % 5 < 2).select("company", F.col("doc_id").alias("ord"), F.concat(F.lit("https://x/"), F.col("doc_id").cast("string")).alias("url"), F.expr(_PAGE).alias("text"))
    bd = e.filter(bucket % 7 == 3).groupBy("company").agg(F.min(F.concat(F.lit("https://b/"), "company")).alias("url")).withColumn("text", F.lit("Our Client needs"))
    st = e.filter(bucket % 11 == 4).groupBy("company").agg((F.max(F.col("n_chars") % 75 + 25) / 100.0).alias("overlap")).withColumn("other", F.lit("Other"))
    return pages.employer_class(e.select("company").distinct(), pg, bd, st)


# Boards that answered, per supplier; the postings of a board are the line items of its supplier.
@query("company_openings", """with p as (select s_name as company, 's' || s_suppkey as slug, s_suppkey from supplier),
    b as (select s_suppkey, case when s_suppkey % 6 = 0 then 'lever' when s_suppkey % 3 = 0 then 'greenhouse' when s_suppkey % 4 = 0 then 'ashby' end as platform from supplier),
    n as (select l_suppkey, count(*) as n from lineitem where l_suppkey % 12 <> 0 group by 1)
  select company, slug, case when platform is not null then platform when p.s_suppkey % 5 = 0 and p.s_suppkey % 10 <> 0 then 'careers-page' else 'none' end as source,
    platform is not null or (p.s_suppkey % 5 = 0 and p.s_suppkey % 10 <> 0) as ok, case when platform is not null then coalesce(n, 0) end as openings,
    case when platform is null and p.s_suppkey % 5 = 0 and p.s_suppkey % 10 <> 0 then 'https://s' || p.s_suppkey || '.example/careers' end as page_url
  from p join b using (s_suppkey) left join n on n.l_suppkey = p.s_suppkey""")
def company_openings(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("company"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("slug"))
    found = F.array_compact(F.array(
        F.when(F.col("s_suppkey") % 3 == 0, F.struct(F.lit("greenhouse").alias("platform"), F.when(F.col("s_suppkey") % 6 == 0, 2).otherwise(1).alias("priority"))),
        F.when(F.col("s_suppkey") % 6 == 0, F.struct(F.lit("lever").alias("platform"), F.lit(1).alias("priority"))),
        F.when((F.col("s_suppkey") % 4 == 0) & (F.col("s_suppkey") % 3 != 0), F.struct(F.lit("ashby").alias("platform"), F.lit(3).alias("priority")))))
    boards = s.select("slug", F.explode(found).alias("b")).select("slug", "b.*")
    chosen = F.expr("case when l_suppkey % 6 = 0 then 'lever' when l_suppkey % 3 = 0 then 'greenhouse' when l_suppkey % 4 = 0 then 'ashby' end")
    openings = table(spark, sf, "lineitem").filter("l_suppkey % 12 <> 0").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("slug"), chosen.alias("platform"))
    careers = s.filter("s_suppkey % 5 = 0").select("slug", F.explode(F.array(F.lit("careers"), F.lit("jobs"))).alias("path"), "s_suppkey").select(
        "slug", F.concat(F.lit("https://"), "slug", F.lit(".example/"), "path").alias("url"),
        F.when(F.col("s_suppkey") % 10 == 0, F.concat(F.lit("Just a moment "), F.repeat(F.lit("x"), 300))).otherwise(F.repeat(F.lit("open roles "), 40)).alias("text"),
        F.when(F.col("path") == "careers", 0).otherwise(1).alias("path_order"))
    return pages.company_openings(s, boards, openings, careers)


_TRAITS = """array_to_string(list_filter([nullif(trim(employment_type), ''), nullif(trim(cadence), ''), case when is_agency then 'agency' end, nullif(trim(rate), '')], lambda x: x is not null), ' · ')"""
_FLAGS = "array_to_string(list_filter(list_transform(string_split(red_flags_text, '|'), lambda x: trim(x)), lambda x: x <> ''), ' · ')"
_WS = t.q(" \t\n\r")
_JDTEXT = f"coalesce(nullif(trim(fetched_jd, {_WS}), ''), trim(email_jd_text, {_WS}))"
CONTENT = f"""coalesce(nullif(trim(title, {_WS}), ''), '(untitled)') || ' — ' || coalesce(nullif(trim(company), ''), '(unknown company)')
  || case when scored then chr(10) || 'Verdict: ' || verdict || ' · ' || fit_score || '/100 · tier ' || tier || case when {_TRAITS} <> '' then ' · ' || {_TRAITS} else '' end
     || case when why <> '' then chr(10) || 'Why: ' || why else '' end || case when role_summary <> '' then chr(10) || 'Role: ' || role_summary else '' end
     || case when meets_goals <> '' then chr(10) || 'Fit: ' || meets_goals else '' end || case when {_FLAGS} <> '' then chr(10) || 'Red flags: ' || {_FLAGS} else '' end else '' end
  || case when {_JDTEXT} <> '' then chr(10) || 'JD: ' || {_JDTEXT} else '' end"""


@query("build_docs", with_views(f" select ord, 'job:' || {t.composite('company', 'title')} as key, {CONTENT} as content, scored, prefiltered from postings where company <> '' or title <> '' or {_JDTEXT} <> ''", "postings"))
def build_docs(spark, sf):
    return index.build_documents(postings(spark, sf)).select("ord", "key", "content", "scored", "prefiltered")


_BY_KEY = "row_number() over (partition by {key} order by run desc, ord desc)"


@query("index_upsert", with_views(f""", d as materialized (select ord, run, 'job:' || {t.composite('company', 'title')} as key, {CONTENT} || case when run >= '2024-01-04' and ord % 2 = 0 then ' v2' else '' end as content from ({LATEST})),
    old as (select key, content from (select *, {_BY_KEY.format(key='key')} as n from d where run < '2024-01-05') where n = 1),
    new as (select key, content from (select *, {_BY_KEY.format(key='key')} as n from d where run >= '2024-01-03') where n = 1)
  select new.key, case when old.key is null then 'new' else 'changed' end as change from new left join old on old.key = new.key where old.key is null or old.content || case when length(new.key) % 3 = 0 then '.' else '' end <> new.content""", "postings"))
def index_upsert(spark, sf):
    docs = index.build_documents(windows.latest_run(postings(spark, sf)))
    docs = docs.withColumn("content", F.concat("content", F.when((F.col("run") >= "2024-01-04") & (F.col("ord") % 2 == 0), F.lit(" v2")).otherwise(F.lit(""))))
    old = windows.newest_per_key(docs.filter(F.col("run") < "2024-01-05"), "key")
    old = old.withColumn("content", F.concat("content", F.when(F.length("key") % 3 == 0, F.lit(".")).otherwise(F.lit(""))))
    new = windows.newest_per_key(docs.filter(F.col("run") >= "2024-01-03"), "key")
    return index.changed_documents(new, old).select("key", "change")


_BRIEFS = """select s_name as company, case s_suppkey % 3 when 0 then concat('https://jobs.acme', cast(s_suppkey as varchar(20)), '.com/careers') when 1 then '' else concat(s_name, ' Inc') end as target,
  concat('2024-03-', lpad(cast(1 + s_suppkey % 28 as varchar(20)), 2, '0')) as researched, concat('# Brief', chr(10), 'about ', s_name) as markdown from supplier"""


@query("brief_upsert", f"""with b as ({_BRIEFS}), k as (select *, regexp_replace({t.company_key('company')}, '[^a-z0-9]+', '-', 'g') as key,
      case when target = '' then {t.company_key('company')} when starts_with(target, 'https') then 'acme' || regexp_extract(target, 'acme(\\d+)', 1) else {t.company_key('target')} end as asked from b),
    r as (select key, '' as alias, coalesce(nullif(target, ''), company) as target, researched, markdown from k where key is not null union all select asked, key, target, researched, '' from k where asked <> key)
  select key, alias, target, researched, markdown from r""")
def brief_upsert(spark, sf):
    rows = briefs.brief_rows(run_sql(spark, _BRIEFS, sf, "supplier"), "2024-04-01")
    old = rows.filter(F.col("researched") < "2024-03-10").withColumn("markdown", F.lit("stale"))
    return briefs.upsert(old, rows).select("key", "alias", "target", "researched", "markdown")
