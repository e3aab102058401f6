"""Queries over key tables, anti joins and row choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacancylens.catalog import twin as t
from vacancylens.catalog.registry import query
from vacancylens.catalog.rules import CORR_SQL, HUMAN_SQL, NAME_SQL, SOURCE_SQL
from vacancylens.catalog.views import mail, postings, run_sql, table, with_views
from vacancylens.functions.identity import job_id
from vacancylens.operators import keys, mail as mails, windows

ID = t.job_id("company", "title", "link")
URLKEY = f"case when link <> '' then 'url:' || {t.normalize_link('link')} end"
# Applied rows: every part stands for one application, with the drift a hand-kept sheet has.
APPLIED = """select cast(p_partkey as int) as row, concat('2024-02-', lpad(cast(1 + p_partkey % 28 as varchar(20)), 2, '0')) as apply_date,
  case when p_partkey % 6 = 0 then '' else concat('src', cast(p_partkey % 20 as varchar(20)), case p_partkey % 3 when 0 then ' Inc' else '' end) end as company,
  case when p_partkey % 7 = 0 then '' else p_name end as title, case when p_partkey % 5 = 0 then 'Dallas, TX' else '' end as city,
  case when p_partkey % 4 = 0 then concat('https://www.linkedin.com/comm/jobs/view/x-', cast(1000000 + p_partkey as varchar(20)), '?trk=a') else '' end as url,
  case p_partkey % 5 when 0 then 'High' when 1 then 'medium' when 2 then 'low' when 3 then 'sure' else '' end as confidence, '' as note from part"""
RECORDS = f"""select row, apply_date, company, title, city, url,
    case when lower(confidence) in ('high', 'medium', 'low') then lower(confidence) when confidence = '' then 'high' else 'low' end as confidence,
    {t.composite('company', 'title', 'city')} as composite_key, case when url <> '' then 'url:' || {t.normalize_link('url')} else '' end as url_key
  from applied where company <> '' or title <> '' or url <> ''"""
APPLIED_KEYS = """select distinct key from (select unnest([case when title <> '' and (company <> '' or city <> '') then composite_key end,
  nullif(url_key, '')]) as key from records where confidence in ('high', 'medium')) where key is not null"""
# Seen: what the earlier runs (all but the last day's) left behind.
SEEN = f"""select distinct key from (select unnest([{ID}, {URLKEY}]) as key from postings where run < '2024-01-04' and not analysis_errored) where key is not null"""
# Skiplist: every fourth posting's composite.
SKIP = f"select distinct {t.composite('company', 'title')} as key from postings where fit_score < 20"
_ALL = f""", applied as ({APPLIED}), records as ({RECORDS}), applied_keys as ({APPLIED_KEYS}), seen as ({SEEN}), skip as ({SKIP}),
  blocked as (select key from seen union select key from skip union select key from applied_keys)"""


def identified(spark, sf):
    return postings(spark, sf).withColumn("id", job_id("company", "title", "link"))


def applied(spark, sf):
    return keys.applied_records(run_sql(spark, APPLIED, sf, "part"))


def seen(spark, sf):
    early = identified(spark, sf).filter(F.col("run") < "2024-01-04").withColumn("duplicates", F.lit(None).cast("array<struct<id:string>>"))
    return keys.seen_keys(early)


def skiplist(spark, sf):
    from vacancylens.functions.identity import composite_id
    return postings(spark, sf).filter(F.expr("cast((ord * 37) % 101 as int)") < 20).select(composite_id("company", "title").alias("key")).distinct()


def blocked(spark, sf):
    return keys.blocked_keys(seen(spark, sf), skiplist(spark, sf), keys.applied_keys(applied(spark, sf)))


@query("src_applied", f"with applied as ({APPLIED}) {RECORDS}")
def src_applied(spark, sf):
    return applied(spark, sf).drop("note")


@query("applied_keys", f"with applied as ({APPLIED}), records as ({RECORDS}) {APPLIED_KEYS}")
def applied_keys(spark, sf):
    return keys.applied_keys(applied(spark, sf))


@query("applied_summary", f"""with applied as ({APPLIED}), records as ({RECORDS}), k as ({APPLIED_KEYS})
  select count(*) as records, count(*) filter (confidence in ('high', 'medium')) as auto_blocked,
    count(*) filter (confidence not in ('high', 'medium')) as held_for_review, (select count(*) from k) as block_keys from records""")
def applied_summary(spark, sf):
    return keys.applied_summary(applied(spark, sf))


@query("blocked_union", with_views(_ALL + " select key from blocked", "postings"))
def blocked_union(spark, sf):
    return blocked(spark, sf)


@query("blocklist_anti", with_views(_ALL + f""" select ord from (select ord, {ID} as id, {URLKEY} as u from postings) p
  where id not in (select key from blocked) and (u is null or u not in (select key from blocked))""", "postings"))
def blocklist_anti(spark, sf):
    return keys.drop_blocked(identified(spark, sf), blocked(spark, sf)).select("ord")


@query("seen_keys", with_views(f""" select distinct key from (select unnest([{ID}, {URLKEY}, case when ord % 5 = 0 then 'dup|' || cast(ord as varchar) || '|' end]) as key
  from postings where not analysis_errored) where key is not null""", "postings"))
def seen_keys(spark, sf):
    dup = F.when(F.col("ord") % 5 == 0, F.array(F.struct(F.concat(F.lit("dup|"), F.col("ord").cast("string"), F.lit("|")).alias("id"))))
    return keys.seen_keys(identified(spark, sf).withColumn("duplicates", dup))


@query("snk_seen_delta", with_views(f""", seen as ({SEEN}), batch as (select distinct key from (select unnest([{ID}, {URLKEY}]) as key from postings
    where run >= '2024-01-04' and not analysis_errored) where key is not null)
  select key from batch except select key from seen""", "postings"))
def snk_seen_delta(spark, sf):
    late = identified(spark, sf).filter(F.col("run") >= "2024-01-04").withColumn("duplicates", F.lit(None).cast("array<struct<id:string>>"))
    return keys.new_keys(keys.seen_keys(late), seen(spark, sf))


_KEYED = f"""select *, {ID} as id, coalesce(nullif({t.link_identity('link')}, ''), {ID}) as link_key from postings"""


@query("resolved_keys", with_views(_ALL + f""", k as ({_KEYED})
  select distinct link_key from k where id in (select key from blocked union select id from k where not analysis_errored and scored)""", "postings"))
def resolved_keys(spark, sf):
    rows = identified(spark, sf).withColumn("link_key", windows.dedup_key())
    scored = rows.filter(F.col("analysis").isNotNull() & ~F.col("analysis_errored")).select(F.col("id").alias("key"))
    return keys.resolved_keys(rows, keys.blocked_keys(blocked(spark, sf), scored))


@query("reconcile_links", with_views(f""", f as (select mid, ord, unnest(regexp_extract_all(content, 'https?://[^\\s"''<>)]+')) as url from mail),
    e as (select mid, 'https://boards.greenhouse.io/acme/jobs/' || split_part(split_part(mid, '-', 1), 'c', 2) || '?gh_src=model' as link, 'Acme' as company, subject as title
      from mail where contains(content, 'greenhouse.io') and ord % 3 <> 0),
    j as (select mid, {t.normalize_link('trim(link)')} as link, company, title from e),
    c as (select distinct mid, {t.link_identity('link')} as identity from j)
  select mid, link, company, title, false as recovered from j
  union all select mid, {t.normalize_link('url')}, '', '', true from f where (mid, {t.link_identity('url')}) not in (select (mid, identity) from c)""", "mail"))
def reconcile_links(spark, sf):
    m = mail(spark, sf)
    found = m.select("mid", F.explode(F.regexp_extract_all("content", F.lit("(https?://[^\\s\"'<>)]+)"), F.lit(1))).alias("url"))
    extracted = m.filter(F.col("content").contains("greenhouse.io") & (F.col("ord") % 3 != 0)).select(
        "mid", F.concat(F.lit("https://boards.greenhouse.io/acme/jobs/"),
                        F.split_part(F.split_part("mid", F.lit("-"), F.lit(1)), F.lit("c"), F.lit(2)), F.lit("?gh_src=model")).alias("link"),
        F.lit("Acme").alias("company"), F.col("subject").alias("title"), F.lit("").alias("email_jd_text"))
    return mails.reconcile(extracted, found)


_LATE = """select distinct id, first_text as late_text from (select id, first_value(text) over (partition by id order by doc_id) as first_text
  from (select p.id, d.text, d.doc_id from (select *, {id} as id from postings) p join documents d on d.doc_id = p.ord + 1 where p.ord % 4 = 0))"""


@query("merge_late_text", with_views(f""", l as ({_LATE.format(id=ID)}), p as (select *, {ID} as id from postings)
  select ord, case when length(trim(late_text, ' ' || chr(10))) >= 120 then 'full' else jd_source end as jd_source,
    md5(case when length(trim(late_text, ' ' || chr(10))) >= 120 then trim(late_text, ' ' || chr(10)) else fetched_jd end) as digest,
    coalesce(length(trim(late_text, ' ' || chr(10))) >= 120, false) or analysis_errored as rescore
  from p left join l on p.id = l.id""", "postings"))
def merge_late_text(spark, sf):
    rows = identified(spark, sf)
    docs = table(spark, sf, "documents").select((F.col("doc_id") - 1).alias("ord"), "text")
    late = rows.filter(F.col("ord") % 4 == 0).select("id", "ord").join(docs, "ord").groupBy("id").agg(F.min_by("text", "ord").alias("late_text"))
    return keys.merge_late_text(rows, late).select("ord", "jd_source", F.md5("fetched_jd").alias("digest"), "rescore")


_FOUND = """select link, min_by(concat('Co ', source_name), ord) as c, min_by(concat(' Dev ', lang), ord) as t from postings
  where link <> '' and ord % 2 = 1 group by link"""


@query("hydrate", with_views(f""", f as ({_FOUND})
  select ord, case when p.link <> '' and (company = '' or title = '') then coalesce(nullif(company, ''), trim(c), '') else company end as company,
    case when p.link <> '' and (company = '' or title = '') then coalesce(nullif(title, ''), trim(t), '') else title end as title
  from postings p left join f on p.link = f.link""", "postings"))
def hydrate(spark, sf):
    rows = postings(spark, sf)
    found = rows.filter((F.col("link") != "") & (F.col("ord") % 2 == 1)).groupBy("link").agg(
        F.min_by(F.concat(F.lit("Co "), "source_name"), "ord").alias("found_company"),
        F.min_by(F.concat(F.lit(" Dev "), "lang"), "ord").alias("found_title")).withColumn("found_platform", F.lit(""))
    return keys.hydrate(rows, found).select("ord", "company", "title")


@query("archive_plan", with_views(f""", k as ({_KEYED}), r as (select distinct link_key from k where scored and ord % 7 <> 0),
    m as (select *, link_key in (select link_key from r) as resolved from k where email_mid <> '' and not from_correspondence),
    g as (select email_mid as mid, bool_and(resolved) as done, min_by(email_sender, ord) as sender, min_by(email_subject, ord) as subject,
      min_by(company, ord) as company, min_by(title, ord) as title, count(*) as n_jobs from m group by email_mid)
  select mid, sender, subject, n_jobs, coalesce(nullif(company, ''), '?') || ' — ' || coalesce(nullif(title, ''), '?') as context,
    case when {HUMAN_SQL} then 'hold' else 'archive' end as action,
    case when {HUMAN_SQL} then 'sender names a person: ' || {NAME_SQL} else '' end as reason from g where done""", "postings"))
def archive_plan(spark, sf):
    rows = identified(spark, sf).withColumn("link_key", windows.dedup_key())
    resolved = rows.filter(F.col("analysis").isNotNull() & (F.col("ord") % 7 != 0)).select("link_key")
    return mails.archive_plan(rows, resolved)


# One cached brief per part; most of them stand for themselves, some point to another, a few point nowhere.
_CACHE = """select concat('k', cast(p_partkey as varchar(20))) as key,
  case p_partkey % 5 when 0 then concat('k', cast(p_partkey + 1 as varchar(20))) when 4 then concat('k', cast(p_partkey - 4 as varchar(20))) else '' end as alias,
  p_name as company, date '2024-03-01' + cast(p_partkey % 40 as int) as researched from part"""


@query("alias_one_hop", f"""with c as ({_CACHE}), h as (select key as asked, coalesce(nullif(alias, ''), key) as key from c)
  select h.asked, h.key, c.company from h join c on h.key = c.key where c.alias = ''""")
def alias_one_hop(spark, sf):
    cache = run_sql(spark, _CACHE, sf, "part")
    return keys.resolve_alias(cache, cache.select("key")).select("asked", "key", "company")


@query("ttl_lookup", """with c as (select user_id, cast(ts as date) as day from events where event_type = 'view'),
    q as (select distinct user_id, cast(ts as date) as today from events where event_type = 'error')
  select user_id, strftime(today, '%Y-%m-%d') as today, strftime(max(day), '%Y-%m-%d') as researched, cast(min(datediff('day', day, today)) as int) as age_days
  from q join c using (user_id) where datediff('day', day, today) between 0 and 14 group by user_id, today""")
def ttl_lookup(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("day"))
    # One cached row per entity and day, which bounds what a single entity can hold.
    cache = events.filter(F.col("event_type") == "view").select("user_id", F.col("day").alias("researched")).distinct()
    probes = events.filter(F.col("event_type") == "error").select("user_id", F.col("day").alias("today")).distinct()
    hit = keys.within_ttl(cache, probes, key="user_id")
    return hit.select("user_id", F.date_format("today", "yyyy-MM-dd").alias("today"),
                      F.date_format("researched", "yyyy-MM-dd").alias("researched"), "age_days")


@query("first_wins", with_views(f""", k as ({_KEYED}), r as (select ord, row_number() over (partition by link_key order by ord % 3, ord) as n from k)
  select ord from r where n = 1""", "postings"))
def first_wins(spark, sf):
    return windows.first_wins(identified(spark, sf).withColumn("channel_rank", F.col("ord") % 3)).select("ord")


@query("first_wins_legacy", with_views(f""", k as (select *, {ID} as id from postings), r as (select ord, row_number() over
    (partition by coalesce(nullif(regexp_replace(split_part(link, '?', 1), '/+$', ''), ''), id) order by ord % 3, ord) as n from k)
  select ord from r where n = 1""", "postings"))
def first_wins_legacy(spark, sf):
    return windows.first_wins(identified(spark, sf).withColumn("channel_rank", F.col("ord") % 3), legacy=True).select("ord")


LATEST = f"""select * from (select *, row_number() over (partition by coalesce(nullif({t.normalize_link('trim(link)')}, ''), {t.composite('company', 'title')})
  order by run desc, ord desc) as latest from postings) where latest = 1"""


@query("latest_run", with_views(f" select ord, run from ({LATEST})", "postings"))
def latest_run(spark, sf):
    return windows.latest_run(postings(spark, sf)).select("ord", "run")


@query("cap_per_source", """select source, l_orderkey, l_linenumber, place from (select *, row_number() over (partition by source order by posted desc nulls last, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as place
    from (select l_returnflag as source, case when l_orderkey % 11 = 0 then null else cast(l_shipdate as date) end as posted, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from lineitem)) where place <= 600""")
def cap_per_source(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("source"), F.when(F.col("l_orderkey") % 11 != 0, F.col("l_shipdate").cast("date")).alias("posted"),
        "l_orderkey", "l_linenumber", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord"))
    return windows.cap_per_source(rows, 600).select("source", "l_orderkey", "l_linenumber", "place")


@query("round_robin", with_views(f""", c as (select mid, ord, {SOURCE_SQL} as klass from mail),
    r as (select *, row_number() over (partition by klass order by ord) as turn, min(ord) over (partition by klass) as seen,
      case klass when 'indeed' then 0 when 'dice' then 1 when 'linkedin' then 2 when 'rvc' then 3 else 4 end as rank from c)
  select mid, klass from r order by turn, rank, seen limit 100""", "mail"))
def round_robin(spark, sf):
    classed = mail(spark, sf).withColumn("klass", mails.email_source("sender", "content"))
    return mails.round_robin(classed, 100, "klass", "ord").select("mid", "klass")


@query("link_discovery", """with h as (select page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) as hrefs from pages),
    u as (select page_id, unnest(hrefs) as link, generate_subscripts(hrefs, 1) - 1 as pos from h),
    f as (select link, min({'page': page_id, 'pos': pos}) as first from u group by link)
  select link, first.page as page, cast(first.pos as int) as pos, count(*) over (partition by first.page) as new_on_page from f""")
def link_discovery(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("pos", "link"))
    found = keys.link_novelty(rows, "page_id", "pos", F.col("link"))
    counts = found.groupBy("page").agg(F.count("*").alias("new_on_page"))
    return found.join(counts, "page").select("link", "page", "pos", "new_on_page")


@query("src_url_list", f"""with u as (select page_id, trim(split_part(case page_id % 10 when 0 then 'not a link' when 1 then '# comment' else url || '  # note' end, '#', 1)) as u from pages),
    w as (select *, row_number() over (partition by {t.normalize_link('u')} order by page_id) as n from u where starts_with(lower(u), 'http://') or starts_with(lower(u), 'https://'))
  select page_id as ord, u as url from w where n = 1""")
def src_url_list(spark, sf):
    from vacancylens.sources.text_lists import url_list
    lines = table(spark, sf, "pages").select(F.col("page_id").alias("ord"), F.expr(
        "case page_id % 10 when 0 then 'not a link' when 1 then '# comment' else concat(url, '  # note') end").alias("value"))
    return url_list(lines, cap=None).select("ord", "url")
