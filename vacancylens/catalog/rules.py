"""Queries over the row rules: screening, mail, pages, bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.catalog import twin as t
from vacancylens.catalog.registry import query
from vacancylens.catalog.views import fetched, mail, postings, postings_flat, table, with_views
from vacancylens.functions.text import strip_tags
from vacancylens.operators import bands, mail as mails, pages, rules, windows
from vacancylens.sources.posting import board_head, posting_text

JD = "coalesce(nullif(fetched_jd, ''), email_jd_text)"


def screened(spark, sf):
    return postings(spark, sf).withColumn("jd_text", F.expr(JD))


def _numbers(x: str, pattern: str, group: int) -> str:
    return (f"list_transform(regexp_extract_all({x}, {t.q('(?i)' + pattern)}, {group}), lambda n: try_cast(n as int))")


YEARS_SQL = (f"coalesce(list_min(list_filter(list_concat({_numbers(JD, fixed.YEARS_AFTER, 1)}, "
             f"{_numbers(JD, fixed.YEARS_BEFORE, 1)}), lambda n: n between 1 and 30)), 0)")
TRAVEL_SQL = (f"coalesce(list_max(list_filter(list_concat({_numbers(JD, fixed.TRAVEL, 1)}, "
              f"{_numbers(JD, fixed.TRAVEL, 2)}), lambda n: n between 1 and 100)), 0)")
CLEARANCE_SQL = (f"(regexp_matches({JD}, {t.q('(?i)' + fixed.CLEARANCE)}) and not regexp_matches({JD}, "
                 f"{t.q('(?i)' + fixed.CLEARANCE_OBTAINABLE)}))")
TITLE_SQL = (f"regexp_matches(regexp_replace(title, {t.q('(?i)' + fixed.IN_LANE_RESCUE)}, ' ', 'g'), "
             f"{t.q('(?i)' + fixed.OFF_LANE_TITLE)})")
REASON_SQL = f"""case when {TITLE_SQL} then 'prefilter: off-lane primary stack in title (' || substr(title, 1, 60) || ')'
  when {JD} <> '' and {YEARS_SQL} >= 10 then 'prefilter: stated ' || cast({YEARS_SQL} as varchar) || '+ year entry bar (>= 10)'
  when {JD} <> '' and {CLEARANCE_SQL} then 'prefilter: requires an active security clearance'
  when {JD} <> '' and {TRAVEL_SQL} >= 50 then 'prefilter: ' || cast({TRAVEL_SQL} as varchar) || '% travel required (>= 50%)' end"""


@query("flt_years_bar", with_views(f" select ord, {YEARS_SQL} as years, {YEARS_SQL} >= 10 as rejected from postings", "postings"))
def flt_years_bar(spark, sf):
    years = rules.entry_years("jd_text")
    return screened(spark, sf).select("ord", years.alias("years"), (years >= fixed.YEARS_BAR).alias("rejected"))


@query("flt_clearance", with_views(f" select ord, {CLEARANCE_SQL} as rejected from postings", "postings"))
def flt_clearance(spark, sf):
    return screened(spark, sf).select("ord", rules.needs_clearance("jd_text").alias("rejected"))


@query("flt_travel", with_views(f" select ord, {TRAVEL_SQL} as travel, {TRAVEL_SQL} >= 50 as rejected from postings", "postings"))
def flt_travel(spark, sf):
    travel = rules.max_travel("jd_text")
    return screened(spark, sf).select("ord", travel.alias("travel"), (travel >= fixed.TRAVEL_BAR).alias("rejected"))


_CAUGHT = ("regexp_matches(regexp_replace(title, '(?i)\\b(javascript|java\\s*script)\\b', ' ', 'g'), "
           "'(?i)(?:^|[^\\w.])(java|\\.net|c#|dotnet|salesforce|sap|abap|ios|android|swift|kotlin|golang|rust|php|drupal)(?:[^\\w#]|$)')")


@query("flt_off_lane", with_views(f" select ord, title, {TITLE_SQL} as rejected, {_CAUGHT} as rejected_strict from postings", "postings"))
def flt_off_lane(spark, sf):
    return postings_flat(spark, sf).select(
        "ord", "title", rules.off_lane_title("title").alias("rejected"),
        rules.off_lane_title("title", catch_symbols=True).alias("rejected_strict"))


@query("hard_skip", with_views(f" select ord, {REASON_SQL} as skip_reason from postings", "postings"))
def hard_skip(spark, sf):
    return screened(spark, sf).select("ord", rules.skip_reason("title", "jd_text").alias("skip_reason"))


@query("screen_bypass", "select doc_id, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 80 as bypass from documents")
def screen_bypass(spark, sf):
    return table(spark, sf, "documents").select("doc_id", rules.too_short_to_screen("text").alias("bypass"))


@query("skip_stub", with_views(f""", r as (select ord, {REASON_SQL} as reason from postings)
  select ord, 'SKIP' as verdict, 0 as fit_score, 3 as intensity, reason as why, reason as red_flags, 'OPPORTUNISTIC' as tier
  from r where reason is not null""", "postings"))
def skip_stub(spark, sf):
    _, skipped = rules.split_by_screen(rules.screen(screened(spark, sf)))
    return skipped.select("ord", "analysis.verdict", "analysis.fit_score", "analysis.intensity", "analysis.why",
                          F.array_join("analysis.red_flags", ";").alias("red_flags"), "analysis.tier")


_HINT = fixed.JOB_HINT.removeprefix(r"\b").removesuffix(r"\b")
HINT_SQL = f"regexp_matches(subject || ' ' || content, {t.q('(?i)' + t.NONWORD + _HINT + t.ENDWORD)})"
CORR_SQL = f"""(case when regexp_matches(sender, {t.q('(?i)' + fixed.PRIVATE_RELAY)}) then true when is_reply then true
  else not regexp_matches(sender, {t.q('(?i)' + fixed.AUTOMATED_SENDER)}) end)"""
NAME_SQL = "trim(case when contains(trim(sender), '<') then trim(split_part(trim(sender), '<', 1)) else '' end, '\"'' ' || chr(9))"
HUMAN_SQL = f"""({NAME_SQL} <> '' and not regexp_matches({NAME_SQL}, {t.q('(?i)' + fixed.ORG_WORD)})
  and len(list_filter(string_split_regex(replace({NAME_SQL}, ',', ' '), '\\s+'), lambda w: w <> '')) between 2 and 3
  and len(list_filter(string_split_regex(replace({NAME_SQL}, ',', ' '), '\\s+'), lambda w: w <> '' and not regexp_matches(w, {t.q(fixed.NAME_WORD)}))) = 0)"""
PLATFORM_SQL = "lower(split_part(regexp_extract(sender, '@([\\w.-]+)', 1), '.', 1))"
HEAD_SQL = "lower(substr(content, 1, 600))"
SOURCE_SQL = f"""(case when contains(lower(sender), 'linkedin') then 'linkedin' when contains(lower(sender), 'indeed') then 'indeed'
  when contains(lower(sender), 'dice') or contains({HEAD_SQL}, 'dice') then 'dice'
  when contains(lower(sender), 'remotevibecoding') or contains({HEAD_SQL}, 'remotevibecoding') then 'rvc'
  else coalesce(nullif({PLATFORM_SQL}, ''), 'other') end)"""


@query("flt_job_hint", with_views(f" select mid, {HINT_SQL} as related from mail", "mail"))
def flt_job_hint(spark, sf):
    return mail(spark, sf).select("mid", mails.job_related("subject", "content").alias("related"))


@query("is_correspondence", with_views(f" select mid, {CORR_SQL} as human from mail", "mail"))
def is_correspondence(spark, sf):
    return mail(spark, sf).select("mid", mails.is_correspondence("sender", "is_reply").alias("human"))


@query("human_sender", with_views(f" select mid, {NAME_SQL} as name, {HUMAN_SQL} as named from mail", "mail"))
def human_sender(spark, sf):
    return mail(spark, sf).select("mid", mails.display_name("sender").alias("name"), mails.has_human_name("sender").alias("named"))


@query("email_source", with_views(f" select mid, {SOURCE_SQL} as source, {PLATFORM_SQL} as platform from mail", "mail"))
def email_source(spark, sf):
    return mail(spark, sf).select(
        "mid", mails.email_source("sender", "content").alias("source"), mails.sender_platform("sender").alias("platform"))


# Page links made absolute, plus the links inside mail: both kinds of text go through the same buckets.
LINKED_TEXT_SQL = """(select concat('p', cast(page_id as varchar(20))) as doc, concat(
    replace(html, 'href="/', concat('href="https://', case page_id % 3 when 0 then 'boards.greenhouse.io' when 1 then 'licdn.com' else 'jobs.example.com' end, '/')),
    ' ', url, ' ', url, '?utm_source=again#x) ', url, '&eacute;t&#233;&amp;n=1&rsquo;') as body from pages
  union all select mid as doc, content as body from mail)"""


def linked_text(spark, sf):
    p = table(spark, sf, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("doc"),
        F.concat(F.replace("html", F.lit('href="/'), F.concat(F.lit('href="https://'), F.expr(
            "case page_id % 3 when 0 then 'boards.greenhouse.io' when 1 then 'licdn.com' else 'jobs.example.com' end"), F.lit("/"))),
            F.lit(" "), "url", F.lit(" "), "url", F.lit("?utm_source=again#x) "), "url", F.lit("&eacute;t&#233;&amp;n=1&rsquo;")).alias("body"))
    return p.unionByName(mail(spark, sf).select(F.col("mid").alias("doc"), F.col("content").alias("body")))


def _entities(x: str) -> str:
    from vacancylens.functions.text import _ENTITIES
    for old, new in (("&copy;", "©"), ("&middot;", "·"), ("&eacute;", "é"), ("&#233;", "é"), ("&rsquo;", "’"), *_ENTITIES):
        x = f"replace({x}, {t.q(old)}, {t.q(new)})"
    return x


_JUNK = " or ".join(f"regexp_matches(url, {t.q('(?i)' + p)})" for p in (fixed.ASSET_URL, fixed.JUNK_HOST, fixed.JUNK_PATH))
BUCKETS_SQL = f""", lt as {LINKED_TEXT_SQL},
  found as (select doc, regexp_extract_all(body, {t.q(fixed.URL_IN_TEXT)}) as raw from lt),
  pos as (select doc, unnest(raw) as raw, generate_subscripts(raw, 1) - 1 as pos from found),
  u as (select doc, pos, {_entities("rtrim(raw, '.,)>\"''')")} as url from pos),
  k as (select doc, pos, url, {t.link_identity('url')} as identity,
    case when {t.contains_any('url', fixed.JOB_HOSTS)} then 'job' when not ({_JUNK}) then 'unclassified' end as bucket from u),
  f as (select *, row_number() over (partition by doc, identity order by pos) as nth from k where bucket is not null and identity <> '')"""


@query("url_buckets", with_views(BUCKETS_SQL + " select doc, cast(pos as int) as pos, identity, url, bucket from f where nth = 1", "mail"))
def url_buckets(spark, sf):
    return mails.classify_links(linked_text(spark, sf), "doc", "body")


@query("unclassified_hosts", with_views(BUCKETS_SQL + f""",
  un as (select url, regexp_extract(url, '^https?://([^/?#]+)', 1) as h from f where nth = 1 and bucket = 'unclassified'),
  shaped as (select case when h <> '' and (regexp_matches(h, {t.q('(?i)' + fixed.ATS_HOST)}) or regexp_matches(substr(url, strpos(url, h) + length(h)), {t.q('(?i)' + fixed.JOB_PATH)}))
    then lower(h) end as host from un)
  select host, count(*) as n, (select count(*) from un) as total_links from shaped where host is not null group by host order by n desc, host limit 12""", "mail"))
def unclassified_hosts(spark, sf):
    found = mails.classify_links(linked_text(spark, sf), "doc", "body").filter(F.col("bucket") == "unclassified")
    hosts = mails.unclassified_hosts(found)
    return hosts.select("host", "n", "total_links")


@query("flt_fresh", """select o_orderkey, case when o_orderkey % 10 = 0 then null else cast(o_orderdate as date) end as posted
  from orders where o_orderkey % 10 = 0 or cast(o_orderdate as date) >= date '1998-06-01'""")
def flt_fresh(spark, sf):
    from vacancylens.functions.dates import in_window
    dated = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate").cast("date")).alias("posted"))
    return dated.filter(in_window("posted", F.lit("1998-06-01").cast("date")))


@query("flt_usable", with_views(" select ord from postings where length(link) > 0 and length(title) > 0", "postings"))
def flt_usable(spark, sf):
    return windows.usable(postings_flat(spark, sf)).select("ord")


@query("flt_slug", f"""select p_partkey, term from (select p_partkey, p_name from part) cross join (values
    {', '.join(f"('kore1', {t.q(x)})" for x in ('ring', 'blue', 'widget'))}) v(source, term)
  where contains(lower(p_name), term)""")
def flt_slug(spark, sf):
    parts = table(spark, sf, "part").withColumn("source", F.lit("kore1"))
    return windows.matching_terms(parts, "p_name", {"kore1": ("ring", "blue", "widget")}).select("p_partkey", "term")


# Each posting's title as the slug of one of the sources in turn.
_SLUG_SOURCE = "case ord % {n} {whens} end".format(
    n=len(fixed.DEV_TERMS), whens=" ".join(f"when {i} then '{name}'" for i, name in enumerate(fixed.DEV_TERMS)))
_DEV_SQL = " or ".join("(source = '{}' and ({}))".format(name, " or ".join(f"contains(slug, {t.q(x)})" for x in terms))
                       for name, terms in fixed.DEV_TERMS.items())


@query("developer_role", with_views(f""", s as (select ord, {_SLUG_SOURCE} as source, replace(lower(title), ' ', '-') as slug from postings)
  select ord, source, slug, ({_DEV_SQL}) as developer from s""", "postings"))
def developer_role(spark, sf):
    rows = postings_flat(spark, sf).select(
        "ord", F.expr(_SLUG_SOURCE).alias("source"), F.expr("replace(lower(title), ' ', '-')").alias("slug"))
    return rows.withColumn("developer", windows.is_developer_role("slug", "source"))


@query("flt_attribution", with_views(f""", s as (select ord, case ord % 3 when 0 then 'adzuna' when 1 then 'remotive' else 'apex' end as source,
    {JD} || case when ord % 2 = 0 then {t.q(fixed.ATTRIBUTION['adzuna'])} else {t.q(fixed.ATTRIBUTION['remotive'])} end as jd_text from postings)
  select source, count(*) as n, sum(case when (source = 'adzuna' and not contains(jd_text, {t.q(fixed.ATTRIBUTION['adzuna'])}))
    or (source = 'remotive' and not contains(jd_text, {t.q(fixed.ATTRIBUTION['remotive'])})) then 1 else 0 end)::bigint as dropped
  from s group by source""", "postings"))
def flt_attribution(spark, sf):
    rows = screened(spark, sf).select(
        F.expr("case ord % 3 when 0 then 'adzuna' when 1 then 'remotive' else 'apex' end").alias("source"),
        F.concat("jd_text", F.when(F.col("ord") % 2 == 0, F.lit(fixed.ATTRIBUTION["adzuna"]))
                 .otherwise(F.lit(fixed.ATTRIBUTION["remotive"]))).alias("jd_text"))
    return rows.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(~windows.is_attributed("source", "jd_text")).alias("dropped"))


_TEXT_SQL = "trim(regexp_replace(body, '<[^>]+>', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13))"
_BLOCKED = t.contains_any("lower(substr(body, 1, 600))", fixed.BLOCK_MARKERS)
_USABLE = f"(link <> '' and error = '' and not {_BLOCKED} and length(trim(body, ' ' || chr(9) || chr(10) || chr(13))) >= 120)"


@query("jd_source", with_views(f"""
  select ord, case when {_USABLE} then 'full' when length(trim(email_jd_text)) >= 120 then 'email_snippet' else 'title_only' end as jd_source,
    case when {_USABLE} or link = '' then '' when error <> '' then error when {_BLOCKED} and body <> '' then {t.q(fixed.ERROR_BLOCKED)}
      else {t.q(fixed.ERROR_NO_TEXT)} end as fetch_error from fetched""", "fetched"))
def jd_source(spark, sf):
    return pages.with_jd_source(fetched(spark, sf), text="body").select("ord", "jd_source", "fetch_error")


_HOST = "regexp_replace(lower(regexp_extract(link, '^https?://([^/?#:]*)', 1)), '^www\\.', '')"
_LOW = "lower(body)"


@query("liveness", with_views(f"""
  select ord, case when link = '' then 'unknown' when {' or '.join(f"ends_with({_HOST}, {t.q(h)})" for h in fixed.AGGREGATOR_HOSTS)} then 'unknown'
      when {' or '.join(f"ends_with({_HOST}, {t.q(h)})" for h, _ in fixed.SESSION_HOSTS)} then 'unknown' when error <> '' then 'unknown'
      when status in (404, 410) then 'closed' when status >= 400 then 'unknown' when {_BLOCKED} then 'unknown'
      when {t.contains_any(_LOW, fixed.CLOSED_MARKERS)} then 'closed' else 'open' end as state,
    case when link = '' then 'no link' when {' or '.join(f"ends_with({_HOST}, {t.q(h)})" for h in fixed.AGGREGATOR_HOSTS)} then {t.q(fixed.AGGREGATOR_NOTE)}
      {' '.join(f"when ends_with({_HOST}, {t.q(h)}) then {t.q(n)}" for h, n in fixed.SESSION_HOSTS)}
      when error <> '' then 'unreachable (' || error || ')' when status >= 400 then 'HTTP ' || cast(status as varchar)
      when {_BLOCKED} then 'bot-walled'
      when {t.contains_any(_LOW, fixed.CLOSED_MARKERS)} then 'page says "' || {t.first_contained(_LOW, fixed.CLOSED_MARKERS)} || '"' else '' end as detail
  from fetched""", "fetched"))
def liveness(spark, sf):
    found = pages.liveness("link", "status", "body", "error")
    return fetched(spark, sf).select("ord", found.alias("l")).select("ord", "l.state", "l.detail")


@query("browser_queue", with_views(f"""
  select ord, link, company, title, jd_source, why from postings where scored and verdict <> 'SKIP' and link <> ''
    and jd_source <> 'full' and not {t.contains_any('link', fixed.NOT_BROWSER_FETCHABLE)}""", "postings"))
def browser_queue(spark, sf):
    return postings(spark, sf).filter(pages.needs_browser()).select(
        "ord", "link", "company", "title", "jd_source", "analysis.why")


@query("flt_precedent", with_views(f"""
  select ord from postings where scored and not prefiltered and not starts_with(why, 'prefilter:') and not starts_with(why, 'analysis_error:')""", "postings"))
def flt_precedent(spark, sf):
    from vacancylens.operators.index import is_precedent
    return postings(spark, sf).filter(is_precedent()).select("ord")


@query("same_ad", f"""with a as (select page_id, trim({_entities("regexp_replace(html, '<[^>]+>', ' ', 'g')")}) as page from pages),
    d as (select p.page_id, p.page, d.text as teaser from a p join documents d on d.doc_id = p.page_id),
    s as (select page_id, regexp_replace(lower(page), '[^a-z0-9]', '', 'g') as p, regexp_replace(lower(case when page_id % 2 = 0 then page else teaser end), '[^a-z0-9]', '', 'g') as x from d)
  select page_id, substr(x, 1, 120) <> '' and contains(p, substr(x, 1, 120)) as same from s""")
def same_ad(spark, sf):
    p = table(spark, sf, "pages").select("page_id", strip_tags("html").alias("page"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), "text")
    both = p.join(d, "page_id").withColumn("teaser", F.when(F.col("page_id") % 2 == 0, F.col("page")).otherwise(F.col("text")))
    return both.select("page_id", pages.same_ad("teaser", "page").alias("same"))


FORBIDDEN_RULES = (
    ("the-cloud", r"\bthe\s+cloud\b", "unbacked", False),
    ("ering-start", r"^ering", "pattern at the start", False),
    ("stupid", r"\bstupid\b", "tone", False),
    ("dollar-run", r"\$\$\$", "junk", True),
    ("that-and", r"\bthat\b.{0,40}\band\b", "phrase", True),
)


@query("forbidden_scan", "select doc_id, rule, why from documents cross join (values " + ", ".join(
    f"({t.q(n)}, {t.q('(?i)' + p)}, {t.q(w)}, {str(prose).lower()})" for n, p, w, prose in FORBIDDEN_RULES) +
    ") r(rule, pattern, why, prose_only) where regexp_matches(text, pattern) and (not prose_only or n_chars >= 200)")
def forbidden_scan(spark, sf):
    return windows.forbidden_hits(table(spark, sf, "documents"), "text", FORBIDDEN_RULES, F.col("n_chars") >= 200).select(
        "doc_id", "rule", "why")


@query("posting_header", with_views("""
  select ord, trim(concat(
    case when trim(employment_type) <> '' then 'Employment type: ' || trim(employment_type) || '. ' else '' end,
    case when trim(lang) <> '' then 'Location: ' || lang || '. ' else '' end,
    case when trim(cadence) <> '' then 'Cadence: ' || cadence || '. ' else '' end,
    case when trim(rate) <> '' then 'Posted rate: ' || rate || '. ' else '' end, trim(role_summary))) as text,
    case when trim(role_summary) <> '' then 'full' else 'title_only' end as jd_source from postings""", "postings"))
def posting_header(spark, sf):
    body, source = posting_text(F.col("role_summary"), employment_type=F.col("employment_type"), metro=F.col("lang"),
                                cadence=F.col("cadence"), rate=F.col("rate"))
    return postings_flat(spark, sf).select("ord", body.alias("text"), source.alias("jd_source"))


@query("board_head", with_views("""
  select ord, case when company <> '' then title || ' — ' || company else title end
    || case when cadence <> '' then chr(10) || 'Location: ' || cadence else '' end
    || case when rate <> '' then chr(10) || 'Compensation (employer-stated): ' || rate else '' end
    || case when posted_hint <> '' then chr(10) || 'Posted: ' || posted_hint else '' end as head
  from postings where trim(title) <> ''""", "postings"))
def board_head_query(spark, sf):
    return postings_flat(spark, sf).filter(F.trim("title") != "").select(
        "ord", board_head(F.col("title"), F.col("company"), F.col("cadence"), F.col("rate"), F.col("posted_hint"), F.lit("")).alias("head"))


@query("score_input", with_views(f"""
  select ord, 'TITLE: ' || coalesce(nullif(title, ''), 'unknown') || chr(10) || 'COMPANY: ' || coalesce(nullif(company, ''), 'unknown')
    || chr(10) || 'SOURCE: ' || source_platform || chr(10) || 'POSTED: ' || coalesce(nullif(posted_hint, ''), 'unknown')
    || chr(10) || 'LINK: ' || coalesce(nullif(link, ''), '(none — inline recruiter email)') || chr(10) || 'JD_SOURCE: ' || jd_source
    || chr(10) || chr(10) || 'JOB DESCRIPTION:' || chr(10) || coalesce(nullif({JD}, ''), {t.q(fixed.SCORER_NO_TEXT)}) as body
  from postings""", "postings"))
def score_input(spark, sf):
    df = screened(spark, sf)
    return df.select("ord", rules.scorer_input(df).alias("body"))


_BANDS = """(select p_partkey, case when p_partkey % 5 = 0 then '' when p_partkey % 5 = 1 then 'a ceiling figure' else 'a Predicted figure' end as caveat,
  case when p_partkey % 7 = 0 then ' ' else 'src' end as attribution, p_partkey % 3 = 0 as is_ceiling, p_partkey % 2 = 0 as is_predicted from part)"""


@query("dq_bands", f"""select p_partkey, coalesce(array_to_string([case when trim(caveat) = '' then 'no caveat' end,
    case when trim(attribution) = '' then 'no attribution' end,
    case when is_ceiling and not contains(lower(caveat), 'ceiling') then 'ceiling not stated' end,
    case when is_predicted and not contains(lower(caveat), 'predict') then 'prediction not stated' end], ';'), '') as violations from {_BANDS}""")
def dq_bands(spark, sf):
    rows = table(spark, sf, "part").selectExpr(
        "p_partkey", "case when p_partkey % 5 = 0 then '' when p_partkey % 5 = 1 then 'a ceiling figure' else 'a Predicted figure' end as caveat",
        "case when p_partkey % 7 = 0 then ' ' else 'src' end as attribution", "p_partkey % 3 = 0 as is_ceiling", "p_partkey % 2 = 0 as is_predicted")
    return bands.with_violations(rows, bands.BAND_RULES).select("p_partkey", F.array_join("violations", ";").alias("violations"))
