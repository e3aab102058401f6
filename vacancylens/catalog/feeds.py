"""Queries over landed payloads. Each payload is built from the driver tables as the JSON a source would send."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.catalog import twin as t
from vacancylens.catalog.registry import query
from vacancylens.catalog.rules import _entities
from vacancylens.catalog.scalars import _WS
from vacancylens.catalog.views import postings, run_sql, table
from vacancylens.session import run_dir
from vacancylens.sources import boards, email_messages, feeds, jsonld, payloads, registry, states

VISIBLE = f"""trim(regexp_replace(array_to_string(list_transform(string_split_regex(text, '\\r\\n|[\\n\\r]'), lambda l: trim(l, {_WS})), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), {_WS})"""
_DAY = "concat('2024-01-', lpad(cast(1 + doc_id % 28 as varchar(20)), 2, '0'))"


def docs(spark, sf):
    return table(spark, sf, "documents").withColumn("day", F.expr(_DAY)).withColumn("key", F.col("doc_id").cast("string"))


def _batched(df, rows, key, size=20):
    """One JSON body per batch of rows, as an answer page carries them."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", rows.alias("j")))), lambda x: x["j"])
    return df.groupBy(F.floor(F.col("doc_id") / size).alias("batch"), key.alias("token")).agg(listed.alias("jobs"))


def _when(test, value):
    return F.when(F.expr(test), value)


def _board_rows(spark, sf):
    d = docs(spark, sf)
    job = F.struct(
        F.concat(F.lit("https://boards.greenhouse.io/x/jobs/"), "key").alias("absolute_url"), _when("doc_id % 2 = 0", F.concat(F.lit("Co "), "source")).alias("company_name"),
        F.concat(F.lit(" Dev "), "key").alias("title"), F.struct(F.col("lang").alias("name")).alias("location"),
        _when("doc_id % 3 <> 0", F.concat("day", F.lit("T09:30:00Z"))).alias("first_published"), _when("doc_id % 9 <> 0", F.concat("day", F.lit("T23:00:00"))).alias("updated_at"),
        _when("doc_id % 4 <> 0", F.array(F.struct((F.expr("(40 + doc_id % 50) * 100000")).alias("min_cents"), _when("doc_id % 8 < 6", F.expr("(60 + doc_id % 50) * 100000")).alias("max_cents"),
              F.lit("USD").alias("currency_type"), _when("doc_id % 5 = 0", F.lit("US Range:")).alias("title")))).alias("pay_input_ranges"),
        F.concat(F.lit("&lt;div&gt;"), "text", F.lit("&lt;/div&gt;&lt;script&gt;track()&lt;/script&gt;")).alias("content"))
    return _batched(d, job, F.concat(F.lit("acme-"), "source")).select("token", F.to_json(F.struct("jobs")).alias("body"))


_HINT = f"case when doc_id % 9 = 0 then '' else {_DAY} end"
_PAY = """case when doc_id % 4 = 0 then '' else case when doc_id % 5 = 0 then 'US Range' else 'Pay range' end || ': ' || format('{:,}', (40 + doc_id % 50) * 1000) || '–'
  || format('{:,}', case when doc_id % 8 < 6 then (60 + doc_id % 50) * 1000 else (40 + doc_id % 50) * 1000 end) || ' USD' end"""


def _board_twin(company, title, link, place, pay, hint):
    return f"""with b as (select doc_id, {link} as link, {company} as company, {title} as title, {hint} as posted_hint, {place} as place, {pay} as pay, {VISIBLE} as body from documents),
    c as (select *, title || ' — ' || company || chr(10) || 'Location: ' || place || case when pay <> '' then chr(10) || 'Compensation (employer-stated): ' || pay else '' end
      || case when posted_hint <> '' then chr(10) || 'Posted: ' || posted_hint else '' end || chr(10) || chr(10) || body as jd from b)
  select link, company, title, posted_hint, case when body <> '' and length(jd) >= 120 then 'full' else 'title_only' end as jd_source, md5(jd) as digest from c"""


def _board_out(df):
    return df.select("link", "company", "title", "posted_hint", "jd_source", F.md5(F.concat("fetched_jd", "email_jd_text")).alias("digest"))


@query("src_greenhouse", _board_twin("case when doc_id % 2 = 0 then 'Co ' || source else 'Acme ' || upper(source[1:1]) || source[2:] end", "'Dev ' || doc_id",
                                     "'https://boards.greenhouse.io/x/jobs/' || doc_id", "lang", _PAY, _HINT))
def src_greenhouse(spark, sf):
    return _board_out(boards.greenhouse(_board_rows(spark, sf)))


def _lever_rows(spark, sf):
    job = F.struct(
        _when("doc_id % 2 = 0", F.concat(F.lit("https://jobs.lever.co/x/"), "key")).alias("hostedUrl"), F.concat(F.lit("https://jobs.lever.co/x/"), "key", F.lit("/apply")).alias("applyUrl"),
        F.concat(F.lit("Dev "), "key").alias("text"), F.struct(F.col("lang").alias("location"), F.lit("Eng").alias("team")).alias("categories"),
        F.unix_millis(F.to_timestamp("day")).alias("createdAt"), _when("doc_id % 3 = 0", F.lit("remote")).alias("workplaceType"),
        _when("doc_id % 4 <> 0", F.struct(F.expr("cast(40 + doc_id % 50 as double)").alias("min"), F.expr("cast(60 + doc_id % 50 as double)").alias("max"), F.lit("USD").alias("currency"),
              F.when(F.expr("doc_id % 5 = 0"), "per-hour-wage").otherwise("per-moon").alias("interval"))).alias("salaryRange"),
        _when("doc_id % 2 = 1", F.col("text")).alias("descriptionPlain"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("description"),
        F.array(F.struct(F.lit("Needs").alias("text"), F.lit("<ul><li>one</li><li>two</li></ul>").alias("content"))).alias("lists"))
    return _batched(docs(spark, sf), job, F.concat(F.lit("acme_"), "source")).select("token", F.to_json("jobs").alias("body"))


_LEVER_PAY = """case when doc_id % 4 = 0 then '' else 'Pay range: ' || (40 + doc_id % 50) || '–' || (60 + doc_id % 50) || ' USD ' || case when doc_id % 5 = 0 then 'per hour' else 'per-moon' end end"""
_LEVER_SQL = _board_twin("'Acme ' || upper(source[1:1]) || source[2:]", "'Dev ' || doc_id", "case when doc_id % 2 = 0 then 'https://jobs.lever.co/x/' || doc_id else 'https://jobs.lever.co/x/' || doc_id || '/apply' end",
                         "lang || case when doc_id % 3 = 0 then ' · remote' else '' end", _LEVER_PAY, _DAY)
_PARTS = "case when doc_id % 2 = 1 and text <> '' then text else " + VISIBLE + " end"


@query("src_lever", _LEVER_SQL.replace(f"{VISIBLE} as body", f"trim(({_PARTS}) || chr(10) || chr(10) || 'Needs' || chr(10) || 'one' || chr(10) || chr(10) || 'two', {_WS}) as body"))
def src_lever(spark, sf):
    return _board_out(boards.lever(_lever_rows(spark, sf)))


@query("src_board_listing", """select case doc_id % 3 when 0 then 'greenhouse' when 1 then 'lever' else 'ashby' end as platform, 'Dev ' || doc_id as title,
    case when doc_id % 3 = 1 and doc_id % 2 = 0 then '' else lang end as location, 'https://x/' || doc_id as url from documents where doc_id % 10 <> 9""")
def src_board_listing(spark, sf):
    d = docs(spark, sf).filter("doc_id % 10 <> 9")
    title, url = F.concat(F.lit("Dev "), "key"), F.concat(F.lit("https://x/"), "key")
    bodies = {
        0: ("greenhouse", F.to_json(F.struct(F.array(F.struct(title.alias("title"), F.struct(F.col("lang").alias("name")).alias("location"), url.alias("absolute_url"))).alias("jobs")))),
        1: ("lever", F.to_json(F.array(F.struct(title.alias("text"), F.struct(_when("doc_id % 2 = 1", F.col("lang")).alias("location")).alias("categories"), url.alias("hostedUrl"))))),
        2: ("ashby", F.to_json(F.struct(F.array(F.struct(title.alias("title"), F.col("lang").alias("location"), url.alias("jobUrl"))).alias("jobs")))),
    }
    platform = F.coalesce(*[F.when(F.col("doc_id") % 3 == i, F.lit(p)) for i, (p, _) in bodies.items()])
    body = F.coalesce(*[F.when(F.col("doc_id") % 3 == i, b) for i, (_, b) in bodies.items()])
    return boards.listings(d.select(platform.alias("platform"), F.col("source").alias("slug"), body.alias("body"))).select("platform", "title", "location", "url")


def _header(*facts):
    return " || ".join(f"case when trim({v}, {_WS}) <> '' then '{k}: ' || trim({v}, {_WS}) || '. ' else '' end" for k, v in facts)


def _feed_twin(where, link, company, title, posted, header, text, source="'full'"):
    return f"""select doc_id as ord, {link} as link, {company} as company, {title} as title, {posted} as posted_hint, case when trim({text}, {_WS}) <> '' then {source} else 'title_only' end as jd_source,
    md5(trim({header} || trim({text}, {_WS}), {_WS})) as digest from documents where {where}"""


def _feed_out(df):
    return df.select("ord", "link", "company", "title", "posted_hint", "jd_source", F.md5("fetched_jd").alias("digest"))


_REMOTE = "contains(lower('Dev ' || doc_id || ' ' || text || ' ' || lang), 'remote')"


@query("src_adzuna", _feed_twin(
    "doc_id % 10 <> 3", "'https://a/' || doc_id", "'Co ' || source", "'Dev ' || doc_id", _DAY, _header(
        ("Employment type", "trim(case when doc_id % 4 = 0 then 'permanent' else 'contract' end || ' ' || case when doc_id % 2 = 0 then 'full_time' else '' end)"),
        ("Location", f"case when {_REMOTE} then 'Remote' else lang end"), ("Cadence", f"case when {_REMOTE} then 'remote' else '' end"),
        ("Posted rate", f"case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then {t.q(fixed.ADZUNA_PREDICTED)} else '$' || (90000 + doc_id % 100) || '-0/yr (posted)' end"),
        ("Attribution", t.q(fixed.ATTRIBUTION["adzuna"]))), "text", "case when doc_id % 6 = 0 then 'full' else 'title_only' end"))
def src_adzuna(spark, sf):
    d = docs(spark, sf)
    item = F.struct(
        F.col("key").alias("id"), F.concat(F.lit("Dev "), "key").alias("title"), F.struct(F.concat(F.lit("Co "), "source").alias("display_name")).alias("company"),
        F.struct(F.col("lang").alias("display_name")).alias("location"), F.when(F.expr("doc_id % 10 = 3"), F.lit("")).otherwise(F.concat(F.lit("https://a/"), "key")).alias("redirect_url"),
        F.col("text").alias("description"), _when("doc_id % 4 = 0", F.lit("permanent")).alias("contract_type"), _when("doc_id % 2 = 0", F.lit("full_time")).alias("contract_time"),
        F.concat("day", F.lit("T01:00:00Z")).alias("created"), _when("doc_id % 3 <> 0", F.expr("cast(90000 + doc_id % 100 as double)")).alias("salary_min"),
        F.when(F.expr("doc_id % 3 = 2"), F.lit("0")).otherwise(F.lit("1")).alias("salary_is_predicted"))
    once = d.select(F.col("doc_id").alias("ord"), F.lit("contract").alias("label"), F.to_json(item).alias("body"))
    again = once.select((F.col("ord") + 10**12).alias("ord"), F.lit("permanent").alias("label"), "body")
    texts = d.filter("doc_id % 6 = 0").select(F.col("key").alias("id"), F.col("text").alias("page_text"))
    return _feed_out(feeds.adzuna(once.unionByName(again), texts))


@query("src_jsearch", _feed_twin("true", "'https://j/' || doc_id", "'Co ' || source", "'Dev ' || doc_id", _DAY, _header(
    ("Employment type", "'FULLTIME'"), ("Location", "case when doc_id % 3 = 0 then 'Remote' when doc_id % 2 = 0 then 'Austin, TX' else 'TX' end"),
    ("Cadence", "case when doc_id % 3 = 0 then 'remote' else 'onsite' end"), ("Posted rate", "case when doc_id % 4 = 0 then '' when doc_id % 4 = 1 then '50.5-? HOUR' else '50.5-80.0' || case when doc_id % 2 = 0 then ' YEAR' else ' HOUR' end end")), "text"))
def src_jsearch(spark, sf):
    item = F.struct(
        F.concat(F.lit("Dev "), "key").alias("job_title"), F.concat(F.lit("Co "), "source").alias("employer_name"), F.concat(F.lit("https://j/"), "key").alias("job_apply_link"),
        F.col("text").alias("job_description"), _when("doc_id % 2 = 0", F.lit("Austin")).alias("job_city"), F.lit("TX").alias("job_state"), F.lit("FULLTIME").alias("job_employment_type"),
        F.when(F.expr("doc_id % 2 = 0"), "YEAR").otherwise("HOUR").alias("job_salary_period"), F.concat("day", F.lit("T01:00:00Z")).alias("job_posted_at_datetime_utc"),
        F.expr("doc_id % 3 = 0").alias("job_is_remote"), _when("doc_id % 4 <> 0", F.lit(50.5)).alias("job_min_salary"), _when("doc_id % 4 > 1", F.lit(80.0)).alias("job_max_salary"))
    return _feed_out(feeds.jsearch(docs(spark, sf).select(F.col("doc_id").alias("ord"), F.to_json(item).alias("body"))))


@query("src_theirstack", _feed_twin("true", "case when doc_id % 2 = 0 then 'https://t/' || doc_id else 'https://f/' || doc_id end", "case when doc_id % 5 = 0 then 'TheirStack agency' else 'Co ' || source end",
                                    "'Dev ' || doc_id", _DAY, _header(
    ("Employment type", "'contract,temporary'"), ("Location", "case when doc_id % 3 = 0 then 'Remote' else lang end"), ("Cadence", "case doc_id % 3 when 0 then 'remote' when 1 then 'hybrid' else 'onsite' end"),
    ("Posted rate", "case when doc_id % 4 = 0 then '$60/hr' when doc_id % 4 = 1 then '$120000-150000 /yr' else '' end"), ("Tech", "'a1, a2, a3, a4, a5, a6, a7, a8, a9, a10, a11, a12'")),
    "('Seniority: mid level. ' || text)"))
def src_theirstack(spark, sf):
    item = F.struct(
        F.concat(F.lit("Dev "), "key").alias("job_title"), F.when(F.expr("doc_id % 5 = 0"), F.lit(" ")).otherwise(F.concat(F.lit("Co "), "source")).alias("company"),
        _when("doc_id % 2 = 0", F.concat(F.lit("https://t/"), "key")).alias("url"), F.concat(F.lit("https://f/"), "key").alias("final_url"), F.col("lang").alias("location"),
        _when("doc_id % 4 = 0", F.lit("$60/hr")).alias("salary_string"), F.lit("mid_level").alias("seniority"), F.col("text").alias("description"), F.col("day").alias("date_posted"),
        F.expr("doc_id % 3 = 0").alias("remote"), F.expr("doc_id % 3 = 1").alias("hybrid"), _when("doc_id % 4 = 1", F.lit(120000.0)).alias("min_annual_salary_usd"),
        _when("doc_id % 4 = 1", F.lit(150000.0)).alias("max_annual_salary_usd"), F.array(F.lit("contract"), F.lit("temporary")).alias("employment_statuses"),
        F.array(*[F.lit(f"a{i}") for i in range(1, 15)]).alias("technology_slugs"))
    return _feed_out(feeds.theirstack(docs(spark, sf).select(F.col("doc_id").alias("ord"), F.to_json(item).alias("body")), max_slugs=fixed.THEIRSTACK_SLUGS))


_CLEAN = f"trim({_entities('text')}, {_WS})"


@query("src_himalayas", _feed_twin("doc_id % 3 <> 0", "'https://h/' || doc_id", "'Co ' || source", "'Dev ' || doc_id", _DAY, _header(
    ("Employment type", "'Contractor'"), ("Location", "case when doc_id % 2 = 0 then 'US, ' || lang else '' end"), ("Cadence", "'remote'"),
    ("Posted rate", "case when doc_id % 5 = 0 then '' when doc_id % 4 = 0 then '$' || (40 + doc_id % 50) || '-' || (100 + doc_id % 50) || '/hr' when doc_id % 4 = 1 then '$58/hr' else '' end"),
    ("Attribution", t.q(fixed.ATTRIBUTION["himalayas"]))), _CLEAN))
def src_himalayas(spark, sf):
    item = F.struct(
        F.concat(F.lit("Dev "), "key").alias("title"), F.concat(F.lit("Co "), "source").alias("companyName"), F.lit("Contractor").alias("employmentType"),
        F.expr("case doc_id % 4 when 0 then cast(40 + doc_id % 50 as double) else 120000d end").alias("minSalary"), _when("doc_id % 4 = 0", F.expr("cast(100 + doc_id % 50 as double)")).alias("maxSalary"),
        F.expr("case doc_id % 4 when 0 then 'hourly' when 1 then 'annual' else 'monthly' end").alias("salaryPeriod"), F.when(F.expr("doc_id % 5 = 0"), "EUR").otherwise("USD").alias("currency"),
        _when("doc_id % 2 = 0", F.array(F.lit("US"), F.col("lang"))).alias("locationRestrictions"),
        F.when(F.expr("doc_id % 3 = 0"), F.array(F.lit("Sales"))).otherwise(F.array(F.lit("Design"), F.lit("DevOps"))).alias("parentCategories"),
        F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("description"), F.unix_timestamp(F.to_timestamp("day")).alias("pubDate"), F.concat(F.lit("https://h/"), "key").alias("applicationLink"))
    return _feed_out(feeds.himalayas(docs(spark, sf).select(F.col("doc_id").alias("ord"), F.to_json(item).alias("body"))))


@query("src_remotive", _feed_twin("doc_id % 4 <> 0", "'https://r/' || doc_id", "'Co ' || source", "'Dev ' || doc_id", _DAY, _header(
    ("Employment type", "'contract'"), ("Location", "lang"), ("Cadence", "'remote'"), ("Posted rate", "case when doc_id % 3 = 0 then '$72/hr' when doc_id % 3 = 1 then '$58-72/hr' else '' end"),
    ("Attribution", t.q(fixed.ATTRIBUTION["remotive"]))), _CLEAN))
def src_remotive(spark, sf):
    item = F.struct(
        F.col("doc_id").alias("id"), F.concat(F.lit("https://r/"), "key").alias("url"), F.concat(F.lit("Dev "), "key").alias("title"), F.concat(F.lit("Co "), "source").alias("company_name"),
        F.when(F.expr("doc_id % 4 = 0"), "Marketing").otherwise("Devops").alias("category"), F.lit("contract").alias("job_type"), F.concat("day", F.lit("T10:00:00")).alias("publication_date"),
        F.col("lang").alias("candidate_required_location"), F.expr("case doc_id % 3 when 0 then '$150k' when 1 then '$120,000 - $150,000 per year' else 'competitive' end").alias("salary"),
        F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("description"))
    return _feed_out(feeds.remotive(docs(spark, sf).select(F.col("doc_id").alias("ord"), F.to_json(item).alias("body"))))


# Pages with posting objects: alone, in a list, in a graph, followed by junk, or missing.
_OBJ = """concat('{"@type":', case page_id % 3 when 0 then '["Thing","JobPosting"]' else '"JobPosting"' end, ',"title":"Dev ', cast(page_id as varchar(20)), '","employmentType":', case page_id % 2 when 0 then '["CONTRACTOR","TEMPORARY"]' else '"FULL_TIME"' end,
  ',"hiringOrganization":{"name":"', case page_id % 7 when 0 then 'Confidential' when 1 then '' else 'Acme' end, '"}', case page_id % 5 when 0 then ',"jobLocationType":"TELECOMMUTE"' else '' end,
  ',"jobLocation":', case page_id % 2 when 0 then '[{"address":{"addressLocality":"Austin","addressRegion":"TX"}}]' else '{"address":[{"addressLocality":"Remote"}]}' end,
  ',"baseSalary":{"value":', case page_id % 4 when 0 then '{"minValue":50,"maxValue":80,"unitText":"HOUR"}' when 1 then '{"value":"90000","unitText":"year"}' when 2 then '{"minValue":50}' else '{}' end, '}',
  ',"datePosted":"2024-01-', lpad(cast(1 + page_id % 28 as varchar(20)), 2, '0'), 'T00:00:00","description":"<p>Role ', cast(page_id as varchar(20)), ' &amp; more</p>"}')"""
LD_PAGES = f"""select page_id, url, case page_id % 6 when 0 then 'teksystems' when 1 then 'mondo' when 2 then 'motion' when 3 then 'apex' when 4 then 'kore1' else 'scion' end as source,
  concat('List title ', cast(page_id as varchar(20))) as list_title,
  concat(html, case page_id % 6 when 5 then '<table><td class="wpjb-info-label">Pay rate</td> <td>$60 <b>hourly</b></td><td class="wpjb-info-label">Employment Type</td><td></td></table>' else '' end,
    case when page_id % 11 = 4 then '' else concat('<script type="application/ld+json">', case page_id % 4 when 0 then {_OBJ} when 1 then concat('[{{"@type":"Organization"}},', {_OBJ}, ']')
      when 2 then concat('{{"@graph":[', {_OBJ}, ']}}') else concat({_OBJ}, ' ;trailing junk') end, '</script>') end) as html from pages"""


def ld_pages(spark, sf):
    return run_sql(spark, LD_PAGES, sf, "pages")


_ET = "case page_id % 2 when 0 then 'CONTRACTOR,TEMPORARY' else 'FULL_TIME' end"
_ORG = "case page_id % 7 when 0 then 'Confidential' when 1 then '' else 'Acme' end"
_METRO = "case when page_id % 5 = 0 then 'Remote' when page_id % 2 = 0 then 'Austin, TX' else 'Remote' end"
_SAL = "case page_id % 4 when 0 then '$50-80/hr' when 1 then '$90000/yr' when 2 then '$50-?' else '' end"
_POSTED = "'2024-01-' || lpad(cast(1 + page_id % 28 as varchar), 2, '0')"


@query("src_jsonld", "select page_id as page, 'Dev ' || page_id as title from pages where page_id % 11 <> 4")
def src_jsonld(spark, sf):
    return jsonld.fields(jsonld.job_postings(ld_pages(spark, sf))).select("page", "title")


@query("jsonld_fields", f"""select page_id as page, {_ET} as employment_type, page_id % 2 = 0 as contract, {_ORG} as company, {_METRO} as metro, page_id % 5 = 0 as remote, {_SAL} as salary, {_POSTED} as posted,
    'Role ' || page_id || ' & more' as description from pages where page_id % 11 <> 4""")
def jsonld_fields(spark, sf):
    return jsonld.fields(jsonld.job_postings(ld_pages(spark, sf))).select(
        "page", "employment_type", "contract", "company", "place.metro", "place.remote", "salary", "posted", "description")


_AG = "case page_id % 6 when 0 then 'TEKsystems' when 1 then 'Mondo' when 2 then 'Motion' when 3 then 'Apex Systems' when 4 then 'KORE1' else 'Scion Staffing' end"
_FALL = "page_id % 11 = 4"
_CAD = "case when page_id % 5 = 0 or (page_id % 6 = 5 and page_id % 2 = 1) then 'remote' else 'onsite' end"
_BODY = f"trim(regexp_replace(trim({_entities('''regexp_replace(html, '<[^>]+>', ' ', 'g')''')}, {_WS}), '\\s+', ' ', 'g'))"


@query("src_agency_map", f"""with p as ({LD_PAGES}) select page_id, case when {_FALL} then list_title else 'Dev ' || page_id end as title,
    case when {_FALL} then 'KORE1' when page_id % 6 = 3 and page_id % 7 = 0 then {_AG} else coalesce(nullif({_ORG}, ''), {_AG}) end as company, source as source_platform,
    case when {_FALL} then '' else {_POSTED} end as posted_hint, md5(case when {_FALL} then {_BODY} else
      'Employment type: ' || {_ET} || '. Location: ' || {_METRO} || '. Cadence: ' || {_CAD} || '. '
      || case when page_id % 6 = 5 then 'Posted rate: $60 hourly. ' when {_SAL} <> '' then 'Posted rate: ' || {_SAL} || '. ' else '' end || 'Role ' || page_id || ' & more' end) as digest
  from p where not {_FALL} or page_id % 6 = 4""")
def src_agency_map(spark, sf):
    return jsonld.agency_postings(ld_pages(spark, sf)).select("page_id", "title", "company", "source_platform", "posted_hint", F.md5("fetched_jd").alias("digest"))


_EMB = """concat(html, 'display:none;">', case page_id % 5 when 4 then '{broken' else concat('{"JobID":', cast(cast(floor(page_id / 2) as bigint) as varchar(20)), ',"Title":"T', cast(page_id as varchar(20)), '","City":"Austin","State":"TX","IsRemoteJob":',
  case page_id % 3 when 0 then 'true' else 'false' end, ',"SalaryLow":', case page_id % 2 when 0 then '50.0' else '90000' end, ',"SalaryHigh":', case page_id % 2 when 0 then '80.0' else '120000' end,
  ',"Description":"Do work","JobType":["Contract","Perm"],"PostedDate":"2024-02-03T00:00:00"} rest') end, 'display:none;">{"Other":1}')"""


@query("src_embedded_json", """with p as (select page_id, cast(floor(page_id / 2) as bigint) as "JobID" from pages where page_id % 5 <> 4), f as (select "JobID", min(page_id) as page_id from p group by 1)
  select "JobID", 'T' || page_id as title, '2024-02-03' as posted_hint, 'Employment type: Contract,Perm. Location: ' || case page_id % 3 when 0 then 'Remote' else 'Austin, TX' end || '. Cadence: '
    || case page_id % 3 when 0 then 'remote' else 'onsite' end || '. Posted rate: ' || case page_id % 2 when 0 then '$50-80/hr' else '$90000-120000/yr' end || '. Do work Requirements:  Skills:' as body from f""")
def src_embedded_json(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.expr(_EMB).alias("html"))
    return jsonld.embedded_postings(p).select("JobID", "title", "posted_hint", F.col("fetched_jd").alias("body"))


# Run-state files: batches of forty postings as one file each; some files are cut short, some records are junk.
def state_files(spark, sf):
    p = postings(spark, sf).withColumn("run_no", F.expr("cast(floor(ord / 40) as bigint)")).withColumn("fit", F.col("analysis.fit_score"))
    record = F.to_json(F.struct("link", "company", "title", "jd_source", "prefiltered", F.col("fetched_jd"), F.col("analysis"),
                                F.when(F.col("ord") % 9 == 0, F.lit(5)).alias("source_platform")))
    junk = F.when(F.col("ord") % 13 == 5, F.lit('"not a record"')).when(F.col("ord") % 13 == 6, F.lit("null")).otherwise(record)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", junk.alias("r")))), lambda x: x["r"]), ",")
    files = p.groupBy("run_no").agg(body.alias("jobs"))
    whole = F.concat(F.lit('{"days":3,"skipped_pre":0,"jobs":['), "jobs", F.lit("]}"))
    value = F.when(F.col("run_no") % 7 == 3, F.substring(whole, F.lit(1), F.length(whole) - 2)).otherwise(whole)
    path = F.concat(F.lit("/corpus/state-2024-01-"), F.lpad((1 + F.col("run_no") % 28).cast("string"), 2, "0"), F.lit("-"), F.lpad(F.col("run_no").cast("string"), 6, "0"), F.lit(".json"))
    return files.select(path.alias("path"), value.alias("value"))


_RUN = "'2024-01-' || lpad(cast(1 + floor(ord / 40)::bigint % 28 as varchar), 2, '0') || '-' || lpad(cast(floor(ord / 40)::bigint as varchar), 6, '0')"


def _state_twin(select, where="true"):
    from vacancylens.catalog.views import with_views
    return with_views(f" select {select} from postings where floor(ord / 40)::bigint % 7 <> 3 and ord % 13 not in (5, 6) and {where}", "postings")


@query("src_state_scan", _state_twin(f"{_RUN} as run, cast(ord % 40 as int) as nth, link, company, title, md5(fetched_jd) as digest, prefiltered, case when scored then fit_score end as fit_score, '' as source_platform"))
def src_state_scan(spark, sf):
    return states.scan_states(state_files(spark, sf)).select(
        "run", "nth", "link", "company", "title", F.md5("fetched_jd").alias("digest"), "prefiltered", F.col("analysis.fit_score").alias("fit_score"), "source_platform")


@query("src_status", """with f as (select distinct cast(floor(doc_id / 40) as bigint) as n from documents)
  select 'state-2024-01-' || lpad((1 + n % 28)::varchar, 2, '0') || '-' || lpad(n::varchar, 6, '0') || '.json' as name, '2024-01-' || lpad((1 + n % 28)::varchar, 2, '0') as date,
    case when n % 7 = 3 then 'unreadable' else 'read' end as state from f""")
def src_status(spark, sf):
    return states.scan_status(state_files(spark, sf))


# Snapshot files: one per user; some have another version, no date, or text among their numbers.
@query("src_snapshots", """with u as (select user_id, count(*) as n, round_even(avg(value), 2) as v from events group by user_id)
  select '2024-' || lpad(user_id::varchar, 6, '0') as as_of, cast(n as int) as postings, case when user_id % 4 = 0 then 1 else 2 end as n_metrics, cast(n as double) as first_metric from u where user_id % 5 <> 1 and user_id % 7 <> 2""")
def src_snapshots(spark, sf):
    u = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.bround(F.avg("value"), 2).alias("v"))
    body = F.concat(
        F.lit('{"version":'), F.when(F.col("user_id") % 5 == 1, "2").otherwise("1"), F.lit(',"as_of":'),
        F.when(F.col("user_id") % 7 == 2, F.lit("null")).otherwise(F.concat(F.lit('"2024-'), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit('"'))),
        F.lit(',"rubric":"r","postings":'), F.col("n").cast("string"), F.lit(',"metrics":{"a":'), F.col("n").cast("string"), F.lit(',"b":'),
        F.when(F.col("user_id") % 4 == 0, F.lit('"text"')).otherwise(F.col("v").cast("string")), F.lit('},"terms":{"x":{"y":2}}}'))
    return states.scan_snapshots(u.select(F.lit("p").alias("path"), body.alias("value"))).select(
        "as_of", "postings", F.size("metrics").alias("n_metrics"), F.col("metrics")["a"].alias("first_metric"))


# Raw messages: plain or HTML bodies in base64, as mail servers send them; some answer an earlier one.
_RAW = """concat('Message-ID: <', cast(conv_id as string), '.', cast(turn as string), '@x>\n', 'From: Jane <j@x.example>\n', 'Subject: ', role, '\n', case when turn > 0 then concat('In-Reply-To: <', cast(conv_id as string), '@x>\n') else '' end,
  'MIME-Version: 1.0\n', 'Content-Type: ', case turn % 2 when 0 then 'text/plain' else 'text/html' end, '; charset="utf-8"\n', 'Content-Transfer-Encoding: base64\n\n',
  base64(encode(case turn % 2 when 0 then text else concat('<p>', text, '</p>') end, 'utf-8')))"""


@query("src_email", f"""select '<' || conv_id || '.' || turn || '@x>' as mid, 'Jane <j@x.example>' as sender, role as subject, case turn % 2 when 0 then trim(text, {_WS}) else {VISIBLE} end as content,
    turn > 0 as is_reply from conversations""")
def src_email(spark, sf):
    raw = table(spark, sf, "conversations").select(F.expr(_RAW).alias("raw"))
    return email_messages.parse_messages(raw).select("mid", "sender", "subject", "content", "is_reply")


@query("src_union", """select 'remotive' as source, 0 as channel_rank, count(*) as n from documents where doc_id % 4 <> 0 union all select 'jsearch', 2, count(*) from documents""")
def src_union(spark, sf):
    """Two feeds and a third whose builder fails; the failure costs only its own rows."""
    d = docs(spark, sf)
    item = F.struct(F.concat(F.lit("https://r/"), "key").alias("url"), F.lit("t").alias("title"), F.when(F.expr("doc_id % 4 = 0"), "Marketing").otherwise("Devops").alias("category"))
    other = F.struct(F.concat(F.lit("https://j/"), "key").alias("job_apply_link"), F.lit("t").alias("job_title"))

    def broken():
        raise OSError("feed was not landed")

    builders = {
        "remotive": lambda: feeds.remotive(d.select(F.col("doc_id").alias("ord"), F.to_json(item).alias("body"))), "adzuna": broken,
        "jsearch": lambda: feeds.jsearch(d.select(F.col("doc_id").alias("ord"), F.to_json(other).alias("body"))),
    }
    rows, _ = registry.union_sources(builders)
    return rows.groupBy("source", "channel_rank").agg(F.count("*").alias("n"))


@query("src_landed", """select 'remotive' as source, 0 as channel_rank, count(*) as n, count(distinct doc_id) as links from documents where doc_id % 4 <> 0
  union all select 'jsearch', 1, count(*), count(distinct doc_id) from documents""")
def src_landed(spark, sf):
    """Two feeds landed as payload files and read back through the data source."""
    base = run_dir(spark, "payloads")
    d = docs(spark, sf)
    item = F.struct(F.concat(F.lit("https://r/"), "key").alias("url"), F.lit("t").alias("title"), F.when(F.expr("doc_id % 4 = 0"), "Marketing").otherwise("Devops").alias("category"))
    other = F.struct(F.concat(F.lit("https://j/"), "key").alias("job_apply_link"), F.lit("t").alias("job_title"))
    for name, body in (("remotive", item), ("jsearch", other)):
        d.select(F.to_json(body).alias("body")).write.text(f"{base}/{name}")
    payloads.register(spark)
    rows, _ = payloads.union_landed(spark, base, {"remotive": feeds.remotive, "jsearch": feeds.jsearch})
    return rows.groupBy("source", "channel_rank").agg(F.count("*").alias("n"), F.countDistinct("link").alias("links"))
