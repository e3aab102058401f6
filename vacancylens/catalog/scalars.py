"""Queries over the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.catalog import twin as t
from vacancylens.catalog.registry import query
from vacancylens.catalog.views import companies, postings_flat, run_sql, table, with_views
from vacancylens.functions import dates, identity, links, rates, text, vectors

# Every address in the pages: their own and the ones they link to, made absolute, some routed through job boards.
URL_ROWS_SQL = """
select page_id as ord, url from pages
union all
select page_id as ord, case page_id % 6
  when 0 then concat('https://boards.greenhouse.io/acme', cast(page_id % 7 as varchar(20)), '/jobs/', cast(page_id as varchar(20)), '?gh_src=a&gh_jid=7')
  when 1 then concat('https://www.linkedin.com/comm/jobs/view/dev-at-x-', cast(20000000 + page_id as varchar(20)), '?trk=eml')
  when 2 then concat('https://jobs.lever.co/acme/0a1b2c3d-0000-0000-0000-', lpad(cast(page_id as varchar(20)), 12, '0'))
  when 3 then concat('https://jobs.ashbyhq.com/Org/', '0a1b2c3d-0000-0000-0000-', lpad(cast(page_id as varchar(20)), 12, '0'), '/application')
  when 4 then concat('https://www.indeed.com/viewjob?from=x&jk=ab', cast(page_id as varchar(20)))
  else concat('https://www.linkedin.com/jobs/search?currentJobId=', cast(page_id as varchar(20)), '#f') end as url
from pages
"""


def url_rows(spark, sf):
    return run_sql(spark, URL_ROWS_SQL, sf, "pages")


def _url_twin(select: str) -> str:
    return f"with url_rows as ({URL_ROWS_SQL}) select ord, url, {select} from url_rows"


@query("norm_text", f"select doc_id, {t.norm('text')} as norm from documents")
def norm_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.norm_text("text").alias("norm"))


@query("composite_id", with_views(
    f" select ord, {t.composite('company', 'title')} as plain, {t.composite('company', 'title', 'cadence')} as with_city from postings",
    "postings"))
def composite_id(spark, sf):
    return postings_flat(spark, sf).select(
        "ord", identity.composite_id("company", "title").alias("plain"),
        identity.composite_id("company", "title", "cadence").alias("with_city"))


@query("normalize_link", _url_twin(f"{t.normalize_link('url')} as clean"))
def normalize_link(spark, sf):
    return url_rows(spark, sf).select("ord", "url", links.normalize_link("url").alias("clean"))


@query("link_identity", _url_twin(f"{t.link_identity('url')} as identity"))
def link_identity(spark, sf):
    return url_rows(spark, sf).select("ord", "url", links.link_identity("url").alias("identity"))


@query("job_id", with_views(f" select ord, {t.job_id('company', 'title', 'link')} as id from postings", "postings"))
def job_id(spark, sf):
    return postings_flat(spark, sf).select("ord", identity.job_id("company", "title", "link").alias("id"))


@query("slugs", with_views(f"""
  select id, {t.company_key('company')} as company_key,
    coalesce(nullif(trim(regexp_replace(lower(company), '[^a-z0-9]+', '_', 'g'), '_'), ''), '') as metric_slug,
    coalesce(nullif(trim(regexp_replace(lower(company), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown') as folder_slug,
    array_to_string(list_distinct_ordered, ',') as board_slugs, pretty, cache_key
  from (select *, case when joined = '' then [] when joined = hyphened then [joined] else [joined, hyphened] end as list_distinct_ordered,
      array_to_string(list_transform(string_split(trim(regexp_replace(company, '[-_\\s]+', ' ', 'g')), ' '),
        lambda w: upper(w[1:1]) || lower(w[2:])), ' ') as pretty,
      coalesce(nullif(trim(regexp_replace({t.company_key('company')}, '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unnamed') as cache_key
    from (select *, array_to_string(ws, '') as joined, array_to_string(ws, '-') as hyphened
      from (select id, company, regexp_extract_all(regexp_replace(lower(company), {t.q(fixed.BOARD_SLUG_NOISE)}, ' ', 'g'), '[a-z0-9]+') as ws
        from companies)))""", "companies"))
def slugs(spark, sf):
    return companies(spark, sf).select(
        "id", identity.company_key("company").alias("company_key"), identity.metric_slug("company").alias("metric_slug"),
        identity.folder_slug("company").alias("folder_slug"),
        F.array_join(identity.board_slugs("company"), ",").alias("board_slugs"),
        identity.pretty_token("company").alias("pretty"), identity.cache_key("company").alias("cache_key"))


_NETLOC = "lower(regexp_extract(url, '^https?://([^/?#]*)', 1))"
_LABELS = f"list_filter(string_split({_NETLOC}, '.'), lambda x: x <> 'www')"


@query("host_parts", _url_twin(f"""
  regexp_replace({_NETLOC}, '^www\\.', '') as host,
  case when {t.contains_any(_NETLOC, fixed.NOT_COMPANY_DOMAINS)} then '' else {_NETLOC} end as company_domain,
  case when len({_LABELS}) >= 2 then {_LABELS}[-2] else coalesce({_LABELS}[1], '') end as name"""))
def host_parts(spark, sf):
    netloc = F.lower(F.regexp_extract("url", "^https?://([^/?#]*)", 1))
    return url_rows(spark, sf).select(
        "ord", "url", links.host("url").alias("host"), links.company_domain("url").alias("company_domain"),
        links.name_from_domain(netloc).alias("name"))


def _board_sql(platform: str, pattern: str) -> str:
    b = f"regexp_extract(url, {t.q(pattern)}, 1)"
    return f"when {b} not in ('', 'v1', 'embed') then '{platform}/' || {b}"


@query("url_route", _url_twin(f"""
  case {' '.join(_board_sql(p, r) for p, r in fixed.ATS_BOARD_PATTERNS)} end as board,
  case when contains({_NETLOC}, 'greenhouse.io') then 'greenhouse' when contains({_NETLOC}, 'lever.co') then 'lever'
    when contains({_NETLOC}, 'ashbyhq.com') then 'ashby' when contains({_NETLOC}, 'linkedin.com') then 'linkedin' else 'generic' end as route,
  case when contains({_NETLOC}, 'greenhouse.io') then coalesce(nullif(regexp_extract(url, 'greenhouse\\.io/.*?/jobs/(\\d+)', 1), ''),
      regexp_extract(url, '[?&]gh_jid=([^&#]+)', 1))
    when contains({_NETLOC}, 'lever.co') then regexp_extract(url, 'lever\\.co/[^/?#]+/([0-9a-f-]{{16,}})', 1)
    when contains({_NETLOC}, 'ashbyhq.com') then regexp_extract(url, 'ashbyhq\\.com/[^/?#]+/([0-9a-f-]{{16,}})', 1)
    when contains({_NETLOC}, 'linkedin.com') then coalesce(nullif(regexp_extract(url, '[?&]currentJobId=([^&#]+)', 1), ''),
      regexp_extract(url, '(?:jobs/view/|-)(\\d{{8,}})', 1)) else '' end as number"""))
def url_route(spark, sf):
    route = links.board_route("url")
    return url_rows(spark, sf).select(
        "ord", "url", F.concat(route.platform, F.lit("/"), route.board).alias("board"),
        links.fetch_route("url").alias("route"), links.posting_number("url").alias("number"))


_MARKED = "(select page_id, html || '<p>caf&eacute; &#233; &#xE9; &#146; &rsquo;&hellip; &copy2024 &none; &</p>' as html from pages)"
_MORE = (("&copy;", "©"), ("&middot;", "·"), ("&eacute;", "é"), ("&#233;", "é"), ("&#xE9;", "é"), ("&#146;", "’"), ("&rsquo;", "’"), ("&hellip;", "…"), ("&copy2024", "©2024"))


def _entities(x: str) -> str:
    for old, new in (*_MORE, *text._ENTITIES):
        x = f"replace({x}, {t.q(old)}, {t.q(new)})"
    return x


_WS = t.q(" \t\n\r")


@query("html_to_text", f"""
  select page_id, trim({_entities("regexp_replace(html, '<[^>]+>', ' ', 'g')")}, {_WS}) as stripped,
    trim(regexp_replace(array_to_string(list_transform(string_split_regex({_entities(
      "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script *>|<style.*?</style *>|<!--.*?-->', '', 'g'), '(?i)<!doctype[^>]*>', '', 'g'), '<[^>]+>', chr(10), 'g')"
    )}, '\\r\\n|[\\n\\r]'), lambda l: trim(l, {_WS})), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), {_WS}) as visible
  from {_MARKED}""")
def html_to_text(spark, sf):
    marked = F.concat("html", F.lit("<p>caf&eacute; &#233; &#xE9; &#146; &rsquo;&hellip; &copy2024 &none; &</p>"))
    return table(spark, sf, "pages").select("page_id", marked.alias("html")).select(
        "page_id", text.strip_tags("html").alias("stripped"), text.html_to_text("html").alias("visible"))


@query("shingles", f"""
  select doc_id, len(s) as n_shingles, md5(array_to_string(list_sort(s), '|')) as digest
  from (select doc_id, {t.shingles('w')} as s from (select doc_id, {t.words('text')} as w from documents))""")
def shingles(spark, sf):
    worded = table(spark, sf, "documents").select("doc_id", text.words("text").alias("w"))
    return worded.select("doc_id", text.word_shingles(F.col("w")).alias("s")).select(
        "doc_id", F.size("s").cast("bigint").alias("n_shingles"), F.md5(F.array_join(F.array_sort("s"), "|")).alias("digest"))


@query("char_ngrams", with_views(f"""
  select id, array_to_string(list_sort({t.char_grams('company')}), '|') as grams from companies""", "companies"))
def char_ngrams(spark, sf):
    return companies(spark, sf).select("id", F.array_join(F.array_sort(text.char_ngrams("company")), "|").alias("grams"))


# Each document against its successor in key order, so the work grows with the table and never with its square.
_PAIR_SQL = f"""with w as (select doc_id, {t.words('text')} as w from documents),
  s as (select doc_id, {t.shingles('w', 2)} as s from w),
  p as (select a.doc_id, a.s as a, b.s as b from s a join s b on b.doc_id = a.doc_id + 1)"""


def _neighbours(spark, sf):
    worded = table(spark, sf, "documents").select("doc_id", text.words("text").alias("w"))
    grams = worded.select("doc_id", text.word_shingles(F.col("w"), 2).alias("s"))
    return grams.alias("a").join(
        grams.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("b")), "doc_id"
    ).select("doc_id", F.col("s").alias("a"), "b")


@query("ngram_sets", _PAIR_SQL + """ select doc_id, cast(len(list_intersect(a, b)) as int) as both,
  cast(len(list_distinct(list_concat(a, b))) as int) as either from p""")
def ngram_sets(spark, sf):
    return _neighbours(spark, sf).select(
        "doc_id", vectors.shared(F.col("a"), F.col("b")).alias("both"), F.size(F.array_union("a", "b")).alias("either"))


@query("set_similarity", _PAIR_SQL + """, m as (select doc_id, len(list_intersect(a, b)) as i, len(a) as na, len(b) as nb from p)
  select doc_id, case when na > 0 and nb > 0 then round(i / (na + nb - i), 6) else 0 end as jaccard,
    case when least(na, nb) > 0 then round(i / least(na, nb), 6) else 0 end as overlap from m""")
def set_similarity(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _neighbours(spark, sf).select(
        "doc_id", F.round(vectors.jaccard(a, b), 6).alias("jaccard"), F.round(vectors.overlap(a, b), 6).alias("overlap"))


@query("cosine", """
  select a.vec_id, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as cosine
  from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def cosine(spark, sf):
    v = table(spark, sf, "embeddings")
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select(
        "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("hash_embed", f"""with {t.embed_sql('documents', 'doc_id', 'text')}
  select doc_id, array_to_string(list_transform(v, lambda x: cast(x as bigint)), ',') as counts, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) as length from vec""")
def hash_embed(spark, sf):
    counted = table(spark, sf, "documents").select("doc_id", vectors.bucket_counts("text").alias("v")).filter(F.exists("v", lambda x: x > 0))
    unit = F.col("u")
    return counted.withColumn("u", vectors.unit("v")).filter(F.abs(vectors.norm(unit) - 1) < 1e-9).select(
        "doc_id", F.array_join(F.col("v").cast("array<string>"), ",").alias("counts"), F.round(vectors.norm(F.col("v")), 6).alias("length"))


@query("fingerprint", """select doc_id, case when trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' then ''
  else substr(sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 12) end as fingerprint from documents""")
def fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.fingerprint("text").alias("fingerprint"))


_GLOSSED = "concat(text, case doc_id % 4 " + " ".join(
    f"when {i} then {t.q(fixed.GLOSS[i + 2][0])}" for i in range(3)) + " else '' end, case when doc_id % 3 = 0 then " + \
    t.q(fixed.GLOSS[0][0]) + " else '' end)"


def _replaced(x: str) -> str:
    for old, new in fixed.GLOSS:
        x = f"replace({x}, {t.q(old)}, {t.q(new)})"
    return x


@query("degloss", f"""with g as (select doc_id, {_GLOSSED} as body from documents)
  select doc_id, {_replaced('body')} as body,
    coalesce(array_to_string([{', '.join(f"case when contains(body, {t.q(o)}) then {t.q(o)} end" for o, _ in fixed.GLOSS)}], ';'), '') as cut from g""")
def degloss(spark, sf):
    body = table(spark, sf, "documents").select("doc_id", F.expr(_GLOSSED.replace("''s", "\\'s")).alias("body"))
    return body.select("doc_id", text.replace_all("body", fixed.GLOSS).alias("body"),
                       F.array_join(text.present_terms("body", [o for o, _ in fixed.GLOSS]), ";").alias("cut"))


@query("extract_rate", with_views(
    f" select ord, {t.rate('(fetched_jd || email_jd_text)')} as rate from postings", "postings"))
def extract_rate(spark, sf):
    return postings_flat(spark, sf).select(
        "ord", rates.extract_rate(F.concat("fetched_jd", "email_jd_text")).alias("rate"))


@query("rate_midpoint", with_views(f""", r as (select ord, {t.rate('(fetched_jd || email_jd_text)')} as rate from postings)
  select ord, rate, {t.midpoint('rate')} as midpoint from r""", "postings"))
def rate_midpoint(spark, sf):
    return extract_rate(spark, sf).withColumn("midpoint", rates.rate_midpoint("rate"))


@query("date_parse", """
  select event_id, strftime(ts, '%Y-%m-%d') as day, cast(floor(epoch_us(ts) / 1000) as bigint) as back_to_millis,
    case when event_id % 5 = 0 then null else strftime(ts, '%Y-%m-%d') end as tolerant,
    strftime(ts, '%Y-%m-%d') as run_day,
    datediff('day', date '2024-01-01', cast(ts as date)) + 1 as days from events""")
def date_parse(spark, sf):
    ts = F.col("ts").cast("timestamp")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    ragged = F.when(F.col("event_id") % 5 == 0, F.lit("not a date")).otherwise(iso)
    return table(spark, sf, "events").select(
        "event_id", F.date_format(dates.iso_timestamp(iso), "yyyy-MM-dd").alias("day"),
        F.unix_millis(dates.epoch_millis(F.unix_millis(ts))).alias("back_to_millis"),
        F.date_format(dates.day_prefix(ragged), "yyyy-MM-dd").alias("tolerant"),
        F.date_format(dates.run_date(F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit("-090000"))), "yyyy-MM-dd").alias("run_day"),
        dates.inclusive_days(F.lit("2024-01-01"), F.date_format(ts, "yyyy-MM-dd")).cast("bigint").alias("days"))
