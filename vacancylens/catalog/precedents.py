"""Diverse retrieval, over vectors and over past judgments, and the scorer's input that holds them."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.catalog import twin as t
from vacancylens.catalog.entities import CONTENT
from vacancylens.catalog.registry import query
from vacancylens.catalog.rules import JD, screened
from vacancylens.catalog.views import postings, table, with_views
from vacancylens.operators import index, knn, precedents, windows


def mmr_sql(top: str, vectors: str, key: str, vector: str) -> str:
    """CTEs p1, p2, p3 (query, neighbour): the three places filled out of `top` (query, neighbour, sim, rank)."""
    def step(n: int, pool: str, close: str) -> str:
        return f"""m{n} as materialized (select t.query, t.neighbour, t.rank, t.sim, {close.format(c='list_cosine_similarity(a.x, b.x)')} as c
      from {pool} t join p{n} on p{n}.query = t.query and p{n}.neighbour <> t.neighbour join vx a on a.k = t.neighbour join vx b on b.k = p{n}.neighbour),
    p{n + 1} as materialized (select query, neighbour from m{n}
      qualify row_number() over (partition by query order by round(0.5 * sim - 0.5 * c, 9) desc, rank) = 1)"""

    return f"""vx as materialized (select {key} as k, {vector} as x from {vectors}),
    p1 as materialized (select query, neighbour from {top} where rank = 1),
    {step(1, top, '{c}')}, {step(2, 'm1', 'greatest(t.c, {c})')}"""


PLACES = "select query, neighbour, 1 as place from p1 union all select query, neighbour, 2 from p2 union all select query, neighbour, 3 from p3"

TOP = """u as materialized (select vec_id, cast(embedding as double[]) as e from embeddings),
  s as (select a.vec_id as query, b.vec_id as neighbour, round(list_cosine_similarity(a.e, b.e), 9) as sim from u a join u b on a.vec_id <> b.vec_id),
  top as materialized (select *, row_number() over (partition by query order by sim desc, neighbour) as rank from s qualify rank <= 20)"""


@query("mmr", f"with {TOP}, {mmr_sql('top', 'u', 'vec_id', 'e')} {PLACES}")
def mmr(spark, sf):
    v = table(spark, sf, "embeddings")
    return knn.retrieve(v, v, key="vec_id")


# Postings of the last two runs ask; the newest document of each key from earlier runs answers.
NEW, OLD = "run >= '2024-01-05'", "run < '2024-01-05'"
_ID = t.composite("company", "title")
_ASKED = f"title || ' — ' || company || chr(10) || {JD}"
FOUND = f""", d as materialized (select *, 'job:' || {_ID} as key, {CONTENT} as content from postings where {OLD}
      qualify row_number() over (partition by 'job:' || {_ID} order by run desc, ord desc) = 1),
    src as materialized (select 'd' || key as k, content as body from d union all select 'q' || ord, {_ASKED} from postings where {NEW}),
    {t.embed_sql('src', 'k', 'body')},
    el as materialized (select key, {_ID} as own, v from d join vec on vec.k = 'd' || key
      where scored and not prefiltered and not starts_with(why, 'prefilter:') and not starts_with(why, 'analysis_error:')),
    qs as (select ord, {_ID} as own, v from postings join vec on vec.k = 'q' || ord where {NEW}),
    s as (select qs.ord as query, el.key as neighbour, round(list_cosine_similarity(qs.v, el.v), 9) as sim from qs join el on qs.own <> el.own),
    top as materialized (select *, row_number() over (partition by query order by sim desc, neighbour) as rank from s qualify rank <= 20),
    {mmr_sql('top', 'el', 'key', 'v')}, places as materialized ({PLACES})"""


def _asked_and_known(spark, sf):
    docs = windows.newest_per_key(precedents.embedded(index.build_documents(postings(spark, sf).filter(OLD))), "key")
    return screened(spark, sf).filter(NEW), docs


@query("precedents", with_views(FOUND + " select query as ord, neighbour as key, place from places", "postings"))
def precedents_found(spark, sf):
    """Up to three past judgments per new posting: similar, of another identity, and different from each other."""
    jobs, docs = _asked_and_known(spark, sf)
    return precedents.find(jobs, docs).select(F.col("query").alias("ord"), "key", "place")


_TRAIT = ("concat_ws(' · ', case when is_agency then 'agency' end, nullif(trim(employment_type), ''), nullif(trim(cadence), ''), nullif(trim(rate), ''))")
_LINE = f"""place || '. ' || coalesce(nullif(trim(title, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), ''), '(untitled)') || ' @ ' || coalesce(nullif(trim(company), ''), '(unknown)') || ' — '
  || coalesce(nullif(verdict, ''), 'unknown') || ' ' || fit_score || '/100 · ' || coalesce(nullif(tier, ''), 'unknown')
  || case when {_TRAIT} <> '' then ' · ' || {_TRAIT} else '' end || case when trim(why) <> '' then chr(10) || '   why: ' || trim(why) else '' end"""


@query("precedent_input", with_views(FOUND + f""", b as (select places.query, string_agg({_LINE}, chr(10) order by place) as listed from places join d on d.key = places.neighbour group by 1)
  select ord, coalesce('Past decisions' || chr(10) || listed || chr(10) || 'End of past decisions' || chr(10) || chr(10), '')
    || 'TITLE: ' || coalesce(nullif(title, ''), 'unknown') || chr(10) || 'COMPANY: ' || coalesce(nullif(company, ''), 'unknown')
    || chr(10) || 'SOURCE: ' || source_platform || chr(10) || 'POSTED: ' || coalesce(nullif(posted_hint, ''), 'unknown')
    || chr(10) || 'LINK: ' || coalesce(nullif(link, ''), '(none — inline recruiter email)') || chr(10) || 'JD_SOURCE: ' || jd_source
    || chr(10) || chr(10) || 'JOB DESCRIPTION:' || chr(10) || coalesce(nullif({JD}, ''), {t.q(fixed.SCORER_NO_TEXT)}) as body
  from postings left join b on b.query = ord where {NEW}""", "postings"))
def precedent_input(spark, sf):
    """What the scorer reads of each new posting, its precedents first."""
    jobs, docs = _asked_and_known(spark, sf)
    return precedents.scorer_texts(jobs, docs, opening="Past decisions", closing="End of past decisions")
