"""Queries over the similarity operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacancylens.catalog import twin as t
from vacancylens.catalog.registry import query
from vacancylens.catalog.views import postings, run_sql, table, with_views
from vacancylens.functions.identity import composite_id
from vacancylens.operators import knn, leader, neardup
from vacancylens.plans import worklist

# The documents as they are, as postings: many companies share texts, some copies differ in their title.
DUP_SQL = """select d.doc_id as ord, concat(d.source, case d.doc_id % 3 when 0 then ' Inc' else '' end) as company,
  case d.doc_id % 4 when 0 then 'Software Engineer' when 1 then 'Software Engineer II' else split_part(split_part(d.text, chr(10), 1), '.', 1) end as title,
  d.text as jd_text, '' as link, d.doc_id % 31 = 0 as from_correspondence from documents d"""

PREPARED = f"""dup as materialized ({DUP_SQL}), el as materialized (select *, {t.company_words('company')} as c, {t.norm('title')} as t, {t.words('jd_text')} as jw,
    title || chr(10) || jd_text as embed from dup where not from_correspondence and length(jd_text) >= 500),
  {t.embed_sql('el', 'ord', 'embed')},
  sh as materialized (select ord, {t.shingles('jw')} as s from el),
  ss as materialized (select ord, unnest(s) as g from sh), sn as (select ord, len(s) as n from sh),
  raw as (select a.ord as a, b.ord as b, count(*) as i from ss a join ss b on a.g = b.g and a.ord < b.ord group by a.ord, b.ord),
  jac as materialized (select a, b, i / (x.n + y.n - i) as j from raw join sn x on x.ord = a join sn y on y.ord = b where i / (x.n + y.n - i) >= 0.8),
  pair as materialized (select jac.a, jac.b, j, list_cosine_similarity(va.v, vb.v) as cos from jac
    join vec va on va.ord = a join vec vb on vb.ord = b join el ea on ea.ord = a join el eb on eb.ord = b
    where list_cosine_similarity(va.v, vb.v) >= 0.95 - 1e-12 and (ea.c <> eb.c or ea.t = eb.t))"""


def dup_postings(spark, sf):
    return run_sql(spark, DUP_SQL, sf, "documents")


@query("near_dup_pairs", f"""with recursive {PREPARED},
    rep as (select min(ord) as ord from el group by array_to_string(jw, ' '))
  select a, b, round(j, 4) as overlap, round(cos, 4) as similarity from pair where a in (select ord from rep) and b in (select ord from rep)""")
def near_dup_pairs(spark, sf):
    """Pairs of the first postings of distinct texts; copies of a text are reached through its first posting."""
    return neardup.representative_pairs(dup_postings(spark, sf))


COMPONENTS = f"""{PREPARED}, ways as (select a, b from pair union all select b, a from pair),
  reach(node, seen) as (select ord, ord from el union select b.b, r.seen from reach r join ways b on b.a = r.node),
  comp as (select node as ord, min(seen) as first from reach group by node)"""
SURVIVORS = f"""{COMPONENTS}, best as (select first, min(row(-length(jd_text), el.ord)) as best from comp join el using (ord) group by first),
  surv as (select comp.ord, best.best[2] as survivor from comp join best using (first))"""


@query("near_dup_components", f"with recursive {SURVIVORS} select ord, survivor from surv")
def near_dup_components(spark, sf):
    return neardup.with_survivor(dup_postings(spark, sf)).select("ord", "survivor")


@query("near_dup", f"""with recursive {SURVIVORS}
  select s.ord, survivor, round_even(list_cosine_similarity(va.v, vb.v), 4) as similarity,
    round_even(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))), 4) as overlap
  from surv s join vec va on va.ord = s.ord join vec vb on vb.ord = survivor join sh x on x.ord = s.ord join sh y on y.ord = survivor
  where s.ord <> survivor""")
def near_dup(spark, sf):
    rows = dup_postings(spark, sf).withColumn("id", composite_id("company", "title"))
    _, absorbed = neardup.collapse(rows)
    return absorbed.select("ord", "survivor", "similarity", "overlap")


@query("value_counts", with_views(""" select value, count(*) as n from (select trim(unnest(string_split(red_flags_text, '|'))) as value from postings where scored)
  where value <> '' group by value""", "postings"))
def value_counts(spark, sf):
    rows = postings(spark, sf)
    return leader.value_counts(rows, leader.field_values(rows, "red_flags"))


def leader_sql(values: str, cosine: float = 0.82) -> str:
    """Greedy leader clustering as a recursion that carries the seeds found so far. `values` gives (value, n)."""
    return f"""vals as materialized (select value, n, row_number() over (order by n desc, value) as rk from ({values})),
  {t.embed_sql('vals', 'rk', 'value')},
  gr as materialized (select rk, {t.char_grams('value')} as g from vals),
  sim as materialized (select a.rk as hi, b.rk as lo, coalesce(list_cosine_similarity(x.v, y.v), 0) as cos, len(list_intersect(ga.g, gb.g)) as i,
      least(len(ga.g), len(gb.g)) as m from vals a join vals b on a.rk < b.rk left join vec x on x.rk = a.rk left join vec y on y.rk = b.rk
      join gr ga on ga.rk = a.rk join gr gb on gb.rk = b.rk),
  nb as materialized (select lo, list(hi order by hi) as his from sim where cos >= {cosine} - 1e-12 or (m > 0 and i / m >= 0.9) group by lo),
  walk(step, seeds) as (select 0::bigint, []::bigint[] union all
    select step + 1, case when nb.his is null or len(list_intersect(nb.his, seeds)) = 0 then list_append(seeds, step + 1) else seeds end
    from walk left join nb on nb.lo = step + 1 where step < (select max(rk) from vals)),
  final as (select seeds from walk order by step desc limit 1),
  led as (select v.rk, v.value, v.n, case when list_contains(seeds, v.rk) then v.rk else list_min(list_intersect(nb.his, seeds)) end as seed
    from vals v cross join final left join nb on nb.lo = v.rk),
  clus as (select s.value as label, led.value, led.n, case when led.rk = seed then 1.0 else round(coalesce(sim.cos, 0), 3) end as similarity
    from led join vals s on s.rk = led.seed left join sim on sim.hi = led.seed and sim.lo = led.rk)"""


FLAGS = "select value, count(*) as n from (select trim(unnest(string_split(red_flags_text, '|'))) as value from postings where scored) where value <> '' group by value"
KEYWORDS = FLAGS.replace("red_flags_text", "keywords_text")


@query("leader_clusters", with_views(f", {leader_sql(FLAGS)} select label, value, n, similarity from clus", "postings"))
def leader_clusters(spark, sf):
    counts = leader.value_counts(postings(spark, sf), "analysis.red_flags")
    return leader.cluster_values(counts).select("label", "value", "n", F.round("similarity", 3).alias("similarity"))


# Questions: the sentences of every document, in order.
@query("keep_first_near_dup", f"""with recursive q as (select doc_id, unnest(string_split(text, '.')) as s, generate_subscripts(string_split(text, '.'), 1) as pos from documents),
    k as materialized (select doc_id, pos, {t.shingles('w', 4)} as g from (select doc_id, pos, {t.words('s')} as w from q)),
    g as (select doc_id, pos, unnest(g) as x from k),
    o as materialized (select a.doc_id, a.pos as hi, b.pos as lo from g a join g b on a.doc_id = b.doc_id and a.x = b.x and a.pos < b.pos
      join k ka on ka.doc_id = a.doc_id and ka.pos = a.pos join k kb on kb.doc_id = b.doc_id and kb.pos = b.pos
      group by all having count(*) / least(any_value(len(ka.g)), any_value(len(kb.g))) >= 0.5),
    nb as materialized (select doc_id, lo, list(hi) as his from o group by doc_id, lo),
    walk(doc_id, step, kept) as (select doc_id, 0::bigint, []::bigint[] from documents union all
      select w.doc_id, step + 1, case when nb.his is null or len(list_intersect(nb.his, kept)) = 0 then list_append(kept, step + 1) else kept end
      from walk w left join nb on nb.doc_id = w.doc_id and nb.lo = step + 1 where exists (select 1 from k where k.doc_id = w.doc_id and k.pos = step + 1)),
    f as (select doc_id, max_by(kept, step) as kept from walk group by doc_id)
  select doc_id, cast(unnest(kept) as int) as pos from f""")
def keep_first_near_dup(spark, sf):
    sentences = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", r"\.")).alias("p", "s"))
    items = sentences.select("doc_id", (F.col("p") + 1).alias("pos"), "s")
    return leader.keep_first(items, "doc_id", "pos", "s").select("doc_id", "pos")


TOPK = """u as materialized (select vec_id, cast(embedding as double[]) as e from embeddings),
  s as (select a.vec_id as query, b.vec_id as neighbour, round(list_cosine_similarity(a.e, b.e), 9) as sim from u a join u b on a.vec_id <> b.vec_id),
  top as materialized (select *, row_number() over (partition by query order by sim desc, neighbour) as rank from s qualify rank <= 20)"""


@query("knn_topk", f"with {TOPK} select query, neighbour, cast(rank as int) as rank, round(sim, 6) as similarity from top")
def knn_topk(spark, sf):
    v = table(spark, sf, "embeddings")
    return knn.nearest(v, v, 20, key="vec_id").select("query", "neighbour", "rank", F.round("similarity", 6).alias("similarity"))


_SHOWN = """case when link <> '' then '[' || coalesce(nullif(title, ''), 'Untitled') || ' @ ' || coalesce(nullif(company, ''), 'unknown') || '](' || link || ')'
    else coalesce(nullif(title, ''), 'Untitled') || ' @ ' || coalesce(nullif(company, ''), 'unknown') end"""


@query("collapsed_list", f"""with recursive {SURVIVORS}, ab as (
  select s.ord, survivor, round_even(list_cosine_similarity(va.v, vb.v), 4)::decimal(10, 4) as similarity,
    round_even(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))), 4)::decimal(10, 4) as overlap
  from surv s join vec va on va.ord = s.ord join vec vb on vb.ord = survivor join sh x on x.ord = s.ord join sh y on y.ord = survivor where s.ord <> survivor),
  li as (select survivor, count(*) as n, string_agg({_SHOWN} || ' (similarity ' || round(similarity, 2)::decimal(10, 2) || ' · JD overlap ' || round(overlap * 100, 0)::int || '%)', '; ' order by ab.ord) as absorbed
    from ab join dup using (ord) group by survivor)
  select d.ord, coalesce(nullif(title, ''), 'Untitled') || ' @ ' || coalesce(nullif(company, ''), 'unknown') as posting, n::int as n_absorbed, absorbed from li join dup d on d.ord = survivor""")
def collapsed_list(spark, sf):
    """Every posting that absorbed others, with the evidence for each."""
    rows = dup_postings(spark, sf).withColumn("id", composite_id("company", "title"))
    return worklist.collapsed(neardup.with_duplicates(*neardup.collapse(rows)))
