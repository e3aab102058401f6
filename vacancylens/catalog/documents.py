"""Queries over markdown documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.catalog import twin as t
from vacancylens.catalog.registry import query
from vacancylens.catalog.views import run_sql, table
from vacancylens.functions.text import WHITESPACE
from vacancylens.operators import docs, ranking

# Lines of apply documents: forty source documents make one, each giving one line.
LINES = """select concat('apply-2024-05-', lpad(cast(1 + cast(floor(doc_id / 40) as bigint) % 28 as varchar(20)), 2, '0'), '-', cast(cast(floor(doc_id / 40) as bigint) as varchar(20))) as doc, doc_id % 40 as pos,
  case (doc_id * 7) % 12
    when 0 then '## Tier 1 - focus' when 1 then concat('- [ ] **Dev ', cast(doc_id as varchar(20)), ' @ ', source, '** **fit ', cast(doc_id % 100 as varchar(20)), '** https://x.example/', cast(doc_id as varchar(20)), ' ok')
    when 2 then concat('  more text fit ', cast(doc_id % 90 as varchar(20))) when 3 then '### Detail' when 4 then concat('- [x] **Done @ ', source, '**')
    when 5 then '## Already applied' when 6 then concat('- [ ] **Lead @ at @ ', source, '** `applications/2024_', source, '/`') when 7 then 'plain line'
    when 8 then '- [ ] ~~**Struck @ Y**~~' when 9 then case when doc_id % 5 = 0 then '## Mystery' else '' end when 10 then '#### Backup roles' else '  - [ ] **Solo**' end as line from documents"""


def apply_docs(spark, sf):
    lines = run_sql(spark, LINES, sf, "documents")
    return lines.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


_BOX, _HEAD = t.q(fixed.CHECKBOX), t.q(fixed.SECTION_HEADING)
CLASSED = f"""l as ({LINES}), m as (select *, regexp_matches(line, {_BOX}) as box, trim(line) <> '' and not starts_with(line, ' ') and not regexp_matches(line, {_BOX}) as flush,
    case when trim(line) <> '' and not starts_with(line, ' ') then length(nullif(regexp_extract(line, {_HEAD}, 1), '')) end as lev, regexp_extract(line, {_HEAD}, 2) as h from l),
  n as (select *, case when lev is null then null when regexp_matches(h, {t.q('(?i)' + fixed.SKIP_HEADING)}) then 'skip' when regexp_matches(h, {t.q('(?i)' + fixed.APPLY_HEADING)}) then 'apply' else '' end as own from m),
  hd as materialized (select a.doc, a.pos, b.lev, b.own, b.pos as at from n a join n b on a.doc = b.doc and b.pos <= a.pos and b.lev is not null
    where not exists (select 1 from n c where c.doc = a.doc and c.pos > b.pos and c.pos <= a.pos and c.lev is not null and c.lev <= b.lev)),
  k as (select n.doc, n.pos, any_value(line) as line, any_value(box) as box, any_value(flush) as flush, count(hd.lev) as open, max_by(hd.own, hd.lev) filter (hd.own <> '') as named from n left join hd using (doc, pos) group by n.doc, n.pos),
  c as materialized (select doc, pos, line, box, case when open = 0 then 'apply' else coalesce(named, 'unclassified') end as section_class,
    last_value(case when box then pos when flush then -1 end ignore nulls) over (partition by doc order by pos) as ev from k)"""


@query("section_class", f"with {CLASSED} select doc, cast(pos as int) as pos, section_class, cast(case when ev >= 0 then ev end as int) as entry from c")
def section_class(spark, sf):
    return docs.section_classes(apply_docs(spark, sf)).select("doc", "pos", "section_class", "entry")


_TITLE = f"regexp_extract(body, {t.q(fixed.BOLD_TITLE)}, 1)"
_ROLE = f"trim(case when contains({_TITLE}, '@') then regexp_extract({_TITLE}, '(?s)^(.*)@[^@]*$', 1) else {_TITLE} end)"
_COMP = f"trim(case when contains({_TITLE}, '@') then regexp_extract({_TITLE}, '(?s)@([^@]*)$', 1) else '' end)"


def _slug(x: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown')"


@query("work_items", f"""with {CLASSED}, e as (select doc, ev as entry, string_agg(case when box then regexp_extract(line, {_BOX}, 2) else line end, chr(10) order by pos) as body,
      max(case when box then regexp_extract(line, {_BOX}, 1) end) as mark, max(case when box then section_class end) as section_class from c where ev >= 0 group by doc, ev),
    i as (select doc, entry, {_COMP} as company, {_ROLE} as role, coalesce(nullif(regexp_extract(body, {t.q(fixed.FOLDER_CODE)}, 1), ''),
        'applications/' || regexp_extract(doc, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) || '_' || {_slug(_COMP)} || '_' || {_slug(_ROLE)}) as folder,
      regexp_extract(body, '(https?://[^\\s)\\]]+)', 1) as link, try_cast(regexp_extract(body, {t.q('(?i)' + fixed.FIT_NUMBER)}, 1) as int) as fit,
      case when section_class = 'unclassified' then 'unrecognized section' end as problem from e where not contains(body, '~~') and trim(mark) = '' and section_class <> 'skip'),
    f as (select *, row_number() over (partition by doc, folder order by entry) as n from i where role <> '')
  select doc, cast(entry as int) as ord, company, role, folder, link, fit, problem from f where n = 1 and (fit is null or fit >= 40)""")
def work_items(spark, sf):
    return ranking.work_items(docs.work_items(apply_docs(spark, sf)), min_fit=40)


# Markdown around whole documents: nested headings, two kinds of fences, a heading inside a fence.
MARKDOWN = """select concat('doc', cast(doc_id as varchar(20))) as source, concat('intro ', lang, chr(10), '# Title ', cast(doc_id as varchar(20)), chr(10), text, chr(10), chr(10),
  case when doc_id % 3 = 0 then concat('## Part one ##', chr(10), 'short', chr(10), '```', chr(10), '# not a heading', chr(10), '~~~', chr(10), '```', chr(10)) else '' end,
  '### Deep', chr(10), text, chr(10), chr(10), text, chr(10), '## Part two', chr(10), case when doc_id % 4 = 0 then '' else 'tail' end) as text from documents"""


_WS = t.q(WHITESPACE)
_ATX = t.q(fixed.ATX_HEADING)
# Paragraphs as pieces (t, alone), then a fold that fills parts up to the limit.
_PACKED = f"""list_reduce(list_prepend({{'t': '', 'alone': false, 'parts': []::varchar[], 'buf': ''}}, list_transform(pieces, lambda p:
    {{'t': p.t, 'alone': p.alone, 'parts': []::varchar[], 'buf': ''}})), lambda a, x: case
  when x.alone then {{'t': '', 'alone': false, 'parts': list_append(case when a.buf <> '' then list_append(a.parts, a.buf) else a.parts end, x.t), 'buf': ''}}
  when a.buf = '' then {{'t': '', 'alone': false, 'parts': a.parts, 'buf': x.t}}
  when length(a.buf) + 2 + length(x.t) <= {fixed.CHUNK_CHARS} then {{'t': '', 'alone': false, 'parts': a.parts, 'buf': a.buf || chr(10) || chr(10) || x.t}}
  else {{'t': '', 'alone': false, 'parts': list_append(a.parts, a.buf), 'buf': x.t}} end)"""
CHUNKS_SQL = f"""with src as ({MARKDOWN}), ln as materialized (select source, string_split(text, chr(10)) as lines from src),
  fl as (select source, list_filter(list_transform(lines, lambda l, i: {{'at': i - 1, 'm': regexp_extract(l, {t.q(fixed.FENCE)}, 1), 'open': '', 'start': 0::bigint,
    'spans': []::struct(s bigint, e bigint)[]}}), lambda x: x.m <> '') as f from ln),
  sp as materialized (select source, case when r.open <> '' then list_append(r.spans, {{'s': r.start, 'e': 2147483647::bigint}}) else r.spans end as spans from (
    select source, list_reduce(list_prepend({{'at': 0::bigint, 'm': '', 'open': '', 'start': 0::bigint, 'spans': []::struct(s bigint, e bigint)[]}}, f), lambda a, x:
      case when a.open = '' then {{'at': x.at, 'm': '', 'open': x.m, 'start': x.at, 'spans': a.spans}}
        when a.open = x.m then {{'at': x.at, 'm': '', 'open': '', 'start': 0::bigint, 'spans': list_append(a.spans, {{'s': a.start, 'e': x.at}})}} else a end) as r from fl)),
  l as materialized (select source, unnest(lines) as line, generate_subscripts(lines, 1) - 1 as pos from ln),
  h as materialized (select source, pos, length(nullif(regexp_extract(line, {_ATX}, 1), '')) as lev, trim(regexp_extract(line, {_ATX}, 2), {_WS}) as heading
    from l join sp using (source) where regexp_extract(line, {_ATX}, 1) <> '' and len(list_filter(spans, lambda s: pos between s.s and s.e)) = 0),
  pa as materialized (select a.source, a.pos, list(b.heading order by b.lev) as path from h a join h b on a.source = b.source and b.pos <= a.pos
      and not exists (select 1 from h c where c.source = a.source and c.pos > b.pos and c.pos <= a.pos and c.lev <= b.lev) group by a.source, a.pos),
  sec as (select l.source, l.pos, l.line, h.pos is not null as is_head, count(h.pos) over w as section, max(h.pos) over w as head_pos
    from l left join h on h.source = l.source and h.pos = l.pos window w as (partition by l.source order by l.pos)),
  body as materialized (select sec.source, section, trim(string_agg(line, chr(10) order by sec.pos), {_WS}) as body, any_value(head_pos) as head_pos from sec where not is_head group by sec.source, section),
  par as (select body.*, coalesce(pa.path, []) as path, list_filter(list_transform(regexp_split_to_array(body, '\\n\\s*\\n'), lambda p: trim(p, {_WS})), lambda p: p <> '') as ps
    from body left join pa on pa.source = body.source and pa.pos = body.head_pos where body <> ''),
  pc as (select *, flatten(list_transform(ps, lambda p: list_transform(range(0, greatest(ceil(length(p) / {fixed.CHUNK_CHARS}), 1)::bigint), lambda i:
    {{'t': substr(p, i * {fixed.CHUNK_CHARS} + 1, {fixed.CHUNK_CHARS}), 'alone': i < ceil(length(p) / {fixed.CHUNK_CHARS}) - 1}}))) as pieces from par),
  fo as (select *, {_PACKED} as r from pc),
  re as (select *, case when length(body) <= {fixed.CHUNK_CHARS} then [body] when r.buf <> '' then list_append(r.parts, r.buf) else r.parts end as all_parts from fo),
  un as (select *, unnest(all_parts) as piece, generate_subscripts(all_parts, 1) as nth from re)
  select source, section, array_to_string(path, ' > ') as heading_path, coalesce(path[-1], '') as heading, len(path)::int as heading_level, (nth - 1)::int as part, len(all_parts)::int as parts,
    case when len(path) > 0 then array_to_string(list_transform(path, lambda x, i: repeat('#', i) || ' ' || x), chr(10)) || chr(10) || chr(10) || piece else piece end as content from un"""


@query("md_chunks", CHUNKS_SQL)
def md_chunks(spark, sf):
    return docs.chunk_markdown(run_sql(spark, MARKDOWN, sf, "documents"))
