"""Text fragments for the plain SQL twins: the column functions said again in SQL."""

from __future__ import annotations

from vacancylens import fixed

NONWORD = r"(?:^|[^\p{L}\p{N}_])"
ENDWORD = r"(?:[^\p{L}\p{N}_]|$)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def norm(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))")


def company_words(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({norm(x)}, {q(fixed.LEGAL_SUFFIXES)}, ' ', 'g'), ' +', ' ', 'g'))"


def company_key(x: str) -> str:
    return f"replace({company_words(x)}, ' ', '')"


def composite(company: str, title: str, metro: str = "''") -> str:
    return f"concat({company_words(company)}, '|', {norm(title)}, '|', {norm(metro)})"


def normalize_link(x: str) -> str:
    u = f"coalesce({x}, '')"
    li = f"regexp_extract({u}, {q(fixed.LINKEDIN_VIEW)}, 1)"
    ind = f"regexp_extract({u}, {q(fixed.INDEED_VIEW)}, 1)"
    return (f"(case when {li} <> '' then 'https://www.linkedin.com/jobs/view/' || {li} "
            f"when {ind} <> '' then 'https://www.indeed.com/viewjob?jk=' || {ind} else {u} end)")


def link_identity(x: str) -> str:
    url = f"split_part({normalize_link(f'trim(coalesce({x}, {q(chr(39)+chr(39))[1:-1]}))')}, '#', 1)"
    head = f"split_part({url}, '?', 1)"
    scheme = f"split_part({head}, '://', 1)"
    rest = f"substr({head}, strpos({head}, '://') + 3)"
    host = f"regexp_replace(lower(split_part({rest}, '/', 1)), '^www\\.', '')"
    path = f"substr({rest}, length(split_part({rest}, '/', 1)) + 1)"
    full = f"(case when contains({head}, '://') then lower({scheme}) || '://' || {host} || {path} else {head} end)"
    query = f"(case when contains({url}, '?') then substr({url}, strpos({url}, '?') + 1) else '' end)"
    names = ", ".join(q(p) for p in fixed.TRACKING_PARAMS)
    name = "lower(trim(split_part(p, '=', 1)))"
    prefixes = " and ".join(f"not starts_with({name}, {q(p)})" for p in fixed.TRACKING_PREFIXES)
    kept = (f"array_to_string(list_sort(list_filter(string_split({query}, '&'), "
            f"lambda p: p <> '' and {name} not in ({names}) and {prefixes})), '&')")
    return (f"(case when {url} = '' then '' else regexp_replace({full}, '/+$', '') || "
            f"(case when {kept} <> '' then '?' || {kept} else '' end) end)")


def job_id(company: str, title: str, link: str) -> str:
    c = composite(company, title)
    return f"(case when trim({c}, '|') <> '' then {c} else coalesce(nullif({link_identity(link)}, ''), {c}) end)"


def contains_any(x: str, terms) -> str:
    return "(" + " or ".join(f"contains({x}, {q(t)})" for t in terms) + ")"


def first_contained(x: str, terms) -> str:
    return "case " + " ".join(f"when contains({x}, {q(t)}) then {q(t)}" for t in terms) + " end"


def words(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"


def shingles(w: str, n: int = 5) -> str:
    """Distinct runs of n words of a word-list column."""
    runs = ", ".join(f"{w}[{i + 1}:len({w}) - {n - 1 - i}]" for i in range(n))
    joined = " || ' ' || ".join(f"z[{i + 1}]" for i in range(n))
    return f"(case when len({w}) >= {n} then list_distinct(list_transform(list_zip({runs}), lambda z: {joined})) else [] end)"


def char_grams(x: str, n: int = 4, floor: int = 10) -> str:
    s = f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]', '', 'g')"
    return (f"(case when length({s}) >= {max(n, floor)} then list_distinct(list_transform(range(1, length({s}) - {n} + 2), "
            f"lambda i: substr({s}, i, {n}))) else [] end)")


def rate(x: str) -> str:
    """The posted-rate rule; RE2 has no lookbehind, so groups come straight from the pattern."""
    def amount(num: str, k: str) -> str:
        v = f"try_cast(replace({num}, ',', '') as double)"
        return f"(case when {k} <> '' then {v} * 1000 else {v} end)"

    def g(pattern: str, i: int) -> str:
        return f"regexp_extract({x}, {q('(?i)' + pattern)}, {i})"

    def yearly(v: str, unit: str, k: str) -> str:
        u = f"lower({unit})"
        return (f"(case when {contains_any(u, fixed.HOURLY_WORDS)} then false "
                f"when {contains_any(u, fixed.YEARLY_WORDS)} then true else ({k} <> '' or {v} >= 1000) end)")

    def hourly(v: str, y: str) -> str:
        return f"(case when {y} then {v} / 2080 else {v} end)"

    def ok(h: str) -> str:
        return f"({h} between 10 and 600)"

    def usd(h: str) -> str:
        return f"cast(cast(round_even({h}, 0) as bigint) as varchar)"

    r = fixed.RATE_RANGE
    lo, hi = amount(g(r, 1), g(r, 2)), amount(g(r, 3), g(r, 4))
    y = yearly(f"greatest({lo}, {hi})", g(r, 5), f"concat({g(r, 2)}, {g(r, 4)})")
    lo_h, hi_h = hourly(lo, y), hourly(hi, y)
    ranged = (f"case when {g(r, 0)} <> '' and {ok(lo_h)} and {ok(hi_h)} and {lo_h} <= {hi_h} "
              f"then '$' || {usd(lo_h)} || '-' || {usd(hi_h)} || '/hr' end")
    s = fixed.RATE_SINGLE
    v = amount(g(s, 1), g(s, 2))
    h = hourly(v, yearly(v, g(s, 3), g(s, 2)))
    single = f"case when {g(s, 0)} <> '' and {ok(h)} then '$' || {usd(h)} || '/hr' end"
    n = q("(?i)" + fixed.RATE_NUMBER)
    num, k = f"regexp_extract(m, {n}, 1)", f"regexp_extract(m, {n}, 2)"
    mv = amount(num, k)
    mh = hourly(mv, f"({k} <> '' or {mv} >= 1000)")
    lone = (f"list_filter(list_transform(regexp_extract_all({x}, {n}), lambda m: case when contains({num}, ',') or {k} <> '' "
            f"then {mh} end), lambda h: h between 10 and 600)")
    return (f"(case when contains({x}, '$') then coalesce({ranged}, {single}, "
            f"case when len({lone}) > 0 then '$' || {usd(lone + '[1]')} || '/hr' end) end)")


def midpoint(x: str) -> str:
    lo = f"try_cast(nullif(regexp_extract(coalesce({x}, ''), {q(fixed.RATE_TEXT)}, 1), '') as double)"
    hi = f"try_cast(nullif(regexp_extract(coalesce({x}, ''), {q(fixed.RATE_TEXT)}, 2), '') as double)"
    return f"(({lo} + coalesce({hi}, {lo})) / 2)"


def stats(value: str, where: str = "true") -> str:
    """Six exact distribution figures of a value under a condition, two decimals."""
    v = f"case when {where} then {value} end"
    out = [f"round_even(median({v}), 2) as median", f"round_even(avg({v}), 2) as mean"]
    for name, p in (("p10", .1), ("p25", .25), ("p75", .75), ("p90", .9)):
        out.append(f"case when count({v}) >= 2 then round_even(quantile_cont({v}, {p}), 2) end as {name}")
    return ", ".join(out)


# CRC32 of a word, bit by bit; its bucket is the remainder by 64.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(w, ''), lambda c: ascii(c)::bigint)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, z: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint)"""


def embed_sql(source: str, key: str, text: str) -> str:
    """CTEs `tok` (words) and `vec` (key, v: 64 counts) for a text column."""
    return f"""tok as (select {key}, {words(text)} as ws from {source}),
  lw as (select {key}, unnest(ws) as w from tok), dw as (select w, {_CRC} % 64 as bucket from (select distinct w from lw)),
  bc as (select {key}, bucket, count(*) as n from lw join dw using (w) group by {key}, bucket),
  vec as (select {key}, list_transform(range(0, 64), lambda i: coalesce(map_extract(m, i)[1], 0)::double) as v
    from (select {key}, map(list(bucket), list(n)) as m from bc group by {key}))"""
