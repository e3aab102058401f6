"""Line deduplication through a log-template tree. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancylens.functions.text import let
from vacancylens.llm.common import saved, unused

MIN_DOCS = 2
MIN_TOKENS = 4
MIN_BYTES = 48
DEPTH = 3
ALIKE = 0.8
FIELD = "<*>"
WORDS = 1 << 20


def _plain(text: Column) -> Column:
    """The text with single blanks between tokens and none at the ends of its lines."""
    odd = text.contains("  ") | text.rlike(r"[\x09\x0B-\x0D]")  # a single blank needs no replacement, and most texts have no other
    single = F.when(odd, F.regexp_replace(text, r"[\x09\x0B-\x0D ]+", " ")).otherwise(text)
    return F.trim(F.replace(F.replace(single, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n")))


def _masked(plain: Column) -> Column:
    """The text with the field mark for every token with a digit."""
    digits = r"(^|[ \n])[^ \n0-9]*+[0-9][^ \n]*+"
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, digits, "$1" + FIELD)).otherwise(plain)


def _tokens(line: Column) -> Column:
    """Number of tokens of a line with single blanks."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "))) + 1


def _lines(docs: DataFrame, key: str, text: str, depth: int, min_tokens: int, min_bytes: int) -> DataFrame:
    # Whole texts are masked, and cut into lines after that: expressions over array elements are interpreted one by one.
    # The outer form brings null texts one null line, which the filter drops; the plain form would compute all of it in a filter too.
    texts = docs.select(F.col(key).alias("id"), F.xxhash64(key, text).alias("doc"), _plain(F.col(text)).alias("plain"))
    texts = texts.withColumn("both", F.arrays_zip(F.split("plain", "\n").alias("plain"), F.split(_masked(F.col("plain")), "\n").alias("masked")))
    rows = texts.select("id", "doc", F.posexplode_outer("both").alias("line_no", "line")).withColumn("n", _tokens(F.col("line.plain")))
    # A line of few tokens would not be known by its mask and stays as it is.
    rows = rows.withColumn("tokens", F.when(F.col("n") >= min_tokens, F.col("line.masked")).otherwise(F.col("line.plain")))
    # A leaf holds the whole of a line that does not go past its lead, hence a single form; only longer ones are read again.
    return rows.filter((F.length("tokens") > 0) & ((F.col("n") >= min_tokens) | (F.octet_length("tokens") >= min_bytes))).select(
        "id", "doc", "line_no", F.when(F.col("n") > depth, F.col("tokens")).alias("tokens"), "n",
        F.xxhash64("n", F.substring_index("tokens", " ", depth)).alias("leaf"), F.xxhash64("tokens").alias("form"))


def _may_meet(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """The rows with `may`: true wherever `keys` has their values of `on`, and for few others.

    The keys are read as a table of bits, 64 a row. It is broadcast, as `WORDS` bounds its length.
    """
    slot = F.pmod(F.xxhash64(*on), F.lit(64 * WORDS))
    word, place = F.shiftright(slot, 6), slot.bitwiseAND(F.lit(63)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    bits = keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return rows.withColumn("word", word).join(F.broadcast(bits), "word", "left").withColumn(
        "may", F.coalesce(F.getbit("bits", place) == 1, F.lit(False))).drop("word", "bits")


def _generalised(lines: DataFrame, depth: int, min_docs: int, alike: float) -> DataFrame:
    """(leaf, form, template) of the lines that a template of their leaf covers.

    Only leaves with two forms or more are read again. In such a leaf a position is fixed where one token stands in over
    half of the forms, and a field elsewhere; the template covers the forms that agree with at least `alike` of their
    positions. The forms left over are tried again by themselves, until nothing more is covered. Where a template covers
    none of a group's forms, the group is split: the positions past the lead are cut into one segment more than the
    positions in which two forms may differ, so that alike forms share at least one, and each form goes with those that
    share the segment of its that most forms hold, but not all. A form that shares none is a template of its own.
    """
    leaves = saved(lines.groupBy("leaf").agg(F.min("form").alias("a"), F.max("form").alias("b"), F.count("*").alias("n")).filter(
        (F.col("a") != F.col("b")) & (F.col("n") >= min_docs)).select("leaf"), "line-leaves")
    few = _may_meet(lines.select("leaf", "form", "tokens", "n"), leaves, "leaf").filter("may")  # most lines are in no such leaf
    forms = few.groupBy("leaf", "form").agg(F.first("tokens").alias("tokens"), F.first("n").alias("n")).join(leaves, "leaf", "left_semi")
    left = saved(forms.withColumn("template", F.lit(0).cast("long")), "line-forms")
    group, covered = ["leaf", "template"], None
    while not left.isEmpty():
        found = saved(_agreeing(left, group, alike), "line-agreeing")
        covered = found if covered is None else covered.unionByName(found)
        met = found.select(*group).distinct().withColumn("met", F.lit(True))
        rest = saved(left.join(found, ["leaf", "template", "form"], "left_anti").join(met, group, "left"), "line-rest")
        again = rest.filter("met").withColumn("template", F.xxhash64("template", F.lit("rest"))).drop("met")
        left = saved(again.unionByName(_split(rest.filter("met is null").drop("met"), depth, alike)), "line-left")
        left = left.join(left.groupBy(group).agg(F.count("*").alias("forms")).filter("forms > 1").select(*group), group, "left_semi")
    return covered if covered is not None else left.select("leaf", "form", "template")


def _agreeing(forms: DataFrame, group: list[str], alike: float) -> DataFrame:
    """(leaf, form, template) of the forms that agree with at least `alike` of the positions their group's majority fixes."""
    sizes = forms.groupBy(*group).agg(F.count("*").alias("forms"))
    marks = F.transform(F.split("tokens", " "), lambda token, pos: F.concat_ws(" ", pos.cast("string"), token))
    # A group has two forms or more, so that one form's own tokens are never fixed. What is fixed is one list, no longer than a
    # line, which meets whole forms: tokens are counted but not joined.
    held = forms.select(*group, F.explode(marks).alias("mark")).groupBy(*group, "mark").agg(F.count("*").alias("held")).filter("held > 1")
    fixed = held.join(sizes, group).filter(2 * F.col("held") > F.col("forms")).groupBy(*group).agg(F.collect_list("mark").alias("fixed"))
    agree = F.size(F.array_intersect(marks, F.col("fixed")))
    return forms.join(fixed, group).filter(agree >= F.greatest(F.lit(1.0), F.lit(alike) * F.col("n"))).select("leaf", "form", "template")


def _split(forms: DataFrame, depth: int, alike: float) -> DataFrame:
    """The forms in smaller groups: each with those of its group that hold its most common segment that not all hold."""
    group = ["leaf", "template"]
    past = F.split("tokens", " ")
    cuts = F.least(F.col("n") - depth, F.col("n") - F.ceil(F.lit(alike) * F.col("n")) + 1).cast("int")
    ends = F.transform(F.sequence(F.lit(0), F.col("cuts")), lambda i: F.floor(i * (F.col("n") - depth) / F.col("cuts")).cast("int") + depth)
    parts = F.transform(F.sequence(F.lit(1), F.col("cuts")), lambda i: F.xxhash64(i, F.array_join(F.slice(
        "past", F.element_at("ends", i) + 1, F.element_at("ends", i + 1) - F.element_at("ends", i)), " ")))
    segments = forms.withColumns({"past": past, "cuts": cuts}).filter("cuts > 0").withColumn("ends", ends).select(
        *group, "form", F.explode(parts).alias("segment"))
    sizes = forms.groupBy(*group).agg(F.count("*").alias("forms"))
    held = segments.groupBy(*group, "segment").agg(F.count("*").alias("held")).join(sizes, group).filter(
        (F.col("held") > 1) & (F.col("held") < F.col("forms"))).select(*group, "segment", "held")
    best = segments.join(held, [*group, "segment"]).groupBy(*group, "form").agg(F.max(F.struct("held", "segment"))["segment"].alias("segment"))
    return forms.join(best, [*group, "form"]).withColumn("template", F.xxhash64("template", "segment")).drop("segment")


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS,
                   min_tokens: int = MIN_TOKENS, depth: int = DEPTH, alike: float = ALIKE, keep_first: bool = True,
                   min_bytes: int = MIN_BYTES) -> DataFrame:
    """(doc, lines): per document, the numbers of its lines to drop; `doc` is a hash of key and text.

    A line reaches a leaf of the tree by its token count and its first `depth` tokens, tokens with digits being fields.
    Lines of one leaf share one of its templates or are a template of their own. A template recurs if `min_docs` different
    documents hold it; it stays at its first place (smallest key, null last, then smallest line number) and every other
    line of it goes, or with `keep_first` off all of them. Lines under `min_tokens` tokens stay if they are under
    `min_bytes` bytes too; longer ones, as scripts without blanks have them, match by their exact form.
    """
    rows = saved(_lines(docs, key, text, depth, min_tokens, min_bytes), "line-places", compression="zstd")
    covered = _generalised(rows, depth, min_docs, alike)
    lines = _may_meet(rows.select("id", "doc", "line_no", "leaf", "form"), covered, "leaf", "form")
    met = saved(lines.filter("may").drop("may").join(covered, ["leaf", "form"], "left"), "line-met")
    alone = lines.filter(~F.col("may")).drop("may").withColumn("template", F.lit(None).cast("long"))
    places = met.unionByName(alone).withColumn("own", F.col("template").isNull()).withColumn("template", F.coalesce("template", "form")).drop("form")
    # Few lines recur. A count and two documents per template tell which may, and only the places of those are shuffled whole.
    group = ["leaf", "own", "template"]
    held = places.groupBy(*group).agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("n")).filter(
        (F.col("n") >= min_docs) & ((F.col("a") != F.col("b")) | F.lit(min_docs < 2)))
    places = saved(_may_meet(places, held, *group).filter("may").drop("may"), "line-recurring")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "doc", "line_no")
    recurring = places.groupBy(*group, "doc").agg(F.min(place).alias("first")).groupBy(*group).agg(
        F.count("*").alias("docs"), F.min("first").alias("first")).filter(F.col("docs") >= min_docs).select(
        *group, F.col("first.doc").alias("first_doc"), F.col("first.line_no").alias("first_line"))
    dropped = places.join(recurring, group)
    if keep_first:
        dropped = dropped.filter(~((F.col("doc") == F.col("first_doc")) & (F.col("line_no") == F.col("first_line"))))
    return dropped.select("doc", "line_no").distinct().groupBy("doc").agg(F.collect_list("line_no").alias("lines"))


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with their recurring lines dropped, plus `lines` and `dropped_lines`, the counts before and of the drop.

    Every row stays, also one that lost all its lines. A null text has no lines and stays null; an empty or blank text
    stays as it is; equal rows get equal results; very long texts are cut at their line ends like others; an empty
    table gives an empty result. Columns of the input with the names of the two counts are replaced.
    """
    doc, drop, body = unused(docs, "_doc", "_drop", "_text")
    drops = repeated_lines(docs, key, text, **options).withColumnRenamed("doc", doc).withColumnRenamed("lines", drop)
    rows = docs.withColumn(doc, F.xxhash64(key, text)).join(drops, doc, "left")
    ends = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))

    def without(split: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(drop))
        return F.array_join(F.transform(kept, lambda i: F.element_at(split, i + 1)), "\n")

    # The text is cut once a row: an expression inside a lambda is worked out for every element.
    cleaned = F.when(F.col(drop).isNull(), F.col(text)).otherwise(let(F.split(F.col(text), "\n"), without))
    counts = {"lines": ends + 1, "dropped_lines": F.coalesce(F.size(drop), F.lit(0))}
    return rows.withColumns({k: F.when(F.col(text).isNull(), 0).otherwise(v).cast("long") for k, v in counts.items()} | {body: cleaned}).withColumn(
        text, F.col(body)).drop(doc, drop, body)


def all_lost(rows: DataFrame, text: str = "text") -> Column:
    """True where nothing but blanks is left of a text that lost lines."""
    return (F.col("dropped_lines") > 0) & (F.trim(F.regexp_replace(F.col(text), r"[\x09-\x0D ]+", " ")) == "")


ORACLE_SQL = r"""
with lines as (
  select doc_id, generate_subscripts(l, 1) - 1 as line_no, unnest(l) as line
  from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)
), masked as (
  select doc_id, line_no, regexp_replace(trim(regexp_replace(line, '[\x09-\x0D ]+', ' ', 'g')), '(^| )[^ 0-9]*[0-9][^ ]*', '\1<*>', 'g') as tokens
  from lines
), placed as (
  select doc_id, line_no, tokens, string_split(tokens, ' ') as parts from masked where tokens <> ''
), leaves as (
  select doc_id, line_no, tokens, parts, len(parts) as n, array_to_string(parts[1:3], ' ') as lead from placed where len(parts) >= 4
), forms as (
  select n, lead, tokens, any_value(parts) as parts from leaves
  where (n, lead) in (select (n, lead) from leaves group by n, lead having count(distinct tokens) > 1 and count(*) >= 2)
  group by n, lead, tokens
), words as (
  select n, lead, tokens, generate_subscripts(parts, 1) as pos, unnest(parts) as word from forms
), fixed as (
  select w.n, w.lead, pos, word from words w join (select n, lead, count(*) as m from forms group by n, lead) s on w.n = s.n and w.lead = s.lead
  group by w.n, w.lead, pos, word, m having 2 * count(*) > m
), covered as (
  select w.n, w.lead, w.tokens from words w join fixed f on w.n = f.n and w.lead = f.lead and w.pos = f.pos and w.word = f.word
  group by w.n, w.lead, w.tokens having count(*) >= 0.8 * w.n
), templates as (
  select l.doc_id, l.line_no, l.n, l.lead, case when c.tokens is null then l.tokens end as own
  from leaves l left join covered c on l.n = c.n and l.lead = c.lead and l.tokens = c.tokens
), firsts as (
  select *, min(doc_id) over t as first_doc, rank() over (partition by n, lead, own order by doc_id, line_no) as place,
         count(distinct doc_id) over t as docs
  from templates window t as (partition by n, lead, own)
), drops as (
  select doc_id, list(line_no) as gone from firsts where docs >= 2 and place > 1 group by doc_id
)
select d.doc_id, d.lang, d.source, d.n_chars,
       case when gone is null then d.text
            else array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: not list_contains(gone, i - 1)), chr(10)) end as text,
       case when d.text is null then 0 else len(string_split(d.text, chr(10))) end as lines,
       coalesce(len(gone), 0) as dropped_lines
from documents d left join drops using (doc_id)
"""
