"""Near-duplicate postings: pairs, components, survivors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.functions.identity import company_words
from vacancylens.functions.text import blank, norm_text, words
from vacancylens.functions.vectors import bucket_counts, dot, norm
from vacancylens.operators.graph import components
from vacancylens.operators.textsets import alike, lowered, perhaps_in, run_sets, word_counts
from vacancylens.session import cut, ship


def _embed_text(title: str, text: str, chars: int | None) -> Column:
    body = blank(text) if chars is None else F.substring(blank(text), 1, chars)
    return F.concat_ws("\n", blank(title), body)


def eligible(text: str = "jd_text", correspondence: str = "from_correspondence",
             min_chars: int = fixed.NEAR_DUP_MIN_CHARS) -> Column:
    return ~F.coalesce(F.col(correspondence), F.lit(False)) & (F.length(blank(text)) >= min_chars)


def _keyed(df: DataFrame, ord_col: str, text: str, embed_chars: int | None, min_chars: int) -> DataFrame:
    worded = df.filter(eligible(text, min_chars=min_chars)).select(
        F.col(ord_col).alias("ord"), company_words("company").alias("c"), norm_text("title").alias("t"),
        F.length(text).alias("chars"), words(text).alias("w"), _embed_text("title", text, embed_chars).alias("embed"))
    return worded.withColumn("text_key", F.md5(F.array_join("w", " ")))


def prepare(df: DataFrame, ord_col: str = "ord", text: str = "jd_text", embed_chars: int | None = None,
            min_chars: int = fixed.NEAR_DUP_MIN_CHARS, dim: int = fixed.EMBED_DIM) -> DataFrame:
    """Eligible postings with the keys and the word-count vector the join needs; the texts stay where they are.

    `text_key` stands for the text's word sequence, `class_key` for company, title and text together: postings of one
    class pass every test with each other, so one of them speaks for all. Whole texts are embedded unless
    `embed_chars` says how far a model reads.
    """
    keyed = _keyed(df, ord_col, text, embed_chars, min_chars)
    return keyed.select("ord", "c", "t", "chars", F.size("w").alias("n_words"), "text_key",
                        F.md5(F.concat_ws("|", "c", "t", "text_key")).alias("class_key"), word_counts("embed", dim).alias("v"))


def text_pairs(df: DataFrame, prepared: DataFrame, min_overlap: float = fixed.NEAR_DUP_JACCARD, ord_col: str = "ord",
               text: str = "jd_text", min_chars: int = fixed.NEAR_DUP_MIN_CHARS) -> DataFrame:
    """Pairs of distinct texts whose word 5-grams overlap enough: (a, b, overlap) over text keys.

    Each distinct text enters the join once; its words are read where the text lies.
    """
    texts = df.filter(eligible(text, min_chars=min_chars)).select(F.xxhash64(ord_col).alias("row"), lowered(text))
    pairs = alike(texts, min_overlap)
    names = prepared.groupBy("text_key").agg(F.min("ord").alias("ord"))
    placed = (pairs.join(names.select(F.col("text_key").alias("a"), F.col("ord").alias("ord_a")), "a")
              .join(names.select(F.col("text_key").alias("b"), F.col("ord").alias("ord_b")), "b"))
    swap = F.col("ord_a") > F.col("ord_b")
    return placed.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"),
                         F.col("score").alias("overlap"))


def classes(prepared: DataFrame) -> DataFrame:
    """One row per class: its first posting."""
    w = Window.partitionBy("class_key").orderBy("ord")
    return prepared.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("class_key", "text_key", "c", "t", "ord", "n_words", "v")


def representative_pairs(df: DataFrame, ord_col: str = "ord", text: str = "jd_text", min_cosine: float = fixed.NEAR_DUP_COSINE,
                         min_overlap: float = fixed.NEAR_DUP_JACCARD) -> DataFrame:
    """(a, b, overlap, similarity) by position, between the first postings of distinct texts that pass every test."""
    prepared = cut(prepare(df, ord_col, text))
    first = Window.partitionBy("text_key").orderBy("ord")
    reps = prepared.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    pairs = text_pairs(df, prepared, min_overlap, ord_col, text)
    met = pairs.join(reps.alias("p"), F.col("a") == F.col("p.text_key")).join(
        reps.alias("q"), F.col("b") == F.col("q.text_key")).filter(_titles_allow("p", "q") & _similar("p", "q", min_cosine))
    similarity = dot(F.col("p.v"), F.col("q.v")) / (norm(F.col("p.v")) * norm(F.col("q.v")))
    return met.select(F.least("p.ord", "q.ord").alias("a"), F.greatest("p.ord", "q.ord").alias("b"),
                      F.round("overlap", 4).alias("overlap"), F.round(similarity, 4).alias("similarity"))


def _similar(a: str, b: str, min_cosine: float) -> Column:
    scale = norm(F.col(f"{a}.v")) * norm(F.col(f"{b}.v"))
    return (scale > 0) & (dot(F.col(f"{a}.v"), F.col(f"{b}.v")) >= F.lit(min_cosine) * scale - F.lit(1e-12))


def _titles_allow(a: str, b: str) -> Column:
    return (F.col(f"{a}.c") != F.col(f"{b}.c")) | (F.col(f"{a}.t") == F.col(f"{b}.t"))


FEW = 256
BLOCK_TITLES = 8192
SLICE = 512
_EDGE = "a string, b string"


def _forest(min_cosine: float):
    """Edges of a spanning forest of the passing pairs between two blocks of titles: linear in the titles."""

    def run(rows: pa.Table) -> pa.Table:
        left, right = rows.filter(pc.field("first")), rows.filter(~pc.field("first"))
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string())})

        def side(rows: pa.Table) -> tuple:
            m = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1).astype(float)
            return (rows["x"].to_numpy(zero_copy_only=False), m, np.sqrt((m * m).sum(axis=1)),
                    *(rows[c].to_numpy(zero_copy_only=False) for c in ("t", "low", "high")))

        (x, a, na, ta, la, ha), (y, b, nb, tb, lb, hb) = side(left), side(right)
        names = np.unique(np.concatenate([x, y]))
        root = np.arange(len(names))
        at_x, at_y = np.searchsorted(names, x), np.searchsorted(names, y)

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        out = []
        for start in range(0, len(x), SLICE):
            part = slice(start, start + SLICE)
            scale = na[part, None] * nb[None, :]
            near = (scale > 0) & (a[part] @ b.T >= min_cosine * scale - 1e-12)
            # Two titles of one company that has no other name under either may not merge.
            alone = (la[part] == ha[part])[:, None] & (lb == hb)[None, :] & (la[part][:, None] == lb[None, :])
            near &= ~alone | (ta[part][:, None] == tb[None, :])
            for i, row in enumerate(near, start):
                mine = at_x[i]
                labels = root[at_y[row]]
                for j in at_y[row][np.unique(labels, return_index=True)[1]] if len(labels) else ():
                    p, q = find(mine), find(int(j))
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        out.append((names[mine], names[j]))
        return pa.table({"a": pa.array([e[0] for e in out], pa.string()), "b": pa.array([e[1] for e in out], pa.string())})

    return run


def title_vertices(reps: DataFrame) -> DataFrame:
    """(text_key, t, v, x, low, high): the titles a text stands under, each with its first class and two of its companies.

    Classes of one text and title differ in their company alone, so they pass every test with each other. Whether two
    titles meet depends on no more of their companies than whether both have one, and the same.
    """
    return reps.filter(F.col("n_words") >= fixed.SHINGLE_WORDS).groupBy("text_key", "t", "v").agg(
        F.min(F.struct("ord", "class_key"))["class_key"].alias("x"), F.min("c").alias("low"), F.max("c").alias("high"))


def class_edges(reps: DataFrame, pairs: DataFrame, min_cosine: float = fixed.NEAR_DUP_COSINE, block: int = BLOCK_TITLES) -> DataFrame:
    """Edges (a, b) over class keys that connect exactly what all passing pairs would connect.

    The classes of one text and title hang on their first one. Neighbouring texts, and each text with itself, meet title
    by title: a few titles in a plain join, many in blocks whose passing pairs leave a spanning forest, so a text under
    thousands of names gives edges in proportion to its names, whatever passes and whatever fails. A text whose shingle
    set is empty overlaps nothing, not even itself.
    """
    ship(reps.sparkSession)
    titles = cut(title_vertices(reps))
    members = reps.join(titles.select("text_key", "t", "v", "x"), ["text_key", "t", "v"]).filter("class_key <> x").select(
        F.col("x").alias("a"), F.col("class_key").alias("b"))
    sizes = titles.groupBy("text_key").agg(F.count("*").alias("n"))
    # A text meets its neighbours and, if it stands under several titles, itself.
    itself = sizes.filter("n > 1").select(F.explode(F.array(F.struct(F.col("text_key").alias("a"), F.col("text_key").alias("b")))).alias("e")).select("e.a", "e.b")
    near = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().unionByName(itself)
    near = near.join(sizes.select(F.col("text_key").alias("a"), F.col("n").alias("na")), "a").join(
        sizes.select(F.col("text_key").alias("b"), F.col("n").alias("nb")), "b")

    few = near.filter(F.col("na") * F.col("nb") <= FEW).join(titles.alias("p"), F.col("a") == F.col("p.text_key")).join(
        titles.alias("q"), F.col("b") == F.col("q.text_key"))
    alone = (F.col("p.low") == F.col("p.high")) & (F.col("q.low") == F.col("q.high")) & (F.col("p.low") == F.col("q.low"))
    meets = (F.col("p.x") != F.col("q.x")) & (~alone | (F.col("p.t") == F.col("q.t"))) & _similar("p", "q", min_cosine)
    plain = few.filter(meets).select(F.col("p.x").alias("a"), F.col("q.x").alias("b"))

    many = near.filter(F.col("na") * F.col("nb") > FEW).withColumn("parts_a", F.ceil(F.col("na") / block).cast("int")).withColumn(
        "parts_b", F.ceil(F.col("nb") / block).cast("int"))

    def dealt(own: str, other: str, mine: str, theirs: str) -> DataFrame:
        rows = titles.join(many, F.col("text_key") == F.col(own)).withColumn(
            mine, F.pmod(F.xxhash64("x"), F.col(f"parts_{own}")).cast("int")).withColumn(
            theirs, F.explode(F.sequence(F.lit(0), F.col(f"parts_{other}") - 1)))
        return rows.filter((F.col("a") != F.col("b")) | (F.col("i") <= F.col("j"))).select("a", "b", "i", "j", "x", "t", "v", "low", "high")

    sides = dealt("a", "b", "i", "j").withColumn("first", F.lit(True)).unionByName(dealt("b", "a", "j", "i").withColumn("first", F.lit(False)))
    forest = sides.groupBy("a", "b", "i", "j").applyInArrow(_forest(min_cosine), _EDGE)
    return members.unionByName(plain).unionByName(forest)


def with_survivor(df: DataFrame, ord_col: str = "ord", text: str = "jd_text", min_cosine: float = fixed.NEAR_DUP_COSINE,
                  min_overlap: float = fixed.NEAR_DUP_JACCARD, embed_chars: int | None = None,
                  min_chars: int = fixed.NEAR_DUP_MIN_CHARS) -> DataFrame:
    """(ord, survivor) of every eligible posting: the longest text of its component, then the first in order."""
    prepared = cut(prepare(df, ord_col, text, embed_chars, min_chars))
    reps = cut(classes(prepared))
    edges = class_edges(reps, cut(text_pairs(df, prepared, min_overlap, ord_col, text, min_chars)), min_cosine)
    found = components(edges)
    # A text without shingles is never a duplicate, so its classes stay apart from their own copies too.
    own = F.when(F.col("n_words") >= fixed.SHINGLE_WORDS, F.col("class_key")).otherwise(F.col("ord").cast("string"))
    placed = prepared.select("ord", "chars", own.alias("class_key")).join(
        found.select(F.col("node").alias("class_key"), "component"), "class_key", "left").select(
        "ord", "chars", F.coalesce("component", "class_key").alias("component"))
    best = placed.groupBy("component").agg(F.min(F.struct(-F.col("chars"), F.col("ord").alias("ord"))).alias("best"))
    return placed.join(best, "component").select("ord", F.col("best.ord").alias("survivor"), "component")


def collapse(df: DataFrame, ord_col: str = "ord", text: str = "jd_text", max_listed: int | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(survivors, absorbed). Ineligible postings survive untouched.

    `absorbed` has one row per absorbed posting with its similarity and overlap measured against the survivor, which in a
    chain may lie under the thresholds. Survivors carry the number of absorbed postings; the list itself stays a table,
    because a posting may absorb a third of all rows.
    """
    groups = cut(with_survivor(df, ord_col, text, **options))
    lost = groups.filter("ord <> survivor")
    # Only texts that take part in a comparison are read again; a bounded table tells most others before any shuffle.
    # Their vectors are made by columns: a second Python step in one task would double what an executor's workers hold.
    taking = cut(lost.select(F.explode(F.array("ord", "survivor")).alias(ord_col)).distinct())
    near = perhaps_in(df, F.xxhash64(ord_col), taking.select(F.xxhash64(ord_col).alias("number")))
    side = run_sets(near.select(F.col(ord_col).alias("ord"), "id", "company", "title", "link", lowered(text),
                                bucket_counts(_embed_text("title", text, options.get("embed_chars"))).alias("v"))).join(
        taking.select(F.col(ord_col).alias("ord")), "ord", "left_semi")
    members = lost.join(side, "ord")
    heads = side.select(F.col("ord").alias("survivor"), F.col("tokens").alias("tokens_s"), F.col("v").alias("v_s")).join(
        lost.select("survivor").distinct(), "survivor", "left_semi")
    compared = members.join(heads, "survivor")
    both = F.size(F.array_intersect("tokens", "tokens_s"))
    absorbed = compared.select(
        "survivor", "ord", "id", "company", "title", "link",
        F.bround(dot(F.col("v"), F.col("v_s")) / (norm(F.col("v")) * norm(F.col("v_s"))), 4).alias("similarity"),
        F.bround(both / (F.size("tokens") + F.size("tokens_s") - both), 4).alias("overlap"))
    counts = lost.groupBy(F.col("survivor").alias(ord_col)).agg(F.count("*").alias("n_absorbed"))
    survivors = df.join(lost.select(F.col("ord").alias(ord_col)), ord_col, "left_anti").join(counts, ord_col, "left").withColumn(
        "n_absorbed", F.coalesce("n_absorbed", F.lit(0)))
    return survivors, absorbed


def with_duplicates(survivors: DataFrame, absorbed: DataFrame, most: int | None = None, ord_col: str = "ord") -> DataFrame:
    """Survivors with their absorbed postings as an array, for tables that want it in the row.

    All of them, unless `most` says how many a reader takes; `n_absorbed` and the absorbed table are whole in any case,
    and are what to use where a posting may absorb a large part of all rows.
    """
    first = Window.partitionBy("survivor").orderBy("ord")
    listed = absorbed if most is None else absorbed.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most)
    lists = listed.groupBy(F.col("survivor").alias(ord_col)).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "id", "company", "title", "link", "similarity", "overlap"))),
        lambda x: F.struct(x["id"].alias("id"), x["company"].alias("company"), x["title"].alias("title"),
                           x["link"].alias("link"), x["similarity"].alias("similarity"), x["overlap"].alias("overlap"))).alias("duplicates"))
    return survivors.join(lists, ord_col, "left")
