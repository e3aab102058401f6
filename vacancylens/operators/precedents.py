"""Precedents: earlier judgments on similar postings, found by filtered retrieval and put before the scorer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.functions.identity import composite_id
from vacancylens.functions.text import blank, strip
from vacancylens.operators import knn, rules
from vacancylens.operators.textsets import word_counts
from vacancylens.session import cut

PRECEDENT = "precedent"
VECTOR = "_vector"


def eligible() -> Column:
    """Documents that hold a judgment of the scorer itself: no screened-out posting, no failed call."""
    why = blank("rationale")
    return ((F.col("kind") == "job") & F.col("scored") & ~F.col("prefiltered")
            & ~why.startswith("prefilter:") & ~why.startswith("analysis_error:"))


def question(chars: int | None = None) -> Column:
    """What a posting is asked as: title and company first, then its text, cut only where the embedder has a limit."""
    text = blank("jd_text") if chars is None else F.substring(blank("jd_text"), 1, chars)
    return strip(F.concat(blank("title"), F.lit(" — "), blank("company"), F.lit("\n"), text))


def embedded(documents: DataFrame, embed: Callable[[Column], Column] = word_counts) -> DataFrame:
    """The documents with a vector in place of their text. Before a shuffle of documents, this keeps their texts out of it."""
    return documents.withColumn(VECTOR, embed(F.col("content"))).drop("content")


def find(jobs: DataFrame, documents: DataFrame, by: str = "ord", k: int = fixed.RETRIEVE_K, fetch_k: int = fixed.RETRIEVE_FETCH_K,
         weight: float = fixed.RETRIEVE_LAMBDA, embed: Callable[[Column], Column] = word_counts, chars: int | None = None) -> DataFrame:
    """(query, place, and the document's columns): per posting up to `k` similar, mutually different past judgments.

    documents as `index.build_documents` or `embedded` gives them, one row per key; they are worked out once. `embed` need
    not give vectors of length one, the search is by cosine. Documents that are no precedent, and those of the
    posting's own identity, are ruled out before ranking and inside the cells of the search, so a rare kind of document
    still fills a posting's list. Postings without any text ask nothing.
    """
    known = cut(documents if VECTOR in documents.columns else embedded(documents, embed))
    pool = known.select(F.col("key").alias("id"), F.col(VECTOR).alias("embedding"),
                        F.when(eligible(), PRECEDENT).otherwise("other").alias("label"), F.col("id").alias("own"))
    asked = jobs.filter((blank("title") != "") | (blank("company") != "") | (blank("jd_text") != "")).select(
        F.col(by).alias("id"), embed(question(chars)).alias("embedding"), F.lit(PRECEDENT).alias("label"), composite_id("company", "title").alias("own"))
    chosen = knn.retrieve(asked, pool, k, fetch_k, weight, skip_self=False, label="label", apart="own")
    return chosen.withColumnRenamed("neighbour", "key").join(known.drop(VECTOR), "key")


def with_precedents(jobs: DataFrame, documents: DataFrame, by: str = "ord", opening: str | None = None, closing: str | None = None,
                    rationale_chars: int | None = None, **options) -> DataFrame:
    """jobs with `precedents`: their past judgments as one text, framed by the caller's instructions, '' if there are none."""
    texts = rules.precedent_block(find(jobs, documents, by, **options), "query", "place", rationale_chars)
    framed = F.concat_ws("\n", *[F.lit(x) for x in (opening,) if x], F.col("precedents"), *[F.lit(x) for x in (closing,) if x])
    return jobs.join(texts.select(F.col("query").alias(by), framed.alias("precedents")), by, "left").withColumn("precedents", blank("precedents"))


def scorer_texts(jobs: DataFrame, documents: DataFrame, by: str = "ord", **options) -> DataFrame:
    """(by, body): what the scorer reads of each posting, precedents first."""
    df = with_precedents(jobs, documents, by, **options)
    return df.select(by, rules.scorer_input(df, "precedents").alias("body"))
