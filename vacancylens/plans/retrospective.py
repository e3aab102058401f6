"""The market retrospective: every corpus measure over one de-duplicated frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.operators import market
from vacancylens.operators.bands import STATS
from vacancylens.operators.leader import cluster_fields
from vacancylens.session import cut


@dataclass(frozen=True)
class Retrospective:
    window: DataFrame
    rates: DataFrame
    splits: DataFrame
    terms: DataFrame
    employers: DataFrame


def build(postings: DataFrame, top_terms: int = fixed.TOP_TERMS, min_term_count: int = 1, **options) -> Retrospective:
    """All sections. Only the narrow facts frame is materialised; the texts are read once and dropped."""
    facts = cut(market.posting_facts(postings))
    clusters = cluster_fields(market.field_counts(facts, min_term_count=min_term_count), **options)
    return Retrospective(
        window=market.corpus_window(facts), rates=market.rate_reality(facts), splits=market.supply_splits(facts),
        terms=market.term_sections(facts, clusters, top=top_terms), employers=market.employers(facts, clusters))


def _slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def metrics(r: Retrospective) -> DataFrame:
    """Every section flattened to (key, value) rows, null figures left out.

    Labels that read alike once they are keys, as `Full-time` and `Full time` do, are one key: their counts add up, and so
    do their shares, which are parts of one whole.
    """
    def rows(df: DataFrame, *pairs: tuple[Column, Column]) -> DataFrame:
        return df.select(F.explode(F.array(*[F.struct(k.alias("key"), v.cast("double").alias("value")) for k, v in pairs])).alias("m")).select("m.*")

    scope = _slug(F.col("scope"))
    label = F.concat(F.col("field"), F.lit("_"), _slug(F.col("label")))
    question = F.when(F.col("is_agency"), F.lit("employers_who_s_hiring_agencies")).otherwise(F.lit("employers_who_s_hiring_direct"))
    both = F.array(F.lit(False), F.lit(True))
    sides = r.window.select(F.explode(both).alias("is_agency"))
    counts = sides.join(r.employers.groupBy("is_agency").agg(F.count("*").alias("n")), "is_agency", "left")
    out = rows(r.window, (F.lit("postings"), F.col("postings")), (F.lit("jd_read"), F.col("jd_read")))
    out = out.unionByName(rows(
        r.rates, (F.concat(F.lit("rate_n_"), scope), F.col("n")), (F.concat(F.lit("rate_total_"), scope), F.col("total")),
        (F.concat(F.lit("rate_share_"), scope), F.col("share")),
        *[(F.concat(F.lit(f"rate_{s}_"), scope), F.col(s)) for s in STATS]))
    out = out.unionByName(rows(r.splits, (F.concat(F.lit("share_"), label), F.col("share")), (F.concat(F.lit("count_"), label), F.col("n"))))
    out = out.unionByName(rows(counts, (question, F.coalesce(F.col("n"), F.lit(0)))))
    return out.filter(F.col("value").isNotNull()).groupBy("key").agg(F.sum("value").alias("value"))


def long_table(r: Retrospective, top_employers: int = fixed.TOP_EMPLOYERS) -> DataFrame:
    """The whole retrospective as one table: (section, item, measure, value)."""
    def rows(df: DataFrame, section: Column, item: Column, *measures: str) -> DataFrame:
        return df.select(section.alias("section"), item.alias("item"), F.explode(F.array(
            *[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])).alias("m")).select(
            "section", "item", "m.*")

    ranked = None
    for flag, name in ((False, "employers direct"), (True, "employers agency")):
        side = market.top_with_total(r.employers.filter(F.col("is_agency") == flag), top_employers, "n", "name")
        part = rows(side, F.lit(name), F.col("name"), "n", "spellings", "place")
        ranked = part if ranked is None else ranked.unionByName(part)
    out = rows(r.window, F.lit("window"), F.lit("all"), "postings", "jd_read", "runs", "days")
    out = out.unionByName(rows(r.rates, F.lit("rates"), F.col("scope"), "n", "total", "share", *STATS))
    out = out.unionByName(rows(r.splits, F.concat(F.lit("split "), "field"), F.col("label"), "n", "share"))
    out = out.unionByName(rows(r.terms, F.concat(F.lit("terms "), "field"), F.col("label"), "total", "spellings", "place"))
    return out.unionByName(ranked)
