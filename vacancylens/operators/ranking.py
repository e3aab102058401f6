"""Ranking: final tier, sort order, worklist sections, review groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.functions.text import any_contains, blank, strip
from vacancylens.operators.pages import needs_manual_review
from vacancylens.operators.windows import ranked_within


def _rank_of(c: Column, names: Sequence[str], missing: int) -> Column:
    out = F.lit(missing)
    for i, name in enumerate(names):
        out = F.when(c == name, F.lit(i)).otherwise(out)
    return out


def final_tier(agencies: Sequence[str] = (), platforms: Sequence[str] = ()) -> Column:
    """Tier decided by rule: agency contracts first, then configured platforms, else the scorer's own tier."""
    hay = F.lower(F.concat_ws(" ", blank("company"), blank("source_platform")))
    agency = F.coalesce(F.col("analysis.is_agency"), F.lit(False)) | any_contains(hay, [a.lower() for a in agencies])
    contract = blank("analysis.employment_type").isin(*fixed.CONTRACT_LIKE)
    return (
        F.when(F.col("analysis").isNull(), F.lit("OPPORTUNISTIC"))
        .when((blank("analysis.verdict") != "SKIP") & agency & contract, F.lit("PRIMARY"))
        .when(any_contains(hay, [p.lower() for p in platforms]), F.lit("SECONDARY"))
        .otherwise(F.col("analysis.tier"))
    )


def sort_columns() -> list[Column]:
    """Ascending sort order of a ranked batch; end with the input order to keep ties stable."""
    return [
        _rank_of(F.coalesce(F.nullif("final_tier", F.lit("")), F.lit("OPPORTUNISTIC")), fixed.TIERS, 2),
        _rank_of(F.coalesce(F.col("analysis.verdict"), F.lit("SKIP")), fixed.VERDICTS, 3),
        F.coalesce(F.col("analysis.intensity"), F.lit(5)), -F.coalesce(F.col("analysis.fit_score"), F.lit(0)),
        F.when(F.col("jd_source") == "full", F.lit(0)).otherwise(F.lit(1)),
    ]


def rank_key(ord_col: str = "ord") -> Column:
    """The sort order as one comparable value, so a rank can be compared without a global sort."""
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate([*sort_columns(), F.col(ord_col)])])


def is_held_back() -> Column:
    return F.coalesce(strip(F.col("analysis.held_back_reason")) != "", F.lit(False))


def hours_risk() -> Column:
    return F.coalesce(F.col("analysis.intensity") >= fixed.HOURS_RISK_INTENSITY, F.lit(False)) & ~is_held_back()


def red_flag_text() -> Column:
    flags = F.col("analysis.red_flags")
    return F.when(F.size(F.coalesce(flags, F.array().cast("array<string>"))) > 0, F.array_join(flags, "; ")).otherwise(F.col("analysis.why"))


def hours_note() -> Column:
    return F.when(hours_risk(), F.concat(F.lit("hours (int"), F.col("analysis.intensity").cast("string"), F.lit("): "), red_flag_text())).otherwise(F.lit(""))


def review_reason() -> Column:
    return F.coalesce(F.nullif(strip(blank("analysis.held_back_reason")), F.lit("")), F.lit(fixed.UNGROUPED_REASON))


def with_section(df: DataFrame, batch: Sequence[str] = ("run",), ord_col: str = "ord", focus_rows: int = fixed.FOCUS_ROWS) -> DataFrame:
    """Adds `section`; every row gets exactly one.

    correspondence, errored, held_back, skipped, focus (the batch's best fitting rows), the final tier, unfetched (never
    judged) or unplaced. Needs `final_tier`. Focus is a rank limit per batch, cut before the shuffle.
    """
    judged = F.col("analysis").isNotNull()
    fits = F.coalesce(F.col("analysis.verdict").isin("STRONG_FIT", "FIT"), F.lit(False))
    base = (
        F.when(F.coalesce(F.col("from_correspondence"), F.lit(False)) & judged, F.lit("correspondence"))
        .when(F.coalesce(F.col("analysis_errored"), F.lit(False)), F.lit("errored"))
        .when(is_held_back(), F.lit("held_back"))
        .when(judged & (F.col("analysis.verdict") == "SKIP"), F.lit("skipped"))
        .when(judged & fits, F.lit("candidate"))
        .when(judged & F.col("final_tier").isin(*fixed.TIERS), F.col("final_tier"))
        .when(needs_manual_review(), F.lit("unfetched"))
        .otherwise(F.lit("unplaced"))
    )
    marked = df.withColumn("section", base)
    order = Window.partitionBy(*batch).orderBy(hours_risk(), rank_key(ord_col))
    best = marked.filter(F.col("section") == "candidate").select(*batch, ord_col, "analysis", "final_tier", "jd_source").withColumn(
        "_n", F.row_number().over(order)).filter(F.col("_n") <= focus_rows).select(F.col(ord_col), F.lit(True).alias("_focus"))
    tier = F.when(F.col("final_tier").isin(*fixed.TIERS), F.col("final_tier")).otherwise(F.lit("unplaced"))
    return marked.join(best, ord_col, "left").withColumn("section", F.when(
        F.col("section") != "candidate", F.col("section")).when(F.col("_focus"), F.lit("focus")).otherwise(tier)).drop("_focus")


def reason_groups(df: DataFrame) -> DataFrame:
    """Review rows per reason with their display order: size, then name, the unnamed reason last."""
    groups = df.groupBy(review_reason().alias("reason")).agg(F.count("*").alias("n"))
    order = F.struct((F.col("reason") == fixed.UNGROUPED_REASON).alias("unnamed"), (-F.col("n")).alias("size"), "reason")
    placed = ranked_within(groups.withColumn("_all", F.lit(0)), ["_all"], order, "place").drop("_all")
    return placed.withColumn("place", F.col("place").cast("int"))


def liveness_targets(df: DataFrame, cap: int = fixed.LIVENESS_CAP, ord_col: str = "ord") -> DataFrame:
    """The highest ranked linked rows worth checking. A top-k, not a full sort."""
    worth = (blank("link") != "") & F.coalesce(F.col("analysis.verdict") != "SKIP", F.lit(False))
    return df.filter(worth).orderBy(rank_key(ord_col)).limit(cap)


def work_items(items: DataFrame, top: int | None = None, min_fit: int | None = None, fit: str = "fit", order: Sequence[str] = ("ord",)) -> DataFrame:
    """Fit gate that keeps unscored rows, then an optional ceiling in document order."""
    kept = items if min_fit is None else items.filter(F.col(fit).isNull() | (F.col(fit) >= min_fit))
    return kept if top is None else kept.orderBy(*order).limit(top)
