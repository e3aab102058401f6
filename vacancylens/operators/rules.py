"""Screening rules: years bar, clearance, travel, off-lane titles, the ordered gate, stub judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.functions.text import UNICODE_NOCASE, blank, col, either, strip
from vacancylens.models import ANALYSIS


def _all_numbers(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(UNICODE_NOCASE + pattern), F.lit(group))
    return F.transform(found, lambda x: x.try_cast("int"))


def entry_years(text: Column | str) -> Column:
    """Lowest stated experience requirement between 1 and 30 years, 0 where none is stated."""
    t = blank(text)
    stated = F.concat(_all_numbers(t, fixed.YEARS_AFTER, 1), _all_numbers(t, fixed.YEARS_BEFORE, 1))
    return F.coalesce(F.array_min(F.filter(stated, lambda n: n.between(1, 30))), F.lit(0))


def max_travel(text: Column | str) -> Column:
    """Highest stated travel percentage; only two-digit figures count, so 100 % reads as 00 and is ignored."""
    t = blank(text)
    stated = F.concat(_all_numbers(t, fixed.TRAVEL, 1), _all_numbers(t, fixed.TRAVEL, 2))
    return F.coalesce(F.array_max(F.filter(stated, lambda n: n.between(1, 100))), F.lit(0))


def needs_clearance(text: Column | str) -> Column:
    t = blank(text)
    return t.rlike(UNICODE_NOCASE + fixed.CLEARANCE) & ~t.rlike(UNICODE_NOCASE + fixed.CLEARANCE_OBTAINABLE)


def off_lane_title(title: Column | str, catch_symbols: bool = False) -> Column:
    """Does the title name another stack? By default `.NET` and `C#` slip through at word edges, as the
    word-bounded list has it; `catch_symbols` closes that gap."""
    kept = F.regexp_replace(blank(title), UNICODE_NOCASE + fixed.IN_LANE_RESCUE, " ")
    pattern = fixed.OFF_LANE_TITLE_FIXED if catch_symbols else fixed.OFF_LANE_TITLE
    return kept.rlike(UNICODE_NOCASE + pattern)


def skip_reason(title: Column | str, text: Column | str) -> Column:
    """First rule that fires, as a reason; null keeps the row. Text rules wait until the title rule passed."""
    t, years, travel = blank(text), entry_years(text), max_travel(text)
    bar, travel_bar = str(fixed.YEARS_BAR), str(fixed.TRAVEL_BAR)
    has_text = t != ""
    return (
        F.when(off_lane_title(title), F.concat(
            F.lit("prefilter: off-lane primary stack in title ("), F.substring(blank(title), 1, 60), F.lit(")")))
        .when(has_text & (years >= fixed.YEARS_BAR), F.concat(
            F.lit("prefilter: stated "), years.cast("string"), F.lit(f"+ year entry bar (>= {bar})")))
        .when(has_text & needs_clearance(t), F.lit("prefilter: requires an active security clearance"))
        .when(has_text & (travel >= fixed.TRAVEL_BAR), F.concat(
            F.lit("prefilter: "), travel.cast("string"), F.lit(f"% travel required (>= {travel_bar}%)")))
    )


def too_short_to_screen(text: Column | str, chars: int | None = None) -> Column:
    """Rows the second-stage screen keeps without asking. `chars` is the length of text that the screen is shown, if cut."""
    shown = blank(text) if chars is None else F.substring(blank(text), 1, chars)
    return F.length(strip(shown)) < fixed.SCREEN_MIN_CHARS


def stub_judgment(reason: Column | str) -> Column:
    """Judgment standing in for a row a rule screened out."""
    r = col(reason)
    values = {
        "tier": F.lit("OPPORTUNISTIC"), "fit_score": F.lit(0), "intensity": F.lit(3), "verdict": F.lit("SKIP"),
        "why": r, "meets_goals": F.lit(fixed.STUB_GOALS), "red_flags": F.array(r), "resume_keywords": F.array(),
        "is_agency": F.lit(False),
    }
    fields = [values.get(f.name, F.lit("")).cast(f.dataType).alias(f.name) for f in ANALYSIS.fields]
    return F.when(r.isNotNull(), F.struct(*fields))


def screen(df: DataFrame, title: str = "title", text: str = "jd_text") -> DataFrame:
    """Adds `skip_reason`, sets `prefiltered` and the stub judgment where a rule fires."""
    out = df.withColumn("skip_reason", skip_reason(title, text))
    hit = F.col("skip_reason").isNotNull()
    judged = F.coalesce(stub_judgment("skip_reason"), F.col("analysis"))
    return out.withColumn("prefiltered", hit | F.coalesce(F.col("prefiltered"), F.lit(False))).withColumn("analysis", judged)


def split_by_screen(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped). Two frames, so that no expensive scorer runs on a skipped row."""
    return df.filter(F.col("skip_reason").isNull()), df.filter(F.col("skip_reason").isNotNull())


def scorer_input(df: DataFrame, precedents: str | None = None, chars: int | None = None) -> Column:
    """Labelled fields of a posting as one text for a scorer; `chars` cuts the posting's text for a scorer with a limit."""
    def shown(name: str, missing: str) -> Column:
        return either(name, F.lit(missing))

    body = either("jd_text" if chars is None else F.substring(blank("jd_text"), 1, chars), F.lit(fixed.SCORER_NO_TEXT))
    head = F.concat(
        F.lit("TITLE: "), shown("title", "unknown"), F.lit("\nCOMPANY: "), shown("company", "unknown"),
        F.lit("\nSOURCE: "), shown("source_platform", "unknown"), F.lit("\nPOSTED: "), shown("posted_hint", "unknown"),
        F.lit("\nLINK: "), shown("link", "(none — inline recruiter email)"), F.lit("\nJD_SOURCE: "), blank("jd_source"),
        F.lit("\n\nJOB DESCRIPTION:\n"), body)
    if precedents is None:
        return head
    return F.concat(F.when(blank(precedents) != "", F.concat(col(precedents), F.lit("\n\n"))).otherwise(F.lit("")), head)


def precedent_block(df: DataFrame, by: str, rank: str = "rank", rationale_chars: int | None = None) -> DataFrame:
    """One text per query row from its ranked neighbours; the neighbour lists are k rows long by construction.

    `rationale_chars` cuts each neighbour's rationale where the reader has a limit.
    """
    rationale = strip(blank("rationale"))
    rationale = rationale if rationale_chars is None else F.substring(rationale, 1, rationale_chars)
    traits = F.concat_ws(
        " · ", F.when(F.col("is_agency"), F.lit("agency")), F.nullif("employment_type", F.lit("")),
        F.nullif("cadence", F.lit("")), F.nullif("rate", F.lit("")))
    line = F.concat(
        F.col(rank).cast("string"), F.lit(". "), either("title", F.lit("(untitled)")), F.lit(" @ "),
        either("company", F.lit("(unknown)")), F.lit(" — "), either("verdict", F.lit("unknown")), F.lit(" "),
        F.coalesce(F.col("fit_score"), F.lit(0)).cast("string"), F.lit("/100 · "), either("tier", F.lit("unknown")),
        F.when(traits != "", F.concat(F.lit(" · "), traits)).otherwise(F.lit("")),
        F.when(rationale != "", F.concat(F.lit("\n   why: "), rationale)).otherwise(F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), line.alias("line"))))
    return df.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: x.line), "\n").alias("precedents"))
