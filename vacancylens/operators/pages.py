"""Fetched pages: usable text, block pages, liveness, browser queue, employer class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.functions.links import host
from vacancylens.functions.text import any_contains, blank, col, either, first_contained, squash, strip


def is_block_page(body: Column | str) -> Column:
    """A bot wall announces itself in the head of the page."""
    return any_contains(F.lower(F.substring(blank(body), 1, fixed.BLOCK_HEAD_CHARS)), fixed.BLOCK_MARKERS)


def with_jd_source(df: DataFrame, link: str = "link", text: str = "fetched_text", error: str = "error",
                   snippet: str = "email_jd_text") -> DataFrame:
    """Adds `fetched_jd`, `jd_source` and `fetch_error` from a landed fetch result."""
    has_link, body = blank(link) != "", strip(blank(text))
    failed, blocked = blank(error) != "", is_block_page(text)
    usable = has_link & ~failed & ~blocked & (F.length(body) >= fixed.MIN_TEXT_CHARS)
    source = (F.when(usable, F.lit("full"))
              .when(F.length(strip(blank(snippet))) >= fixed.MIN_TEXT_CHARS, F.lit("email_snippet"))
              .otherwise(F.lit("title_only")))
    problem = (F.when(usable | ~has_link, F.lit("")).when(failed, col(error))
               .when(blocked & (blank(text) != ""), F.lit(fixed.ERROR_BLOCKED)).otherwise(F.lit(fixed.ERROR_NO_TEXT)))
    return (df.withColumn("jd_source", source).withColumn("fetch_error", problem)
            .withColumn("fetched_jd", F.when(usable, body).otherwise(F.lit(""))))


def needs_manual_review(link: Column | str = "link", jd_source: Column | str = "jd_source") -> Column:
    return (blank(link) != "") & (blank(jd_source) != "full")


def needs_browser(link: Column | str = "link", jd_source: Column | str = "jd_source",
                  verdict: Column | str = "analysis.verdict") -> Column:
    """Judged, not skipped, linked, unread, and on a host a browser can read."""
    return (
        (blank(link) != "") & ~any_contains(blank(link), fixed.NOT_BROWSER_FETCHABLE) & (blank(jd_source) != "full")
        & F.coalesce(col(verdict) != "SKIP", F.lit(False))
    )


def liveness(link: Column | str, status: Column | str, body: Column | str, error: Column | str) -> Column:
    """STRUCT(state, detail): open, closed or unknown, with the evidence."""
    where, code = host(link), col(status)
    aggregator = F.lit(False)
    for name in fixed.AGGREGATOR_HOSTS:
        aggregator = aggregator | where.endswith(name)
    session = F.coalesce(*[F.when(where.endswith(name), F.lit(note)) for name, note in fixed.SESSION_HOSTS])
    marker = first_contained(F.lower(blank(body)), fixed.CLOSED_MARKERS)

    def result(state: str, detail: Column | str) -> Column:
        return F.struct(F.lit(state).alias("state"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))

    http = F.concat(F.lit("HTTP "), code.cast("string"))
    return (
        F.when(blank(link) == "", result("unknown", "no link"))
        .when(aggregator, result("unknown", fixed.AGGREGATOR_NOTE))
        .when(session.isNotNull(), result("unknown", session))
        .when(blank(error) != "", result("unknown", F.concat(F.lit("unreachable ("), col(error), F.lit(")"))))
        .when(code.isin(404, 410), result("closed", http))
        .when(code >= 400, result("unknown", http))
        .when(is_block_page(body), result("unknown", "bot-walled"))
        .when(marker.isNotNull(), result("closed", F.concat(F.lit('page says "'), marker, F.lit('"'))))
        .otherwise(result("open", ""))
    )


def agency_marker(text: Column | str) -> Column:
    return first_contained(F.lower(blank(text)), fixed.AGENCY_MARKERS)


def employer_class(companies: DataFrame, pages: DataFrame, boards: DataFrame, same_text: DataFrame) -> DataFrame:
    """agency / direct / undetermined per company, by the first evidence that speaks, with the reason.

    companies(company); pages(company, ord, url, text); boards(company, url, text); same_text(company, other, overlap).
    """
    def evidence(df: DataFrame, level: int, order: Column, verdict: Column | str, why: Column) -> DataFrame:
        return df.select("company", F.lit(level).alias("level"), order.cast("double").alias("nth"),
                         F.lit(verdict).alias("employer"), why.alias("why"))

    def says(df: DataFrame) -> DataFrame:
        return df.withColumn("marker", agency_marker("text")).filter(F.col("marker").isNotNull())

    quoted = F.concat(F.col("url"), F.lit(' says "'), F.col("marker"), F.lit('"'))
    named = companies.withColumn("marker", agency_marker("company")).filter(F.col("marker").isNotNull())
    rows = [
        evidence(named, 0, F.lit(0), "agency", F.concat(
            F.lit('the name itself reads as an agency ("'), F.col("marker"), F.lit('")'))),
        evidence(says(pages), 1, F.col("ord"), "agency", quoted),
        evidence(says(boards), 2, F.lit(0), "agency", quoted),
        evidence(same_text, 3, -F.col("overlap"), "agency", F.concat(
            F.lit("the same JD is in your corpus under "), F.col("other"), F.lit(" ("),
            F.floor(F.col("overlap") * 100).cast("string"),
            F.lit("% phrase overlap) — one req, more than one poster"))),
        evidence(pages, 4, F.col("ord"), "direct", F.concat(
            F.lit("nothing on "), F.col("url"),
            F.lit(" reads as agency language — probable direct employer, on one page's evidence"))),
        evidence(companies, 5, F.lit(0), "undetermined", F.lit("nothing was read that says who the employer actually is")),
    ]
    union = rows[0]
    for other in rows[1:]:
        union = union.unionByName(other)
    # min_by over (level, nth) combines on the map side; no company's evidence is collected in one place.
    best = union.groupBy("company").agg(F.min(F.struct("level", "nth", "employer", "why")).alias("best"))
    return best.select("company", "best.employer", "best.why")


def same_ad(teaser: Column | str, page: Column | str) -> Column:
    """Does the page carry the teaser's opening?"""
    head = F.substring(squash(teaser), 1, fixed.TEASER_CHARS)
    return (head != "") & squash(page).contains(head)


def company_openings(probes: DataFrame, boards: DataFrame, postings: DataFrame, pages: DataFrame,
                     top: int | None = None) -> DataFrame:
    """Who else hires: per probe the first board that answered, else a readable careers page, else nothing.

    probes(company, slug); boards(slug, platform, priority) lists the boards that answered; postings(slug,
    platform, title, location, url); pages(slug, url, text, path_order). An answered board may list nothing.
    """
    answered = boards.groupBy("slug").agg(F.min_by("platform", "priority").alias("platform"))
    readable = pages.filter(~is_block_page("text") & (F.length(strip(blank("text"))) >= 200))
    careers = readable.groupBy("slug").agg(F.min_by("url", "path_order").alias("page_url"))
    counts = postings.groupBy("slug", "platform").agg(F.count("*").alias("n"))
    out = probes.join(answered, "slug", "left").join(careers, "slug", "left").join(counts, ["slug", "platform"], "left")
    source = (F.when(F.col("platform").isNotNull(), F.col("platform"))
              .when(F.col("page_url").isNotNull(), F.lit("careers-page")).otherwise(F.lit("none")))
    return out.select("company", "slug", source.alias("source"), (source != "none").alias("ok"),
                      F.when(F.col("platform").isNotNull(), F.coalesce("n", F.lit(0))).cast("bigint").alias("openings"),
                      F.when(source == "careers-page", F.col("page_url")).alias("page_url"))
