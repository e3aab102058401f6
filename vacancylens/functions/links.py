"""Link columns: platform rewrites, canonical identity, hosts, board routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.functions.text import blank, col, filled, let, strip


def normalize_link(c: Column | str) -> Column:
    """Two platforms' tracking links to their resolvable form; every other link unchanged."""
    url = blank(c)
    linkedin = F.regexp_extract(url, fixed.LINKEDIN_VIEW, 1)
    indeed = F.regexp_extract(url, fixed.INDEED_VIEW, 1)
    return (
        F.when(linkedin != "", F.concat(F.lit("https://www.linkedin.com/jobs/view/"), linkedin))
        .when(indeed != "", F.concat(F.lit("https://www.indeed.com/viewjob?jk="), indeed))
        .otherwise(url)
    )


def _is_tracking(param: Column) -> Column:
    name = F.lower(strip(F.split_part(param, F.lit("="), F.lit(1))))
    test = name.isin(*fixed.TRACKING_PARAMS)
    for prefix in fixed.TRACKING_PREFIXES:
        test = test | name.startswith(prefix)
    return test


def _canonical_head(head: Column) -> Column:
    """Scheme and host in lower case, `www.` and trailing slashes gone."""
    parts = r"(?s)^(.*?)://([^/]*)(.*)$"
    host = F.regexp_replace(F.lower(F.regexp_extract(head, parts, 2)), r"^www\.", "")
    rebuilt = F.concat(F.lower(F.regexp_extract(head, parts, 1)), F.lit("://"), host, F.regexp_extract(head, parts, 3))
    return F.regexp_replace(F.when(head.contains("://"), rebuilt).otherwise(head), "/+$", "")


def link_identity(c: Column | str) -> Column:
    """One value per posting link: tracking, fragment, case, `www.` and parameter order do not matter."""

    def identity(url: Column) -> Column:
        head = _canonical_head(F.regexp_extract(url, r"(?s)^([^?]*)", 1))
        query = F.regexp_extract(url, r"(?s)^[^?]*\?(.*)$", 1)
        kept = F.array_join(
            F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~_is_tracking(p))), "&"
        )
        tail = let(kept, lambda k: F.when(k != "", F.concat(F.lit("?"), k)).otherwise(F.lit("")))
        return F.when(url == "", F.lit("")).otherwise(F.concat(head, tail))

    return let(F.split_part(normalize_link(strip(blank(c))), F.lit("#"), F.lit(1)), identity)


def legacy_link_key(c: Column | str) -> Column:
    """The link with its whole query dropped; kept only as an option, it merges distinct postings."""
    return F.regexp_replace(F.split_part(blank(c), F.lit("?"), F.lit(1)), "/+$", "")


def url_key(c: Column | str) -> Column:
    """Block key of a link: `url:` plus the normalised link, null where there is no link."""
    return F.when(blank(c) != "", F.concat(F.lit("url:"), normalize_link(c)))


def host(c: Column | str) -> Column:
    """Host in lower case without `www.`, '' where the value is no URL."""
    found = F.lower(F.regexp_extract(blank(c), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(found, r"^www\.", "")


def company_domain(c: Column | str) -> Column:
    """The posting company's own host; '' for aggregators and for values that are no URL."""
    url = blank(c)
    netloc = F.lower(F.regexp_extract(url, r"^https?://([^/?#]*)", 1))
    foreign = F.lit(False)
    for domain in fixed.NOT_COMPANY_DOMAINS:
        foreign = foreign | netloc.contains(domain)
    return F.when(foreign, F.lit("")).otherwise(netloc)


def name_from_domain(c: Column | str) -> Column:
    """Second-level label of a host, ignoring `www` labels."""
    labels = F.filter(F.split(blank(c), r"\."), lambda x: x != "www")
    return F.when(F.size(labels) >= 2, F.try_element_at(labels, F.lit(-2))).otherwise(
        F.coalesce(F.try_element_at(labels, F.lit(1)), F.lit(""))
    )


def board_route(c: Column | str) -> Column:
    """STRUCT(platform, board) of a job-board link, null where no board is recognised."""
    url = blank(c)
    options = []
    for platform, pattern in fixed.ATS_BOARD_PATTERNS:
        board = F.regexp_extract(url, pattern, 1)
        options.append(
            F.when((board != "") & ~board.isin("v1", "embed"),
                   F.struct(F.lit(platform).alias("platform"), board.alias("board")))
        )
    return F.coalesce(*options)


def fetch_route(c: Column | str) -> Column:
    """Which reader a link's host belongs to."""
    netloc = F.lower(F.regexp_extract(blank(c), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return (
        F.when(netloc.contains("greenhouse.io"), F.lit("greenhouse"))
        .when(netloc.contains("lever.co"), F.lit("lever"))
        .when(netloc.contains("ashbyhq.com"), F.lit("ashby"))
        .when(netloc.contains("linkedin.com"), F.lit("linkedin"))
        .otherwise(F.lit("generic"))
    )


def posting_number(c: Column | str) -> Column:
    """The platform's own posting id inside a link, '' where it has none."""
    url = blank(c)
    by_route = {
        "greenhouse": F.coalesce(filled(F.regexp_extract(url, r"greenhouse\.io/.*?/jobs/(\d+)", 1)),
                                 filled(F.regexp_extract(url, r"[?&]gh_jid=([^&#]+)", 1))),
        "lever": filled(F.regexp_extract(url, r"lever\.co/[^/?#]+/([0-9a-f-]{16,})", 1)),
        "ashby": filled(F.regexp_extract(url, r"ashbyhq\.com/[^/?#]+/([0-9a-f-]{16,})", 1)),
        "linkedin": F.coalesce(filled(F.regexp_extract(url, r"[?&]currentJobId=([^&#]+)", 1)),
                               filled(F.regexp_extract(url, r"(?:jobs/view/|-)(\d{8,})", 1))),
    }
    route = fetch_route(url)
    return F.coalesce(*[F.when(route == name, value) for name, value in by_route.items()], F.lit(""))


def board_listing_url(platform: Column | str, board: Column | str) -> Column:
    """Public listing address of a board."""
    out = None
    for name, (prefix, suffix) in fixed.BOARD_URLS.items():
        url = F.concat(F.lit(prefix), col(board), F.lit(suffix))
        out = F.when(col(platform) == name, url) if out is None else out.when(col(platform) == name, url)
    return out
