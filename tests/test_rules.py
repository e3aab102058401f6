"""Screening, mail and page rules on literals."""

import pytest

from vacancylens.operators import mail, pages, ranking, rules


@pytest.mark.parametrize("text,years", [
    ("5+ years of professional experience", 5), ("Experience 5-10+ Years", 5), ("12 years of experience is required", 12), ("operating for 10 years", 0),
    ("10 years. experience", 0), ("15 years experience or 3 years of hands-on experience", 3), ("45 years experience", 0), ("", 0),
])
def test_entry_years(one, text, years):
    assert one(rules.entry_years("t"), t=text) == years


@pytest.mark.parametrize("text,share", [("50% travel", 50), ("travel up to 25%", 25), ("100% travel", 0), ("10% travel and travel 75 %", 75), ("", 0)])
def test_max_travel(one, text, share):
    assert one(rules.max_travel("t"), t=text) == share


@pytest.mark.parametrize("title,off,strict", [
    ("Java Developer", True, True), ("Senior JavaScript Developer", False, False), ("ASP.NET Developer", True, False), (".NET Developer", False, True),
    ("C# Engineer", False, True), ("iOS Engineer", True, True), ("React Developer", False, False),
])
def test_off_lane(one, title, off, strict):
    assert one(rules.off_lane_title("t"), t=title) is off
    if title != "ASP.NET Developer":
        assert one(rules.off_lane_title("t", catch_symbols=True), t=title) is strict


def test_clearance(one):
    assert one(rules.needs_clearance("t"), t="Must have an active clearance") is True
    assert one(rules.needs_clearance("t"), t="TS/SCI, or obtain one within a year") is False


def test_gate_order(one):
    both = "12 years experience and 80% travel"
    assert one(rules.skip_reason("t", "j"), t="PHP dev", j=both).startswith("prefilter: off-lane")
    assert one(rules.skip_reason("t", "j"), t="React dev", j=both) == "prefilter: stated 12+ year entry bar (>= 10)"
    assert one(rules.skip_reason("t", "j"), t="React dev", j="80% travel") == "prefilter: 80% travel required (>= 50%)"
    assert one(rules.skip_reason("t", "j"), t="React dev", j="") is None


@pytest.mark.parametrize("sender,reply,human", [
    ("Jane <jane@corp.com>", False, True), ("alerts@dice.com", False, False), ("x@user.dice.com", False, True), ("no-reply@x.com", True, True),
    ("News <newsletter@x.com>", False, False), ("", False, True),
])
def test_correspondence(spark, sender, reply, human):
    df = spark.createDataFrame([(sender, reply)], "s string, r boolean")
    assert df.select(mail.is_correspondence("s", "r").alias("v")).first()["v"] is human


@pytest.mark.parametrize("sender,named", [
    ("Jane Doe <j@x.com>", True), ("Doe, Jane Q. <j@x.com>", True), ("Acme Jobs <a@x.com>", False), ("jane@x.com", False), ("Jane <j@x.com>", False),
    ('"Mary-Ann O\'Neil" <m@x.com>', True), ("A B C D <x@x.com>", False),
])
def test_human_name(one, sender, named):
    assert one(mail.has_human_name("s"), s=sender) is named


def test_links_in_text(spark):
    body = ("see https://boards.greenhouse.io/a/jobs/1?gh_src=x, https://boards.greenhouse.io/a/jobs/1 and https://x.com/logo.png "
            "https://x.com/unsubscribe https://other.example/page. https://www.linkedin.com/jobs/view/12345678?trk=1")
    df = spark.createDataFrame([(1, body)], "doc int, body string")
    got = {(r["bucket"], r["identity"]) for r in mail.classify_links(df, "doc", "body").collect()}
    assert got == {("job", "https://boards.greenhouse.io/a/jobs/1"), ("unclassified", "https://other.example/page"), ("job", "https://linkedin.com/jobs/view/12345678")}


@pytest.mark.parametrize("link,status,body,error,state", [
    ("", 200, "x", "", "unknown"), ("https://www.linkedin.com/jobs/view/1", 200, "x", "", "unknown"), ("https://x.com", 404, "", "", "closed"), ("https://x.com", 503, "", "", "unknown"),
    ("https://x.com", 200, "Just a moment...", "", "unknown"), ("https://x.com", 200, "This position has been FILLED", "", "closed"), ("https://x.com", 200, "apply now", "", "open"),
    ("https://x.com", 200, "", "Timeout", "unknown"), ("https://jobs.jobright.ai/x", 404, "", "", "unknown"),
])
def test_liveness(spark, link, status, body, error, state):
    df = spark.createDataFrame([(link, status, body, error)], "l string, s int, b string, e string")
    assert df.select(pages.liveness("l", "s", "b", "e").alias("v")).first()["v"]["state"] == state


def test_sections_conserve_rows(spark, sf):
    from vacancylens.catalog.ranking import tiered
    from vacancylens.plans.worklist import SECTIONS, worklist

    rows = tiered(spark, sf)
    out = worklist(rows).collect()
    assert len(out) == rows.count() and len({r["ord"] for r in out}) == len(out)
    assert {r["section"] for r in out} <= set(SECTIONS)
    focus = {}
    for r in out:
        if r["section"] == "focus":
            focus.setdefault(r["run"], []).append(r["position"])
    assert all(sorted(p) == list(range(1, len(p) + 1)) and len(p) <= 5 for p in focus.values())


def test_rank_order(spark):
    df = spark.createDataFrame(
        [(1, "OPPORTUNISTIC", "FIT", 2, 90, "full"), (2, "PRIMARY", "LOW_FIT", 5, 10, ""), (3, "PRIMARY", "FIT", 3, 50, "full"), (4, "PRIMARY", "FIT", 3, 60, ""), (5, "PRIMARY", "FIT", 1, 0, "")],
        "ord int, final_tier string, v string, i int, f int, jd_source string").selectExpr("ord", "final_tier", "jd_source", "struct(v as verdict, i as intensity, f as fit_score) as analysis")
    assert [r["ord"] for r in df.orderBy(ranking.rank_key()).collect()] == [5, 4, 3, 2, 1]


def test_developer_terms(spark):
    from vacancylens.operators.windows import is_developer_role

    rows = [("apex", "/job/senior-React-dev", True), ("apex", "/job/nurse", False), ("kore1", "ML Engineer", True), ("mondo", "x-node-y", True), ("mondo", "node-y", False)]
    df = spark.createDataFrame(rows, "source string, slug string, want boolean")
    assert all(r["got"] is r["want"] for r in df.withColumn("got", is_developer_role("slug", "source")).collect())
