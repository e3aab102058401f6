"""Column functions on literals."""

import hashlib
import html
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from vacancylens.functions import dates, identity, links, rates, text, vectors


def evaluate(spark, column, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r["v"] for r in df.select(column.alias("v")).collect()]


RATES = [
    ("$85.00 – $90.00 per hour", "$85-90/hr"), ("$120,000 - $150,000 per year", "$58-72/hr"), ("$150k", "$72/hr"),
    ("Compensation Range: $195K - $275K", "$94-132/hr"), ("$70 - 100/hr", "$70-100/hr"),
    ("We have raised over $35M from a16z", None), ("Reference ID $1234567", None), ("$8/hr", None), ("", None), (None, None),
    ("no money", None), ("$62.5 an hour", "$62/hr"), ("$63.5/hr", "$64/hr"), ("up to $130,000", "$62/hr"), ("$90 - $20 per hour, $150,000", "$20/hr"),
    ("$50 to $60", "$50-60/hr"), ("pay $100,000 – 140,000", "$48-67/hr"),
]


def test_extract_rate(spark):
    got = evaluate(spark, rates.extract_rate("t"), [(a,) for a, _ in RATES], "t string")
    assert got == [b for _, b in RATES]


def test_rate_midpoint(spark):
    got = evaluate(spark, rates.rate_midpoint("t"), [("$85-90/hr",), ("$72/hr",), ("x $72/hr",), (None,)], "t string")
    assert got == [87.5, 72.0, None, None]


LINKS = [
    ("HTTPS://WWW.Foo.com/a/b/?utm_source=x&b=2&a=1#frag", "https://foo.com/a/b?a=1&b=2"),
    ("https://www.linkedin.com/comm/jobs/view/senior-dev-at-x-12345678?trk=a", "https://linkedin.com/jobs/view/12345678"),
    ("https://indeed.com/rc/clk?x=1&jk=0a1b2c", "https://indeed.com/viewjob?jk=0a1b2c"), ("", ""), (None, ""),
    ("https://boards.greenhouse.io/acme/jobs/1?gh_jid=7&gh_src=z", "https://boards.greenhouse.io/acme/jobs/1?gh_jid=7"),
    ("  https://x.com/A/?b=1&a=2&_hsenc=3&mc_cid=4 ", "https://x.com/A?a=2&b=1"), ("foo/", "foo"),
]


def test_link_identity(spark):
    assert evaluate(spark, links.link_identity("u"), [(a,) for a, _ in LINKS], "u string") == [b for _, b in LINKS]


def test_one_posting_has_one_identity(spark):
    variants = ["https://www.acme.com/jobs/1", "http" + "s://acme.com/jobs/1/", "https://ACME.com/jobs/1?utm_medium=mail", "https://acme.com/jobs/1#apply",
                "HTTPS://acme.com/jobs/1?ref=x&src=y", "https://acme.com/jobs/1?trk=1", " https://acme.com/jobs/1 ", "https://acme.com/jobs/1/?source=feed"]
    assert set(evaluate(spark, links.link_identity("u"), [(v,) for v in variants], "u string")) == {"https://acme.com/jobs/1"}


@pytest.mark.parametrize("company,title,link,expected", [
    ("Genesis10", "Senior Full Stack Developer - Remote", "", "genesis10|senior full stack developer remote|"),
    ("Hashorn", "Senior Backend Engineer (Node.js / TypeScript)", "", "hashorn|senior backend engineer node js typescript|"),
    ("", "", "https://www.x.com/a/?utm_x=1", "https://x.com/a"), ("", "", "", "||"), ("Acme, Inc.", "Dev", "", "acme|dev|"), ("Acme L.L.C.", "Dev", "", "acme l l c|dev|"),
])
def test_job_id(one, company, title, link, expected):
    assert one(identity.job_id("c", "t", "l"), c=company, t=title, l=link) == expected


def test_city_keeps_its_region_unless_split(one):
    assert one(identity.composite_id("c", "t", "m"), c="A", t="B", m="Dallas, TX") == "a|b|dallas tx"
    assert one(identity.composite_id("c", "t", "m", split_city=True), c="A", t="B", m="Dallas, TX") == "a|b|dallas"


@pytest.mark.parametrize("a,b,same", [("Acme Inc", "ACME", True), ("Genesis10", "Genesis10 Staffing LLC", True), ("Acme", "Acmeology", False), ("", "", False), ("Beta Corp", "Alpha", False)])
def test_same_company(one, a, b, same):
    assert one(identity.same_company(identity.company_key("a"), identity.company_key("b")), a=a, b=b) is same


def test_slugs(one):
    assert one(identity.board_slugs("c"), c="Acme Widget Labs, Inc") == ["acmewidget", "acme-widget"]
    assert one(identity.board_slugs("c"), c="Acme") == ["acme"]
    assert one(identity.pretty_token("c"), c="acme-widget_co") == "Acme Widget Co"
    assert one(identity.cache_key("c"), c="https://jobs.acme.com/x") == "acme"
    assert one(identity.cache_key("c"), c="https://www.linkedin.com/company/acme") == "www-linkedin-com-company-acme"
    assert one(identity.cache_key("c"), c="Acme, Inc.") == "acme"
    assert one(identity.folder_slug("c"), c="!!") == "unknown"


def test_text_helpers(one):
    assert one(text.norm_text("t"), t="Crème  Brûlée\n#1!") == "cr me br l e 1"
    assert one(text.fingerprint("t"), t="  a \n b ") == hashlib.sha256(b"a b").hexdigest()[:12]
    assert one(text.fingerprint("t"), t=" \n ") == ""
    assert one(text.strip_tags("t"), t="<p>Fish &amp; chips</p>") == "Fish & chips"
    for t in ("caf&eacute; &#233; &#xE9; &rsquo; &hellip;", "&copy2024 &notit; &none; a&b &", "&#146; &#0; &#55296; &#1114112; &#99999999999; &#x1F600; &#11;x",
              "&amp;eacute; &amp;lt; &lt;", "&eacute", "&#;&#x;&#xg &acE; &NotEqualTilde;", ""):
        assert one(text.unescape("t"), t=t) == html.unescape(t), t
    assert one(text.html_to_text("t"), t="<style>x</style><p>a</p>\n\n\n<script>b</script><p> c </p>") == "a\n\nc"
    assert one(text.thousands(F.lit(1234567.5))) == "1,234,568"


def brute_shingles(t, n):
    w = re.findall("[a-z0-9]+", t.lower())
    return {" ".join(w[i:i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize("t", ["", "a b c d", "a b c d e", "The cat, the cat, the cat; the cat the cat", "één twee 3 vier vijf zes"])
def test_shingles(one, t):
    got = one(text.word_shingles(text.words("t")), t=t)
    assert set(got) == brute_shingles(t, 5) and len(got) == len(set(got))


@pytest.mark.parametrize("t", ["short", "vibe-coding", "remotevibecodingjobs", ""])
def test_char_ngrams(one, t):
    s = re.sub("[^a-z0-9]+", "", t.lower())
    want = set() if len(s) < 10 else {s[i:i + 4] for i in range(len(s) - 3)}
    assert set(one(text.char_ngrams("t"), t=t)) == want


@pytest.mark.parametrize("t", ["node js react", "", "React react REACT typescript"])
def test_hash_embed(one, t):
    v = [0.0] * 64
    for w in re.findall("[a-z0-9]+", t.lower()):
        v[zlib.crc32(w.encode()) % 64] += 1
    length = math.sqrt(sum(x * x for x in v)) or 1.0
    assert one(vectors.hash_embed("t"), t=t) == pytest.approx([x / length for x in v])


def test_dates(one):
    assert str(one(dates.iso_timestamp("t"), t="2024-01-02T03:04:05Z")) == "2024-01-02 03:04:05"
    assert str(one(dates.iso_timestamp("t"), t="2024-01-02T03:04:05+02:00")) == "2024-01-02 01:04:05"
    assert one(dates.iso_timestamp("t"), t="soon") is None
    assert str(one(dates.epoch_millis(F.lit(1704067200123)))).startswith("2024-01-01 00:00:00.123")
    assert str(one(dates.day_prefix("t"), t=" 2024-02-30x")) == "None"
    assert one(dates.inclusive_days("a", "b"), a="2024-01-01", b="2024-03-01") == 61
    assert one(dates.inclusive_days("a", "b"), a="bad", b="2024-03-01") == 0


def test_routes(one):
    assert one(links.board_route("u"), u="https://boards.greenhouse.io/embed/job_app?for=acme")["board"] == "acme"
    assert one(links.board_route("u"), u="https://api.lever.co/v1") is None
    assert one(links.posting_number("u"), u="https://www.linkedin.com/jobs/search?currentJobId=42") == "42"
    assert one(links.company_domain("u"), u="https://careers.acme.com/x") == "careers.acme.com"
    assert one(links.company_domain("u"), u="https://boards.greenhouse.io/x") == ""
    assert one(links.name_from_domain("u"), u="www.acme.co") == "acme"
