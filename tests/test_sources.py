"""Landed payloads: tolerant reads, fault isolation, wire shapes."""

import json

import pytest
from pyspark.sql import functions as F

from vacancylens.sources import boards, email_messages, feeds, jsonld, registry, states, text_lists


def test_state_files(spark, tmp_path):
    good = {"days": 3, "jobs": [
        {"link": "https://x/1", "company": "Acme", "title": 5, "analysis": {"verdict": "FIT", "fit_score": "high", "red_flags": ["a", 3, "b"], "is_agency": True}},
        None, "junk", {"company": "Beta", "analysis": "none", "duplicates": [{"id": "d|", "similarity": 0.99}]}, {}]}
    (tmp_path / "state-2024-01-01-090000.json").write_text(json.dumps(good))
    (tmp_path / "state-2024-01-02-090000.json").write_text(json.dumps(good)[:-9])
    (tmp_path / "state-2024-01-03-090000.json").write_text('{"jobs": null}')
    files = states.read_files(spark, f"{tmp_path}/state-*.json")
    rows = states.scan_states(files).orderBy("run", "nth").collect()
    assert [(r["run"], r["nth"], r["company"], r["title"]) for r in rows] == [
        ("2024-01-01-090000", 0, "Acme", ""), ("2024-01-01-090000", 3, "Beta", ""), ("2024-01-01-090000", 4, "", "")]
    assert rows[0]["analysis"]["fit_score"] == 0 and rows[0]["analysis"]["red_flags"] == ["a", "b"] and rows[0]["analysis"]["is_agency"]
    assert rows[1]["analysis"] is None and rows[1]["duplicates"][0]["similarity"] == 0.99
    status = {r["name"]: r["state"] for r in states.scan_status(files).collect()}
    assert status == {"state-2024-01-01-090000.json": "read", "state-2024-01-02-090000.json": "unreadable", "state-2024-01-03-090000.json": "read"}
    assert [r["state"] for r in states.scan_status(files.filter("false")).collect()] == ["absent"]


def test_snapshot_files(spark):
    bodies = [{"version": 1, "as_of": "2024-01-02", "metrics": {"a": 1, "b": "x", "c": 2.5}}, {"version": 2, "as_of": "2024-01-03"}, {"version": 1, "as_of": ""}, {"version": 1}]
    df = spark.createDataFrame([("p", json.dumps(b)) for b in bodies] + [("p", "{half")], "path string, value string")
    rows = states.scan_snapshots(df).collect()
    assert [(r["as_of"], r["metrics"]) for r in rows] == [("2024-01-02", {"a": 1.0, "c": 2.5})]


def test_greenhouse_and_lever(spark):
    green = {"jobs": [
        {"absolute_url": "https://boards.greenhouse.io/a/jobs/1", "title": " Dev ", "location": {"name": "NYC"}, "first_published": "2024-03-01T00:00:00-05:00",
         "pay_input_ranges": [{"min_cents": 12000000, "max_cents": 15000000, "currency_type": "USD", "title": "Base:"}, {"title": "none"}],
         "content": "&lt;p&gt;We build &amp;amp; ship things.&lt;/p&gt;" + "x" * 150}, {"absolute_url": "https://b/2", "title": "Old", "updated_at": "2020-01-01"}, {"absolute_url": "https://b/3", "title": "Undated"}]}
    df = spark.createDataFrame([("acme-labs", json.dumps(green))], "token string, body string")
    rows = {r["title"]: r for r in boards.greenhouse(df, since=F.lit("2024-01-01").cast("timestamp")).collect()}
    assert set(rows) == {"Dev", "Undated"}
    assert rows["Dev"]["fetched_jd"].startswith("Dev — Acme Labs\nLocation: NYC\nCompensation (employer-stated): Base: 120,000–150,000 USD\nPosted: 2024-03-01\n\nWe build & ship things.")
    assert rows["Dev"]["jd_source"] == "full" and rows["Undated"]["jd_source"] == "title_only"
    lever = [{"applyUrl": "https://jobs.lever.co/a/1/apply", "text": "Dev", "categories": {"location": "LA"}, "createdAt": 1704067200000, "workplaceType": "remote",
              "salaryRange": {"min": 50, "max": 60.5, "currency": "USD", "interval": "per-hour-wage"}, "descriptionPlain": "Plain", "lists": [{"text": "Needs", "content": "<li>one</li>"}]}]
    row = boards.lever(spark.createDataFrame([("acme_co", json.dumps(lever))], "token string, body string")).first()
    assert row["jd_source"] == "full" and row["fetched_jd"] == "Dev — Acme Co\nLocation: LA · remote\nCompensation (employer-stated): Pay range: 50–60 USD per hour\nPosted: 2024-01-01\n\nPlain\n\nNeeds\none"


def test_cap_keeps_the_newest(spark):
    jobs = [{"absolute_url": f"u{i}", "title": f"t{i}", "updated_at": f"2024-01-{i:02d}" if i else None} for i in range(6)]
    df = spark.createDataFrame([("t", json.dumps({"jobs": jobs}))], "token string, body string")
    assert {r["title"] for r in boards.greenhouse(df, cap=2).collect()} == {"t5", "t4"}


@pytest.mark.parametrize("block,n", [
    ('{"@type":"JobPosting"}', 1), ('[{"@type":["Thing","JobPosting"]},{"@type":"Organization"}]', 1), ('{"@graph":[{"@type":"JobPosting"},{"@type":"JobPosting"}]}', 2),
    ('{"@type":"JobPosting"} ; junk', 1), ("not json", 0), ('{"@type":"NotJobPosting"}', 0), ('{"@type":"JobPosting","@graph":[{"@type":"JobPosting"}]}', 2),
])
def test_job_postings_in_pages(spark, block, n):
    df = spark.createDataFrame([(1, f"<script type='application/ld+json' >\n{block}\n</script>")], "page_id int, html string")
    assert jsonld.job_postings(df).count() == n


def test_embedded_objects(spark):
    html = 'a display:none;">{"JobID": 7, "Title": "T", "PayRateStraight": 55.5} x display:none;">{bad display:none;">{"JobID": 7, "Title": "again"} display:none;">{"Other": 1}'
    rows = jsonld.embedded_postings(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()
    assert [(r["JobID"], r["title"]) for r in rows] == [(7, "T")] and "Posted rate: $55.5/hr." in rows[0]["fetched_jd"]


def test_adzuna_withholds_predicted_pay(spark):
    def row(**kw):
        return json.dumps({"id": "1", "title": "Dev", "redirect_url": "https://a/1", "description": "teaser text", "salary_min": 100000, **kw})

    df = spark.createDataFrame([(1, "contract", row()), (2, "permanent", row()), (3, "contract", row(redirect_url="https://a/2", salary_is_predicted="0"))], "ord long, label string, body string")
    pages = spark.createDataFrame([("1", "nav TEASER, text! and the whole ad")], "id string, page_text string")
    rows = feeds.adzuna(df, pages).orderBy("ord").collect()
    assert [r["ord"] for r in rows] == [1, 3]
    assert "PREDICTED" in rows[0]["fetched_jd"] and rows[0]["fetched_jd"].endswith("whole ad") and rows[0]["jd_source"] == "full"
    assert "$100000-0/yr (posted)" in rows[1]["fetched_jd"] and "Employment type: contract." in rows[1]["fetched_jd"]
    assert feeds.adzuna(df).filter("jd_source <> 'title_only'").count() == 0


def test_raw_mail(spark):
    raw = "Message-ID: <1@x>\nFrom: A <a@x>\nSubject: S\nReferences: <0@x>\nContent-Type: multipart/alternative; boundary=b\n\n--b\nContent-Type: text/html\n\n<p>Hi <a href='https://x/1'>there</a></p>\n--b--\n"
    row = email_messages.parse_messages(spark.createDataFrame([(raw,)], "raw string")).first()
    assert row["content"] == "Hi\nthere" and row["is_reply"] and "https://x/1" in row["linked_text"]


def test_text_lists(spark):
    text = "<!-- one\na|b|\n-->\nacme|dev|dallas  # no fit\nplain\n<!-- x --> \nbeta|lead|#\n"
    df = spark.createDataFrame([(text,)], "value string")
    rows = text_lists.skiplist_rows(df).collect()
    assert {(r["job_id"], r["company"], r["title"], r["reason"]) for r in rows} == {("acme|dev|dallas", "acme", "dev", "no fit"), ("beta|lead|", "beta", "lead", "")}
    assert {r["key"] for r in text_lists.skiplist_keys(df).collect()} == {"a|b|", "acme|dev|dallas", "beta|lead|"}
    urls = spark.createDataFrame([(1, "https://x/1 # c"), (2, " <https://x/1>"), (3, "ftp://x"), (4, "https://x/2"), (5, "")], "ord int, value string")
    assert [r["url"] for r in text_lists.url_list(urls).orderBy("ord").collect()] == ["https://x/1", "https://x/2"]
    assert [r["url"] for r in text_lists.url_list(urls, cap=1).collect()] == ["https://x/1"]


def test_registry(spark):
    def rows(**kw):
        return spark.createDataFrame([("l", "c", "t", "s", "", "jd", "", "full")], ", ".join(f"{c} string" for c in registry.SOURCE_FIELDS))

    def broken():
        raise OSError("down")

    out, status = registry.union_sources({"a": rows, "b": broken, "c": rows}, registry.selection(["a", "B"], ["a", "b", "c"]))
    assert [(s.name, s.state) for s in status] == [("a", "ok"), ("b", "crashed"), ("c", "disabled")] and out.count() == 1
    for names in ([], ["nope"]):
        with pytest.raises(registry.UnknownSource):
            registry.selection(names, ["a"])


@pytest.mark.parametrize("read,body", [
    (boards.greenhouse, '{"jobs":[{"absolute_url":"https://x/1","title":"Dev","content":"&lt;p&gt;' + "a b " * 60 + '&lt;/p&gt;"}]}'),
    (boards.lever, '[{"hostedUrl":"https://x/1","text":"Dev","description":"<p>' + "a b " * 60 + '</p>"}]')])
def test_board_bodies_are_worked_out_once(spark, read, body):
    rows = read(spark.createDataFrame([("acme", body), ("none", None)], "token string, body string").repartition(2))
    kinds = 1 if read is boards.greenhouse else 2  # a lever job has a description and lists
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("(script|style)") == kinds
    got = rows.collect()
    assert [(r["token"], r["jd_source"], r["email_jd_text"]) for r in got] == [("acme", "full", "")]
    assert got[0]["fetched_jd"].endswith("a b a b")
