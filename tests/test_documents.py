"""Markdown chunks and work items against a line-by-line reading."""

import re

import pytest
from pyspark.sql import functions as F

from vacancylens.operators import briefs, docs

MARKDOWN = """intro line

# Title
first para

```
# not a heading
~~~
```
## Part one ##
text

#### Deep

~~~
## still fenced
```
~~~
under deep
## Part two
# Other

tail
"""


def read_sections(text):
    """(heading path, body lines) of a text, read line by line."""
    out, stack, body, fence = [], [], [], None

    def flush():
        if any(x.strip() for x in body):
            out.append(([h for _, h in stack], "\n".join(body).strip()))
        body.clear()

    for line in text.splitlines():
        mark = re.match(r"\s*(```|~~~)", line)
        head = re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if mark:
            fence = mark.group(1) if fence is None else None if mark.group(1) == fence else fence
            body.append(line)
        elif head and fence is None:
            flush()
            level = len(head.group(1))
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, head.group(2).strip()))
        else:
            body.append(line)
    flush()
    return out


def test_sections(spark):
    df = spark.createDataFrame([("a", MARKDOWN), ("b", ""), ("c", "no heading")], "source string, text string")
    got = {}
    for r in docs.chunk_markdown(df).orderBy("source", "section", "part").collect():
        got.setdefault(r["source"], []).append((r["heading_path"], r["content"]))
    want = []
    for path, body in read_sections(MARKDOWN):
        head = "\n".join(f"{'#' * (i + 1)} {h}" for i, h in enumerate(path))
        want.append((" > ".join(path), f"{head}\n\n{body}" if head else body))
    assert got["a"] == want and "b" not in got and got["c"] == [("", "no heading")]


@pytest.mark.parametrize("text,limit", [
    ("aaaa\n\nbbbb\n\ncccc", 10), ("a" * 25, 10), ("xx\n\n" + "b" * 23 + "\n\ncc\n \ndd", 10), ("short", 10), ("a" * 20 + "\n\n" + "b" * 10, 10),
])
def test_paragraphs_pack_without_loss(spark, text, limit):
    df = spark.createDataFrame([(text,)], "t string")
    parts = df.select(docs.pack_paragraphs(F.col("t"), limit).alias("p")).first()["p"]
    assert all(len(p) <= limit for p in parts)
    assert re.sub(r"\s", "", "".join(parts)) == re.sub(r"\s", "", text)
    if text == "aaaa\n\nbbbb\n\ncccc":
        assert parts == ["aaaa\n\nbbbb", "cccc"]
    if text.startswith("xx"):
        assert parts == ["xx", "b" * 10, "b" * 10, "bbb\n\ncc", "dd"]


APPLY = """# Jobs 2024-05-06
- [ ] **Early @ Zero** before any section
## Tier 1 - focus
- [ ] **Lead Dev @ Acme** **fit 87** https://x.example/1 ok
  fit 12 is only a note
- [x] **Done @ Co**
- [ ] ~~**Struck @ Co**~~
plain text ends the entry
  fit 99
### Notes
- [ ] **Dev @ at @ Beta** `applications/2024_beta/`
## Already applied
- [ ] **Skip @ Me**
### Deeper
- [ ] **Skip too @ Me**
## Mystery
- [ ] **What @ This**
## Backup
- [ ] **Again @ Beta** `applications/2024_beta/`
- [ ] **Solo**
"""


def test_work_items(spark):
    df = spark.createDataFrame([("apply-2024-05-06.md", APPLY)], "doc string, text string")
    rows = docs.work_items(df).orderBy("ord").collect()
    assert [(r["role"], r["company"], r["fit"], r["problem"]) for r in rows] == [
        ("Early", "Zero", None, None), ("Lead Dev", "Acme", 87, None), ("Dev @ at", "Beta", None, None), ("What", "This", None, "unrecognized section"), ("Solo", "", None, None)]
    assert rows[1]["link"] == "https://x.example/1" and rows[1]["folder"] == "applications/2024-05-06_acme_lead-dev"
    assert rows[2]["folder"] == "applications/2024_beta" and rows[4]["folder"] == "applications/2024-05-06_unknown_solo"
    assert docs.work_items(df, include_done=True).filter("role = 'Done'").count() == 1


def test_brief_answers_replace(spark):
    df = spark.createDataFrame([("# B\n\n## Answered by the agent (old)\n\nx", "new"), ("# B\n", " ")], "m string, a string")
    got = [r[0] for r in df.select(briefs.with_answers("m", "a", "2024-01-02")).collect()]
    assert got == ["# B\n\n## Answered by the agent (2024-01-02, from its own web search)\n\nnew\n", "# B\n"]


def test_lines_never_leave_their_row(spark):
    df = spark.createDataFrame([("a", MARKDOWN)], "source string, text string")
    for frame, doc in ((docs.chunk_markdown(df), None), (docs.section_classes(df, "source"), None)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan


def test_long_documents_with_many_headings(spark):
    text = "\n".join(f"{'#' * (1 + i % 6)} h{i}\nline {i}\n```\n# no\n```" for i in range(3000))
    df = spark.createDataFrame([("a", text)], "source string, text string")
    got = [(r["heading_path"], r["content"]) for r in docs.chunk_markdown(df).orderBy("section").collect()]
    want = read_sections(text)
    assert len(got) == 3000 and [g[0] for g in got] == [" > ".join(p) for p, _ in want]
