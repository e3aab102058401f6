"""Markdown documents: heading-aware chunks, section classes, work items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.functions.identity import folder_slug
from vacancylens.functions.text import UNICODE_NOCASE, blank, strip

_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def split_lines(text: Column) -> Column:
    return F.split(blank(text), _LINE_END)


def _sections(lines: Column, marks: Column, payload: str) -> Column:
    """The stretches of a text between its headings: (start, size, open), outermost open heading first.

    marks: array of (at, fence, level, p), in order: a line with a fence mark, or a heading. A heading closes all open ones
    of its level or deeper; inside a fence, which closes on its own mark alone or runs to the end, there are none. Only
    marks are folded; `start` is the line after the heading, counted from 1 as slices are, and before the first nothing
    is open.
    """
    stack = f"array<struct<level:int,p:{payload}>>"
    kind = f"struct<fence:string,stack:{stack},out:array<struct<at:int,open:array<{payload}>>>>"
    before = F.array(F.struct(F.lit(-1).alias("at"), F.array().cast(f"array<{payload}>").alias("open")))
    begin = F.struct(F.lit("").alias("fence"), F.array().cast(stack).alias("stack"), before.alias("out")).cast(kind)

    def opened(acc: Column, x: Column) -> Column:
        kept = F.filter(acc["stack"], lambda s: s["level"] < x["level"])
        now = F.array_append(kept, F.struct(x["level"].alias("level"), x["p"].alias("p")).cast(f"struct<level:int,p:{payload}>"))
        return F.struct(acc["fence"].alias("fence"), now.alias("stack"), F.array_append(acc["out"], F.struct(
            x["at"].alias("at"), F.transform(now, lambda s: s["p"]).alias("open"))).alias("out")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        def fenced(mark: Column) -> Column:
            return F.struct(mark.alias("fence"), acc["stack"].alias("stack"), acc["out"].alias("out")).cast(kind)

        return (F.when(x["fence"] == "", F.when(acc["fence"] == "", opened(acc, x)).otherwise(acc))
                .when(acc["fence"] == "", fenced(x["fence"])).when(acc["fence"] == x["fence"], fenced(F.lit(""))).otherwise(acc))

    def spans(out: Column) -> Column:
        ends = F.concat(F.transform(F.slice(out, 2, F.size(out)), lambda o: o["at"]), F.array(F.size(lines)))
        return F.zip_with(out, ends, lambda o, e: F.struct((o["at"] + 2).alias("start"), (e - o["at"] - 1).alias("size"), o["open"].alias("open")))

    return F.aggregate(marks, begin, step, lambda a: spans(a["out"]))


def pack_paragraphs(text: Column, limit: int = fixed.CHUNK_CHARS) -> Column:
    """Paragraphs packed greedily into parts of at most `limit` characters; a longer paragraph is cut into pieces."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: p != "")

    def pieces(p: Column) -> Column:
        full = F.greatest(F.ceil(F.length(p) / limit) - 1, F.lit(0)).cast("int")
        whole = F.when(full > 0, F.transform(F.sequence(F.lit(0), F.greatest(full - 1, F.lit(0))), lambda i: F.struct(
            F.substring(p, i * limit + 1, F.lit(limit)).alias("t"), F.lit(True).alias("alone")))).otherwise(
            F.array().cast("array<struct<t:string,alone:boolean>>"))
        rest = F.struct(F.substring(p, full * limit + 1, F.lit(limit)).alias("t"), F.lit(False).alias("alone"))
        return F.concat(whole, F.array(rest))

    kind = "struct<parts:array<string>,buf:string>"
    begin = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("buf")).cast(kind)

    def flushed(acc: Column) -> Column:
        return F.when(acc["buf"] != "", F.array_append(acc["parts"], acc["buf"])).otherwise(acc["parts"])

    def step(acc: Column, x: Column) -> Column:
        alone = F.struct(F.array_append(flushed(acc), x["t"]).alias("parts"), F.lit("").alias("buf"))
        first = F.struct(acc["parts"].alias("parts"), x["t"].alias("buf"))
        joined = F.struct(acc["parts"].alias("parts"), F.concat(acc["buf"], F.lit("\n\n"), x["t"]).alias("buf"))
        full = F.struct(flushed(acc).alias("parts"), x["t"].alias("buf"))
        fits = F.length(acc["buf"]) + 2 + F.length(x["t"]) <= limit
        return (F.when(x["alone"], alone.cast(kind)).when(acc["buf"] == "", first.cast(kind))
                .when(fits, joined.cast(kind)).otherwise(full.cast(kind)))

    packed = F.aggregate(F.flatten(F.transform(paragraphs, pieces)), begin, step, flushed)
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed)


def chunk_markdown(df: DataFrame, doc: str = "source", text: str = "text", limit: int = fixed.CHUNK_CHARS) -> DataFrame:
    """Heading-aware chunks: (source, section, heading_path, heading, heading_level, part, parts, content).

    A text is cut, resolved and packed inside its row, where it lies; only finished chunks become rows.
    """
    lined = df.select(F.col(doc).alias("source"), split_lines(F.col(text)).alias("lines"))
    marked = F.filter(F.transform("lines", lambda line, i: F.struct(
        i.cast("int").alias("at"), F.regexp_extract(line, fixed.FENCE, 1).alias("fence"),
        F.length(F.regexp_extract(line, fixed.ATX_HEADING, 1)).alias("level"), line.alias("line"))), lambda x: (x["fence"] != "") | (x["level"] > 0))
    headings = F.transform(marked, lambda x: F.struct(
        x["at"].alias("at"), x["fence"].alias("fence"), x["level"].alias("level"), strip(F.regexp_extract(x["line"], fixed.ATX_HEADING, 2)).alias("p")))
    resolved = lined.withColumn("sections", _sections(F.col("lines"), headings, "string"))
    bodies = F.transform("sections", lambda s, i: F.struct(
        i.cast("long").alias("section"), s["open"].alias("path"), strip(F.array_join(F.slice("lines", s["start"], s["size"]), "\n")).alias("body")))
    sections = resolved.select("source", F.explode(F.filter(bodies, lambda x: x["body"] != "")).alias("s")).select("source", "s.*")
    parts = sections.withColumn("all_parts", pack_paragraphs(F.col("body"), limit))
    header = F.array_join(F.transform("path", lambda h, i: F.concat(F.repeat(F.lit("#"), (i + 1).cast("int")), F.lit(" "), h)), "\n")
    return parts.select("source", "section", "path", F.size("all_parts").alias("parts"), F.posexplode("all_parts").alias("part", "piece")).select(
        "source", "section", F.array_join("path", " > ").alias("heading_path"), F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit("")).alias("heading"),
        F.size("path").alias("heading_level"), "part", "parts",
        F.when(F.size("path") > 0, F.concat(header, F.lit("\n\n"), "piece")).otherwise(F.col("piece")).alias("content"))


def _is_flush(line: Column) -> Column:
    """A line that starts at the margin and is no checkbox: it ends an entry."""
    return (strip(line) != "") & ~F.substring(line, 1, 1).rlike(r"\s") & ~line.rlike(fixed.CHECKBOX)


def _classed_entries(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, lines, stretches): the runs of lines under one section and one entry, all inside the document's row.

    A stretch is (start, size, section_class, is_box): a checkbox line, or one at the margin, with the blank or indented
    lines below it.
    """
    lined = df.select(F.col(doc).alias("doc"), split_lines(F.col(text)).alias("lines"))
    marked = F.filter(F.transform("lines", lambda line, i: F.struct(
        i.cast("int").alias("at"), F.length(F.regexp_extract(line, fixed.SECTION_HEADING, 1)).alias("level"), line.alias("line"))),
        lambda x: (x["level"] > 0) & _is_flush(x["line"]))

    def own(line: Column) -> Column:
        heading = F.regexp_extract(line, fixed.SECTION_HEADING, 2)
        return (F.when(heading.rlike(UNICODE_NOCASE + fixed.SKIP_HEADING), F.lit("skip"))
                .when(heading.rlike(UNICODE_NOCASE + fixed.APPLY_HEADING), F.lit("apply")).otherwise(F.lit("")))

    headings = F.transform(marked, lambda x: F.struct(
        x["at"].alias("at"), F.lit("").alias("fence"), x["level"].alias("level"), own(x["line"]).alias("p")))

    def named(open_: Column) -> Column:
        known = F.filter(open_, lambda x: x != "")
        return F.when(F.size(open_) == 0, F.lit("apply")).when(F.size(known) > 0, F.try_element_at(known, F.lit(-1))).otherwise(F.lit("unclassified"))

    def stretches(section: Column) -> Column:
        """Heading line first, then cuts at every line that begins or ends an entry; positions count from 1."""
        first = F.greatest(section["start"] - 1, F.lit(1))
        size = section["size"] + section["start"] - first
        cuts = F.filter(F.transform(F.slice("lines", first, size), lambda line, i: F.struct(
            (i + first).cast("int").alias("at"), line.rlike(fixed.CHECKBOX).alias("box"), _is_flush(line).alias("flush"))),
            lambda x: x["box"] | x["flush"])
        begun = F.concat(F.array(F.struct(first.cast("int").alias("at"), F.lit(False).alias("box"), F.lit(False).alias("flush"))), cuts)
        ends = F.concat(F.transform(cuts, lambda x: x["at"]), F.array((first + size).cast("int")))
        klass = named(section["open"])
        return F.filter(F.zip_with(begun, ends, lambda x, e: F.struct(
            x["at"].alias("start"), (e - x["at"]).alias("size"), klass.alias("section_class"), x["box"].alias("is_box"))), lambda x: x["size"] > 0)

    resolved = lined.withColumn("sections", _sections(F.col("lines"), headings, "string"))
    return resolved.select("doc", "lines", F.flatten(F.transform("sections", stretches)).alias("stretches"))


def section_classes(df: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """Lines of apply documents with the class of their section and the entry they belong to.

    (doc, pos, line, section_class, entry): class apply, skip or unclassified; before any heading it is apply. A deeper
    heading that names neither inherits. An entry is a checkbox line and the blank or indented lines below it.
    """
    rows = _classed_entries(df, doc, text)
    listed = F.flatten(F.transform("stretches", lambda s: F.transform(F.slice("lines", s["start"], s["size"]), lambda line, i: F.struct(
        (s["start"] - 1 + i).cast("int").alias("pos"), line.alias("line"), s["section_class"].alias("section_class"),
        F.when(s["is_box"], s["start"] - 1).cast("int").alias("entry")))))
    return rows.select("doc", F.explode(listed).alias("l")).select("doc", "l.*")


def work_items(df: DataFrame, doc: str = "doc", text: str = "text", include_done: bool = False) -> DataFrame:
    """Open entries of apply sections: (doc, ord, company, role, folder, link, fit), one per folder, first wins.

    Entries under an unclassified section come out with `problem` set instead of being guessed at. Lines never leave
    their document's row; items alone meet by folder.
    """
    boxes = F.transform(F.filter("stretches", lambda s: s["is_box"]), lambda s: F.struct(
        (s["start"] - 1).cast("int").alias("entry"), s["section_class"].alias("section_class"),
        F.element_at("lines", s["start"]).alias("box"), F.slice("lines", s["start"] + 1, s["size"] - 1).alias("below")))
    entry = _classed_entries(df, doc, text).select("doc", F.explode(boxes).alias("b")).select(
        "doc", "b.entry", "b.section_class", F.regexp_extract("b.box", fixed.CHECKBOX, 1).alias("mark"),
        F.array_join(F.concat(F.array(F.regexp_extract("b.box", fixed.CHECKBOX, 2)), "b.below"), "\n").alias("body"))
    title = F.regexp_extract("body", fixed.BOLD_TITLE, 1)
    role = F.when(title.contains("@"), strip(F.regexp_extract(title, r"(?s)^(.*)@[^@]*$", 1))).otherwise(strip(title))
    company = F.when(title.contains("@"), strip(F.regexp_extract(title, r"(?s)@([^@]*)$", 1))).otherwise(F.lit(""))
    day = F.coalesce(F.nullif(F.regexp_extract("doc", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit("undated"))
    named = F.regexp_extract("body", fixed.FOLDER_CODE, 1)
    default = F.concat(F.lit("applications/"), day, F.lit("_"), folder_slug(company), F.lit("_"), folder_slug(role))
    folder = F.when(named != "", named).otherwise(default)
    open_item = ~F.col("body").contains("~~") & (role != "")
    if not include_done:
        open_item = open_item & (strip("mark") == "")
    items = entry.filter(open_item & (F.col("section_class") != "skip")).select(
        "doc", F.col("entry").alias("ord"), company.alias("company"), role.alias("role"), folder.alias("folder"),
        F.regexp_extract("body", fixed.LINK_IN_ITEM, 1).alias("link"),
        F.regexp_extract("body", UNICODE_NOCASE + fixed.FIT_NUMBER, 1).try_cast("int").alias("fit"),
        F.when(F.col("section_class") == "unclassified", F.lit("unrecognized section")).alias("problem"))
    nth = F.row_number().over(Window.partitionBy("doc", "folder").orderBy("ord"))
    return items.withColumn("_n", nth).filter(F.col("_n") == 1).drop("_n")
