"""schema.org postings and objects embedded in landed pages."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.functions.text import any_contains, blank, either, strip, strip_tags, unescape
from vacancylens.models import INT, LONG, TEXT, struct
from vacancylens.sources.posting import posting_columns


def _prefix(text: str) -> str | None:
    """The longest valid JSON value at the start of a text, serialised again."""
    try:
        return json.dumps(json.JSONDecoder().raw_decode(text)[0])
    except ValueError:
        return None


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(block=[_prefix(b) for b in batch["block"]])


def _elements(values: Column) -> Column:
    """Lists inside a list of values opened once."""
    return F.flatten(F.transform(values, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))


def _graph(v: Column) -> Column:
    return _elements(F.coalesce(F.try_variant_get(v, "$['@graph']", "array<variant>"), F.array().cast("array<variant>")))


def _objects(block: Column) -> Column:
    """Values of a block: lists opened, each value preceded by the members of its graph."""
    def with_members(v: Column) -> Column:
        nested = F.flatten(F.transform(_graph(v), lambda m: F.concat(_graph(m), F.array(m))))
        return F.concat(nested, F.array(v))

    return F.flatten(F.transform(_elements(_elements(F.array(block))), with_members))


def is_job_posting(v: Column) -> Column:
    kinds = F.try_variant_get(v, "$['@type']", "array<string>")
    return F.coalesce(F.array_contains(kinds, "JobPosting"), F.try_variant_get(v, "$['@type']", "string") == "JobPosting", F.lit(False))


def job_postings(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """(page, block_no, nth, jp VARIANT): every JobPosting in the pages' ld+json blocks.

    Clean blocks are parsed in place; only blocks with trailing junk go through Python, for their valid prefix. Two
    levels of lists and graphs are opened.
    """
    blocks = F.regexp_extract_all(blank(html), F.lit("(?is)" + fixed.JSONLD_BLOCK), F.lit(1))
    found = pages.select(F.col(page).cast("bigint").alias("page"), F.posexplode(blocks).alias("block_no", "block")).withColumn("block", strip("block"))
    clean = found.filter(F.try_parse_json("block").isNotNull())
    repaired = found.filter(F.try_parse_json("block").isNull()).mapInPandas(
        _repair, struct(("page", LONG), ("block_no", INT), ("block", TEXT))).filter("block is not null")
    opened = _objects(F.try_parse_json("block"))
    rows = clean.unionByName(repaired).select("page", "block_no", F.posexplode(opened).alias("nth", "jp"))
    return rows.filter(F.schema_of_variant("jp").startswith("OBJECT") & is_job_posting(F.col("jp")))


def _text(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def employment_type(jp: Column) -> Column:
    return F.coalesce(F.array_join(F.try_variant_get(jp, "$.employmentType", "array<string>"), ","), _text(jp, "$.employmentType"))


def is_contract(jp: Column) -> Column:
    return any_contains(F.lower(employment_type(jp)), ("contract", "temporary"))


def company(jp: Column) -> Column:
    return _text(jp, "$.hiringOrganization.name")


def location(jp: Column) -> Column:
    """STRUCT(metro, remote) of the first place and its first address."""
    remote = F.upper(_text(jp, "$.jobLocationType")) == "TELECOMMUTE"
    place = F.coalesce(F.try_variant_get(jp, "$.jobLocation[0]", "variant"), F.try_variant_get(jp, "$.jobLocation", "variant"))
    address = F.coalesce(F.try_variant_get(place, "$.address[0]", "variant"), F.try_variant_get(place, "$.address", "variant"))
    named = F.concat_ws(", ", F.nullif(_text(address, "$.addressLocality"), F.lit("")), F.nullif(_text(address, "$.addressRegion"), F.lit("")))
    return F.struct(F.when(remote, F.lit("Remote")).otherwise(named).alias("metro"), remote.alias("remote"))


def salary(jp: Column) -> Column:
    base = F.coalesce(F.try_variant_get(jp, "$.baseSalary", "variant"), F.try_variant_get(jp, "$.estimatedSalary", "variant"))
    lo, hi, one = (_text(base, f"$.value.{k}") for k in ("minValue", "maxValue", "value"))
    unit_text = F.upper(_text(base, "$.value.unitText"))
    unit = F.coalesce(*[F.when(unit_text == k, F.lit(v)) for k, v in fixed.SALARY_UNITS.items()], F.lit(""))

    def stated(x: Column) -> Column:
        return ~x.isin("", "0", "0.0")

    return (F.when(stated(lo) | stated(hi), F.concat(F.lit("$"), F.when(stated(lo), lo).otherwise("?"), F.lit("-"), F.when(stated(hi), hi).otherwise("?"), unit))
            .when(stated(one), F.concat(F.lit("$"), one, unit)).otherwise(F.lit("")))


def posted(jp: Column) -> Column:
    return F.substring(_text(jp, "$.datePosted"), 1, 10)


def fields(df: DataFrame, jp: str = "jp") -> DataFrame:
    """Adds the typed fields of a posting object; the description keeps its whole text."""
    v = F.col(jp)
    return (df.withColumn("employment_type", employment_type(v)).withColumn("contract", is_contract(v)).withColumn("company", company(v))
            .withColumn("place", location(v)).withColumn("salary", salary(v)).withColumn("posted", posted(v)).withColumn("title", _text(v, "$.title"))
            .withColumn("description", strip_tags(_text(v, "$.description"))))


def _info(html: Column, label: str) -> Column:
    cell = F.regexp_extract(html, "(?is)" + fixed.INFO_CELL.format(label), 1)
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(cell, "<[^>]+>", " ")), r"\s+", " "))


def agency_postings(pages: DataFrame) -> DataFrame:
    """Detail pages of the agencies to postings: one projection for all, with each agency's own rules.

    pages(page_id, source, url, html, list_title); the first JobPosting of a page counts. One agency hides its name,
    one falls back to the listing's title and the page text, one states type and rate in an info table first.
    """
    first = job_postings(pages).groupBy("page").agg(F.min_by("jp", F.struct("block_no", "nth")).alias("jp"))
    joined = fields(pages.join(first, pages.page_id == first.page, "left").drop("page"))
    is_scion, is_kore, found = F.col("source") == "scion", F.col("source") == "kore1", F.col("jp").isNotNull()
    named = F.coalesce(*[F.when(F.col("source") == k, F.lit(v)) for k, v in fixed.AGENCY_NAMES.items()], F.lit(""))
    hidden = (F.col("source") == "apex") & (F.lower("company") == "confidential")
    metro = F.col("place.metro")
    remote = F.col("place.remote") | (is_scion & (F.lower(strip(metro)) == "remote"))
    page_text = strip(F.regexp_replace(strip_tags("html"), r"\s+", " "))
    columns = posting_columns(
        title=F.when(is_kore, either("title", "list_title")).otherwise(F.col("title")),
        company=F.when(hidden, named).otherwise(either("company", named)), link=F.col("url"), source=F.col("source"),
        description=F.when(found, F.col("description")).otherwise(page_text),
        employment_type=F.when(is_scion, either(_info(F.col("html"), "Employment Type"), "employment_type")).otherwise(F.col("employment_type")),
        metro=metro, cadence=F.when(found, F.when(remote, "remote").otherwise("onsite")),
        rate=F.when(is_scion, either(_info(F.col("html"), "Pay rate"), "salary")).otherwise(F.col("salary")), posted=F.col("posted"))
    return joined.filter(found | is_kore).select("page_id", *columns)


def _embedded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    decoder = json.JSONDecoder()
    for batch in batches:
        rows = []
        for page, body in zip(batch["page"], batch["body"]):
            for nth, piece in enumerate(body.split(fixed.EMBEDDED_MARKER)[1:]):
                try:
                    found = decoder.raw_decode(piece)[0]
                except ValueError:
                    continue
                if isinstance(found, dict) and "JobID" in found:
                    rows.append((page, nth, json.dumps(found)))
        yield pd.DataFrame(rows, columns=["page", "nth", "body"])


EMBEDDED = ("struct<JobID:bigint,Title:string,City:string,State:string,Description:string,Requirements:string,Skills:string,JobDuration:string,PostedDate:string,"
            "IsRemoteJob:boolean,IsRemote:boolean,PayRateStraight:string,SalaryLow:double,SalaryHigh:double,ApplicantCount:string,JobType:array<string>>")


def embedded_postings(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """Objects behind a marker that carry a job id, first of each id, as postings. A pay of under 1000 is hourly."""
    bodies = pages.select(F.col(page).cast("bigint").alias("page"), F.col(html).alias("body")).filter(F.col("body").contains(fixed.EMBEDDED_MARKER))
    objects = bodies.mapInPandas(_embedded, struct(("page", LONG), ("nth", INT), ("body", TEXT)))
    rows = objects.withColumn("o", F.from_json("body", EMBEDDED))
    first = rows.groupBy("o.JobID").agg(F.min_by("o", F.struct("page", "nth")).alias("o"))
    o = F.col("o")
    remote = F.coalesce(o.IsRemoteJob, F.lit(False)) | F.coalesce(o.IsRemote, F.lit(False))
    lo, hi = F.coalesce(o.SalaryLow, F.lit(0.0)), F.coalesce(o.SalaryHigh, F.lit(0.0))
    rate = (F.when(~blank(o.PayRateStraight).isin("", "0", "0.0"), F.concat(F.lit("$"), o.PayRateStraight, F.lit("/hr")))
            .when((lo != 0) | (hi != 0), F.concat(F.lit("$"), lo.cast("bigint").cast("string"), F.lit("-"), hi.cast("bigint").cast("string"),
                                                  F.when(F.greatest(lo, hi) < 1000, "/hr").otherwise("/yr"))).otherwise(F.lit("")))
    description = F.concat_ws(
        " ", F.nullif(blank(o.Description), F.lit("")), F.concat(F.lit("Requirements: "), blank(o.Requirements)), F.concat(F.lit("Skills: "), blank(o.Skills)),
        F.when(blank(o.JobDuration) != "", F.concat(F.lit("Duration: "), o.JobDuration, F.lit("."))),
        F.when(~blank(o.ApplicantCount).isin("", "0"), F.concat(F.lit("Applicants: "), o.ApplicantCount, F.lit("."))))
    place = F.concat_ws(", ", F.nullif(blank(o.City), F.lit("")), F.nullif(blank(o.State), F.lit("")))
    return first.select("JobID", *posting_columns(
        title=o.Title, company=F.lit(fixed.AGENCY_NAMES["insightglobal"]),
        link=F.concat(F.lit("https://jobs.insightglobal.com/jobapplynoaccount.aspx?jobid="), F.col("JobID").cast("string")), source=F.lit("insightglobal"),
        description=description, employment_type=F.array_join(F.coalesce(o.JobType, F.array().cast("array<string>")), ","),
        metro=F.when(remote, F.lit("Remote")).otherwise(place), cadence=F.when(remote, F.lit("remote")).otherwise(F.lit("onsite")), rate=rate,
        posted=F.substring(blank(o.PostedDate), 1, 10)))
