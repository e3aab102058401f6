"""Job-board payloads to postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.functions.dates import epoch_millis, in_window, iso_timestamp
from vacancylens.functions.identity import pretty_token
from vacancylens.functions.text import blank, either, html_to_text, strip, thousands, unescape
from vacancylens.sources.posting import board_rows

GREENHOUSE = (
    "struct<jobs:array<struct<absolute_url:string,company_name:string,title:string,location:struct<name:string>,first_published:string,"
    "updated_at:string,pay_input_ranges:array<struct<min_cents:bigint,max_cents:bigint,currency_type:string,title:string>>,content:string>>>"
)
LEVER = (
    "array<struct<hostedUrl:string,applyUrl:string,text:string,categories:struct<location:string,team:string>,createdAt:bigint,workplaceType:string,"
    "salaryRange:struct<min:double,max:double,currency:string,interval:string>,descriptionPlain:string,description:string,"
    "lists:array<struct<text:string,content:string>>>>"
)
ASHBY = "struct<jobs:array<struct<title:string,location:string,jobUrl:string>>>"


def _newest(rows: DataFrame, cap: int | None) -> DataFrame:
    """Newest rows of each board, undated last, input order on ties."""
    if cap is None:
        return rows
    order = Window.partitionBy("token").orderBy(F.col("posted").desc_nulls_last(), "nth")
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= cap).drop("_n")


def _span(lo: Column, hi: Column) -> Column:
    return F.concat(thousands(F.coalesce(lo, F.lit(0))), F.lit("–"), thousands(F.coalesce(F.nullif(hi, F.lit(0)), lo)))


def greenhouse(payloads: DataFrame, since: Column | None = None, cap: int | None = None) -> DataFrame:
    """payloads(token, body) to postings; pay comes in cents, bodies are escaped HTML in an escaped string."""
    rows = payloads.select("token", F.posexplode(F.from_json("body", GREENHOUSE).jobs).alias("nth", "j")).filter("j is not null")
    rows = rows.withColumn("posted", F.coalesce(iso_timestamp("j.first_published"), iso_timestamp("j.updated_at")))
    rows = _newest(rows.filter(in_window("posted", F.lit(None).cast("timestamp") if since is None else since)), cap)

    def pay(r: Column) -> Column:
        label = F.rtrim(strip(either(r["title"], F.lit("Pay range"))), F.lit(":"))
        stated = (F.coalesce(r["min_cents"], F.lit(0)) != 0) | (F.coalesce(r["max_cents"], F.lit(0)) != 0)
        return F.when(stated, strip(F.concat(label, F.lit(": "), _span(r["min_cents"] / 100, r["max_cents"] / 100), F.lit(" "), strip(blank(r["currency_type"])))))

    ranges = F.coalesce("j.pay_input_ranges", F.array().cast("array<struct<min_cents:bigint,max_cents:bigint,currency_type:string,title:string>>"))
    return board_rows(
        rows, "token", link=F.col("j.absolute_url"), company=either(strip(blank("j.company_name")), pretty_token("token")), title=strip(blank("j.title")),
        platform="greenhouse", location=strip(blank("j.location.name")), pay=F.array_join(F.array_compact(F.transform(ranges, pay)), " · "),
        posted=F.col("posted"), body=html_to_text(unescape(blank("j.content"))))


def lever(payloads: DataFrame, since: Column | None = None, cap: int | None = None) -> DataFrame:
    """payloads(token, body) to postings; pay comes in whole units, the body is the description and every list block."""
    rows = payloads.select("token", F.posexplode(F.from_json("body", LEVER)).alias("nth", "j")).filter("j is not null")
    rows = rows.withColumn("posted", epoch_millis("j.createdAt"))
    rows = _newest(rows.filter(in_window("posted", F.lit(None).cast("timestamp") if since is None else since)), cap)
    slug = strip(blank("j.salaryRange.interval"))
    interval = F.coalesce(*[F.when(slug == k, F.lit(v)) for k, v in fixed.LEVER_INTERVALS.items()], slug)
    lo, hi = F.col("j.salaryRange.min"), F.col("j.salaryRange.max")
    stated = (F.coalesce(lo, F.lit(0.0)) != 0) | (F.coalesce(hi, F.lit(0.0)) != 0)
    pay = F.when(stated, F.concat_ws(" ", F.concat(F.lit("Pay range: "), _span(lo, hi)),
                                     F.nullif(strip(blank("j.salaryRange.currency")), F.lit("")), F.nullif(interval, F.lit("")))).otherwise(F.lit(""))
    lists = F.transform(F.coalesce("j.lists", F.array().cast("array<struct<text:string,content:string>>")),
                        lambda x: F.concat(blank(x["text"]), F.lit("\n"), html_to_text(x["content"])))
    described = F.when(blank("j.descriptionPlain") != "", F.col("j.descriptionPlain")).otherwise(html_to_text("j.description"))
    body = strip(F.array_join(F.filter(F.concat(F.array(described), lists), lambda x: x != ""), "\n\n"))
    place = F.concat_ws(" · ", F.nullif(strip(blank("j.categories.location")), F.lit("")), F.nullif(strip(blank("j.workplaceType")), F.lit("")))
    return board_rows(
        rows, "token", link=either("j.hostedUrl", "j.applyUrl"), company=pretty_token("token"), title=strip(blank("j.text")), platform="lever", location=place,
        pay=pay, posted=F.col("posted"), body=body)


def listings(payloads: DataFrame) -> DataFrame:
    """payloads(platform, slug, body) of three dialects to (platform, slug, title, location, url).

    An empty list is a valid answer; see `answered` for boards without openings.
    """
    def rows(platform: str, kind: str, jobs, title: str, location: str, url: str) -> DataFrame:
        parsed = payloads.filter(F.col("platform") == platform).select("platform", "slug", F.explode(jobs(F.from_json("body", kind))).alias("j"))
        return parsed.select("platform", "slug", blank(title).alias("title"), blank(location).alias("location"), blank(url).alias("url"))

    return (rows("greenhouse", GREENHOUSE, lambda v: v.jobs, "j.title", "j.location.name", "j.absolute_url")
            .unionByName(rows("lever", LEVER, lambda v: v, "j.text", "j.categories.location", "j.hostedUrl"))
            .unionByName(rows("ashby", ASHBY, lambda v: v.jobs, "j.title", "j.location", "j.jobUrl")))


def answered(payloads: DataFrame) -> DataFrame:
    """Boards whose payload parses, with or without openings."""
    return payloads.filter(F.try_parse_json("body").isNotNull()).select("platform", "slug")
