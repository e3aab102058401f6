"""Market feeds: one row of a feed's payload to one posting. Each takes (ord, body) rows, body being the row's JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.functions.dates import epoch_seconds
from vacancylens.functions.rates import extract_rate
from vacancylens.functions.text import blank, either, strip, strip_tags, thousands
from vacancylens.operators.pages import same_ad
from vacancylens.sources.posting import posting_columns

ADZUNA = ("struct<id:string,title:string,company:struct<display_name:string>,location:struct<display_name:string>,redirect_url:string,description:string,"
          "contract_type:string,contract_time:string,created:string,salary_min:double,salary_max:double,salary_is_predicted:string>")
JSEARCH = ("struct<job_title:string,employer_name:string,job_apply_link:string,job_description:string,job_city:string,job_state:string,job_employment_type:string,"
           "job_salary_period:string,job_posted_at_datetime_utc:string,job_is_remote:boolean,job_min_salary:string,job_max_salary:string>")
THEIRSTACK = ("struct<job_title:string,company:string,url:string,final_url:string,source_url:string,short_location:string,location:string,salary_string:string,"
              "seniority:string,description:string,date_posted:string,remote:boolean,hybrid:boolean,min_annual_salary_usd:double,max_annual_salary_usd:double,"
              "min_annual_salary:double,max_annual_salary:double,employment_statuses:array<string>,technology_slugs:array<string>>")
HIMALAYAS = ("struct<title:string,companyName:string,employmentType:string,minSalary:double,maxSalary:double,salaryPeriod:string,currency:string,"
             "locationRestrictions:array<string>,parentCategories:array<string>,description:string,pubDate:bigint,applicationLink:string,guid:string>")
REMOTIVE = ("struct<id:bigint,url:string,title:string,company_name:string,category:string,job_type:string,publication_date:string,"
            "candidate_required_location:string,salary:string,description:string>")


def _rows(payload: DataFrame, kind: str, *extra: str) -> DataFrame:
    return payload.select("ord", *extra, F.from_json("body", kind).alias("j")).filter("j is not null")


def _first_link(rows: DataFrame, link: Column) -> DataFrame:
    """First row of each non-empty link: a rank limit of one, which cuts each link's rows before the shuffle."""
    keyed = rows.withColumn("_link", link).filter(blank("_link") != "")
    first = F.row_number().over(Window.partitionBy("_link").orderBy("ord"))
    return keyed.withColumn("_n", first).filter(F.col("_n") == 1).select(*rows.columns)


def _non_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0)) != 0


def _whole(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0)).cast("bigint").cast("string")


def adzuna(payload: DataFrame, full_texts: DataFrame | None = None) -> DataFrame:
    """payload also has `label`, the query filter that returned the row; full_texts(id, page_text) are read ad pages.

    A page counts only where it carries the teaser's opening. Predicted or unflagged pay is withheld.
    """
    rows = _first_link(_rows(payload, ADZUNA, "label"), F.col("j.redirect_url"))
    if full_texts is None:
        rows = rows.withColumn("page_text", F.lit(None).cast("string"))
    else:
        rows = rows.join(full_texts.select(F.col("id").alias("_id"), "page_text"), F.col("j.id") == F.col("_id"), "left").drop("_id")
    full = F.when(same_ad("j.description", "page_text"), F.col("page_text"))
    text = F.coalesce(full, blank("j.description"))
    place = blank("j.location.display_name")
    remote = F.lower(F.concat_ws(" ", blank("j.title"), text, place)).contains("remote")
    stated = _non_zero(F.col("j.salary_min")) | _non_zero(F.col("j.salary_max"))
    rate = (F.when(~stated, F.lit("")).when(either("j.salary_is_predicted", F.lit("1")) == "1", F.lit(fixed.ADZUNA_PREDICTED))
            .otherwise(F.concat(F.lit("$"), _whole(F.col("j.salary_min")), F.lit("-"), _whole(F.col("j.salary_max")), F.lit("/yr (posted)"))))
    kind = strip(F.concat(either("j.contract_type", "label", F.lit("unspecified")), F.lit(" "), blank("j.contract_time")))
    out = rows.withColumn("_full", full.isNotNull()).select("ord", "_full", *posting_columns(
        title=F.col("j.title"), company=F.col("j.company.display_name"), link=F.col("j.redirect_url"), source=F.lit("adzuna"), description=text,
        employment_type=kind, metro=F.when(remote, F.lit("Remote")).otherwise(place), cadence=F.when(remote, F.lit("remote")), rate=rate,
        posted=F.substring(blank("j.created"), 1, 10), attribution=F.lit(fixed.ATTRIBUTION["adzuna"])))
    return out.withColumn("jd_source", F.when(F.col("_full"), F.col("jd_source")).otherwise(F.lit("title_only"))).drop("_full")


def jsearch(payload: DataFrame) -> DataFrame:
    rows = _first_link(_rows(payload, JSEARCH), F.col("j.job_apply_link"))
    remote = F.coalesce("j.job_is_remote", F.lit(False))
    lo, hi = blank("j.job_min_salary"), blank("j.job_max_salary")

    def shown(x: Column) -> Column:
        return F.when(x.isin("", "0", "0.0"), F.lit("?")).otherwise(x)

    stated = (shown(lo) != "?") | (shown(hi) != "?")
    rate = F.when(stated, strip(F.concat(shown(lo), F.lit("-"), shown(hi), F.lit(" "), blank("j.job_salary_period")))).otherwise(F.lit(""))
    place = F.concat_ws(", ", F.nullif(blank("j.job_city"), F.lit("")), F.nullif(blank("j.job_state"), F.lit("")))
    return rows.select("ord", *posting_columns(
        title=F.col("j.job_title"), company=F.col("j.employer_name"), link=F.col("j.job_apply_link"), source=F.lit("jsearch"),
        description=F.col("j.job_description"), employment_type=F.col("j.job_employment_type"), metro=F.when(remote, F.lit("Remote")).otherwise(place),
        cadence=F.when(remote, F.lit("remote")).otherwise(F.lit("onsite")), rate=rate, posted=F.substring(blank("j.job_posted_at_datetime_utc"), 1, 10)))


def theirstack(payload: DataFrame, max_rows: int | None = None, max_slugs: int | None = None) -> DataFrame:
    """`max_rows` cuts the pull in order, as a paid feed is, and `max_slugs` a row's technologies; neither cuts by default."""
    rows = _rows(payload, THEIRSTACK)
    if max_rows is not None:
        rows = rows.orderBy("ord").limit(max_rows)
    remote, hybrid = F.coalesce("j.remote", F.lit(False)), F.coalesce("j.hybrid", F.lit(False))
    lo, hi = F.coalesce(F.nullif("j.min_annual_salary_usd", F.lit(0.0)), F.col("j.min_annual_salary")), F.coalesce(F.nullif("j.max_annual_salary_usd", F.lit(0.0)), F.col("j.max_annual_salary"))
    rate = (F.when(blank("j.salary_string") != "", F.col("j.salary_string"))
            .when(_non_zero(lo) | _non_zero(hi), F.concat(F.lit("$"), _whole(lo), F.lit("-"), _whole(hi), F.lit(" /yr"))).otherwise(F.lit("")))
    level = F.replace(blank("j.seniority"), F.lit("_"), F.lit(" "))
    text = F.concat(F.when(level != "", F.concat(F.lit("Seniority: "), level, F.lit(". "))).otherwise(F.lit("")), blank("j.description"))
    none = F.array().cast("array<string>")
    slugs = F.coalesce("j.technology_slugs", none)
    slugs = slugs if max_slugs is None else F.slice(slugs, 1, max_slugs)
    return rows.select("ord", *posting_columns(
        title=F.col("j.job_title"), company=either(strip(blank("j.company")), F.lit(fixed.THEIRSTACK_AGENCY)), link=either("j.url", "j.final_url", "j.source_url"),
        source=F.lit("theirstack"), description=text, employment_type=F.array_join(F.coalesce("j.employment_statuses", none), ","),
        metro=F.when(remote, F.lit("Remote")).otherwise(either("j.short_location", "j.location")),
        cadence=F.when(remote, F.lit("remote")).when(hybrid, F.lit("hybrid")).otherwise(F.lit("onsite")), rate=rate,
        tech=F.array_join(slugs, ", "), posted=F.substring(blank("j.date_posted"), 1, 10)))


def himalayas(payload: DataFrame) -> DataFrame:
    """Developer categories only; pay counts in US dollars per year or hour, else no rate."""
    rows = _rows(payload, HIMALAYAS).filter(F.coalesce(F.arrays_overlap("j.parentCategories", F.array(*map(F.lit, fixed.HIMALAYAS_CATEGORIES))), F.lit(False)))
    rows = _first_link(rows, either("j.applicationLink", "j.guid"))
    lo, hi, period = F.col("j.minSalary"), F.col("j.maxSalary"), F.col("j.salaryPeriod")
    usable = _non_zero(lo) & (F.col("j.currency") == "USD") & period.isin("annual", "hourly")
    per = F.when(period == "annual", F.lit(" per year")).otherwise(F.lit(" per hour"))
    upper = F.when(_non_zero(hi) & (hi != lo), F.concat(F.lit(" - $"), thousands(hi))).otherwise(F.lit(""))
    rate = F.coalesce(extract_rate(F.when(usable, F.concat(F.lit("$"), thousands(lo), upper, per))), F.lit(""))
    return rows.select("ord", *posting_columns(
        title=F.col("j.title"), company=F.col("j.companyName"), link=either("j.applicationLink", "j.guid"), source=F.lit("himalayas"),
        description=strip_tags("j.description"), employment_type=F.col("j.employmentType"),
        metro=F.array_join(F.coalesce("j.locationRestrictions", F.array().cast("array<string>")), ", "), cadence=F.lit("remote"), rate=rate,
        posted=F.coalesce(F.date_format(epoch_seconds("j.pubDate"), "yyyy-MM-dd"), F.lit("")), attribution=F.lit(fixed.ATTRIBUTION["himalayas"])))


def remotive(payload: DataFrame) -> DataFrame:
    rows = _rows(payload, REMOTIVE).filter(F.col("j.category").isin(*fixed.REMOTIVE_CATEGORIES))
    return rows.select("ord", *posting_columns(
        title=F.col("j.title"), company=F.col("j.company_name"), link=F.col("j.url"), source=F.lit("remotive"), description=strip_tags("j.description"),
        employment_type=F.col("j.job_type"), metro=F.col("j.candidate_required_location"), cadence=F.lit("remote"),
        rate=F.coalesce(extract_rate("j.salary"), F.lit("")), posted=F.substring(blank("j.publication_date"), 1, 10),
        attribution=F.lit(fixed.ATTRIBUTION["remotive"])))
