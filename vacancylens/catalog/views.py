"""Input views over the driver tables, written once in SQL that Spark and DuckDB both read.

The driver tables hold no postings, so each view derives them row by row from `documents`, `pages`,
`conversations`, ... by arithmetic on their keys. `*_SQL` are the texts; the functions return DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancylens.models import ANALYSIS
from vacancylens.session import spread

_K = "cast(floor(d.doc_id / 16) as bigint)"

_SUFFIX = """concat(
  case d.doc_id % 5
    when 0 then concat(' Pay: $', cast(40 + d.doc_id % 50 as varchar(20)), '.00 - $', cast(60 + d.doc_id % 70 as varchar(20)), ' per hour.')
    when 1 then concat(' Salary: $', cast(100 + d.doc_id % 90 as varchar(20)), ',000 to $', cast(150 + d.doc_id % 60 as varchar(20)), ',000 per year.')
    when 2 then concat(' Comp $', cast(90 + d.doc_id % 80 as varchar(20)), 'k.')
    when 4 then concat(' Base salary $', cast(100 + d.doc_id % 100 as varchar(20)), ',500 offered.')
    else '' end,
  case d.doc_id % 9
    when 0 then ' Requires 12+ years of experience.'
    when 1 then ' Asks 3-5 years of relevant experience.'
    when 2 then ' Experience: 7 years; also 11 years experience.'
    else '' end,
  case d.doc_id % 13
    when 0 then ' Must have an active clearance.'
    when 1 then ' TS/SCI required, or obtain within a year.'
    when 2 then ' Active secret clearance.'
    else '' end,
  case d.doc_id % 11
    when 0 then ' About 60% travel.'
    when 1 then ' Travel up to 25%.'
    when 2 then ' 100% travel, then 75 % + travel.'
    else '' end,
  case when d.doc_id % 17 = 0 then ' Our client is hiring.' else '' end)"""

POSTINGS_SQL = f"""
select
  d.doc_id as ord,
  d.lang as lang,
  d.source as source_name,
  case when d.doc_id % 37 = 0 then '' else concat(d.source,
    case d.doc_id % 4 when 0 then '' when 1 then ' Inc.' when 2 then ', LLC' else ' Corp' end) end as company,
  case when d.doc_id % 37 = 0 then '' else concat(
    case d.doc_id % 7 when 0 then 'Senior JavaScript Developer ' when 1 then 'Java Engineer '
      when 2 then 'Full Stack Developer - ' when 3 then 'ASP.NET Developer ' when 4 then 'iOS Engineer '
      when 5 then '.NET Developer ' else '' end,
    split_part(split_part(d.text, chr(10), 1), '.', 1)) end as title,
  case d.doc_id % 8
    when 0 then concat('https://www.linkedin.com/comm/jobs/view/senior-dev-', cast(1000000 + {_K} as varchar(20)), '?trk=mail')
    when 1 then concat('https://indeed.com/rc/clk?x=1&jk=a', cast({_K} as varchar(20)))
    when 2 then concat('https://boards.greenhouse.io/', d.source, '/jobs/', cast({_K} as varchar(20)), '?gh_src=', cast(d.doc_id as varchar(20)))
    when 3 then concat('HTTPS://WWW.Example.com/Jobs/', cast({_K} as varchar(20)), '/?utm_source=x&b=2&a=', cast({_K} as varchar(20)), '#top')
    when 4 then concat('https://example.com/Jobs/', cast({_K} as varchar(20)), '?a=', cast({_K} as varchar(20)), '&b=2')
    when 5 then concat('https://jobs.lever.co/', d.source, '/00000000-0000-', lpad(cast({_K} as varchar(20)), 12, '0'))
    when 6 then ''
    else concat('https://remotevibecodingjobs.com/p/', cast(d.doc_id as varchar(20))) end as link,
  case d.doc_id % 4 when 0 then 'linkedin' when 1 then 'indeed' when 2 then 'greenhouse' else 'toptal' end as source_platform,
  case when d.doc_id % 12 = 0 then '' else concat('2024-01-', lpad(cast(1 + d.doc_id % 28 as varchar(20)), 2, '0')) end as posted_hint,
  case when d.doc_id % 6 = 5 then '' else concat(d.text, {_SUFFIX}) end as fetched_jd,
  case when d.doc_id % 6 = 5 then concat(d.text, {_SUFFIX}) else '' end as email_jd_text,
  case when d.doc_id % 6 <> 5 then 'full' when d.n_chars >= 300 then 'email_snippet' else 'title_only' end as jd_source,
  case when d.doc_id % 6 = 5 then 'fetched but no usable JD text' else '' end as fetch_error,
  case when d.doc_id % 3 = 0 then concat('m', cast(cast(floor(d.doc_id / 9) as bigint) as varchar(20))) else '' end as email_mid,
  case when d.doc_id % 3 <> 0 then '' when floor(d.doc_id / 9) % 3 = 0 then 'Jane Doe <jane@corp.example>'
    else 'Job Alerts <alerts@dice.com>' end as email_sender,
  case when d.doc_id % 3 = 0 then concat('Role ', cast(cast(floor(d.doc_id / 9) as bigint) as varchar(20))) else '' end as email_subject,
  concat('2024-01-0', cast(1 + d.doc_id % 6 as varchar(20)), '-090000') as run,
  d.doc_id % 19 = 0 as prefiltered,
  d.doc_id % 29 = 0 as analysis_errored,
  d.doc_id % 31 = 0 as from_correspondence,
  d.doc_id % 23 <> 0 as scored,
  case d.doc_id % 5 when 0 then 'PRIMARY' when 1 then 'SECONDARY' when 4 then 'UNLISTED' else 'OPPORTUNISTIC' end as tier,
  cast((d.doc_id * 37) % 101 as int) as fit_score,
  cast(1 + d.doc_id % 5 as int) as intensity,
  case when l.quality = 1 and d.doc_id % 2 = 0 then 'STRONG_FIT' when l.quality = 1 then 'FIT'
    when d.doc_id % 3 = 0 then 'SKIP' else 'LOW_FIT' end as verdict,
  case d.doc_id % 14 when 0 then 'travel' when 1 then 'rate' when 2 then 'intensity' when 3 then ' ' else '' end as held_back_reason,
  case d.doc_id % 21 when 0 then 'prefilter: off-lane' when 1 then 'analysis_error: cap' else concat('Why ', cast(d.doc_id % 10 as varchar(20))) end as why,
  case when d.doc_id % 10 = 0 then '' else concat('Role in ', d.lang) end as role_summary,
  case when d.doc_id % 4 = 0 then 'remote ok' else '' end as meets_goals,
  case d.doc_id % 8 when 0 then 'Permanent role, not contract|No rate posted' when 1 then 'Permanent, not contract'
    when 2 then 'Permanent role, not contract|Travel over 40%' when 3 then 'Likely permanent, not contract'
    when 4 then 'No rate' when 5 then '' when 6 then 'Equity-heavy comp'
    else concat('Stack gap: ', lower(split_part(split_part(d.text, chr(10), 1), ' ', 1))) end as red_flags_text,
  concat(case d.doc_id % 5 when 0 then 'Node.js|TypeScript' when 1 then 'Node|React' when 2 then 'NodeJS|Next.js'
    when 3 then 'React|Machine Learning Platforms' else 'machine-learning platform' end,
    '|', lower(split_part(split_part(d.text, chr(10), 1), ' ', 2))) as keywords_text,
  case when d.doc_id % 5 = 0 then concat('$', cast(40 + d.doc_id % 50 as varchar(20)), '/hr') else '' end as rate,
  case d.doc_id % 5 when 0 then 'remote' when 1 then 'hybrid' when 2 then 'onsite' when 3 then 'Unknown' else '' end as cadence,
  case d.doc_id % 4 when 0 then 'contract' when 1 then 'permanent' when 2 then 'contract-to-hire' else '' end as employment_type,
  coalesce(l.toxic, 0) = 1 or d.doc_id % 8 = 0 as is_agency
from documents d left join labels l on d.doc_id = l.doc_id
"""

MAIL_SQL = """
select
  conv_id * 100 + turn as ord,
  concat('c', cast(conv_id as varchar(20)), '-', cast(turn as varchar(20))) as mid,
  case conv_id % 11
    when 0 then '"Jane Q. Doe" <jane@corp.example>'
    when 1 then 'Job Alerts <jobalerts@indeed.com>'
    when 2 then 'LinkedIn <notifications@linkedin.com>'
    when 3 then 'Dice <no-reply@mail.dice.com>'
    when 4 then 'recruiter.smith@user.dice.com'
    when 5 then 'Doe, John <john.doe@agency.example>'
    when 6 then 'Acme Recruiting Team <team@acme.example>'
    when 7 then 'Mary-Ann O''Neil <mary@startup.example>'
    when 8 then 'news@remotevibecodingjobs.com'
    when 9 then ''
    else 'Bob <bob@x.example>' end as sender,
  concat(case conv_id % 4 when 0 then 'New job for you: ' when 1 then 'Your career ' when 2 then 'Weekly notes ' else '' end, role) as subject,
  concat(text,
    case turn % 5
      when 0 then concat(' Apply at https://boards.greenhouse.io/acme/jobs/', cast(conv_id as varchar(20)), '?gh_src=mail now.')
      when 1 then ' See https://example.org/unsubscribe and https://jobs.smartly.example/openings/12.'
      when 2 then concat(' https://www.linkedin.com/comm/jobs/view/', cast(10000000 + conv_id as varchar(20)), '?trk=x, https://cdn.example.com/logo.png')
      when 3 then ' via dice'
      else '' end) as content,
  turn > 0 and conv_id % 3 = 0 as is_reply
from conversations
"""

# Fetched pages: status code and body of an attempt to read each page's address.
FETCHED_SQL = """
select
  page_id as ord,
  case page_id % 9
    when 0 then '' when 1 then concat('https://www.linkedin.com/jobs/view/', cast(10000000 + page_id as varchar(20)))
    when 2 then concat('https://remotevibecodingjobs.com/p/', cast(page_id as varchar(20))) else url end as link,
  case page_id % 10 when 0 then 404 when 1 then 410 when 2 then 503 else 200 end as status,
  case when page_id % 15 = 4 then 'ConnectTimeout' else '' end as error,
  concat(case when page_id % 7 = 3 then '<title>Just a moment...</title>' else '' end,
    case when page_id % 16 = 7 then '' else html end,
    case when page_id % 6 = 5 then '<p>Sorry, this position has been filled.</p>' else '' end,
    case when page_id % 12 = 6 then '<p>We are NO LONGER accepting applications</p>' else '' end) as body,
  case when page_id % 4 = 0 then html else '' end as email_jd_text
from pages
"""

COMPANIES_SQL = """
select concat('c', cast(c_custkey as varchar(20))) as id,
  concat(case c_custkey % 6 when 0 then 'The ' else '' end, replace(replace(c_name, '#', ' '), 'Customer', c_mktsegment),
    case c_custkey % 4 when 0 then ' Inc' when 1 then ', LLC' when 2 then ' Ltd' else '' end) as company
from customer
"""


TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def run_sql(spark: SparkSession, sql: str, sf_dir: str, *names: str) -> DataFrame:
    """Run a view text with its tables passed as arguments, so that no session-wide name is taken."""
    return spark.sql("with " + ", ".join(f"{n} as (select * from {{{n}__}})" for n in names) + "\n" + sql.replace("{", "{{").replace("}", "}}"),
                     **{f"{n}__": df for n, df in ((n, table(spark, sf_dir, n)) for n in names)})


def postings_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, POSTINGS_SQL, sf_dir, "documents", "labels")


def nest(flat: DataFrame) -> DataFrame:
    """Flat judgment columns to the nullable `analysis` struct."""
    listed = {
        "red_flags": F.filter(F.split("red_flags_text", r"\|"), lambda x: x != ""),
        "resume_keywords": F.filter(F.split("keywords_text", r"\|"), lambda x: x != ""),
        "precedent": F.lit(""),
    }
    fields = [listed.get(f.name, F.col(f.name) if f.name in flat.columns else F.lit(None)).cast(f.dataType).alias(f.name)
              for f in ANALYSIS.fields]
    dropped = [f.name for f in ANALYSIS.fields if f.name in flat.columns]
    return (flat.withColumn("analysis", F.when(F.col("scored"), F.struct(*fields)))
            .drop(*dropped, "red_flags_text", "keywords_text"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nest(postings_flat(spark, sf_dir))


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, MAIL_SQL, sf_dir, "conversations")


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, FETCHED_SQL, sf_dir, "pages")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, COMPANIES_SQL, sf_dir, "customer")


def with_views(body: str, *names: str) -> str:
    """SQL text with the named views in front."""
    texts = {"postings": POSTINGS_SQL, "mail": MAIL_SQL, "fetched": FETCHED_SQL, "companies": COMPANIES_SQL}
    return "with recursive " + ", ".join(f"{n} as materialized ({texts[n]})" for n in names) + body
