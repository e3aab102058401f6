"""Run-state files and snapshot files, read tolerantly: one bad field or record never costs the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.models import ANALYSIS, POSTING, POSTING_FLAGS, POSTING_TEXT_FIELDS


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of whole text files; a run's file is one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _typed(v: Column, path: str, kind: str, shapes: tuple[str, ...]) -> Column:
    """A field of the expected JSON type, else null: numbers do not turn into text."""
    field = _get(v, path, "variant")
    return F.when(F.schema_of_variant(field).isin(*shapes) if len(shapes) > 1 else F.schema_of_variant(field) == shapes[0],
                  F.try_variant_get(field, "$", kind))


def text_field(v: Column, path: str) -> Column:
    return F.coalesce(_typed(v, path, "string", ("STRING",)), F.lit(""))


def _text_list(v: Column, path: str) -> Column:
    items = F.coalesce(_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.array_compact(F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))))


def _int_field(v: Column, path: str) -> Column:
    return F.coalesce(_typed(v, path, "int", ("BIGINT", "INT")), F.lit(0))


def _flag(v: Column, path: str) -> Column:
    return F.coalesce(_get(v, path, "boolean"), F.lit(False))


def _analysis(v: Column) -> Column:
    fields = []
    for f in ANALYSIS.fields:
        kind = f.dataType.typeName()
        path = f"$.analysis.{f.name}"
        value = (_text_list(v, path) if kind == "array" else _int_field(v, path) if kind == "integer"
                 else _flag(v, path) if kind == "boolean" else text_field(v, path))
        fields.append(value.cast(f.dataType).alias(f.name))
    is_object = F.schema_of_variant(_get(v, "$.analysis", "variant")).startswith("OBJECT")
    return F.when(is_object, F.struct(*fields))


def run_of(path: Column) -> Column:
    return F.regexp_extract(path, r"state-([^/]*)\.json$", 1)


def scan_states(files: DataFrame) -> DataFrame:
    """Posting rows of run-state files: (run, nth, posting columns). Unparsable files and non-object records are skipped."""
    parsed = files.select(run_of(F.col("path")).alias("run"), F.try_parse_json("value").alias("state"))
    jobs = parsed.select("run", F.posexplode(F.try_variant_get("state", "$.jobs", "array<variant>")).alias("nth", "rec"))
    rec = F.col("rec")
    rows = jobs.filter(F.schema_of_variant(rec).startswith("OBJECT"))
    duplicates = F.transform(
        F.coalesce(_get(rec, "$.duplicates", "array<variant>"), F.array().cast("array<variant>")),
        lambda d: F.struct(text_field(d, "$.id").alias("id"), text_field(d, "$.company").alias("company"), text_field(d, "$.title").alias("title"),
                           text_field(d, "$.link").alias("link"), F.try_variant_get(d, "$.similarity", "double").alias("similarity"),
                           F.try_variant_get(d, "$.overlap", "double").alias("overlap")))
    return rows.select(
        "run", "nth", *[text_field(rec, f"$.{c}").alias(c) for c in POSTING_TEXT_FIELDS], *[_flag(rec, f"$.{c}").alias(c) for c in POSTING_FLAGS],
        duplicates.alias("duplicates"), _analysis(rec).alias("analysis"))


def scan_status(files: DataFrame) -> DataFrame:
    """One row per file: read or unreadable, with the run's date; `absent` where there is no file at all."""
    is_read = F.try_parse_json("value").isNotNull()
    date = F.regexp_extract("path", r"state-(\d+-\d+-\d+)", 1)
    found = files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), date.alias("date"),
                         F.when(is_read, F.lit("read")).otherwise(F.lit("unreadable")).alias("state"))
    one = files.sparkSession.range(1).select(F.lit("scored corpus").alias("name"), F.lit("").alias("date"), F.lit("absent").alias("state"))
    n = files.agg(F.count("*").alias("n"))
    return found.unionByName(one.crossJoin(n).filter("n = 0").drop("n"))


def scan_snapshots(files: DataFrame) -> DataFrame:
    """Snapshots by date: unreadable files, other versions and rows without a date are skipped, metrics keep numbers only."""
    v = F.try_parse_json("value")
    rows = files.select(v.alias("v")).filter(
        F.col("v").isNotNull() & (F.try_variant_get("v", "$.version", "int") == fixed.SNAPSHOT_VERSION) & (text_field(F.col("v"), "$.as_of") != ""))
    raw = F.coalesce(F.try_variant_get("v", "$.metrics", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    numbers = F.map_filter(F.transform_values(raw, lambda k, x: F.when(
        F.schema_of_variant(x).rlike("^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN)$"), F.try_variant_get(x, "$", "double"))), lambda k, x: x.isNotNull())
    col = F.col("v")
    return rows.select(
        text_field(col, "$.as_of").alias("as_of"), text_field(col, "$.rubric").alias("rubric"),
        *[F.coalesce(F.try_variant_get("v", f"$.{c}", "int"), F.lit(0)).alias(c) for c in ("postings", "jd_read", "runs", "window_days")],
        text_field(col, "$.first_run").alias("first_run"), text_field(col, "$.last_run").alias("last_run"), numbers.alias("metrics"),
        F.coalesce(F.try_variant_get("v", "$.terms", "map<string,map<string,bigint>>"), F.create_map().cast("map<string,map<string,bigint>>")).alias("terms"))


def write_states(df: DataFrame, path: str, run: str = "run") -> None:
    """Posting rows as a table with one partition per run; writing a run again replaces that run only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """The table `write_states` wrote; columns missing from older runs come back with their empty values."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    for f in POSTING.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
        if f.name in POSTING_TEXT_FIELDS:
            df = df.withColumn(f.name, F.coalesce(f.name, F.lit("")))
        elif f.name in POSTING_FLAGS:
            df = df.withColumn(f.name, F.coalesce(f.name, F.lit(False)))
    return df
