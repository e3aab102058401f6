"""The postings feed as streams: never judge twice, score in batches, keep undated rows, accumulate by day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vacancylens.operators.keys import new_keys, seen_keys
from vacancylens.operators.windows import first_per_key, newest_per_key
from vacancylens.streaming.keytable import BUCKETS, KeyTable


def read_table(spark: SparkSession, folder: str, file: str, schema: T.StructType, per_trigger: int | None = None) -> DataFrame:
    """A folder's parquet files as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file)
    if per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def load_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of this feed, empty before its first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Each batch owns one partition, so a batch that runs again replaces what it wrote before."""
    df.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def drop_seen(stream: DataFrame, seen_path: str, out_path: str, checkpoint: str, key: str = "key", ord_col: str = "ord",
              buckets: int = BUCKETS) -> StreamingQuery:
    """Rows whose key no earlier batch carried, one per key; their keys then join the seen table.

    The seen set grows for ever by design, so it is a table of hash buckets and not operator state; a batch opens only
    what may hold its keys. Rows are written before keys: a crash between the two repeats the batch, and both writes
    replace their own partition.
    """
    written = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = KeyTable(spark, seen_path, buckets=buckets)
        named = batch.filter(F.col(key).isNotNull()).persist()
        earlier = seen.known(named.select(F.col(key).alias("key")), batch_id).select(F.col("key").alias(key)).distinct()
        write_batch(first_per_key(named.join(earlier, key, "left_anti"), key, ord_col).select(*stream.columns), out_path, batch_id)
        out = load_or_empty(spark, out_path, written).filter(F.col("batch") == batch_id)
        named.unpersist()
        seen.append(out.select(F.col(key).cast("string").alias("key")), batch_id)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_feed(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], state_path: str, seen_path: str, checkpoint: str,
               buckets: int = BUCKETS) -> StreamingQuery:
    """Score in batches; state is written before seen keys, so a crash costs a batch and never a judgment.

    Errored rows leave no key and come back. `stream` rows carry id, link and analysis columns the scorer fills.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = KeyTable(spark, seen_path, buckets=buckets)
        write_batch(scorer(batch), state_path, batch_id)
        scored = spark.read.parquet(state_path).filter(F.col("batch") == batch_id)
        if "duplicates" not in scored.columns:
            scored = scored.withColumn("duplicates", F.lit(None).cast("array<struct<id:string>>"))
        keys = seen_keys(scored)
        seen.append(new_keys(keys, seen.known(keys, batch_id)), batch_id)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fresh(stream: DataFrame, since: Column, key: str = "key", time: str = "posted", delay: str = "2 days") -> DataFrame:
    """Rows inside the window, late and undated ones by rule.

    Dated rows before `since` are dropped. The others carry a watermark: a row further behind than `delay` is too late
    and dropped, and a key that comes again within the delay passes once; state forgets it after that. Undated rows have
    no place on that clock: they pass without state and meet the seen table later (`drop_seen`).
    """
    dated = stream.filter(F.col(time).isNotNull() & (F.col(time) >= since)).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return dated.unionByName(stream.filter(F.col(time).isNull()))


def daily_totals(stream: DataFrame, time: str, *measures: Column, delay: str = "1 day") -> DataFrame:
    """Measures per day; a day closes when the watermark has passed it."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("w")).agg(*measures).withColumn(
        "as_of", F.date_format("w.start", "yyyy-MM-dd")).drop("w")


def keep_daily(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """`daily_totals` as a table with one partition per day, open days included.

    Every batch gives the days it changed with their totals so far, which replace what the table had of them; a batch that
    runs again writes the same.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(path)

    return totals.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def index_feed(stream: DataFrame, index_path: str, checkpoint: str, schema: T.StructType, versions_path: str | None = None,
               buckets: int = BUCKETS) -> StreamingQuery:
    """Only new and changed documents of each batch reach the index table (and an embedder behind it).

    The table is append-only by batch; a key's newest batch is its document. Which version of a key stands there is kept
    beside it as a table of content hashes, in hash buckets: no batch reads a text that was indexed before.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions = KeyTable(spark, versions_path or f"{index_path.rstrip('/')}-versions", "key string, hash string, batch long", buckets)
        current = newest_per_key(batch, "key").withColumn("hash", F.sha2("content", 256))
        known = versions.known(current.select("key"), batch_id).groupBy("key").agg(F.max_by("hash", "batch").alias("old"))
        fresh = current.join(known, "key", "left").filter(F.col("old").isNull() | (F.col("old") != F.col("hash"))).drop("old")
        write_batch(fresh.select(*schema.names, "hash"), index_path, batch_id)
        out = load_or_empty(spark, index_path, T.StructType.fromDDL("key string, hash string, batch long")).filter(F.col("batch") == batch_id)
        versions.append(out, batch_id)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
