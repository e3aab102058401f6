"""Per-entity results that live for some days, kept as stream state: a probe meets the newest entry that is still good."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from vacancylens import fixed
from vacancylens.session import ship, state_store

DAY_MS = 86_400_000
ENTRIES = "entries"
ANSWER = "key string, today date, researched date, age_days int, value string, asked long"


class TtlCache(StatefulProcessor):
    """The entries of one key, newest of each day, for as long as a probe may still meet them.

    On the event clock a timer stands at the day the newest entry runs out; when the watermark passes it, the state of
    the key is cleared. On the processing clock the store itself drops a key that was not written for as long.
    """

    def __init__(self, max_age: int, slack: int, clock: str, ttl_ms: int | None):
        self.max_age, self.slack, self.clock = max_age, slack, clock
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getValueState(ENTRIES, "days array<int>, ranks array<long>, texts array<string>", self.ttl_ms)

    def _stored(self) -> dict[int, tuple[int, str]]:
        if not self.entries.exists():
            return {}
        days, ranks, texts = self.entries.get()
        return {d: (r, t) for d, r, t in zip(days, ranks, texts)}

    def _keep(self, entries: dict[int, tuple[int, str]]) -> None:
        """Write the entries a probe can still meet, and move the timer to the last day of the newest."""
        newest = max(entries)
        days = sorted(d for d in entries if d >= newest - self.max_age - self.slack)
        self.entries.update((days, [entries[d][0] for d in days], [entries[d][1] for d in days]))
        if self.clock == "event":
            ends = (newest + self.max_age + 1) * DAY_MS
            known = list(self.handle.listTimers())
            for timer in known:
                if timer != ends:
                    self.handle.deleteTimer(timer)
            if ends not in known:
                self.handle.registerTimer(ends)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        entries, asked, wrote = self._stored(), {}, False
        for chunk in rows:
            for day, at, entry, text in zip(chunk["day"].tolist(), chunk["at"].tolist(), chunk["entry"].tolist(), chunk["value"].tolist()):
                if not entry:
                    asked[day] = asked.get(day, 0) + 1
                elif day not in entries or (at, text) > entries[day]:
                    entries[day], wrote = (at, text), True
        out = []
        for today, n in sorted(asked.items()):
            hit = max((d for d in entries if 0 <= today - d <= self.max_age), default=None)
            out.append((key[0], _date(today), _date(hit), None if hit is None else today - hit, None if hit is None else entries[hit][1], n))
        if wrote:
            self._keep(entries)
        if out:
            yield pd.DataFrame(out, columns=["key", "today", "researched", "age_days", "value", "asked"]).astype({"age_days": "Int32"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.entries.clear()
        yield from ()

    def close(self) -> None:
        pass


def _date(day: int | None) -> dt.date | None:
    return None if day is None else dt.date(1970, 1, 1) + dt.timedelta(days=day)


def cached(stream: DataFrame, max_age: int = fixed.CACHE_TTL_DAYS, key: str = "key", time: str = "at", entry: str = "entry",
           value: str = "value", late_days: int = 1, clock: str = "event", ttl_ms: int | None = None) -> DataFrame:
    """(key, today, researched, age_days, value, asked): each day's probes of a key, answered by the newest entry that is
    0 to `max_age` days old; an entry of a later day is no answer, and a miss has nulls.

    Rows with `entry` true store `value` for the day of `time`; of one day's entries the latest counts, ties to the larger
    value. All others are probes; a key's probes of one day are answered once per batch, after that batch's entries.
    State is one row per live key with at most max_age + late_days + 1 days. `clock="event"` ends it by watermark, rows
    later than `late_days` behind are dropped; `clock="processing"` ends it `ttl_ms` (default: that many days) after its
    last write and drops no row. Rows without a key or a time take no part.
    """
    ship(stream.sparkSession)
    if clock not in ("event", "processing"):
        raise ValueError(f"clock is 'event' or 'processing', not {clock!r}")
    rows = stream.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("time"), F.coalesce(entry, F.lit(False)).alias("entry"),
        F.coalesce(F.col(value).cast("string"), F.lit("")).alias("value")).withColumn(
        "day", F.unix_date(F.to_date("time"))).withColumn("at", F.unix_micros("time"))
    if clock == "event":
        rows, ttl_ms = rows.withWatermark("time", f"{late_days} days"), None
    else:
        ttl_ms = ttl_ms or (max_age + 1) * DAY_MS
    machine = TtlCache(max_age, late_days, clock, ttl_ms)
    return rows.groupBy("key").transformWithStateInPandas(
        machine, ANSWER, outputMode="Append", timeMode="EventTime" if clock == "event" else "ProcessingTime")


def run_cached(answers: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Answer what has landed, as a table; the next run goes on from the checkpoint's state.

    `every` is the interval of a run that goes on until it is stopped. The processing clock needs one: its batches never
    end by themselves, as time alone may change the state.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    with state_store(answers.sparkSession):
        return answers.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def live_keys(spark, checkpoint: str) -> DataFrame:
    """The state as it stands at the last checkpoint: (key, newest) of every key that still has entries."""
    with state_store(spark):
        state = spark.read.format("statestore").option("stateVarName", ENTRIES).load(checkpoint)
        return state.select(F.col("key.key").alias("key"), F.array_max("value.days").alias("newest"))
