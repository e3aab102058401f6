"""Source health of every micro-batch: metrics observed on the stream, alerts written by a listener."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

METRICS = "source_health"
HEALTH = "batch long, source string, raw long, kept long, status string, alert boolean"


def observed(stream: DataFrame, registry: Mapping[str, str | None], is_kept: Column, source: str = "source") -> DataFrame:
    """The stream with raw and kept rows of every registered source counted on the way, batch by batch.

    registry: source to the reason why it could not run, or None. Two counters per source; nothing is shuffled.
    """
    counts = [F.count_if((F.col(source) == name) & (True if what == "raw" else is_kept)).alias(f"{what}_{i}")
              for i, name in enumerate(registry) for what in ("raw", "kept")]
    return stream.observe(METRICS, *counts)


class SourceListener(StreamingQueryListener):
    """Writes one row per registered source and batch; a source that returned nothing at all raises an alert.

    A source with rows of which none is kept is healthy, and one that could not run says why instead. Each batch owns its
    partition of the table, so a batch that runs again replaces its rows.
    """

    def __init__(self, spark: SparkSession, registry: Mapping[str, str | None], path: str):
        self.spark, self.registry, self.path = spark, dict(registry), path
        self.written: set[int] = set()
        self.lock = threading.Lock()

    def rows(self, batch: int, counts: Mapping[str, int]) -> list[tuple]:
        out = []
        for i, (name, reason) in enumerate(self.registry.items()):
            raw = counts[f"raw_{i}"]
            status = "ok" if raw else reason or "nothing returned"
            out.append((batch, name, raw, counts[f"kept_{i}"], status, raw == 0 and reason is None))
        return out

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(METRICS)
        if seen is None or event.progress.numInputRows == 0:
            return
        table = self.spark.createDataFrame(self.rows(event.progress.batchId, seen.asDict()), HEALTH).coalesce(1)
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)
        with self.lock:
            self.written.add(event.progress.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def run_watched(query: StreamingQuery, listener: SourceListener, seconds: float = 60) -> None:
    """Wait for a query to end and for the listener to have written its last batch; progress reaches it a little later."""
    query.awaitTermination()
    batches = {p["batchId"] for p in map(_as_dict, query.recentProgress) if p["numInputRows"]}
    end = time.monotonic() + seconds
    while not batches <= listener.written:
        if time.monotonic() > end:
            raise TimeoutError(f"no source health of batches {sorted(batches - listener.written)}")
        time.sleep(0.1)


def _as_dict(progress) -> dict:
    return json.loads(progress.json) if hasattr(progress, "json") and isinstance(progress.json, str) else dict(progress)
