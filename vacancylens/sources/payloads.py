"""Landed payloads as a Spark data source: a folder per source, a partition per payload file, sources pruned by filter."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from vacancylens.session import ship
from vacancylens.sources.registry import SourceStatus, union_sources

FORMAT = "landed_payloads"
PAYLOAD = "source string, file string, ord long, body string"
BATCH_LINES = 4096


@dataclass(frozen=True)
class PayloadFile(InputPartition):
    source: str
    path: str


class PayloadReader(DataSourceReader):
    """One partition per file of <path>/<source>/; a filter on `source` keeps the other folders closed."""

    def __init__(self, path: str):
        self.path = path
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("source",):
                self._keep({f.value})
            elif isinstance(f, In) and f.attribute == ("source",):
                self._keep(set(f.value))
            else:
                yield f

    def _keep(self, names: set) -> None:
        self.wanted = names if self.wanted is None else self.wanted & names

    def partitions(self) -> list[PayloadFile]:
        system, root = pafs.FileSystem.from_uri(self.path)
        files = [f.path for f in system.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file]
        named = [(PurePosixPath(f).relative_to(root).parts, f) for f in sorted(files)]
        return [PayloadFile(parts[0], f) for parts, f in named
                if len(parts) > 1 and not parts[-1].startswith(("_", ".")) and (self.wanted is None or parts[0] in self.wanted)]

    def read(self, partition: PayloadFile) -> Iterator[pa.RecordBatch]:
        system, _ = pafs.FileSystem.from_uri(self.path)
        lines: list[str] = []
        at = 0

        def batch() -> pa.RecordBatch:
            n = len(lines)
            return pa.RecordBatch.from_pydict({"source": [partition.source] * n, "file": [partition.path] * n,
                                               "ord": pa.array(range(at, at + n), pa.int64()), "body": pa.array(lines, pa.string())})

        with system.open_input_stream(partition.path) as raw:
            for line in io.BufferedReader(raw, 1 << 20):
                lines.append(line.decode("utf-8", "replace").rstrip("\r\n"))
                if len(lines) >= BATCH_LINES:
                    yield batch()
                    at, lines = at + len(lines), []
        if lines:
            yield batch()


class LandedPayloads(DataSource):
    """spark.read.format("landed_payloads").load(folder): (source, file, ord, body), a row per line of every payload file."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return PAYLOAD

    def reader(self, schema) -> PayloadReader:
        path = self.options.get("path")
        if not path:
            raise ValueError(f"format {FORMAT} reads a folder: give its path to load()")
        return PayloadReader(path if "://" in path else f"file://{path}")


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it, which it needs to leave folders closed."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedPayloads)


def union_landed(spark: SparkSession, path: str, parsers: Mapping[str, Callable[[DataFrame], DataFrame]],
                 enabled: Callable[[str], bool] | None = None) -> tuple[DataFrame | None, list[SourceStatus]]:
    """All landed sources in registry order, parsed by `parsers`: source to a function of its (ord, body) rows.

    Every source loads the folder for itself: a filter stays with the reader it was pushed to.
    """
    def builder(name: str) -> Callable[[], DataFrame]:
        return lambda: parsers[name](spark.read.format(FORMAT).load(path).filter(F.col("source") == name).select("ord", "body"))

    return union_sources({name: builder(name) for name in parsers}, enabled)
