"""Session helpers: where cut lineage, streaming state and written tables go."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, from `spark.checkpoint.dir`.

    Where the session names none, a local folder is made, but only in local mode: executors of a cluster do not see it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="vacancylens-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def run_dir(spark: SparkSession, label: str) -> str:
    """A new folder under the shared one, for the tables a single run writes."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession, provider: str = ROCKS) -> Iterator[None]:
    """Streams started inside keep their state in the given store; a stream takes its settings along when it starts."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, provider)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: its plan is computed once and ends there, and a lost executor
    costs a reread."""
    path = run_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a small text table, which arrives in fewer splits than there are cores, one partition per core.

    Tables of any size worth a cluster have more splits than cores and pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, as spark-submit --py-files would, unless their path has it."""
    root = Path(__file__).resolve().parents[1]
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    name = "vacancylens-package.zip"
    if root not in paths and not any(f.endswith(name) for f in spark.sparkContext.listFiles):
        base = os.path.join(tempfile.mkdtemp(prefix="vacancylens-"), name[:-4])
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "vacancylens"))
