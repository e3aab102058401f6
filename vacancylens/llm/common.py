"""Small helpers that the training-data operators share."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancylens.session import run_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, as spark-submit --py-files would, unless their path has it."""
    root = Path(__file__).resolve().parents[2]
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    name = "vacancylens-package.zip"
    if root not in paths and not any(f.endswith(name) for f in spark.sparkContext.listFiles):
        base = os.path.join(tempfile.mkdtemp(prefix="vacancylens-"), name[:-4])
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "vacancylens"))


def saved(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write a table into the shared folder and read it back: its plan ends there, and lost executors cost a reread."""
    path = run_dir(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def uniform(*parts: Column) -> Column:
    """A double in [0, 1) that depends on nothing but the given values."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def crc32_text(column: Column) -> Column:
    """CRC-32 of a value's text; a null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def word_codes(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of every word, the distinct words by number, words per text): what stands between ASCII white space, in order.

    A null text has no words.
    """
    trimmed = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    cut = pc.ascii_split_whitespace(trimmed)
    per_text = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    words = cut.flatten()
    blank = pc.equal(trimmed, "").to_numpy(zero_copy_only=False)
    if blank.any():
        words = words.filter(pc.not_equal(words, ""))
        per_text[blank] = 0
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, per_text


def join_groups(rows: DataFrame, groups: DataFrame, on: str, size: str, share: int = 1000) -> DataFrame:
    """Rows joined to groups, one row per group with `size` of its rows, where one group may hold most of them.

    Groups over 1/share of all rows are fewer than `share`, hence safe to broadcast; what is left has no such key.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    large = F.col(size) * share > F.lit(total)
    hot = F.broadcast(groups.filter(large))
    rest = rows.join(hot.select(on), on, "left_anti").join(groups.filter(~large), on)
    return rows.join(hot, on).unionByName(rest)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores behind them as it takes to differ from all of a frame's columns."""
    taken = {c.lower() for c in df.columns}

    def free(name: str) -> str:
        return free(f"{name}_") if name.lower() in taken else name

    return [free(n) for n in names]
