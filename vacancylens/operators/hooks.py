"""Pluggable scorers and embedders that run inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacancylens.functions.text import any_contains, blank
from vacancylens.models import ANALYSIS, FLAG, struct

Scorer = Callable[[str], dict]

# The judgment of a row whose scorer failed; `errored` keeps it out of the seen keys.
ERROR_STUB = {"tier": "OPPORTUNISTIC", "fit_score": 0, "intensity": 3, "verdict": "SKIP", "role_summary": "", "meets_goals": "",
              "red_flags": ["analysis error"], "resume_keywords": []}


def score(df: DataFrame, make_scorer: Callable[[], Scorer], text: str = "scorer_text", key: str = "ord") -> DataFrame:
    """(key, analysis, analysis_errored) from a scorer of one text. A scorer that raises costs its own row only.

    `make_scorer` runs once per Python worker task, which is where a model would be loaded.
    """
    names = ANALYSIS.names
    schema = T.StructType([df.schema[key], *struct(("analysis", ANALYSIS), ("analysis_errored", FLAG)).fields])

    def judge(scorer: Scorer, body: str) -> tuple[dict, bool]:
        try:
            return scorer(body), False
        except Exception as error:
            return {**ERROR_STUB, "why": f"analysis_error: {str(error)[:120]}"}, True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            results = [judge(scorer, b) for b in batch[text]]
            yield pd.DataFrame({key: batch[key], "analysis": [{n: r.get(n) for n in names} for r, _ in results],
                                "analysis_errored": [e for _, e in results]})

    return df.select(key, text).mapInPandas(run, schema)


def rule_judgment(text: Column | str = "jd_text", good: Sequence[str] = ("react", "typescript", "python", "node"),
                  bad: Sequence[str] = ("staffing", "on-call")) -> Column:
    """Deterministic scorer without Python: points for wanted terms, off for unwanted ones."""
    low = F.lower(blank(text))
    hits = F.lit(0)
    for term in good:
        hits = hits + F.when(low.contains(term), 25).otherwise(0)
    fit = F.greatest(hits - F.when(any_contains(low, bad), 20).otherwise(0), F.lit(0)).cast("int")
    verdict = F.when(fit >= 75, "STRONG_FIT").when(fit >= 50, "FIT").when(fit >= 25, "LOW_FIT").otherwise("SKIP")
    values = {"tier": F.lit("OPPORTUNISTIC"), "fit_score": fit, "intensity": F.lit(3), "verdict": verdict,
              "why": F.concat(F.lit("rule score "), fit.cast("string")), "red_flags": F.array(), "resume_keywords": F.array(), "is_agency": F.lit(False)}
    return F.struct(*[values.get(f.name, F.lit("")).cast(f.dataType).alias(f.name) for f in ANALYSIS.fields])


def embed(df: DataFrame, make_embedder: Callable[[], Callable[[list[str]], list]], text: str, key: str, batch_rows: int = 256) -> DataFrame:
    """(key, embedding) from a batch embedder that is loaded once per task; vectors come back at length one."""
    schema = T.StructType([df.schema[key], T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder = make_embedder()
        for batch in batches:
            for start in range(0, len(batch), batch_rows):
                part = batch.iloc[start:start + batch_rows]
                m = np.asarray(embedder(part[text].tolist()), dtype=np.float64)
                length = np.linalg.norm(m, axis=1, keepdims=True)
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": list(m / np.where(length == 0, 1.0, length))})

    return df.select(key, text).mapInPandas(run, schema)
