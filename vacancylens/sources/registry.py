"""Registered sources: a frame builder per name, each isolated from the others' failures."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancylens.models import SOURCE_FIELDS
from vacancylens.operators.windows import is_attributed

Builder = Callable[..., DataFrame]


class UnknownSource(ValueError):
    """A selection names a source that is not registered, or names none."""


@dataclass(frozen=True)
class SourceStatus:
    name: str
    state: str  # ok, disabled, crashed, unknown
    error: str = ""


def selection(names: Sequence[str] | None, registered: Sequence[str]) -> Callable[[str], bool]:
    """Which sources run. None means all; an unknown name or an empty list is an error that names it."""
    if names is None:
        return lambda name: True
    wanted = {n.strip().lower() for n in names if n.strip()}
    if not wanted:
        raise UnknownSource("no source named; leave the list out to run all of them")
    unknown = sorted(wanted - set(registered))
    if unknown:
        raise UnknownSource(f"unknown source(s): {', '.join(unknown)}; registered: {', '.join(registered)}")
    return lambda name: name in wanted


def union_sources(builders: Mapping[str, Builder], enabled: Callable[[str], bool] | None = None,
                  options: Mapping[str, dict] | None = None) -> tuple[DataFrame | None, list[SourceStatus]]:
    """All enabled sources in registry order, each row with its source and rank; a crash costs its own source only.

    A builder fails here, while plans are built. Files that fail later fail their own tasks; land feeds first.
    """
    out, states = None, []
    for rank, (name, build) in enumerate(builders.items()):
        if enabled is not None and not enabled(name):
            states.append(SourceStatus(name, "disabled"))
            continue
        try:
            rows = build(**(options or {}).get(name, {})).select(*SOURCE_FIELDS)
        except Exception as error:
            states.append(SourceStatus(name, "crashed", f"{type(error).__name__}: {error}"))
            continue
        tagged = rows.withColumn("source", F.lit(name)).withColumn("channel_rank", F.lit(rank))
        out = tagged if out is None else out.unionByName(tagged)
        states.append(SourceStatus(name, "ok"))
    return out, states


def attributed(rows: DataFrame) -> DataFrame:
    """Rows of sources under an attribution duty that do not carry their line are dropped."""
    return rows.filter(is_attributed("source", "fetched_jd"))
