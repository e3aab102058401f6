"""Raw mail to records."""

from __future__ import annotations

import email
from collections.abc import Iterator
from email import policy

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.functions.text import either, html_to_text, strip
from vacancylens.models import FLAG, TEXT, struct

_RECORD = struct(("mid", TEXT), ("sender", TEXT), ("subject", TEXT), ("date", TEXT), ("plain", TEXT), ("html", TEXT), ("is_reply", FLAG))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """(raw) of message files."""
    return spark.read.format("binaryFile").load(path).select(F.col("content").cast("string").alias("raw"))


def _split(raw: str) -> tuple:
    """Headers and bodies of one message; MIME decoding is the one part Spark has no expression for."""
    try:
        message = email.message_from_string(raw, policy=policy.default)
    except Exception:
        return ("", "", "", "", raw, "", False)
    bodies = {"text/plain": [], "text/html": []}
    for part in message.walk():
        kind = part.get_content_type()
        if kind in bodies:
            try:
                bodies[kind].append(part.get_content())
            except Exception:
                continue
    head = [str(message.get(h) or "") for h in ("Message-ID", "From", "Subject", "Date")]
    is_reply = bool(message.get("In-Reply-To") or message.get("References"))
    return (*head, "\n".join(bodies["text/plain"]), "\n".join(bodies["text/html"]), is_reply)


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([_split(r) for r in batch["raw"]], columns=_RECORD.names)


def parse_messages(raw: DataFrame, body_chars: int | None = None) -> DataFrame:
    """raw(raw) to mail records: plain text parts, else the HTML as text; `linked_text` is what links are found in.

    `body_chars` cuts the shown body; links always come from the whole message.
    """
    parts = raw.select("raw").mapInPandas(_decode, _RECORD)
    whole = strip(either("plain", html_to_text("html")))
    content = whole if body_chars is None else F.substring(whole, 1, body_chars)
    return parts.select("mid", "sender", "subject", "date", content.alias("content"), "is_reply",
                        F.concat("html", F.lit("\n"), whole).alias("linked_text"))
