"""Schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, FLAG, INT, LONG, REAL = T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType(), T.DoubleType()
TEXTS = T.ArrayType(TEXT)


def struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


ANALYSIS = struct(
    ("tier", TEXT), ("fit_score", INT), ("intensity", INT), ("verdict", TEXT), ("held_back_reason", TEXT),
    ("why", TEXT), ("role_summary", TEXT), ("meets_goals", TEXT), ("red_flags", TEXTS), ("resume_keywords", TEXTS),
    ("precedent", TEXT), ("rate", TEXT), ("cadence", TEXT), ("employment_type", TEXT), ("is_agency", FLAG),
)

DUPLICATE = struct(("id", TEXT), ("company", TEXT), ("title", TEXT), ("link", TEXT), ("similarity", REAL), ("overlap", REAL))

POSTING_TEXT_FIELDS = (
    "link", "company", "title", "source_platform", "posted_hint", "email_jd_text", "fetched_jd", "jd_source",
    "fetch_error", "email_mid", "email_sender", "email_subject", "final_tier", "liveness", "liveness_detail",
)
POSTING_FLAGS = ("prefiltered", "analysis_errored", "from_correspondence")

POSTING = struct(
    *[(name, TEXT) for name in POSTING_TEXT_FIELDS], *[(name, FLAG) for name in POSTING_FLAGS],
    ("duplicates", T.ArrayType(DUPLICATE)), ("analysis", ANALYSIS),
)

# What every market or agency source yields.
SOURCE_FIELDS = ("link", "company", "title", "source_platform", "posted_hint", "fetched_jd", "email_jd_text", "jd_source")

BAND = struct(
    ("source", TEXT), ("occupation", TEXT), ("scope", TEXT), ("unit", TEXT), ("n", LONG), ("period", TEXT),
    ("caveat", TEXT), ("attribution", TEXT), ("is_ceiling", FLAG), ("is_predicted", FLAG), ("median", REAL),
    ("mean", REAL), ("p10", REAL), ("p25", REAL), ("p75", REAL), ("p90", REAL), ("query", T.MapType(TEXT, TEXT)),
)
