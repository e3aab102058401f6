"""Posted pay: text to an hourly string, hourly string to a midpoint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.functions.text import UNICODE_NOCASE, any_contains, blank, filled, let

_RANGE = UNICODE_NOCASE + fixed.RATE_RANGE
_SINGLE = UNICODE_NOCASE + fixed.RATE_SINGLE
_NUMBER = UNICODE_NOCASE + fixed.RATE_NUMBER


def _amount(number: Column, k: Column) -> Column:
    value = F.replace(number, F.lit(","), F.lit("")).try_cast("double")
    return F.when(k != "", value * 1000).otherwise(value)


def _is_yearly(value: Column, unit: Column, k: Column) -> Column:
    u = F.lower(unit)
    return (
        F.when(any_contains(u, fixed.HOURLY_WORDS), F.lit(False))
        .when(any_contains(u, fixed.YEARLY_WORDS), F.lit(True))
        .otherwise((k != "") | (value >= 1000))
    )


def _hourly(value: Column, yearly: Column) -> Column:
    return F.when(yearly, value / fixed.HOURS_PER_YEAR).otherwise(value)


def _plausible(hourly: Column) -> Column:
    return hourly.between(fixed.RATE_FLOOR, fixed.RATE_CEILING)


def _dollars(hourly: Column) -> Column:
    return F.rint(hourly).cast("bigint").cast("string")


def _groups(text: Column, pattern: str, names: Sequence[str]) -> Column:
    """The first match's groups as a struct; the long text is searched once, the groups read from the match."""
    return let(
        F.regexp_extract(text, pattern, 0),
        lambda m: F.struct(m.alias("hit"),
                           *[F.regexp_extract(m, pattern, i + 1).alias(n) for i, n in enumerate(names)]),
    )


def _from_range(text: Column) -> Column:
    def read(g: Column) -> Column:
        lo, hi = _amount(g.lo, g.lo_k), _amount(g.hi, g.hi_k)
        yearly = _is_yearly(F.greatest(lo, hi), g.unit, F.concat(g.lo_k, g.hi_k))
        return F.struct((g.hit != "").alias("found"), _hourly(lo, yearly).alias("lo"), _hourly(hi, yearly).alias("hi"))

    hourly = let(_groups(text, _RANGE, ("lo", "lo_k", "hi", "hi_k", "unit")), read)
    return let(hourly, lambda h: F.when(
        h.found & _plausible(h.lo) & _plausible(h.hi) & (h.lo <= h.hi),
        F.concat(F.lit("$"), _dollars(h.lo), F.lit("-"), _dollars(h.hi), F.lit("/hr"))))


def _from_single(text: Column) -> Column:
    def read(g: Column) -> Column:
        value = _amount(g.num, g.k)
        return F.when(g.hit != "", _hourly(value, _is_yearly(value, g.unit, g.k)))

    hourly = let(_groups(text, _SINGLE, ("num", "k", "unit")), read)
    return let(hourly, lambda h: F.when(_plausible(h), F.concat(F.lit("$"), _dollars(h), F.lit("/hr"))))


def _from_lone_salary(text: Column) -> Column:
    def read(m: Column) -> Column:
        number, k = F.regexp_extract(m, _NUMBER, 1), F.regexp_extract(m, _NUMBER, 2)
        value = _amount(number, k)
        return F.when(number.contains(",") | (k != ""), _hourly(value, _is_yearly(value, F.lit(""), k)))

    hourly = F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0)), read)
    good = F.filter(hourly, _plausible)
    return F.when(F.size(good) > 0, F.concat(F.lit("$"), _dollars(F.try_element_at(good, F.lit(1))), F.lit("/hr")))


def extract_rate(text: Column | str) -> Column:
    """Hourly-equivalent rate a text states, like `$85-90/hr`, else null."""
    t = blank(text)
    return F.when(t.contains("$"), F.coalesce(_from_range(t), _from_single(t), _from_lone_salary(t)))


def rate_midpoint(rate: Column | str) -> Column:
    """Midpoint of an extracted rate string; null where the string is no rate."""
    def middle(r: Column) -> Column:
        lo = filled(F.regexp_extract(r, fixed.RATE_TEXT, 1)).try_cast("double")
        hi = filled(F.regexp_extract(r, fixed.RATE_TEXT, 2)).try_cast("double")
        return (lo + F.coalesce(hi, lo)) / 2

    return let(blank(rate), middle)
