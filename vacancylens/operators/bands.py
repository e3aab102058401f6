"""Rate bands: exact distribution figures, ceiling bands, wage series, row constraints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.functions.text import blank, col
from vacancylens.session import cut

STATS = ("median", "mean", "p10", "p25", "p75", "p90")
_PROBABILITIES = (("p10", 0.10), ("p25", 0.25), ("median", 0.50), ("p75", 0.75), ("p90", 0.90))


def distribution(value: Column) -> list[Column]:
    """Six exact figures of a value with a small domain, such as hourly rates in half dollars.

    The aggregate keeps one counter per distinct value of its group; for prices use `exact_percentiles`.
    """
    wide = F.count(value) >= 2
    cuts = F.percentile(value, F.array(*[F.lit(p) for _, p in _PROBABILITIES]))
    out = []
    for i, (name, _) in enumerate(_PROBABILITIES):
        figure = F.bround(F.element_at(cuts, i + 1), 2)
        out.append((figure if name == "median" else F.when(wide, figure)).alias(name))
    return out + [F.bround(F.avg(value), 2).alias("mean")]


def exact_percentiles(df: DataFrame, groups: Sequence[str], value: str, buckets: int | None = None) -> DataFrame:
    """n, mean and exact percentiles per group for values with an open domain.

    Counts per distinct value combine before the shuffle and are dealt to ranges of (group, value) of about equal size,
    `buckets` of them or as many as the session's shuffle partitions. Prefix counts find the ranges that hold the wanted
    ranks, and only those are sorted. A range is no larger because values lie close together or one lies far off; no
    task sees a group that spans several ranges.
    """
    keys = list(groups)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    order = [F.col(k) for k in (*keys, "v")]
    dealt = counts.repartitionByRange(*order) if buckets is None else counts.repartitionByRange(buckets, *order)
    placed = cut(dealt.withColumn("cell", F.spark_partition_id()))
    per_cell = placed.groupBy(*keys, "cell").agg(F.sum("c").alias("cell_n"), F.sum(F.col("v") * F.col("c")).alias("cell_sum"))
    span = per_cell.groupBy(*keys).agg(
        F.sum("cell_n").alias("n"), F.bround(F.sum("cell_sum") / F.sum("cell_n"), 2).alias("mean"))
    upto = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    per_cell = per_cell.withColumn("before", F.coalesce(F.sum("cell_n").over(upto), F.lit(0)))

    position = [F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("n") - 1)).alias("at")) for name, p in _PROBABILITIES]
    wanted = span.select(*keys, F.explode(F.array(*position)).alias("w")).select(
        *keys, "w.name", (F.col("w.at") - F.floor("w.at")).alias("part"),
        F.explode(F.array(F.struct(F.lit("low").alias("end"), F.floor("w.at").alias("rank")),
                          F.struct(F.lit("high").alias("end"), F.ceil("w.at").alias("rank")))).alias("e"),
    ).select(*keys, "name", "part", "e.end", "e.rank")
    hits = wanted.join(per_cell, keys).filter(F.col("rank").between(F.col("before"), F.col("before") + F.col("cell_n") - 1))
    within = Window.partitionBy(*keys, "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    needed = placed.join(hits.select(*keys, "cell").distinct(), [*keys, "cell"], "left_semi")
    sorted_cells = needed.withColumn("inside", F.coalesce(F.sum("c").over(within), F.lit(0)))
    found = hits.join(sorted_cells, [*keys, "cell"]).filter(
        (F.col("rank") - F.col("before")).between(F.col("inside"), F.col("inside") + F.col("c") - 1))
    ends = found.groupBy(*keys, "name").agg(
        F.max(F.when(F.col("end") == "low", F.col("v"))).alias("low"),
        F.max(F.when(F.col("end") == "high", F.col("v"))).alias("high"), F.max("part").alias("part"))
    figure = F.bround(F.col("low") + (F.col("high") - F.col("low")) * F.col("part"), 2)
    wide = ends.withColumn("figure", figure).groupBy(*keys).pivot("name", [n for n, _ in _PROBABILITIES]).agg(F.max("figure"))
    out = span.select(*keys, "n", "mean").join(wide, keys)
    for name, _ in _PROBABILITIES:
        if name != "median":
            out = out.withColumn(name, F.when(F.col("n") >= 2, F.col(name)))
    return out.select(*keys, "n", *STATS)


def matches(min_experience: int | None = None, education: str | None = None, worksite: str | None = None) -> Column:
    """Dimension filter of ceiling-rate rows; a missing experience counts as zero years."""
    test = F.lit(True)
    if min_experience is not None:
        test = test & (F.coalesce(F.col("min_years_experience"), F.lit(0)) >= min_experience)
    if education is not None:
        test = test & (blank("education_level") == education)
    if worksite is not None:
        test = test & (blank("worksite") == worksite)
    return test


def ceiling_bands(rows: DataFrame, term: str = "term", price: str = "current_price", where: Column | None = None,
                  max_rows: int | None = None, caveat: str = "contract ceiling bill rates", attribution: str = "schedule") -> DataFrame:
    """One band per search term; a term whose rows all miss the filter keeps a band with n = 0.

    `max_rows` is the row count at which a landed pull was cut; a cut band says so in its caveat.
    """
    test = F.lit(True) if where is None else where
    terms = rows.groupBy(term).agg(F.count("*").alias("pulled"))
    kept = rows.filter(test)
    stats = exact_percentiles(kept, [term], price)
    truncated = F.lit(False) if max_rows is None else F.col("pulled") >= max_rows
    note = F.concat(F.lit(caveat), F.when(truncated, F.concat(
        F.lit(" This band was truncated at "), F.format_number(F.lit(max_rows or 0), 0),
        F.lit(" of the schedule's rows, which arrive cheapest-first, so it understates the true median."))
    ).otherwise(F.lit("")))
    return terms.join(stats, term, "left").select(
        F.col(term).alias("occupation"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), *STATS,
        note.alias("caveat"), F.lit(attribution).alias("attribution"), F.lit(True).alias("is_ceiling"))


SERIES_ID = r"^OEU([A-Z])(\d{7})000000(\d{6})(\d{2})$"


def wage_bands(occupations: DataFrame, areas: DataFrame, observations: DataFrame) -> DataFrame:
    """Bands from the latest observation of each series, one column per measure.

    occupations(occupation, code); areas(area, kind, area_code); observations(series_id, nth, year, value): nth counts
    from the latest, value is text with commas. A series id spells its area, occupation and measure, so both dimensions
    join on keys read from it and no product of dimensions is built.
    """
    measures = [F.struct(F.lit(d).alias("datatype"), F.lit(unit).alias("unit"), F.lit(m).alias("measure"))
                for unit, table in (("hour", fixed.WAGE_HOURLY), ("year", fixed.WAGE_ANNUAL)) for m, d in table.items()]
    part = [F.regexp_extract("series_id", SERIES_ID, i + 1).alias(n) for i, n in enumerate(("kind", "area_code", "code", "datatype"))]
    latest = observations.filter(F.col("nth") == 0).select(
        *part, F.replace("value", F.lit(","), F.lit("")).try_cast("double").alias("figure"), "year").filter(F.col("figure").isNotNull())
    known = F.filter(F.array(*measures), lambda m: m["datatype"] == F.col("datatype"))
    measured = latest.select("*", F.explode(known).alias("m")).select("kind", "area_code", "code", "figure", "year", "m.unit", "m.measure")
    got = measured.join(occupations, "code").join(areas, ["kind", "area_code"])
    keys = ["occupation", "area", "unit"]
    year = got.groupBy(*keys).agg(F.max(F.nullif("year", F.lit(""))).alias("year"))
    wide = got.groupBy(*keys).pivot("measure", list(STATS)).agg(F.max("figure"))
    period = F.coalesce(F.concat(F.lit("OEWS "), F.col("year"), F.lit(" annual estimates")), F.lit("OEWS, year unknown"))
    return wide.join(year, keys).select(*keys, *STATS, period.alias("period"))


BAND_RULES = (
    ("no caveat", "trim(coalesce(caveat, '')) = ''"),
    ("no attribution", "trim(coalesce(attribution, '')) = ''"),
    ("ceiling not stated", "is_ceiling and not contains(lower(caveat), 'ceiling')"),
    ("prediction not stated", "is_predicted and not contains(lower(caveat), 'predict')"),
)

ANALYSIS_RULES = (
    ("fit_score out of range", "not coalesce(analysis.fit_score between 0 and 100, true)"),
    ("intensity out of range", "not coalesce(analysis.intensity between 1 and 5, true)"),
    ("unknown verdict", "not coalesce(analysis.verdict in ('STRONG_FIT', 'FIT', 'LOW_FIT', 'SKIP'), true)"),
    ("unknown tier", "not coalesce(analysis.tier in ('PRIMARY', 'SECONDARY', 'OPPORTUNISTIC'), true)"),
)


def with_violations(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds `violations`, the names of the rules a row breaks."""
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(F.expr(test), F.lit(name)) for name, test in rules])))


def quarantine(df: DataFrame, rules: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(clean rows, broken rows with their violations)."""
    checked = with_violations(df, rules)
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)


def enforce(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Strict mode: a row that breaks a rule stops the job, naming the rule."""
    checked = with_violations(df, rules)
    broken = F.size("violations") > 0
    return checked.filter(F.when(broken, F.raise_error(F.array_join("violations", "; ")).cast("boolean")).otherwise(F.lit(True))).drop("violations")


def band_flags(is_ceiling: Column | str = "is_ceiling", is_predicted: Column | str = "is_predicted") -> Column:
    return F.array_compact(F.array(F.when(col(is_ceiling), F.lit(fixed.CEILING_FLAG)),
                                   F.when(col(is_predicted), F.lit(fixed.PREDICTED_FLAG))))


def run_bands(builders: Mapping[str, object], names: Sequence[str] | None = None, options: Mapping[str, dict] | None = None):
    """Build each named baseline; returns (frames by name, problems by name)."""
    frames, problems = {}, {}
    for name in builders if names is None else names:
        build = builders.get(name)
        if build is None:
            problems[name] = "no such baseline"
            continue
        try:
            frames[name] = build(**(options or {}).get(name, {}))
        except Exception as error:  # one baseline's failure must not stop the others
            problems[name] = f"{type(error).__name__}: {error}"
    return frames, problems
