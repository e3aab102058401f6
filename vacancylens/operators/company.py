"""Entity history: fuzzy company match, applied and skip lookups, same text under another name."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancylens import fixed
from vacancylens.functions.identity import company_key, same_company
from vacancylens.functions.text import blank, col
from vacancylens.operators.textsets import common_runs, contained, keyed_texts, lowered, perhaps_in
from vacancylens.session import cut

log = logging.getLogger(__name__)

_GRAM = 5
# Overlaps that are looked for in turn, before the threshold.
_LEVELS = (1.0, 0.8)


def _grams(c: Column) -> Column:
    last = F.greatest(F.length(c) - (_GRAM - 1), F.lit(1))
    return F.when(F.length(c) >= _GRAM, F.array_distinct(F.transform(
        F.sequence(F.lit(1), last), lambda i: F.substring(c, i, F.lit(_GRAM))))).otherwise(F.array().cast("array<string>"))


def _shuffled(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """A join on grams. Size estimates miss what `explode` adds, so without a hint a table of grams would pass for a small one and be broadcast."""
    return left.hint("merge").join(right.hint("merge"), "gram", how)


def matching_keys(probes: DataFrame, entries: DataFrame) -> DataFrame:
    """(probe_key, entry_key) of company keys that name the same company.

    probes(probe_key) and entries(entry_key) hold distinct keys. Equal keys join directly. Containment goes through
    character 5-grams: if the shorter key lies in the longer, so do all its 5-grams, and the one that fewest keys of the
    other side hold is what it joins on; a key with a gram that no other holds lies in none. The candidates are then
    checked.
    """
    p = probes.select("probe_key").filter(F.col("probe_key") != "").distinct()
    e = entries.select("entry_key").filter(F.col("entry_key") != "").distinct()
    equal = p.join(e, F.col("probe_key") == F.col("entry_key"))
    p_grams = p.select("probe_key", F.explode(_grams(F.col("probe_key"))).alias("gram"))
    e_grams = e.select("entry_key", F.explode(_grams(F.col("entry_key"))).alias("gram"))

    def rarest(side: DataFrame, key: str, other: DataFrame) -> DataFrame:
        df = other.groupBy("gram").agg(F.count("*").alias("df"))
        return _shuffled(side, df, "left").groupBy(key).agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("g")).filter(
            "g.df > 0").select(key, F.col("g.gram").alias("gram"))

    shorter_probe = _shuffled(rarest(p_grams, "probe_key", e_grams), e_grams).select("probe_key", "entry_key")
    shorter_entry = _shuffled(rarest(e_grams, "entry_key", p_grams), p_grams).select("probe_key", "entry_key")
    inside = shorter_probe.unionByName(shorter_entry).filter(
        (F.col("probe_key") != F.col("entry_key")) & same_company(F.col("probe_key"), F.col("entry_key")))
    return equal.select("probe_key", "entry_key").unionByName(inside).distinct()


def match_companies(probes: DataFrame, rows: DataFrame, company: str = "company") -> DataFrame:
    """Rows of `rows` with the probe they belong to. probes(probe); a row may belong to several probes."""
    asked = probes.select("probe", company_key("probe").alias("probe_key"))
    keyed = rows.withColumn("entry_key", company_key(company))
    pairs = matching_keys(asked, keyed)
    return asked.join(pairs, "probe_key").join(keyed, "entry_key").drop("probe_key", "entry_key")


def applied_hits(probes: DataFrame, applied: DataFrame) -> DataFrame:
    """Applied rows of each probe company, by name or by the host of their link; says which matched.

    applied(row, company, title, apply_date, url, confidence, note).
    """
    by_name = match_companies(probes, applied).withColumn("matched_on", F.lit("company"))
    site = F.regexp_replace(F.lower(F.regexp_extract(blank("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), "[^a-z0-9]", "")
    hosts = applied.withColumn("site", site)
    asked = probes.select("probe", company_key("probe").alias("probe_key")).filter(F.length("probe_key") >= _GRAM)
    sites = hosts.select("site").filter(F.length("site") >= _GRAM).distinct()
    grams = sites.select("site", F.explode(_grams(F.col("site"))).alias("gram"))
    keys = asked.select("probe_key").distinct()
    probe_grams = keys.select("probe_key", F.explode(_grams(F.col("probe_key"))).alias("gram"))
    df = grams.groupBy("gram").agg(F.count("*").alias("df"))
    one = _shuffled(probe_grams, df, "left").groupBy("probe_key").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("g")).select("probe_key", F.col("g.gram").alias("gram"))
    inside = _shuffled(one, grams).filter(F.col("site").contains(F.col("probe_key"))).select("probe_key", "site")
    by_url = asked.join(inside, "probe_key").join(hosts, "site").drop("probe_key", "site").withColumn("matched_on", F.lit("url"))
    fresh = by_url.join(by_name.select("probe", "row"), ["probe", "row"], "left_anti")
    return by_name.unionByName(fresh)


def skiplist_hits(probes: DataFrame, entries: DataFrame) -> DataFrame:
    """Skiplist entries of each probe company with their reason."""
    return match_companies(probes, entries)


def scored_history(rows: DataFrame, by: list[str], run: str = "run", ord_col: str = "ord") -> DataFrame:
    """Per company and lower-case title: judgment of the first run seen, first and last date, newest first by sort order."""
    date = F.substring(col(run), 1, 10)
    keyed = rows.withColumn("title_key", F.lower(blank("title")))
    first = F.min_by(F.struct("company", "title", "link", F.col("analysis.verdict").alias("verdict"),
                              F.col("analysis.fit_score").alias("fit_score")), F.struct(F.col(run), F.col(ord_col)))
    out = keyed.groupBy(*by, "title_key").agg(first.alias("f"), F.min(date).alias("first_seen"), F.max(date).alias("last_seen"))
    return out.select(*by, "title_key", "f.*", "first_seen", "last_seen")


def same_text(rows: DataFrame, threshold: float = fixed.SAME_TEXT_OVERLAP, text: str = "jd_text", ord_col: str = "ord",
              probes: DataFrame | None = None) -> DataFrame:
    """Best text overlap between each probed company and every other: (company_key, other_key, overlap, ord, other_ord).

    probes(probe) are the companies asked about; without them every company is, and the result has a row per pair of
    companies that share text.

    Copies of one text inside a company collapse first, and again across companies before texts are compared, so a text
    that a third of all rows carry enters once. Companies that are spellings of each other do not count as other.

    A pair of companies needs its best overlap only, so high overlaps are looked for first, in all texts. Once they
    give a company its best with every other, its texts drop out, and lower overlaps are looked for among the rest; at
    once for the lowest, where the first level settles less than half of the pairs.
    """
    posted = rows.select(F.col(ord_col).alias("ord"), company_key("company").alias("key"), F.xxhash64(ord_col).alias("row"), lowered(text)).filter(F.col("key") != "")
    holders = cut(keyed_texts(posted.drop("row")).filter("n > 0").groupBy("text_key", "key").agg(F.min("ord").alias("ord")))
    keys = cut(holders.select("key").distinct())
    asked_keys = keys if probes is None else cut(keys.join(probes.select(company_key("probe").alias("key")).distinct(), "key", "left_semi"))
    spelled = cut(matching_keys(asked_keys.withColumnRenamed("key", "probe_key"), keys.withColumnRenamed("key", "entry_key")))
    asked = holders if probes is None else holders.join(asked_keys, "key", "left_semi")
    left = asked.select(F.col("text_key").alias("a"), F.col("key").alias("company_key"), "ord")
    right = holders.select(F.col("text_key").alias("b"), F.col("key").alias("other_key"), F.col("ord").alias("other_ord"))

    def met(both: DataFrame) -> DataFrame:
        """The best overlap, over pairs of texts given both ways, of each pair of companies that hold some."""
        pairs = left.join(both, "a").join(right, "b").filter(~same_company(F.col("company_key"), F.col("other_key")))
        return pairs.groupBy("company_key", "other_key").agg(
            F.min(F.struct((-F.col("score")).alias("s"), F.col("other_ord"), F.col("ord"))).alias("best"))

    def unsettled(found: DataFrame, side: str, name: str, mine: DataFrame, theirs: DataFrame) -> DataFrame:
        """Which of `mine` still miss some of `theirs`: neither found nor a spelling."""
        done = found.select(F.col(side).alias("key")).unionByName(spelled.select(F.col(name).alias("key"))).groupBy("key").agg(F.count("*").alias("n"))
        return mine.join(done, "key", "left").filter(F.coalesce("n", F.lit(0)) < theirs.count()).select("key")

    itself = holders.groupBy("text_key").agg(F.count("*").alias("n")).filter("n > 1").select(
        F.col("text_key").alias("a"), F.col("text_key").alias("b"), F.lit(1.0).alias("score"))
    levels = [x for x in _LEVELS if x > threshold] + [threshold]
    common = common_runs(posted)
    best, open_texts = None, posted
    while levels:
        level = levels.pop(0)
        pairs = cut(contained(open_texts.select("row", "text"), level, common))
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
        # What a higher level found is better than anything below it.
        best = cut(met(both.unionByName(itself)) if best is None else best.unionByName(met(both).join(best, ["company_key", "other_key"], "left_anti")))
        if not levels:
            break
        if 2 * best.count() < keys.count() * asked_keys.count() - spelled.count():
            levels = levels[-1:]
        missing = cut(unsettled(best, "company_key", "probe_key", asked_keys, keys).unionByName(
            unsettled(best, "other_key", "entry_key", keys, asked_keys)).distinct())
        if missing.isEmpty():
            break
        log.info("same text: %d companies are not settled at %s", missing.count(), level)
        open_texts = perhaps_in(posted, F.xxhash64("key"), missing.select(F.xxhash64("key").alias("number")))
    return best.select("company_key", "other_key", F.bround(-F.col("best.s"), 2).alias("overlap"),
                       F.col("best.ord").alias("ord"), F.col("best.other_ord").alias("other_ord"))
