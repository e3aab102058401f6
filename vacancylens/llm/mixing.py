"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancylens.llm.common import saved, uniform, unused

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
LIMIT = 2.0
SHARDS = 64
BLOCK_DOCS = 32
SUPER_BLOCKS = 256
PART_WORDS = 8_000_000
SEED = 71
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """Sources as joinable keys: a null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Adds `target` to sources(src, source, words, ...): the words that each source is to give.

    Sources by code point, null last, weigh `weights`, repeating, and share `share` times all words. A target stops at
    `limit` times its source's words and the excess is reshared by weight until none is above. Raising a common level
    until the budget is spent gives the same: sources in order of the level that fills them, the first that the level
    left by the earlier ones does not fill sets it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(order) - 1) % len(weights) + 1)
    filled = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    most = F.lit(float(limit)) * F.col("words")
    rows = sources.withColumn("weight", weight).withColumn("full_at", most / F.col("weight"))
    rows = rows.withColumn("level", (
        F.lit(float(share)) * F.sum("words").over(everything)
        - F.coalesce(F.sum(most).over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ) / F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything)
    return rows.withColumn("first", first).withColumn(
        "target", F.coalesce(F.least(most, F.col("weight") * F.col("first.level")), most)).drop("full_at", "level", "first")


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _walk(start: Column, stop: Column, step: Column, zero: Column, merge) -> Column:
    ks = F.when((stop - start) * step >= 0, F.sequence(start, stop, step)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(ks, zero, merge)


def hypergeometric(population: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` items are marked ones, by inversion of a uniform number.

    The support is walked upwards from the mode and then downwards, with weights relative to the mode's, so no factorial
    is needed; a first walk sums the weights, a second one stops where the sum reaches u's share. Beyond twelve
    standard deviations the weights vanish in double precision and are left out.
    """
    one, none = F.lit(1).cast("long"), F.lit(None).cast("long")

    def ends(v: Column) -> Column:
        """v with the mode and the first and last number of marked items that are walked."""
        N, K, n = v["population"], v["marked"], v["drawn"]
        low, high = F.greatest(F.lit(0).cast("long"), n - (N - K)), F.least(n, K)
        mode = F.least(high, F.greatest(low, F.floor((n + 1) * ((K + 1) / (N + 2))).cast("long")))
        share = K / F.greatest(N, one)
        reach = F.ceil(12 * F.sqrt(n * share * (1 - share) * ((N - n) / F.greatest(N - 1, one)))).cast("long") + 12
        return _let(F.struct(mode.alias("mode"), reach.alias("reach")), lambda m: F.struct(
            N.alias("population"), K.alias("marked"), n.alias("drawn"), v["u"].alias("u"), m["mode"].alias("mode"),
            F.least(high, m["mode"] + m["reach"]).alias("top"), F.greatest(low, m["mode"] - m["reach"]).alias("bottom")))

    def sample(v: Column) -> Column:
        N, K, n, mode = v["population"], v["marked"], v["drawn"], v["mode"]

        def up(k: Column) -> Column:
            return (K - k + 1) * (n - k + 1) / (k * (N - K - n + k))

        def down(k: Column) -> Column:
            return (k + 1) * (N - K - n + k + 1) / ((K - k) * (n - k))

        def total(ratio):
            return lambda acc, k: _let(acc["w"] * ratio(k), lambda w: F.struct(w.alias("w"), (acc["s"] + w).alias("s")))

        zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
        sums = F.struct(_walk(mode + 1, v["top"], one, zero, total(up))["s"].alias("above"),
                        _walk(mode - 1, v["bottom"], -one, zero, total(down))["s"].alias("below"))

        def choose(s: Column) -> Column:
            goal = v["u"] * (s["above"] + s["below"] + 1)

            def pick(ratio):
                return lambda acc, k: _let(acc["w"] * ratio(k), lambda w: F.struct(
                    w.alias("w"), (acc["s"] + w).alias("s"),
                    F.when(acc["k"].isNull() & (acc["s"] + w > goal), k).otherwise(acc["k"]).alias("k")))

            begun = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("s"), F.when(goal < 1, mode).otherwise(none).alias("k"))
            after = F.struct(F.lit(1.0).alias("w"), (s["above"] + 1).alias("s"), none.alias("k"))
            return F.coalesce(_walk(mode + 1, v["top"], one, begun, pick(up))["k"],
                              _walk(mode - 1, v["bottom"], -one, after, pick(down))["k"], mode)

        return _let(sums, choose)

    given = F.struct(population.alias("population"), marked.alias("marked"), drawn.alias("drawn"), u.alias("u"))
    return _let(_let(given, ends), sample)


def splitting_tree(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(src, ends): for quotas(src, quota), the running sum over the shards of the source's draws in each of them.

    One row starts with all quotas and the range of all shards. At every level a range is halved: its left part gets
    its share of the draws, and how many of each source is a multivariate hypergeometric number, drawn source by source
    from what the range holds. Rows hold one number per source, so their size grows with the sources alone.
    """
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("src", F.col("quota").cast("long").alias("quota")))).alias("all")).select(
        F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.col("all.src").alias("srcs"), F.col("all.quota").alias("held"))
    for _ in range(max(0, (shards - 1).bit_length())):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        all_held = F.aggregate("held", F.lit(0).cast("long"), lambda s, x: s + x)
        nodes = nodes.withColumn("mid", mid).withColumn("total", all_held)
        share = F.floor(F.col("total") * ((F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo")))).cast("long")

        def give(acc, quota):
            drawn = hypergeometric(acc["rest"], quota, acc["room"], uniform(
                F.lit(seed), F.col("lo"), F.col("hi"), F.size(acc["out"])))
            return _let(drawn, lambda k: F.struct((acc["rest"] - quota).alias("rest"), (acc["room"] - k).alias("room"),
                                                  F.concat(acc["out"], F.array(k)).alias("out")))

        left = F.aggregate("held", F.struct(F.col("total").alias("rest"), share.alias("room"),
                                            F.array().cast("array<bigint>").alias("out")), give)["out"]
        whole = F.col("hi") - F.col("lo") == 1
        nodes = nodes.withColumn("left", F.when(whole, F.col("held")).otherwise(left)).withColumn("child", F.explode(
            F.when(whole, F.array(F.struct("lo", "hi", F.col("left").alias("held")))).otherwise(F.array(
                F.struct("lo", F.col("mid").alias("hi"), F.col("left").alias("held")),
                F.struct(F.col("mid").alias("lo"), "hi", F.zip_with("held", "left", lambda a, b: a - b).alias("held")))))
        ).select("child.lo", "child.hi", "srcs", "child.held")
    leaves = nodes.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("srcs", "held")).alias("x")).select(
        "shard", F.col("x.srcs").alias("src"), F.col("x.held").alias("n"))
    ends = F.sum("n").over(Window.partitionBy("src").orderBy("shard"))
    return leaves.withColumn("end", ends).groupBy("src").agg(
        F.array_sort(F.collect_list(F.struct("shard", "end"))).alias("e")).select("src", F.col("e.end").alias("ends"))


def _weight(docs: str) -> Column:
    """Words of an array of documents with all their copies."""
    return F.aggregate(docs, F.lit(0).cast("long"), lambda s, d: s + d["size"] * d["copies"])


def _summed(blocks: DataFrame, amount: str, name: str) -> DataFrame:
    """Adds `name`: the sum of `amount` over the source's blocks before this one, in the order of their spots."""
    inner = Window.partitionBy("src", "sup").orderBy("spot", "block")
    earlier = Window.partitionBy("src").orderBy("sup").rowsBetween(Window.unboundedPreceding, -1)
    groups = blocks.groupBy("src", "sup").agg(F.sum(amount).alias("_in")).select(
        "src", "sup", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before"))
    return blocks.withColumn("_inner", F.sum(amount).over(inner) - F.col(amount)).join(groups, ["src", "sup"]).withColumn(
        name, F.col("_before") + F.col("_inner")).drop("_before", "_inner")


def _taken(blocks: DataFrame, item: str, seed: int) -> DataFrame:
    """Adds `fits` and `got`: all documents of the blocks that fit the room, and of the next block, longest first, those that fit."""
    longest = F.array_sort("docs", lambda a, b: F.when(a["size"] > b["size"], -1).when(a["size"] < b["size"], 1).when(
        F.xxhash64(F.lit(seed), a["key"]) < F.xxhash64(F.lit(seed), b["key"]), -1).when(
        F.xxhash64(F.lit(seed), a["key"]) > F.xxhash64(F.lit(seed), b["key"]), 1).otherwise(0))

    def fit(acc, d):
        takes = (d["size"] > 0) & (d["size"] * d["copies"] <= acc["room"])
        return F.struct((acc["room"] - F.when(takes, d["size"] * d["copies"]).otherwise(0)).alias("room"),
                        F.when(takes, F.concat(acc["got"], F.array(d))).otherwise(acc["got"]).alias("got"))

    none = F.array().cast(item)
    picked = F.aggregate(longest, F.struct((F.col("room") - F.col("start")).alias("room"), none.alias("got")), fit)["got"]
    return blocks.withColumn("fits", F.col("start") + F.col("held") <= F.col("room")).withColumn("got", F.when(
        F.col("fits"), F.col("docs")).when(F.col("start") <= F.col("room"), picked).otherwise(none))


def allocate(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT,
             shards: int = SHARDS, block_docs: int = BLOCK_DOCS, seed: int = SEED,
             key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, copies, source_size, target, shards): one shard number for every time a document is taken.

    Documents of a source fall into blocks by a hash of their key, and blocks stand in the order of another hash. A
    source's target is met by whole passes over its blocks, then by blocks in their order while they fit, then by single
    documents of the next block, longest first while they fit. The room that is left goes on to the blocks behind in the
    same way, less the documents that no longer fit, until every untaken document is longer than it. Whole blocks, and
    those single documents block by block, are draws; they are the source's quota. The splitting tree
    deals quotas to the shards, and each shard takes its number of draws from the source's permuted draws, so that no
    draw is in two shards.

    Equal rows (key, source and size) are one row with their number in `copies`, and all of them are taken alike. A null
    text has no words, a null source is a source, a null key a key; documents without words are in blocks like others
    and add nothing. An empty table gives an empty result. Only these three columns are read. Sources are assumed to be
    some thousands at most, as one row of the tree holds a number for each.
    """
    items = saved(docs.select(
        F.col(key).alias("key"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"),
    ).groupBy("key", "source", "size").agg(F.count("*").alias("copies")), "mix-items").withColumn("src", _source_key(F.col("source")))
    sources = saved(targets(items.groupBy("src", "source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("words"), F.sum("copies").alias("docs")), weights, share, limit), "mix-sources")
    sources = sources.withColumn("passes", F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("long"))
    sources = sources.withColumn("rest", F.col("target") - F.col("passes") * F.col("words"))

    cells = F.greatest(F.lit(1), F.ceil(F.col("docs") / block_docs)).cast("long")
    blocks = saved(items.join(sources.select("src", cells.alias("cells")), "src").withColumn(
        "block", F.pmod(F.xxhash64(F.lit(seed), "src", "key"), F.col("cells"))).groupBy("src", "block").agg(
        F.first("cells").alias("cells"), F.sum(F.col("size") * F.col("copies")).alias("held"),
        F.collect_list(F.struct("size", "copies", "key")).alias("docs")), "mix-blocks")
    spot = uniform(F.lit(seed + 1), F.col("src"), F.col("block"))
    blocks = blocks.withColumn("spot", spot).withColumn(
        "sup", F.floor(F.col("spot") * F.ceil(F.col("cells") / SUPER_BLOCKS)).cast("long"))

    # Ranks and running sums in the permuted order: inside a group of blocks, plus the sums of the groups before it.
    placed = _summed(_summed(blocks.withColumn("one", F.lit(1).cast("long")), "one", "rank"), "held", "start").drop("one").join(
        sources.select("src", "source", "words", "target", "passes", "rest"), "src")
    item = blocks.schema["docs"].dataType.simpleString()
    placed = saved(_taken(placed.withColumn("room", F.col("rest")), item, seed), "mix-placed")

    # What is left of a target goes to the blocks behind, for documents that still fit, until no document does.
    left, more = placed, []
    while True:
        left = left.join(left.groupBy("src").agg((F.first("room") - F.sum(_weight("got"))).alias("now")), "src").filter("not fits").select(
            "src", "block", "sup", "spot", F.col("now").alias("room"), F.filter(F.array_except("docs", "got"), lambda d: (
                d["size"] > 0) & (d["size"] * d["copies"] <= F.col("now"))).alias("docs")).filter(F.size("docs") > 0)
        left = saved(left.withColumn("held", _weight("docs")), f"mix-left-{len(more)}")
        if left.isEmpty():
            break
        left = saved(_taken(_summed(left, "held", "start"), item, seed), f"mix-more-{len(more)}")
        more.append(left.filter(F.size("got") > 0).select("src", "block", F.col("got").alias("more")))
    taken = placed
    if more:  # no block gives twice: what it keeps is longer than the room
        taken = placed.join(reduce(DataFrame.unionByName, more), ["src", "block"], "left").withColumn(
            "got", F.concat("got", F.coalesce("more", F.array().cast(item))))

    # A block that the last pass takes documents of is one draw: `place` counts such blocks before it.
    taken = saved(_summed(taken.withColumn("part", (F.col("fits") | (F.size("got") > 0)).cast("long")), "part", "place").select(
        "src", "source", "words", "target", "passes", "rank", "part", "place", "docs", "got"), "mix-units")
    counted = taken.groupBy("src").agg(F.first("passes").alias("passes"), F.count("*").alias("n"), F.sum("part").alias("parts"))
    quotas = counted.withColumn("quota", F.col("passes") * F.col("n") + F.col("parts"))
    quotas = saved(quotas, "mix-quotas")
    dealt = quotas.join(saved(splitting_tree(quotas, shards, seed), "mix-tree"), "src").select("src", "n", "ends")

    def shard_of(unit: Column) -> Column:
        return F.size(F.filter("ends", lambda end: end <= unit))

    rounds = F.when(F.col("passes") > 0, F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)).otherwise(F.array().cast("array<bigint>"))
    whole = F.transform(rounds, lambda j: shard_of(j * F.col("n") + F.col("rank")))
    last = F.array(shard_of(F.col("passes") * F.col("n") + F.col("place")))
    return taken.join(dealt, "src").select(
        "source", "words", "target", whole.alias("whole"), last.alias("last"), "got", F.explode("docs").alias("d"),
    ).select(
        F.col("d.key").alias(key), F.col("source").alias(source), F.col("d.size").alias("size"), F.col("d.copies").alias("copies"),
        F.col("words").alias("source_size"), "target",
        F.when(F.array_contains("got", F.col("d")), F.concat("whole", "last")).otherwise(F.col("whole")).alias("shards"))


def draw(docs: DataFrame, allocation: DataFrame, part_words: int = PART_WORDS, seed: int = SEED,
         key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed documents with all their columns: a row for every time a document is taken, each shard shuffled locally.

    A shard's rows are dealt by their place in its random order to partitions of about `part_words` words and sorted by
    it there. A document without words, null or empty, is never taken; null keys and sources are values like any other;
    rows that share key, source and size are taken alike; whole texts move with their row; an empty table gives an empty
    result, and columns of any name pass unchanged.
    """
    k, src, size, dealt, words_of, time, shard, spot, part = unused(
        docs, "_key", "_source", "_size", "_shards", "_words", "_time", "_shard", "_spot", "_part")
    shards = [r["shards"] for r in allocation.agg(F.max(F.array_max("shards")).alias("shards")).collect()]
    total = allocation.agg(F.sum(F.col("size") * F.col("copies") * F.size("shards"))).first()[0] or 0
    n_shards = (shards[0] or 0) + 1
    parts = max(1, -(-total // (part_words * n_shards)))
    took = allocation.filter(F.size("shards") > 0).select(
        F.col(key).alias(k), F.col(source).alias(src), F.col("size").alias(size), F.col("shards").alias(dealt))
    rows = docs.select("*", words(F.col(text)).alias(words_of)).join(took, (
        F.col(key).eqNullSafe(F.col(k))) & F.col(source).cast("string").eqNullSafe(F.col(src)) & (F.col(words_of) == F.col(size)))
    rows = rows.select(*docs.columns, F.posexplode(dealt).alias(time, shard)).withColumn(
        spot, uniform(F.lit(seed + 2), F.col(shard), F.col(time), F.col(key)))
    return rows.withColumn(part, F.floor(F.col(spot) * parts)).repartition(
        n_shards * parts, shard, part).sortWithinPartitions(shard, spot).select(*docs.columns)
