"""Iterative graph operators: connected components and first-wins selection."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancylens.session import cut

log = logging.getLogger(__name__)


def _size_and_digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; a component is named for its smallest node.

    Alternates two steps: every node hands its larger neighbours to its smallest one, then its smaller ones. The number
    of rounds grows with the logarithm of the longest chain. Each step is a minimum per node, combined before the
    shuffle, and a join back; no node's neighbours are collected.
    """
    links = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    state = _size_and_digest(links)
    rounds = 0
    while True:
        rounds += 1
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.filter("b > a").join(low.withColumnRenamed("node", "a"), "a").select(F.col("m").alias("a"), "b")
        large = large.filter("a <> b").distinct()
        # Now each link reads (smaller, larger); the larger node hands its smaller neighbours to the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.array(
            F.struct(F.col("m").alias("a"), F.col("b").alias("b")),
            F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        links = cut(small.filter("a <> b").distinct())
        now = _size_and_digest(links)
        if now == state:
            break
        state = now
    log.info("components settled after %d rounds", rounds)
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def first_wins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Greedy selection in priority order, without a sequential pass: (node, leader).

    nodes(node, priority): smaller priority goes first, priorities are distinct. edges(hi, lo) joins neighbours, `hi`
    the one that goes first. A node that no earlier leader neighbours leads itself; any other follows its earliest
    leading neighbour. Per round, a node settles when its earliest neighbour that does not follow is a leader, or when
    no such neighbour is left. That equals the sequential rule, and the rounds are as many as the longest chain of
    waiting nodes; the earliest open node settles in every round, so they end. A round reads only the edges that the
    round before left open: edges into settled nodes, and from nodes that follow another, are gone.
    """
    edges = cut(edges.select("hi", "lo").distinct().join(
        nodes.select(F.col("node").alias("hi"), F.col("priority").alias("hi_priority")), "hi"))
    state = cut(nodes.select("node", F.lit(None).cast(nodes.schema["node"].dataType).alias("leader")).join(
        edges.select(F.col("lo").alias("node")).distinct().withColumn("waits", F.lit(True)), "node", "left").select(
        "node", F.when(F.col("waits"), F.col("leader")).otherwise(F.col("node")).alias("leader")))
    rounds = 0
    while not state.filter(F.col("leader").isNull()).isEmpty():
        rounds += 1
        hi_state = state.select(F.col("node").alias("hi"), F.col("leader").alias("hi_leader"))
        lo_open = state.filter(F.col("leader").isNull()).select(F.col("node").alias("lo"))
        edges = cut(edges.select("hi", "lo", "hi_priority").join(lo_open, "lo", "left_semi").join(hi_state, "hi").filter(
            F.col("hi_leader").isNull() | (F.col("hi_leader") == F.col("hi"))))
        first = edges.groupBy(F.col("lo").alias("node")).agg(
            F.min(F.struct("hi_priority", "hi", F.col("hi_leader").isNotNull().alias("leads"))).alias("first"))
        settled = (F.when(F.col("leader").isNotNull(), F.col("leader")).when(F.col("first").isNull(), F.col("node"))
                   .when(F.col("first.leads"), F.col("first.hi")))
        state = cut(state.join(first, "node", "left").select("node", settled.alias("leader")))
    log.info("first wins settled after %d rounds", rounds)
    return state
