"""Conversation prefix trie: containers of suffixes burst by their next turn until each is small enough to be swept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancylens.llm.common import join_groups, saved, ship

LIMIT = 1 << 13
WINDOW = 8
SHARED = 5
BLOCK = 100
IDS = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """128 bits of the SHA-256 of a role and a text: equal ids are taken for equal turns."""
    who, body = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.unhex(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, body), 256)), 1, 16)


def places(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, part, pos, id, len, cum): every turn's place in its conversation, from 1, and the code points up to it.

    Turns are ordered by number, null first, then by id. They are dealt to ranges and counted there, so a conversation
    that holds most of the table is cut into parts; no task sees more than a range. Texts end here as ids.
    """
    rows = turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), turn_id(F.col(role), F.col(text)).alias("id"),
        F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("len"))
    dealt = saved(rows.repartitionByRange("conv", F.col("turn").asc_nulls_first(), "id").withColumn("part", F.spark_partition_id()), "trie-turns")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("conv", "part").agg(F.count("*").alias("n"), F.sum("len").alias("chars")).select(
        "conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("c0"))
    inside = Window.partitionBy("conv", "part").orderBy(F.col("turn").asc_nulls_first(), "id").rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(starts, ["conv", "part"]).select(
        "conv", "part", (F.col("n0") + F.count("*").over(inside)).alias("pos"), "id", "len", (F.col("c0") + F.sum("len").over(inside)).alias("cum"))


def _chars(turns: Column) -> Column:
    return F.aggregate(turns, F.lit(0).cast("long"), lambda s, t: s + t["len"])


def rebuilt(turns: DataFrame, block: int = BLOCK, shared: int = SHARED, **columns) -> DataFrame:
    """(conv, part, depth, id, len, cum): conversations that open with turns of the first one of their block.

    Conversation c starts with the first h turns of conversation c - c % block (all if it has fewer, none if it is not
    there) and goes on with its own turns after its first h; h is the CRC-32 of c in decimals modulo shared + 1. Every
    conversation has a row of depth 0 without a turn.
    """
    own = saved(places(turns, **columns), "trie-places")
    convs = saved(own.groupBy("conv").agg(
        F.collect_set("part").alias("parts"),
        F.array_sort(F.collect_list(F.when(F.col("pos") <= shared, F.struct("pos", "id", "len")))).alias("first")), "trie-conversations")
    plan = convs.withColumn("base", F.col("conv") - F.col("conv") % block).join(
        convs.select(F.col("conv").alias("base"), F.col("first").alias("given")), "base", "left").withColumn(
        "h", (F.crc32(F.col("conv").cast("string").cast("binary")) % (shared + 1)).cast("int")).select(
        "conv", "parts", "h", F.slice("first", F.lit(1), F.col("h")).alias("lost"),
        F.coalesce(F.slice("given", F.lit(1), F.col("h")), F.slice("first", F.lit(1), F.lit(0))).alias("given"))
    none = F.lit(0).cast("long")
    roots = plan.select("conv", F.lit(-1).alias("part"), none.alias("depth"), F.lit(None).cast("binary").alias("id"), none.alias("len"), none.alias("cum"))
    opening = plan.select("conv", "given", F.posexplode("given").alias("i", "t")).select(
        "conv", F.lit(-1).alias("part"), (F.col("i") + 1).cast("long").alias("depth"), "t.id", "t.len",
        _chars(F.slice("given", F.lit(1), F.col("i") + 1)).alias("cum"))
    moved = plan.select("conv", F.explode("parts").alias("part"), "h", F.size("given").alias("opens"), (_chars(F.col("given")) - _chars(F.col("lost"))).alias("more"))
    rest = own.join(moved, ["conv", "part"]).filter(F.col("pos") > F.col("h")).select(
        "conv", "part", (F.col("pos") - F.col("h") + F.col("opens")).cast("long").alias("depth"), "id", "len", (F.col("cum") + F.col("more")).alias("cum"))
    return roots.unionByName(opening).unionByName(rest)


def _id_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (a, b, length, conv) to runs of at most a few thousand ids of one sequence, written as text."""
    at, ids = None, []

    def run() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": [at[0]], "b": [at[1]], "length": [at[2]], "first": [ids[0]], "n": [len(ids)],
                                           "ids": [",".join(map(str, ids))]}, RUN)

    for batch in batches:
        for *key, conv in zip(*(batch[c].to_pylist() for c in ("a", "b", "length", "conv"))):
            if key != at or len(ids) >= IDS:
                if ids:
                    yield run()
                at, ids = key, []
            ids.append(conv)
    if ids:
        yield run()


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order to one row per sequence: smallest conversation, how many there are, SHA-256 of all their ids."""
    at, state, first, n, out = None, None, 0, 0, []

    def flush() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), DIGEST.types)], schema=DIGEST)
        out.clear()
        return rows

    for batch in batches:
        for *key, conv, count, ids in zip(*(batch[c].to_pylist() for c in ("a", "b", "length", "first", "n", "ids"))):
            if key != at:
                if at is not None:
                    out.append((first, n, state.hexdigest()))
                at, state, first, n = key, hashlib.sha256(ids.encode()), conv, count
            else:
                state.update(b"," + ids.encode())
                n += count
            if len(out) >= IDS:
                yield flush()
    if at is not None:
        out.append((first, n, state.hexdigest()))
        yield flush()


RUN = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("length", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
DIGEST = pa.schema([("seq", pa.int64()), ("weight", pa.int64()), ("digest", pa.string())])


def sequences(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sequences of rows(conv, part, depth, id, len, cum) and their turns.

    Returns (seq, weight, digest, parts, length, total), a row per sequence named for its smallest conversation, and
    (seq, part, depth, id, len, cum, ends). Conversations are told apart by 128 bits that add up from their turns and
    places, so that copies fold before anything else is done and a long conversation needs no task of its own. The ids
    of one sequence pass a single task in order, thousands to a row: a digest over them has no other order.
    """
    lanes = [F.bit_xor(F.xxhash64(F.lit(7), "depth", "id")).alias("a"), F.bit_xor(F.xxhash64("id", "depth", F.lit(11))).alias("b")]
    sums = saved(rows.groupBy("conv").agg(*lanes, F.max("depth").alias("length"), F.max("cum").alias("total"), F.collect_set("part").alias("parts")), "trie-sums")
    key = ["a", "b", "length"]
    runs = sums.select(*key, "conv").repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv").mapInArrow(
        _id_runs, "a long, b long, length long, first long, n long, ids string")
    found = runs.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(_id_digests, "seq long, weight long, digest string")
    kept = saved(found.join(sums.select(F.col("conv").alias("seq"), "parts", "length", "total"), "seq"), "trie-distinct")
    own = kept.select("seq", F.explode("parts").alias("part"), "length", "digest")
    turns = rows.withColumnRenamed("conv", "seq").join(own, ["seq", "part"]).select(
        "seq", "part", "depth", "id", "len", "cum", F.when(F.col("depth") == F.col("length"), F.col("digest")).alias("ends"))
    return kept, saved(turns, "trie-sequences")


NODE = ("container binary, head boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, ends_sha256 string")
NODE_TYPES = pa.schema([("container", pa.binary()), ("head", pa.bool_())] + [
    (n, pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [("ends_sha256", pa.string())])


def swept(start: int, above: int | None, members: list[tuple[int, int, list, list, str | None]]) -> list[list]:
    """The nodes of one container, whose members share their first turn, as rows of `NODE` without container and head.

    members: (seq, weight, ids, lengths, digest). In sorted order the nodes two neighbours share are their common
    prefix: nodes beyond it are complete, are closed and handed to their parents.
    """
    members = sorted(members, key=lambda m: m[2][1:])
    nodes: list[list] = []  # conv, depth, parent, n, children, leaves, saved, ends, len
    path: list[int] = []

    def close() -> None:
        node = nodes[path.pop()]
        node[6] += (node[3] - 1) * node[8]
        node[5] = node[5] or 1
        if path:
            up = nodes[path[-1]]
            up[0] = min(up[0], node[0])
            up[3] += node[3]
            up[4] += 1
            up[5] += node[5]
            up[6] += node[6]

    last: list = []
    for seq, weight, ids, lengths, digest in members:
        same = 0
        while same < min(len(last), len(ids)) and last[same] == ids[same]:
            same += 1
        while len(path) > same:
            close()
        for i in range(same, len(ids)):
            nodes.append([seq, start + i, path[-1] if path else None, 0, 0, 0, 0, NO_ENDS, lengths[i]])
            path.append(len(nodes) - 1)
        end = nodes[path[-1]]
        end[0], end[3], end[7] = min(end[0], seq), end[3] + weight, digest
        last = ids
    while path:
        close()
    return [[n[0], n[1], above if n[2] is None else nodes[n[2]][0], *n[3:8]] for n in nodes]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (container, seq, depth, ...) to the nodes of each container in turn."""
    at, start, above, members, out = None, 0, None, [], []

    def flush() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), NODE_TYPES.types)], schema=NODE_TYPES)
        out.clear()
        return rows

    def finish() -> None:
        out.extend([at, row[1] == start, *row] for row in swept(start, above, [tuple(m) for m in members]))

    for batch in batches:
        for container, seq, weight, begins, upper, turn, length, ends in zip(
                *(batch[c].to_pylist() for c in ("container", "seq", "weight", "start", "above", "id", "len", "ends"))):
            if container != at:
                if members:
                    finish()
                at, start, above, members = container, begins, upper, []
            if not members or members[-1][0] != seq:
                members.append([seq, weight, [], [], None])
            members[-1][2].append(turn)
            members[-1][3].append(length)
            members[-1][4] = ends
        if len(out) >= IDS:
            yield flush()
    if members:
        finish()
    if out:
        yield flush()


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def trie(rows: DataFrame, limit: int = LIMIT, window: int = WINDOW) -> DataFrame:
    """The nodes of the prefix trie over rows(conv, part, depth, id, len, cum), a depth-0 row for every conversation.

    Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256). All sequences
    start in one container. A container with more than `limit` turns left bursts: its members share a stem up to the
    first place where they differ, and the next turn there gives each its new container. Stems longer than the window
    are passed in windows that double. A container with one sequence is nothing but a stem, however long. All others are
    small: they are sent out whole, sorted and swept. Stems need no sort: their nodes are rows of a member's turns, and
    what lies below comes from the containers under it. Rounds are as many as burst containers lie below each other,
    and the logarithm of the longest stem.
    """
    ship(rows.sparkSession)
    kept, turns = sequences(rows)
    none = F.lit(0).cast("long")
    members = kept.select("seq", "weight", "length", "total", "digest", "parts", F.unhex(F.lit("00")).alias("container"), none.alias("start"),
                          none.alias("before"), F.array().cast("array<binary>").alias("path"), F.lit(None).cast("long").alias("above"))
    closed, chains, bursts, rounds = [], [], [], 0
    while True:
        sized = saved(members.groupBy("container").agg(
            F.min("seq").alias("first"), F.sum("weight").alias("n_convs"), F.count("*").alias("sequences"),
            F.sum(F.col("length") - F.col("start") + 1).alias("left")), "trie-containers")
        known = saved(join_groups(members, sized, "container", "sequences"), "trie-members")
        small = F.col("left") <= limit
        chains.append(known.filter(F.col("sequences") == 1))
        closed.append(known.filter((F.col("sequences") > 1) & small))
        open_ = known.filter((F.col("sequences") > 1) & ~small)
        span = open_.agg(F.min("start").alias("low"), F.max("start").alias("high")).first()
        if span["low"] is None:
            break
        reach = window << rounds
        rounds += 1
        look = open_.select("seq", F.explode("parts").alias("part"), "container", "start", "sequences")
        seen = saved(turns.filter(F.col("depth").between(span["low"], span["high"] + reach)).join(look, ["seq", "part"]).filter(
            F.col("depth").between(F.col("start"), F.col("start") + reach)).drop("part"), "trie-seen")
        levels = seen.filter("depth > start").groupBy("container", "depth").agg(
            F.count("*").alias("c"), F.max("sequences").alias("sequences"), F.min("id").alias("low"), F.max("id").alias("high"),
            F.min(F.col("cum") - F.col("len")).alias("cum"))
        agreed = (F.col("c") == F.col("sequences")) & (F.col("low") == F.col("high"))
        place = F.struct("depth", "cum")
        turning = saved(levels.groupBy("container").agg(
            F.coalesce(F.min(F.when(~agreed, place)), F.max(place)).alias("p"), F.max("sequences").alias("sequences")).select(
            "container", F.col("p.depth").alias("next"), F.col("p.cum").alias("until"), "sequences"), "trie-turning")
        met = join_groups(seen.drop("sequences"), turning, "container", "sequences").filter(F.col("depth").between(F.col("next") - 1, F.col("next")))
        met = saved(met.select("seq", "container", "depth", "next", "id", "len", "cum", "ends"), "trie-met")
        step = met.filter("depth = next").select("seq", "id", F.col("next").alias("start_"), (F.col("cum") - F.col("len")).alias("before_"))
        members = open_.join(step, "seq").select(
            "seq", "weight", "length", "total", "digest", "parts", F.unhex(F.md5(F.concat("container", "id"))).alias("container"),
            F.col("start_").alias("start"), F.col("before_").alias("before"), F.concat("path", F.array("container")).alias("path"), F.col("first").alias("above"))
        members = saved(members, "trie-children")
        ending = met.filter((F.col("depth") == F.col("next") - 1) & F.col("ends").isNotNull()).select("container", "ends")
        head = open_.filter(F.col("seq") == F.col("first")).join(turning.drop("sequences"), "container").join(ending, "container", "left")
        bursts.append(saved(head, "trie-bursts"))

    chain = _union(chains)
    sweep = _union(closed).select("container", "seq", F.explode("parts").alias("part"), "weight", "start", "above")
    inside = turns.join(sweep, ["seq", "part"]).filter(F.col("depth") >= F.col("start"))
    nodes = saved(inside.repartition("container").sortWithinPartitions("container", "seq", "depth").select(
        "container", "seq", "weight", "start", "above", "id", "len", "ends").mapInArrow(_sweep, NODE), "trie-swept")
    alone = chain.select(
        "seq", "parts", "start", F.col("length").alias("stop"), "above", "n_convs", none.alias("kids"), F.lit(1).cast("long").alias("leaves"),
        none.alias("below"), F.col("total").alias("until"), F.col("digest").alias("ends"))
    out = nodes.select(OUT)
    if bursts:
        burst = _union(bursts)
        stem = (F.col("n_convs") - 1) * (F.col("until") - F.col("before"))
        tops = nodes.filter("head").select("container", "n_leaves", "saved_tokens").join(
            _union(closed).filter(F.col("seq") == F.col("first")).select("container", "path"), "container")
        parts = tops.select("container", "path", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")).unionByName(
            chain.select("container", "path", F.lit(1).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * (F.col("total") - F.col("before"))).alias("saved"))).unionByName(
            burst.select("container", "path", none.alias("leaves"), stem.alias("saved")))
        up = parts.select(F.explode(F.transform("path", lambda c, i: F.struct(c.alias("container"), (i == F.size("path") - 1).cast("long").alias("kid")))).alias("u"), "leaves", "saved")
        sums = up.groupBy("u.container").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("below"), F.sum("u.kid").alias("kids"))
        stems = burst.join(sums, "container").select(
            "seq", "parts", "start", (F.col("next") - 1).alias("stop"), "above", "n_convs", "kids", "leaves", "below", "until", "ends")
        alone = alone.unionByName(stems)
    drawn = turns.drop("ends").join(alone.withColumn("part", F.explode("parts")).drop("parts"), ["seq", "part"]).filter(
        F.col("depth").between(F.col("start"), F.col("stop")))
    last = F.col("depth") == F.col("stop")
    return out.unionByName(drawn.select(
        F.col("seq").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("start"), F.col("above")).otherwise(F.col("seq")).alias("parent_conv_id"),
        "n_convs", F.when(last, F.col("kids")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("below") + (F.col("n_convs") - 1) * (F.col("until") - F.col("cum") + F.col("len"))).alias("saved_tokens"),
        F.coalesce(F.when(last, F.col("ends")), F.lit(NO_ENDS)).alias("ends_sha256")))


OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversation_trie(turns: DataFrame, limit: int = LIMIT, window: int = WINDOW, **columns) -> DataFrame:
    """The nodes of the trie over rebuilt conversations; see `rebuilt` and `trie`.

    A null role or text is empty; rows without a conversation take no part; turns of one number, repeated rows included,
    are turns of their own, ordered by id; an empty table gives no nodes; other columns are not read; whole texts are
    hashed and never moved.
    """
    return trie(saved(rebuilt(turns, **columns), "trie-rows"), limit, window)


ORACLE_SQL = """with t as (select conv_id as c, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] as id,
    length(coalesce(text, '')) as len from conversations where conv_id is not null),
  own as (select c, list({'id': id, 'len': len} order by turn nulls first, id) as own from t group by c),
  hs as (select c, own, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, z: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint) % 6 as h from own),
  seqs as (select hs.c, list_concat(case when h = 0 or b.own is null then [] else b.own[1:h] end, hs.own[h + 1:]) as s
    from hs left join own b on b.c = hs.c - hs.c % 100),
  pre as (select c, s, len(s) as n, unnest(range(0, len(s) + 1)) as d from seqs),
  k as (select c, d, n, array_to_string(list_transform(s[1:d], lambda x: x.id), ',') as k,
    array_to_string(list_transform(s[1:d - 1], lambda x: x.id), ',') as up, case when d = 0 then 0 else s[d].len end as len from pre),
  nodes as (select k, d, any_value(up) as up, any_value(len) as len, min(c) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (n = d), '')) as ends from k group by k, d),
  kids as (select up as k, d - 1 as d, count(*) as n_children from nodes where d > 0 group by all),
  full_ as (select nodes.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * len as own from nodes left join kids using (k, d)),
  anc as (select distinct a.k as ak, a.d as ad, b.k as bk, b.d as bd from k a join k b on a.c = b.c and a.d <= b.d),
  sums as (select ak as k, ad as d, sum(own)::bigint as saved_tokens, count(*) filter (n_children = 0) as n_leaves
    from anc join full_ on full_.k = bk and full_.d = bd group by all)
  select f.conv_id, f.d::bigint as depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children::bigint as n_children, n_leaves, saved_tokens,
    f.ends as ends_sha256 from full_ f join sums using (k, d) left join nodes p on p.k = f.up and p.d = f.d - 1"""
