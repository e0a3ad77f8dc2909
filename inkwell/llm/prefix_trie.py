"""The prefix trie of conversations, by refinement of a partition of them, turn by turn."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release, tune

#: Conversations that share opening turns, and how many turns at most are shared.
FAMILY, SHARED = 100, 6
#: Turns that a round splits by, at most: rounds take 1, 2, 4, ... turns.
MOST_TURNS = 64
#: Depths that one row of a chain is exploded to at once; bytes of a piece of joined ids.
CHAIN, PIECE = 4096, 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
KINDS = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _digest(x: Column) -> Column:
    """128 bits, so that turns and runs of turns are told apart without moving their texts."""
    return F.substring(F.unhex(F.sha2(x, 256)), 1, 16)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation get their place in it, as far as this partition has it."""
    from pyspark import TaskContext

    part, last, done = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_numpy()
        new = np.ones(len(ids), bool)
        new[1:] = ids[1:] != ids[:-1]
        new[0] = last is None or ids[0] != last
        starts = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
        pos = np.arange(len(ids)) - np.maximum(starts, 0) + np.where(starts < 0, done, 0)
        last, done = ids[-1], int(pos[-1]) + 1
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(pos, pa.int64()), pa.array(np.full(len(ids), part), pa.int64()), batch.column("symbol"), batch.column("chars")], ["conv_id", "pos", "part", "symbol", "chars"])
    release()


def _in_place(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, pos from 0, symbol, chars). A conversation can reach over many partitions of the sort."""
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("symbol")]
    line = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    line = scratch.keep(line.mapInArrow(_placed, "conv_id long, pos long, part long, symbol binary, chars long"))
    # One row for each range partition: which conversation goes on from the one before.
    edges = line.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "pos")).alias("last")).collect()
    before, over, carried = None, 0, []
    for e in sorted(edges, key=lambda e: e["part"]):
        base = over if e["first"] == before else 0
        if base:
            carried.append((e["part"], e["first"], base))
        before, over = e["last"]["conv_id"], e["last"]["pos"] + 1 + (base if e["last"]["conv_id"] == e["first"] else 0)
    if not carried:
        return line.drop("part")
    bases = line.sparkSession.createDataFrame(carried, "part long, conv_id long, base long")
    out = line.join(F.broadcast(bases), ["part", "conv_id"], "left")
    return out.select("conv_id", (F.col("pos") + F.coalesce("base", F.lit(0))).alias("pos"), "symbol", "chars")


def _shared() -> Column:
    return F.crc32(F.col("conv_id").cast("string")) % SHARED


def _rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, len) and (conv_id, depth, symbol, chars) of the conversations behind their family's opening turns."""
    line = _in_place(turns, scratch)
    convs = line.groupBy("conv_id").agg((F.max("pos") + 1).alias("n"))
    opening = line.where((F.col("pos") < SHARED - 1) & (F.col("conv_id") % FAMILY == 0))
    opening = opening.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "symbol", "chars"))).alias("opening"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(opening, "base", "left").withColumn("h", _shared())
    convs = convs.withColumn("opening", F.when(F.col("h") > 0, F.slice("opening", F.lit(1), F.greatest(F.col("h").cast("int"), F.lit(1)))))
    k = F.coalesce(F.size("opening"), F.lit(0))
    k = F.greatest(k, F.lit(0)).cast("long")
    convs = scratch.keep(convs.select("conv_id", "opening", k.alias("k"), (k + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    given = convs.select("conv_id", F.posexplode("opening").alias("i", "t")).select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), "t.symbol", "t.chars")
    own = line.where(F.col("pos") >= _shared()).join(convs.select("conv_id", "k"), "conv_id")
    own = own.select("conv_id", (F.col("pos") - _shared() + F.col("k") + 1).alias("depth"), "symbol", "chars")
    # Sorted by depth, so that a round's scan skips the pages of other depths.
    return convs.select("conv_id", "len"), scratch.keep(given.unionByName(own).sortWithinPartitions("depth"))


def _runs(active: DataFrame, rows: DataFrame, low: int, high: int) -> DataFrame:
    """One row for each active conversation and depth of a round, named by its run of turns since the round began."""
    own = rows.where((F.col("depth") > low) & (F.col("depth") <= high)).join(active, "conv_id")
    own = own.groupBy("conv_id", "class", "before", "len").agg(F.sort_array(F.collect_list(F.struct("depth", "symbol", "chars"))).alias("t"))
    upto = F.sequence(F.lit(1), F.size("t"))
    own = own.withColumn("keys", F.transform(upto, lambda j: _digest(F.aggregate(F.slice("t", 1, j), F.lit(b""), lambda a, x: F.concat(a, x["symbol"])))))
    own = own.withColumn("cum", F.transform(upto, lambda j: F.aggregate(F.slice("t", 1, j), F.col("before"), lambda a, x: a + x["chars"])))
    own = own.select("conv_id", "class", "len", "keys", "cum", F.posexplode("t").alias("j", "t"))
    parent = F.when(F.col("j") > 0, F.get("keys", F.col("j") - 1))
    return own.select("conv_id", "class", "len", "t.depth", F.get("keys", F.col("j")).alias("key"), parent.alias("parent_key"), "t.chars", F.get("cum", F.col("j")).alias("cum"))


def _linked(nodes: DataFrame) -> DataFrame:
    """A round's nodes with their parents; those of its first turn have the class for a parent."""
    above = nodes.select("class", (F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"), F.col("node").alias("parent"), F.col("n").alias("parent_n"))
    out = nodes.join(above, ["class", "depth", "parent_key"], "left")
    return out.select("depth", "node", F.coalesce("parent", "class").alias("parent"), F.coalesce("parent_n", F.lit(2)).alias("parent_n"), "n", "n_end", "chars", "cum", "len")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids sorted by node, joined by commas to pieces of bounded size."""
    for table in _bounded(batches):
        ids = table["conv_id"].to_numpy()
        same = (np.diff(table["depth"].to_numpy()) == 0) & (np.diff(table["node"].to_numpy()) == 0)
        cuts = np.flatnonzero(~same) + 1
        rows = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
            rows.append((table["depth"][a].as_py(), table["node"][a].as_py(), int(ids[a]), ",".join(map(str, ids[a:b].tolist()))))
        depth, node, first, piece = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(node, pa.int64()), pa.array(first, pa.int64()), pa.array(piece, pa.string())], ["depth", "node", "first", "piece"])
    release()


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows together as long as few, so that pieces are long."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= PIECE // 8:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's pieces, read one after the other."""
    at, state, rows = None, None, []
    for batch in batches:
        for depth, node, piece in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "piece"))):
            if (depth, node) != at:
                if at is not None:
                    rows.append((*at, state.hexdigest()))
                at, state = (depth, node), hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
        if rows:
            yield _hash_rows(rows)
            rows = []
    if at is not None:
        yield _hash_rows([(*at, state.hexdigest())])


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    depth, node, ends = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(node, pa.int64()), pa.array(ends, pa.string())], ["depth", "node", "ends_sha256"])


def _ends(members: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of members that end at a node. A node's ids are joined where the sort puts them, so that what meets in one task is few long pieces that stream through it."""
    order = ["depth", "node", "conv_id"]
    pieces = members.where("depth = len").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = pieces.mapInArrow(_pieces, "depth long, node long, first long, piece string")
    pieces = pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first")
    return pieces.mapInArrow(_hashed, "depth long, node long, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation c is rebuilt as the first crc32(c) % 6 turns of conversation c - c % 100
    and its own turns after as many. All conversations are one class at first. A round
    splits each class by the next turns (1, 2, 4, ... 64 of them, turn by turn), so a class
    at depth d is a node, named by its smallest member. A class of one member leaves the
    rounds: the rest of it is a chain without branches. Then members give
    back to all their nodes what they share with a smaller conversation and whether they
    end in a leaf of their own, from which sums over subtrees follow.

    Turns are ordered by turn, null first; turns of one number by a hash of role and text.
    Null role or text counts as empty. Rows without conv_id belong to no conversation;
    repeated rows are turns like all others. Other columns are ignored. An empty table
    gives an empty result. Texts stay where they are read, however long; their hashes move.
    """
    spark = conversations.sparkSession
    tune(spark)
    scratch = Scratch(spark)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("symbol"), F.length(text).cast("long").alias("chars"))
    convs, rows = _rebuilt(turns.where("conv_id is not null"), scratch)
    top = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("root"), F.count_if(F.expr("len = 0")).alias("n_end"), F.max("len").alias("len")).first()
    if not top["n"]:
        return spark.createDataFrame([], KINDS)
    single = spark.createDataFrame([(top["root"], 0, None, top["len"])] if top["n"] == 1 else [], "conv_id long, start long, parent long, len long")
    if top["n"] == 1:
        return _chains(single)

    root = F.lit(top["root"])
    first = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), root.alias("node"), F.lit(0).cast("long").alias("cum"), "len", F.lit(top["n_end"] == top["n"]).alias("whole"))
    members, nodes = [first], []
    active, low, step = convs.where("len > 0").select("conv_id", root.alias("class"), F.lit(0).cast("long").alias("before"), "len"), 0, 1
    while not active.isEmpty():
        high = low + step
        runs = scratch.keep(_runs(active, rows, low, high))
        kinds = [F.count("*").alias("n"), F.min("conv_id").alias("node"), F.count_if(F.expr("len = depth")).alias("n_end"), F.max("len").alias("len")]
        split = runs.groupBy("class", "depth", "key").agg(*kinds, *(F.min(c).alias(c) for c in ("parent_key", "chars", "cum")))
        split = scratch.keep(split)
        many = split.where("n > 1").select("class", "depth", "key", "node", (F.col("n") == F.col("n_end")).alias("whole"))
        own = scratch.keep(runs.join(many, ["class", "depth", "key"]).select("conv_id", "depth", "node", "cum", "len", "whole"))
        scratch.drop(runs)
        members.append(own)
        nodes.append(scratch.keep(_linked(split)))
        scratch.drop(split)
        active = own.where((F.col("depth") == high) & (F.col("len") > high)).select("conv_id", F.col("node").alias("class"), F.col("cum").alias("before"), "len")
        low, step = high, min(2 * step, MOST_TURNS)

    inner = spark.createDataFrame([(0, top["root"], None, top["n"], 0, 0)], "depth long, node long, parent long, n long, chars long, cum long")
    below = spark.createDataFrame([], "depth long, node long, k long")
    if nodes:
        linked = reduce(DataFrame.unionByName, nodes)
        inner = inner.unionByName(linked.where("n > 1").select("depth", "node", "parent", "n", "chars", "cum"))
        tops = linked.where("n = 1 and parent_n > 1")
        single = tops.select(F.col("node").alias("conv_id"), F.col("depth").alias("start"), "parent", "len")
        below = linked.where("parent_n > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count("*").alias("k"))
    held = reduce(DataFrame.unionByName, members)
    # What a conversation shares with a smaller one, and whether it alone names a leaf.
    ends, names = F.col("depth") == F.col("len"), F.col("conv_id") == F.col("node")
    own = held.groupBy("conv_id").agg(F.coalesce(F.max(F.when(~names, F.col("cum"))), F.lit(0)).alias("shared"), (~F.max(ends) | F.max(ends & names & F.col("whole"))).alias("leaf"))
    sums = held.select("conv_id", "depth", "node").join(scratch.keep(own), "conv_id").groupBy("depth", "node")
    sums = sums.agg(F.sum(F.when(~names, F.col("shared")).otherwise(0)).alias("shared"), F.count_if(F.expr("leaf")).alias("leaves"))
    out = inner.join(sums, ["depth", "node"], "left").join(below, ["depth", "node"], "left").join(_ends(held), ["depth", "node"], "left")
    saved = F.coalesce("shared", F.lit(0)) - (F.col("n") - 1) * (F.col("cum") - F.col("chars"))
    out = out.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.coalesce("k", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(0)).alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    return out.unionByName(_chains(single))


def _chains(single: DataFrame) -> DataFrame:
    """The nodes of conversations from where they are alone on to their ends."""
    out = single.withColumn("from", F.explode(F.sequence("start", "len", F.lit(CHAIN).cast("long"))))
    out = out.withColumn("depth", F.explode(F.sequence("from", F.least(F.col("from") + CHAIN - 1, F.col("len")))))
    last, one = F.col("depth") == F.col("len"), F.lit(1).cast("long")
    parent = F.when(F.col("depth") == F.col("start"), F.col("parent")).otherwise(F.col("conv_id"))
    ends = F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(NO_ENDS)
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), ends.alias("ends_sha256"))


def oracle_sql() -> str:
    """DuckDB SQL for the same rows: every prefix of every conversation as a list, and each pair of nodes of which one is above the other."""
    return f"""with crc as (select [list_reduce([i::bigint, 0, 1, 2, 3, 4, 5, 6, 7], lambda a, b: case when a & 1 = 1 then xor(3988292384, a >> 1) else a >> 1 end) for i in range(256)] as t),
clean as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
lists as (
  select conv_id, list({{'role': role, 'text': text}} order by turn nulls first, sha256(length(role) || ':' || role || text)) as l
  from clean group by conv_id),
own as (
  select conv_id, l, xor(4294967295, list_reduce(list_concat([4294967295::bigint], [ascii(c)::bigint for c in string_split(conv_id::varchar, '')]),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % {SHARED} as h
  from lists, crc),
rebuilt as (
  select o.conv_id, list_concat(case when o.h > 0 and b.l is not null then b.l[1:o.h] else [] end, o.l[o.h + 1:]) as l
  from own o left join own b on b.conv_id = o.conv_id - o.conv_id % {FAMILY}),
prefixes as (select conv_id, d, len(l) as n, l[1:d] as path from (select *, unnest(range(0, len(l) + 1)) as d from rebuilt)),
nodes as (
  select path, d, min(conv_id) as conv_id, count(*) as n_convs, coalesce(max(length(path[d].text)), 0) as chars,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d), '')) as ends_sha256
  from prefixes group by path, d),
kids as (select c.path, c.d, c.conv_id, p.conv_id as parent from nodes c join nodes p on p.d = c.d - 1 and p.path = c.path[1:c.d - 1]),
born as (select d - 1 as d, parent as conv_id, count(*) as n from kids group by all),
full_nodes as (select v.*, k.parent, coalesce(b.n, 0) as n_children from nodes v left join kids k on k.d = v.d and k.conv_id = v.conv_id left join born b on b.d = v.d and b.conv_id = v.conv_id),
below as (select v.d, v.conv_id, count(*) filter (u.n_children = 0) as n_leaves, sum((u.n_convs - 1) * u.chars) as saved
          from full_nodes v join full_nodes u on u.d >= v.d and u.path[1:v.d] = v.path group by all)
select v.conv_id, v.d::bigint as depth, v.parent as parent_conv_id, v.n_convs, v.n_children, b.n_leaves, b.saved::bigint as saved_tokens, v.ends_sha256
from full_nodes v join below b on b.d = v.d and b.conv_id = v.conv_id"""
