"""MinHash near-dedup by a signature-coordinate inverted join.

A text's signature has K coordinates. It is posted under each (coordinate, value) pair.
Texts whose Jaccard similarity is J agree in K*J coordinates on average; two with T
common pairs of K share one of the K - T + 1 rarest pairs of either (ordered by corpus
frequency), so only these prefixes are merged; the T - 1 most frequent pairs of a text,
whose lists are the long ones, are skipped. Collisions of a candidate are then counted
over a longer, narrower signature, and pairs above its match threshold are retained and
confirmed on full shingle sets.

A list is merged in two rounds. First each member is held against the list's head, the
member that shares most of its pairs with other texts: what a group of copies was made
from, or is nearest to it. That joins up large groups by as many pairs as they have
members. Then the lists whose members are still in more than one component are compared.
In long ones a member stays only if enough of its shingles occur in other components for
any link at all, and sizes bound whom it can be linked with. The members of a list's main
component lie in blocks by size, and only the others visit the blocks that their sizes
allow. What passes the count is packed, meets its shingle sets there, and only confirmed
links that join two components leave, fewer than there are members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RowFilter, Scratch, groups, map_arrow, mix, row_hash, tune
from .components import connected_components
from .shingles import shingle_sets

COORDINATES = 32
#: At a similarity of 0.75 a pair agrees in fewer coordinates with a probability of 2e-6.
MATCHES = 12
#: Coordinates of one byte for counting, and the matches that a candidate needs; it is missed with a probability of 3e-7.
COUNTERS, COUNTED = 256, 156
#: Members of a list that one block holds, on average, and texts in half a package; members of other blocks that visit one at a time.
BLOCK, VISITORS = 256, 2048

_FACTORS = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_SMALL = (mix(np.arange(1001, 1001 + 1024, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The smallest value of each of ``coordinates`` hash functions over a non-empty set."""
    out = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 4096):
        np.minimum(out, (shingles[a : a + 4096][None, :] * _FACTORS[:coordinates, None]).min(axis=1), out=out)
    return out


def counters(shingles: np.ndarray, size: int = COUNTERS) -> np.ndarray:
    """One byte for each of ``size`` further hash functions' smallest values."""
    out = np.full(size, np.iinfo(np.uint32).max, np.uint32)
    half = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    for a in range(0, len(half), 1024):
        np.minimum(out, (half[a : a + 1024][None, :] * _SMALL[:size, None]).min(axis=1), out=out)
    return (mix(out.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)


def _name(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a shingle set."""
    code = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(code[:8], "little", signed=True), int.from_bytes(code[8:], "little", signed=True)


def _signed(width: int):
    def sign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [(len(s), *_name(s), signature(s).tobytes(), counters(s).tobytes()) if len(s) else (0, None, None, None, None) for s in shingle_sets(batch.column("text"), width)]
        n, low, high, sig, cnt = zip(*rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in (n, low, high)), pa.array(sig, pa.binary()), pa.array(cnt, pa.binary()), batch.column("row_hash")], ["doc_id", "n", "low", "high", "sig", "counters", "row_hash"])

    return sign


_SALT = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _matrix(column: list[bytes], kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, width)


def _posted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    values = _matrix(batch.column("sig").to_pylist(), np.uint64, COORDINATES)
    keys = mix(values ^ _SALT[None, :]).view(np.int64).ravel()
    again = pa.array(np.repeat(np.arange(batch.num_rows), COORDINATES))
    yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("node").take(again), pa.array(np.tile(np.arange(COORDINATES, dtype=np.int32), batch.num_rows))], ["key", "node", "c"])


def _counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    a, b = (_matrix(batch.column(c).to_pylist(), np.uint8, COUNTERS) for c in ("counters_a", "counters_b"))
    keep = pa.array((a == b).sum(axis=1) >= COUNTED)
    yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def _packed(percent: int):
    """Candidates across components, in packages of few nodes; a pair is taken in the list of its lowest common prefix coordinate."""

    def flush(pairs: list[np.ndarray]) -> pa.RecordBatch:
        found = np.concatenate(pairs)  # node, node, comp, comp, matches
        nodes, at = np.unique(found[:, :2], return_inverse=True)
        at = at.reshape(-1, 2)
        comp = np.empty(len(nodes), np.int64)
        comp[at[:, 0]], comp[at[:, 1]] = found[:, 2], found[:, 3]
        best = np.argsort(-found[:, 4], kind="stable")
        return pa.RecordBatch.from_arrays([pa.array([nodes.tolist()], pa.list_(pa.int64())), pa.array([comp.tolist()], pa.list_(pa.int64())), pa.array([at[best].astype("<u4").tobytes()], pa.binary())], ["nodes", "comps", "pairs"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names = [], set()
        for table in groups(batches, ["key", "block", "part"]):
            node, comp, n, most, mask = (table[c].to_numpy() for c in ("node", "comp", "n", "foreign", "mask"))
            visits, main = (table[c].to_numpy(zero_copy_only=False) for c in ("visits", "main"))
            part, c = table["part"][0].as_py(), table["c"][0].as_py()
            at_home = np.flatnonzero(~visits)
            if not len(at_home):
                continue
            cnt, sig = _matrix(table["counters"].to_pylist(), np.uint8, COUNTERS), _matrix(table["sig"].to_pylist(), np.uint64, COORDINATES)
            below = (np.uint64(1) << np.arange(COORDINATES, dtype=np.uint64)).astype(np.int64)[:c]
            # Members of a block meet in its first part only; of two that visit each other one comes.
            for x in range(len(node)) if part == 0 else np.flatnonzero(visits).tolist():
                ys = at_home[main[at_home] | (node[at_home] > node[x])] if visits[x] else at_home[at_home > x]
                total = n[ys] + n[x]
                ys = ys[(comp[ys] != comp[x]) & (100 * np.minimum(n[ys], n[x]) >= percent * np.maximum(n[ys], n[x])) & ((100 + percent) * np.minimum(most[ys], most[x]) >= percent * total)]
                if not len(ys):
                    continue
                matches = (cnt[ys] == cnt[x][None, :]).sum(axis=1)
                ys, matches = ys[matches >= COUNTED], matches[matches >= COUNTED]
                if len(ys) and c:
                    before = ((sig[ys, :c] == sig[x, :c][None, :]) & (((mask[ys] & mask[x])[:, None] & below[None, :]) != 0)).any(axis=1)
                    ys, matches = ys[~before], matches[~before]
                if len(ys):
                    held.append(np.stack([np.full(len(ys), node[x]), node[ys], np.full(len(ys), comp[x]), comp[ys], matches], axis=1))
                    names.update(node[ys].tolist(), [int(node[x])])
                if len(names) >= 2 * BLOCK:
                    yield flush(held)
                    held, names = [], set()
        if held:
            yield flush(held)

    return block


def _linked(percent: int):
    """Of a package's pairs, best first, the confirmed links that join two components."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["uid"]):
            rows = table.to_pydict()
            head = next((k for k, p in enumerate(rows["pairs"]) if p is not None), None)
            if head is None:
                continue
            nodes, comps = rows["nodes"][head], rows["comps"][head]
            sets = {node: np.frombuffer(s, np.uint64) for node, s in zip(rows["node"], rows["shingles"]) if s is not None}
            values = np.unique(np.concatenate(list(sets.values()))) if sets else np.zeros(0, np.uint64)
            places = {node: np.searchsorted(values, s) for node, s in sets.items()}
            root = {c: c for c in comps}

            def find(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            pairs, mark, marked, out = np.frombuffer(rows["pairs"][head], "<u4").reshape(-1, 2).tolist(), np.zeros(len(values), bool), None, []
            for x, y in pairs:
                p, q = find(comps[x]), find(comps[y])
                if p == q:
                    continue
                if marked != x:
                    if marked is not None:
                        mark[places[nodes[marked]]] = False
                    mark[places[nodes[x]]] = True
                    marked = x
                shared, total = int(mark[places[nodes[y]]].sum()), len(places[nodes[x]]) + len(places[nodes[y]])
                if 100 * shared >= percent * (total - shared):
                    root[max(p, q)] = min(p, q)
                    out.append((nodes[x], nodes[y]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return link


def _sets(width: int):
    def sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = list(shingle_sets(batch.column("text"), width))
        low, high = zip(*(_name(s) for s in found))
        yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["low", "high", "shingles"])

    return sets


def _each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of some sets."""
    for a in range(0, batch.num_rows, 64):
        some = batch.slice(a, 64)
        found = [np.frombuffer(s, np.int64) for s in some.column("shingles").to_pylist()]
        sizes = [len(s) for s in found]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), *(pa.array(np.repeat(some.column(c).to_numpy(), sizes)) for c in ("node", "comp"))], ["shingle", "node", "comp"])


def _intersected(percent: int):
    def intersect(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = []
        for x, y in zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return intersect


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, node, row_hash.

    Documents are linked with 100 * intersection >= percent * union of their shingle
    sets; component_id is the smallest doc_id reachable and kept = (doc_id =
    component_id). ``node`` identifies the shingle set. Null, empty and blank texts have
    no shingles, are linked with nothing and are kept. A null doc_id is never a
    representative unless its whole component has none: component_id is then null and
    kept true. Repeated rows fall into one component. Other columns are ignored; texts
    are read whole. ``percent`` may not be below 75, for which the match thresholds are set.
    """
    if percent < 75:
        raise ValueError("the match thresholds are set for 75 percent and more")
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.keep(map_arrow(docs.withColumn("row_hash", row_hash()), _signed(width), "doc_id long, n long, low long, high long, sig binary, counters binary, row_hash long"))
    nodes = signed.where("low is not null").groupBy("low", "high").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc"), F.first("sig").alias("sig"), F.first("counters").alias("counters"))
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()))

    posted = map_arrow(nodes.select("node", "sig"), _posted, "key long, node long, c int")
    lists = posted.groupBy("key").agg(F.count("*").alias("length")).where("length > 1")
    ranked = posted.join(lists, "key").select("*", F.expr("row_number() over (partition by node order by length, key)").alias("r"), F.expr("count(*) over (partition by node)").alias("m"))
    # Of K pairs, K - m are nobody else's and come first; the prefix has K - T + 1, so m - T + 1 of the others.
    prefix = ranked.where(F.col("r") <= F.col("m") - MATCHES + 1).select("key", "node", "c", "m")
    prefix = scratch.keep(prefix.join(nodes.select("node", "n"), "node"))

    fits = lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m)  # noqa: E731  more differing sizes can't be so similar
    heads = prefix.groupBy("key").agg(F.max(F.struct("m", "node", "n")).alias("head"), F.count("*").alias("length")).where("length > 1")
    heads = heads.select("key", F.col("head.node").alias("a"), F.col("head.n").alias("n_a"))
    pairs = prefix.join(heads, "key").where((F.col("node") != F.col("a")) & fits(F.col("n"), F.col("n_a"))).select("a", F.col("node").alias("b")).distinct()
    cnt = nodes.select("node", "counters")
    pairs = pairs.join(cnt.withColumnsRenamed({"node": "b", "counters": "counters_b"}), "b").join(cnt.withColumnsRenamed({"node": "a", "counters": "counters_a"}), "a")
    pairs = scratch.keep(map_arrow(pairs.select("a", "b", "counters_a", "counters_b"), _counted, "a long, b long"))

    def sets_of(ends: DataFrame) -> DataFrame:
        """The shingle sets of some nodes; only texts that may be theirs are read by Python and move."""
        ends = scratch.keep(nodes.select("node", "low", "high", "doc").join(ends.distinct(), "node", "left_semi"))
        texts = RowFilter(ends, "doc").some(docs, "doc_id").where("text is not null")
        found = map_arrow(texts.select("text"), _sets(width), "low long, high long, shingles binary")
        return scratch.keep(found.join(ends.select("node", "low", "high"), ["low", "high"]).dropDuplicates(["node"]).select("node", "shingles"))

    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    both = both.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    links = scratch.keep(map_arrow(both.select("a", "b", "of_a", "of_b"), _intersected(percent), "a long, b long"))
    comps = scratch.keep(connected_components(links, scratch))
    scratch.drop(sets, pairs)

    members = scratch.keep(prefix.join(comps, "node", "left").select("key", "c", "node", "n", F.coalesce("component", "node").alias("comp")))
    masks = members.groupBy("node").agg(F.expr("bit_or(shiftleft(1L, c))").alias("mask"))
    mixed = members.groupBy("key").agg(F.count("*").alias("length"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("length > 2 and lo <> hi")
    left = scratch.keep(members.join(mixed.select("key", "length"), "key"))
    home = {"foreign": "n", "main": "true", "block": "0", "part": "0", "visits": "false"}
    met = left.where(F.col("length") <= BLOCK).select("key", "c", "node", "n", "comp", *(F.expr(e).alias(c) for c, e in home.items()))
    long = left.where(F.col("length") > BLOCK)
    if not long.isEmpty():
        met = met.unionByName(_blocks(long, sets_of, percent, scratch))
    met = met.join(masks.join(nodes.select("node", "sig", "counters"), "node"), "node")
    met = met.repartition("key", "block", "part").sortWithinPartitions("key", "block", "part")
    packed = scratch.keep(met.mapInArrow(_packed(percent), "nodes array<long>, comps array<long>, pairs binary").withColumn("uid", F.monotonically_increasing_id()))
    scratch.drop(prefix, members, left)
    if not packed.isEmpty():
        wanted = packed.select("uid", F.explode("nodes").alias("node"))
        sets = sets_of(wanted.select("node"))
        parts = wanted.join(sets.select("node", "shingles"), "node").select("uid", "node", "shingles")
        parts = parts.unionByName(packed, allowMissingColumns=True)
        parts = parts.repartition("uid").sortWithinPartitions("uid")
        links = scratch.keep(links.unionByName(parts.mapInArrow(_linked(percent), "a long, b long")))
        comps = scratch.keep(connected_components(links, scratch))
        scratch.drop(sets)
    scratch.drop(packed)

    known = nodes.select("node", "low", "high", "doc").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("doc").alias("component_id"))
    known = known.join(least, "component").select("node", "low", "high", "component_id")
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "low", "high", "row_hash").join(known, ["low", "high"], "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "node", "row_hash")


def _blocks(long: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, scratch: Scratch) -> DataFrame:
    """The members of long lists (key, c, node, n, comp, length) in the blocks where they are compared; no link is lost.

    A member's link to another component lies in its ``foreign`` shingles, those that
    occur in other components: linked texts share percent / (100 + percent) of their
    sizes' sum, so its foreign shingles bound the size of whom it can be linked with, and
    one for whom no size is left goes. Blocks hold neighbouring sizes. Members outside of
    the list's main component visit the blocks of the sizes they can be linked with.
    """
    hot = long.select("node", "comp").distinct()
    each = scratch.keep(map_arrow(sets_of(hot.select("node")).join(hot, "node"), _each, "shingle long, node long, comp long"))
    shared = each.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("shingle")
    foreign = each.join(shared, "shingle").groupBy("node").agg(F.count("*").alias("foreign"))
    smallest = long.groupBy("key").agg(F.min("n").alias("smallest"))
    able = long.drop("length").join(foreign, "node").join(smallest, "key").withColumn("to", F.expr(f"foreign * {100 + percent} div {percent} - n")).withColumn("from", F.expr(f"(n * {percent} + 99) div 100"))
    able = scratch.keep(able.where("to >= greatest(smallest, `from`)"))
    scratch.drop(each)

    counted = able.groupBy("key", "comp").agg(F.count("*").alias("k"))
    main = counted.groupBy("key").agg(F.max(F.struct("k", "comp")).alias("main"), F.sum("k").alias("length"))
    main = main.where("main.k < length").select("key", F.col("main.comp").alias("of"), "length", F.ceil(F.col("length") / BLOCK).alias("blocks"), F.ceil((F.col("length") - F.col("main.k")) / VISITORS).alias("parts"))
    # A row for each size in a list, with the members before it.
    sizes = able.groupBy("key", "n").agg(F.count("*").alias("k")).withColumn("ahead", F.expr("sum(k) over (partition by key order by n) - k"))
    placed = sizes.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "ahead", "k"))).alias("sizes")).join(main, "key")
    placed = able.join(placed, "key").withColumn("main", F.col("comp") == F.col("of"))
    own = "filter(sizes, s -> s.n = n)[0]"
    placed = placed.withColumn("own", F.expr(f"({own}.ahead + pmod(xxhash64(node), {own}.k)) * blocks div length"))
    placed = placed.withColumn("first", F.expr("array_min(transform(filter(sizes, s -> s.n >= `from`), s -> s.ahead)) * blocks div length"))
    placed = placed.withColumn("last", F.expr("(array_max(transform(filter(sizes, s -> s.n <= `to`), s -> s.ahead + s.k)) - 1) * blocks div length"))
    placed = placed.select("key", "c", "node", "n", "comp", "foreign", "main", "own", "parts", "first", "last")
    residents = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", "c", "node", "n", "comp", "foreign", "main", F.col("own").alias("block"), "part", F.lit(False).alias("visits"))
    visitors = placed.where("not main and first <= last").withColumn("block", F.explode(F.sequence("first", "last"))).where("block <> own")
    visitors = visitors.select("key", "c", "node", "n", "comp", "foreign", "main", "block", F.expr("pmod(xxhash64(node, 1), parts)").alias("part"), F.lit(True).alias("visits"))
    return residents.unionByName(visitors)
