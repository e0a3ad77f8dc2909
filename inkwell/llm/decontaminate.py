"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on seeds, runs of MIN_MATCH tokens. For each
pair that shares enough of them, the longest matches are marked as tiles again and again,
by running Karp-Rabin over the tokens not yet marked, until none of MIN_MATCH tokens is
left. The share of the item's tokens in tiles, in whatever order they stand, decides.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, mix, powers_to, row_hash, runs, span_hashes, spans, strings, tune

MIN_MATCH = 4
COVERAGE = 0.5
#: Bytes of distinct benchmark texts that are held against the documents at a time.
BLOCK_BYTES = 8 << 20
#: Items that share a seed up to which it joins them to a document by itself.
COMMON = 16

#: Tokens are runs of letters, digits and all that is not ASCII.
TOKEN = np.zeros(256, bool)
TOKEN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def token_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, token hashes, edges of the rows' tokens) of runs of lower-cased texts."""
    data, offsets = strings(pc.utf8_lower(texts.cast(pa.large_string())))
    for first, end in runs(offsets):
        part, at = data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        starts, ends, row = spans(TOKEN[part], at)
        yield first, span_hashes(part, starts, ends), np.searchsorted(row, np.arange(end - first + 1))


def window_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` tokens."""
    n = max(0, len(tokens) - width + 1)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + n]
    return mix(out)


class _Line:
    """Tokens of which any run's hash comes from one running sum, and which of them are free."""

    def __init__(self, tokens: np.ndarray, free: np.ndarray):
        up, self.down = powers_to(len(tokens) + 1)
        self.tokens, self.free = tokens, free
        self.total = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(mix(tokens + np.uint64(1)) * up[: len(tokens)], out=self.total[1:])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, Karp-Rabin hashes) of the runs of ``size`` free tokens."""
        so_far = np.concatenate([[0], np.cumsum(self.free)])
        starts = np.flatnonzero(so_far[size:] - so_far[:-size] == size) if len(self.free) >= size else np.zeros(0, np.int64)
        return starts, (self.total[starts + size] - self.total[starts]) * self.down[starts]


def _shared(item: _Line, text: _Line, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, hashes) of the windows in item and in text that the other has too."""
    (i, hi), (t, ht) = item.windows(size), text.windows(size)
    known = np.unique(hi)
    at = np.searchsorted(known, ht)
    some = known[np.minimum(at, len(known) - 1)] == ht if len(known) else np.zeros(len(ht), bool)
    both = np.isin(hi, ht[some])
    return i[both], hi[both], t[some], ht[some]


def tiles(item, text, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, start in text, length); equal numbers are equal tokens.

    Negative numbers in ``text`` match nothing. Of matches equally long, the one first in
    the item, then in the text, is marked first.

    Each round searches for the greatest length at which free windows are equal (if a length
    has such, so have all lesser ones) and marks all tiles of it, so the next is less. A
    round takes time in proportion to the tokens and the logarithm of the item's length,
    and there are no more rounds than different lengths fit in the item.
    """
    return _tiles(np.array(item, np.uint64), np.array([max(x, 0) for x in text], np.uint64), np.array([x >= 0 for x in text], bool), least)


def _tiles(item: np.ndarray, text: np.ndarray, free: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    item, text = _Line(item, np.ones(len(item), bool)), _Line(text, free)
    out: list[tuple[int, int, int]] = []
    most = min(len(item.free), len(text.free))
    while True:
        # Invariant: ``low`` is shared, or one less than the least that counts.
        low, high = least - 1, most
        while low < high:
            half = (low + high + 1) // 2
            low, high = (half, high) if len(_shared(item, text, half)[0]) else (low, half - 1)
        if low < least:
            return out
        most = low - 1
        starts, hashes, places, found = _shared(item, text, low)
        order = np.lexsort((places, found))
        places, found = places[order], found[order]
        next_at, ends = (dict(zip(hashes.tolist(), np.searchsorted(found, hashes, side).tolist())) for side in ("left", "right"))
        over = 0
        for i, h in zip(starts.tolist(), hashes.tolist()):
            if i < over:
                continue  # reaches into a tile of this round
            k = next_at[h]
            while k < ends[h] and not (text.free[places[k]] and text.free[places[k] + low - 1]):
                k += 1  # a place that is taken stays so
            next_at[h] = k
            if k < ends[h] and np.array_equal(item.tokens[i : i + low], text.tokens[places[k] : places[k] + low]):
                t, over = int(places[k]), i + low
                item.free[i:over] = text.free[t : t + low] = False
                out.append((i, t, low))


class Index:
    """The seeds of a block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str], least: int, coverage: float):
        self.ids, self.tokens, seeds = ids, [], []
        for _, tokens, edges in token_hashes(pa.array(texts, pa.large_string())):
            self.tokens += [tokens[a:b] for a, b in zip(edges[:-1], edges[1:])]
        self.widths = sorted({min(least, len(x)) for x in self.tokens} - {0})
        for width in self.widths:
            of = [(k, window_hashes(x, width)) for k, x in enumerate(self.tokens) if min(least, len(x)) == width]
            seeds += [(h, k, p) for k, hs in of for p, h in enumerate(hs.tolist())]
        seeds.sort()
        self.hashes = np.array([s[0] for s in seeds], np.uint64)
        self.items = np.array([s[1] for s in seeds], np.int64)
        self.places = np.array([s[2] for s in seeds], np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        # A seed of many items joins only those that such seeds alone could cover; to the others it
        # is added once another seed has joined them.
        _, back, counts = np.unique(self.hashes, return_inverse=True, return_counts=True)
        common = np.flatnonzero(counts[back] > COMMON)
        self.common: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k in common.tolist():
            self.common[int(self.items[k])][int(self.hashes[k])].append(int(self.places[k]))
        later = set()
        for k, of in self.common.items():
            covered, width = np.zeros(len(self.tokens[k]), bool), min(least, len(self.tokens[k]))
            for p in sorted(p for ps in of.values() for p in ps):
                covered[p : p + width] = True
            if covered.sum() < coverage * len(covered):
                later.add(k)
        self.common = {k: dict(v) for k, v in self.common.items() if k in later}
        now = ~(np.isin(self.items, list(later)) & (counts[back] > COMMON)) if later else np.ones(len(seeds), bool)
        self.hashes, self.items, self.places = self.hashes[now], self.items[now], self.places[now]

    def hits(self, tokens: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """(row, place in tokens, width, first and end of the equal seeds) of the seeds within a row, by row."""
        found = []
        for width in self.widths:
            rolled = window_hashes(tokens, width)
            at = np.flatnonzero(self.maybe[(rolled >> np.uint64(44)).astype(np.int64)])
            a, b = (np.searchsorted(self.hashes, rolled[at], side) for side in ("left", "right"))
            row = np.searchsorted(edges, at, "right") - 1
            some = (b > a) & (at + width <= edges[row + 1])
            found.append(np.stack([row, at, np.full(len(at), width), a, b], 1)[some])
        out = np.concatenate(found) if found else np.zeros((0, 5), np.int64)
        return out[np.argsort(out[:, 0], kind="stable")]


def _matched(index, least: int, coverage: float):
    def match(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ix, rows = index.value, []
        docs, hashes = batch.column("doc_id").to_pylist(), batch.column("row_hash").to_pylist()
        for first, tokens, edges in token_hashes(batch.column("text")):
            hits = ix.hits(tokens, edges)
            cuts = np.flatnonzero(np.diff(hits[:, 0])) + 1
            for own_hits in np.split(hits, cuts) if len(hits) else []:
                row, start = int(own_hits[0, 0]), int(edges[own_hits[0, 0]])
                # Of equal seeds in a document one says which items' places they cover.
                _, one = np.unique(own_hits[:, 3], return_index=True)
                by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
                for _, _, width, a, b in own_hits[one].tolist():
                    for k in range(a, b):
                        by[int(ix.items[k])].append((a, int(ix.places[k]), width))
                for item, seeds in by.items():
                    own = ix.tokens[item]
                    mine = own_hits[np.isin(own_hits[:, 3], [a for a, _, _ in seeds])]
                    spots = [mine[mine[:, 2] == w, 1, None] - start + np.arange(w) for w in np.unique(mine[:, 2])]
                    # No tile reaches beyond its seeds, so they bound the coverage and bear all that can match.
                    covered = np.zeros(len(own), bool)
                    for _, p, width in seeds:
                        covered[p : p + width] = True
                    if common := ix.common.get(item):
                        width = min(least, len(own))
                        rolled = window_hashes(tokens[start : edges[row + 1]], width)
                        at = np.flatnonzero(np.isin(rolled, np.array(list(common), np.uint64)))
                        spots.append(at[:, None] + np.arange(width))
                        for h in np.unique(rolled[at]).tolist():
                            for p in common[h]:
                                covered[p : p + width] = True
                    if covered.sum() < coverage * len(own):
                        continue
                    at = np.unique(np.concatenate([x.reshape(-1) for x in spots]))
                    gaps = np.flatnonzero(np.diff(at) > 1) + 1
                    text, open_ = np.insert(tokens[start + at], gaps, 0), np.insert(np.ones(len(at), bool), gaps, False)
                    found = _tiles(own, text, open_, min(least, len(own)))
                    size = sum(k for _, _, k in found)
                    if size >= coverage * len(own):
                        rows.append((docs[first + row], ix.ids[item], size / len(own), size, len(own), len(found), hashes[first + row]))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "uid", "coverage", "matched", "item_tokens", "tiles", "row_hash"])

    return match


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """One row per (doc_id, item_id) whose tiles cover ``coverage`` of the item: coverage, matched, item_tokens, tiles, row_hash.

    Tokens are lower-cased. An item of fewer than ``least`` tokens must occur whole; one
    without tokens (or null) matches nothing. Null and empty texts match nothing. Repeated
    rows of either table give repeated pairs; a null id is carried as it is. Other
    columns are ignored. The benchmark's distinct texts are taken in blocks of bounded size,
    each held against all documents, so its size is free; a block's index is gone before
    the next is made.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_hash()).where("text is not null")
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    scratch = Scratch(spark)
    benchmark = scratch.keep(benchmark.withColumn("low", F.xxhash64("text")).withColumn("high", F.xxhash64("text", F.lit(1))))
    texts = benchmark.groupBy("low", "high").agg(F.first("text").alias("text"))
    texts = scratch.keep(texts.withColumn("uid", F.monotonically_increasing_id()))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, out = max(1, math.ceil(total / BLOCK_BYTES)), None
    for k in range(blocks):
        block = texts.where(F.pmod("low", F.lit(blocks)) == k).select("uid", "text").collect()
        index = spark.sparkContext.broadcast(Index([r["uid"] for r in block], [r["text"] for r in block], least, coverage))
        found = map_arrow(docs, _matched(index, least, coverage), "doc_id long, uid long, coverage double, matched long, item_tokens long, tiles long, row_hash long")
        if blocks > 1:
            found = scratch.keep(found)
            index.destroy()
        out = found if out is None else out.unionByName(found)
    items = texts.select("uid", "low", "high").join(benchmark.select("low", "high", "item_id"), ["low", "high"]).select("uid", "item_id")
    return out.join(items, "uid").select("doc_id", "item_id", "coverage", "matched", "item_tokens", "tiles", "row_hash")
