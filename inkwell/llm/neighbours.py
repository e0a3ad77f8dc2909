"""Nearest neighbours by a permutation index: vectors as their ordered nearest pivots, posted in the pivots' inverted files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, release, tune

NEAREST, EVERY = 20, 20
#: Pivots at most (a sixteenth of the rows if those are fewer), and how many of them a vector is posted under.
PIVOTS, POSTED = 512, 48
#: Rows of which the pivots are taken, in the order of a hash of vec_id.
PIVOT_SAMPLE = 4 * PIVOTS
#: Searches that set the least likeness, and the share of their true neighbours that must have it.
TRIALS, SHARE = 128, 0.97
#: Vectors of a shard, which has inverted files of its own; shards whose summaries are held in a task at once (2 MB).
SHARD, SUMMARIES = 4096, 1 << 12
#: A missing vec_id, which sorts last.
NO_ID = np.iinfo(np.int64).max


@dataclass
class Pivots:
    """Unit vectors; the order of a vector's nearest ones stands for it."""

    vectors: np.ndarray
    posted: int

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """The ``posted`` nearest pivots of each row, nearest first, ties to the lower number."""
        near = (x / np.abs(x).max(1, keepdims=True)) @ self.vectors.T
        some = np.argpartition(-near, self.posted - 1, axis=1)[:, : self.posted]
        order = np.lexsort((some, -np.take_along_axis(near, some, 1)), axis=1)
        return np.take_along_axis(some, order, 1).astype(np.int16)

    def likeness(self, files: InvertedFiles, ranked: np.ndarray) -> np.ndarray:
        """Of one permutation to all of a shard's: what the footrule distance falls short of its greatest.

        Ranks count from 0, and a pivot that isn't posted has rank ``posted``. Each file adds, for
        the vectors in it, the lesser of the two weights (``posted`` less rank); the
        distance is a constant less twice the sum.
        """
        weights = self.posted - np.arange(self.posted, dtype=np.int32)
        first, n = files.edges[ranked], files.edges[ranked + 1] - files.edges[ranked]
        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(files.rows[at], np.minimum(files.weights[at], np.repeat(weights, n)), files.size).astype(np.int32)


class InvertedFiles:
    """For each pivot the rows of a shard that are posted under it, with their weights."""

    def __init__(self, ranked: np.ndarray, pivots: int):
        self.size, posted = ranked.shape
        flat = ranked.reshape(-1)
        order = np.argsort(flat, kind="stable")
        self.rows = (order // posted).astype(np.int32)
        self.weights = (posted - order % posted).astype(np.int32)
        self.edges = np.searchsorted(flat[order], np.arange(pivots + 1))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, each summed in the order of the components, so that equal vectors have equal ones."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))


def _best(likely: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, row, score) of each query's ``k`` nearest of its likely rows, by exact products."""
    picks = []
    for q, rows in likely:
        if len(rows) > k:  # a quick product first, with room for its rounding
            near = vectors[rows] @ queries[q]
            least = np.partition(near, -k)[-k]
            rows = rows[near >= least - 1e-9 * (np.abs(near).max() + 1)]
        picks.append((np.full(len(rows), q), rows))
    of, rows = (np.concatenate([p[i] for p in picks]) if picks else np.zeros(0, np.int64) for i in (0, 1))
    score = products(vectors[rows], queries[of])
    order = np.lexsort((ids[rows], -score, of))
    of, rows, score = of[order], rows[order], score[order]
    place = np.arange(len(of)) - np.searchsorted(of, of)
    return of[place < k], rows[place < k], score[place < k]


def _ranking(pivots: Pivots):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = _matrix(batch.column("v"))
        yield pa.RecordBatch.from_arrays([*batch.columns, _lists(pivots.ranked(x))], [*batch.schema.names, "ranked"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their place in the partition. Of equal vectors in a row the NEAREST + 1 of the least ids stay: no other can be among the nearest of anything."""
    from pyspark import TaskContext

    part, done, last, run = TaskContext.get().partitionId(), 0, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column("v"))
        same = np.zeros(len(x), bool)
        same[1:] = (x[1:] == x[:-1]).all(1)
        same[0] = last is not None and bool((x[0] == last).all())
        starts = np.maximum.accumulate(np.where(same, -1, np.arange(len(x))))
        copy = np.arange(len(x)) - np.maximum(starts, 0) + np.where(starts < 0, run, 0)
        last, run = x[-1], int(copy[-1]) + 1
        kept = batch.filter(pa.array(copy <= NEAREST))
        place = done + np.arange(kept.num_rows)
        done += kept.num_rows
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.full(kept.num_rows, part), pa.int64()), pa.array(place, pa.int64())], [*kept.schema.names, "part", "place"])
    release()


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(shard, is it of the shard's vectors, rows) of batches sorted so."""
    for batch in batches:
        if not batch.num_rows:
            continue
        shard, ask = batch.column("shard").to_numpy(), batch.column("ask").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (ask[1:] != ask[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)]):
            yield int(shard[a]), not ask[a], batch.slice(a, b - a)


def _searching(pivots: Pivots, least: int, k: int):
    """Each shard's vectors come first and stay, then its searches pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, files = None, [], None
        for shard, own, rows in _by_shard(batches):
            if shard != at:
                at, held, files = shard, [], None
            if own:
                held.append(rows)
                continue
            if not held:
                continue
            if files is None:
                table = pa.Table.from_batches(held)
                files, vectors = InvertedFiles(_matrix(table["ranked"]), len(pivots.vectors)), _matrix(table["v"])
                ids = table["id"].to_numpy()
            queries, ranked = _matrix(rows.column("v")), _matrix(rows.column("ranked"))
            likely = [(q, np.flatnonzero(pivots.likeness(files, ranked[q]) >= least)) for q in range(len(queries))]
            of, hits, score = _best(likely, queries, vectors, ids, k)
            same = (vectors[hits] == queries[of]).all(1)
            yield pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(of)), pa.array(ids[hits]), pa.array(score), pa.array(same)], ["query", "id", "score", "same"])
        release()

    return run


def _trying(pivots: Pivots, queries: np.ndarray, k: int):
    """The true nearest of the trial searches in a task's rows, with their likeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32)]
        ranked = pivots.ranked(queries)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            files = InvertedFiles(_matrix(batch.column("ranked")), len(pivots.vectors))
            near = queries @ x.T
            for q in range(len(queries)):
                rows = np.argpartition(-near[q], k - 1)[:k] if len(x) > k else np.arange(len(x))
                rows = rows[(x[rows] != queries[q]).any(1)]
                like = pivots.likeness(files, ranked[q])[rows]
                found = [np.concatenate([a, b]) for a, b in zip(found, (np.full(len(rows), q), near[q][rows], like))]
            order = np.lexsort((-found[1], found[0]))
            found = [f[order] for f in found]
            top = np.arange(len(order)) - np.searchsorted(found[0], found[0]) < k
            found = [f[top] for f in found]
        if len(found[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query", "score", "likeness"])
        release()

    return run


def _routing(pivots: Pivots, shards: np.ndarray, weights: np.ndarray, least: int):
    """The shards of a block that may hold a row as like as ``least``: their files' greatest weights bound the sum."""
    own = pivots.posted - np.arange(pivots.posted, dtype=np.int32)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ranked = _matrix(batch.column("ranked"))
        for a in range(0, len(ranked), 64):
            some = ranked[a : a + 64]
            bound = np.stack([np.minimum(weights[:, r], own).sum(1) for r in some])
            q, s = np.nonzero(bound >= least)
            rows = batch.slice(a, 64).take(pa.array(q))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(shards[s])], [*rows.schema.names, "shard"])

    return run


def _summing(pivots: Pivots):
    """Each shard's greatest weight of each pivot, as far as a batch has it."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ranked, shard = _matrix(batch.column("ranked")), batch.column("shard").to_numpy()
        names, place = np.unique(shard, return_inverse=True)
        out = np.zeros((len(names), len(pivots.vectors)), np.int32)
        np.maximum.at(out, (np.repeat(place, pivots.posted), ranked.reshape(-1)), np.tile(pivots.posted - np.arange(pivots.posted, dtype=np.int32), len(ranked)))
        s, p = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(names[s]), pa.array(p, pa.int32()), pa.array(out[s, p])], ["shard", "pivot", "weight"])

    return run


class PermutationIndex:
    """All of ``vectors`` as permutations in shards. A shard has neighbouring permutations and SHARD rows at most.

    Pivots are fitted on a bounded sample; so is ``least``, the likeness from which rows are
    candidates: TRIALS searches are held against all rows, and SHARE of their true
    neighbours have it. It is one number for all searches; none has a cap on its candidates.
    """

    def __init__(self, vectors: DataFrame, k: int = NEAREST):
        spark = self.spark = vectors.sparkSession
        self.scratch, self.k = Scratch(spark), k
        self.rows = vectors.count()
        chosen = vectors.orderBy(F.xxhash64("id"), "id", "v").limit(PIVOT_SAMPLE).select("v").collect()
        unit = np.array([r["v"] for r in chosen], np.float64)
        unit = unit / np.abs(unit).max(1, keepdims=True)
        unit = np.unique(unit / np.linalg.norm(unit, axis=1, keepdims=True), axis=0)
        rng = np.random.default_rng(17)
        unit = unit[rng.permutation(len(unit))][: max(1, min(PIVOTS, max(64, self.rows // 16)))]
        self.pivots = Pivots(unit, min(POSTED, len(unit)))
        ranked = self.scratch.keep(map_arrow(vectors, _ranking(self.pivots), "id long, v array<double>, ranked array<short>"))
        self.least = self._least(ranked, chosen)
        order = [F.slice("ranked", 1, 4), "v", "id"]
        line = ranked.repartitionByRange(*order).sortWithinPartitions(*order)
        line = self.scratch.keep(line.mapInArrow(_numbered, "id long, v array<double>, ranked array<short>, part long, place long"))
        # One number for each range partition.
        sizes = sorted((r["part"], r["n"]) for r in line.groupBy("part").agg(F.count("*").alias("n")).collect())
        bases = np.cumsum([0, *(n for _, n in sizes)]).tolist()
        bases = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, bases)], "part long, base long")
        shard = F.floor((F.col("place") + F.col("base")) / SHARD)
        self.shards = line.join(F.broadcast(bases), "part").select("id", "v", "ranked", shard.alias("shard"))
        self.n_shards = -(-sum(n for _, n in sizes) // SHARD)

    def _least(self, ranked: DataFrame, chosen: list) -> int:
        """The greatest likeness that SHARE of the true neighbours of the trial searches have."""
        trials = np.array([r["v"] for r in chosen[:TRIALS]], np.float64)
        found = ranked.mapInArrow(_trying(self.pivots, trials, self.k), "query long, score double, likeness int")
        best = Window.partitionBy("query").orderBy(F.desc("score"), "likeness")
        found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= self.k)
        value = found.agg(F.expr(f"percentile_disc({1 - SHARE}) within group (order by likeness)").alias("x")).first()["x"]
        return int(value or 0)

    def search(self, queries: DataFrame, least: int | None = None) -> DataFrame:
        """(query, id, score, same): of each query (id, v), the best k + 1 rows of the likely ones. ``same``: the row has the query's vector."""
        least = self.least if least is None else least
        k, pivots = self.k + 1, self.pivots
        asked = self.scratch.keep(map_arrow(queries.select("id", "v"), _ranking(pivots), "id long, v array<double>, ranked array<short>"))
        summary = self.scratch.keep(map_arrow(self.shards.select("ranked", "shard"), _summing(pivots), "shard long, pivot int, weight int").groupBy("shard", "pivot").agg(F.max("weight").alias("weight")))
        routed = []
        for low in range(0, self.n_shards, SUMMARIES):
            own = summary.where((F.col("shard") >= low) & (F.col("shard") < low + SUMMARIES)).toArrow()
            shard, pivot, weight = (own[c].to_numpy() for c in ("shard", "pivot", "weight"))
            weights = np.zeros((min(SUMMARIES, self.n_shards - low), len(pivots.vectors)), np.uint8)
            weights[shard - low, pivot] = weight
            part = map_arrow(asked, _routing(pivots, low + np.arange(len(weights)), weights, least), "id long, v array<double>, ranked array<short>, shard long")
            routed.append(self.scratch.keep(part))
        routed = reduce(DataFrame.unionByName, routed)
        both = self.shards.select("shard", F.lit(False).alias("ask"), "id", "v", "ranked").unionByName(routed.select("shard", F.lit(True).alias("ask"), "id", "v", "ranked"))
        both = both.repartition(max(self.n_shards, 1), "shard").sortWithinPartitions("shard", "ask")
        hits = both.mapInArrow(_searching(pivots, least, k), "query long, id long, score double, same boolean")
        best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        return hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def nearest_neighbours(vectors: DataFrame, k: int = NEAREST, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows found of the largest inner product for each row whose vec_id is divisible by ``every``.

    Candidates are all rows but the query's own, all of them where they are fewer than
    ``k``. Ties go to the smaller vec_id. Equal queries are searched once, and a query with
    fewer than ``k`` likely rows is searched again among all rows.

    Vectors that are null or zero or hold nulls or non-finite numbers take no part, and
    neither do those whose length is rarer than another (of equally frequent ones the
    shorter counts). Rows without a vec_id are found like all others, last among ties, and
    never ask. Repeated rows are rows of their own: each asks, and finds the others.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    tune(spark)
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(int(NO_ID))).alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Zeros of either sign are one.
    rows = rows.where(F.size("v") == length["d"]).select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    index = PermutationIndex(rows, k)
    asking = rows.where((F.col("id") != int(NO_ID)) & (F.col("id") % every == 0))
    # Numbered, as rows of one vec_id can have different vectors.
    queries = index.scratch.keep(asking.select("v").distinct().withColumn("id", F.monotonically_increasing_id()))
    hits = index.scratch.keep(index.search(queries))
    wanted = min(k, index.rows - 1)
    few = hits.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") > wanted).select("query")
    few = index.scratch.keep(queries.join(few, F.col("id") == F.col("query"), "left_anti"))
    if not few.isEmpty():
        again = index.search(few, 0)
        hits = hits.join(few.select(F.col("id").alias("query")), "query", "left_anti").unionByName(again)
    lists = hits.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "id", "same"))).alias("hits"))  # k + 1 at most
    asked = asking.select(F.col("id").alias("query_id"), "v").join(queries.select("v", F.col("id").alias("query")), "v").select("query_id", "query")
    # A row finds itself, or one that can't be told from it: the first of these goes.
    mine = F.expr("array_position(transform(hits, h -> h.same and h.id = query_id), true)")
    out = asked.join(lists, "query").withColumn("mine", mine).select("query_id", F.slice(F.expr("filter(hits, (h, i) -> i + 1 <> mine)"), 1, k).alias("hits"))
    out = out.select("query_id", F.posexplode("hits").alias("i", "h"))
    return out.select("query_id", (F.col("i") + 1).alias("rank"), F.when(F.col("h.id") != int(NO_ID), F.col("h.id")).alias("vec_id"), (-F.col("h.less")).alias("score"))
