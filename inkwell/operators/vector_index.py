"""A stored index of vectors in cells: k-means centroids, residual codes of a byte a component, exact re-ranking.

A search reads the folders of the cells it is sent to, and of those only keys and codes;
vectors are read for the rows that the codes' error bounds leave over.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.workers import ship
from ..sources import scratch

#: Cells are the square root of the rows, MOST_CELLS at most; rows that k-means is fitted on, at most so many a cell and in all; its rounds.
MOST_CELLS, SAMPLE_PER_CELL, SAMPLE, ROUNDS = 4096, 64, 1 << 16, 8
#: Rows of a slice of a cell: a cell of very many rows is dealt over many tasks.
SLICE = 1 << 14
#: Trial searches (held against all rows when the index is built), their depth, and the share of their neighbours that the cells visited must hold.
TRIALS, DEPTH, SHARE = 64, 50, 0.96
#: Scores that a task holds at once, and rows that it sends to cells at once, about.
PAIRS, ROUTED = 1 << 20, 1 << 14
#: What rounding to six places and single precision can add to a score.
SLACK = 2e-6


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)


def kmeans(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of the rows, started from ``cells`` of them; one that loses all its rows stays where it was."""
    rng = np.random.default_rng(7)
    distinct = np.unique(x, axis=0)
    centroids = distinct[rng.permutation(len(distinct))[:cells]].copy()
    for _ in range(rounds):
        near = nearest_cell(x, centroids)
        n = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def nearest_cell(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (2 * x @ centroids.T - (centroids**2).sum(1)).argmax(1)


def _fit(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_matrix(b.column("embedding")) for b in _batches(batches)]
        if found:
            c = kmeans(np.concatenate(found), cells)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c))), pa.array(list(c), pa.list_(pa.float64()))], ["cell", "centroid"])

    return run


def _assigning(centroids: np.ndarray, first: int):
    """Each row's cell, its residual as bytes with a scale, and the residual's norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            x = _matrix(batch.column("embedding"))
            cell = nearest_cell(x, centroids)
            rest = x - centroids[cell]
            scale = np.abs(rest).max(1) / 127
            codes = np.round(rest / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
            more = [pa.array(cell + first, pa.int32()), pa.array(scale), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.linalg.norm(rest, axis=1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "cell", "scale", "code", "radius"])

    return run


def _trying(queries: np.ndarray, centroids: np.ndarray, k: int):
    """The best of a task's rows for each trial, and how many cells the trial would visit before theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(-queries @ centroids.T, axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(centroids))[None, :], 1)
        best = np.zeros((0, 3))
        for batch in _batches(batches):
            x, cell = _matrix(batch.column("embedding")), batch.column("cell").to_numpy()
            score = queries @ x.T
            for q in range(len(queries)):
                top = np.argpartition(-score[q], k - 1)[:k] if len(x) > k else np.arange(len(x))
                best = np.concatenate([best, np.stack([np.full(len(top), q), score[q][top], place[q][cell[top]]], 1)])
            best = best[np.lexsort((-best[:, 1], best[:, 0]))]
            best = best[np.arange(len(best)) - np.searchsorted(best[:, 0], best[:, 0]) < k]
        if len(best):
            yield pa.RecordBatch.from_arrays([pa.array(best[:, 0].astype(np.int64)), pa.array(best[:, 1]), pa.array(best[:, 2].astype(np.int64))], ["query", "score", "place"])

    return run


def _routing(cells: np.ndarray, centroids: np.ndarray, radius: np.ndarray, slices: np.ndarray, least: float | None, visit: int | None):
    """Each query's cells: those whose best possible score reaches ``least``, the ``visit`` of the nearest centroids where that is given; a row for each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            step = max(1, min(256, ROUTED // max(1, int(slices.sum()))))
            for a in range(0, batch.num_rows, step):
                some = batch.slice(a, step)
                x = _matrix(some.column("vector"))
                base = x @ centroids.T
                go = np.ones(base.shape, bool) if least is None else base + np.linalg.norm(x, axis=1)[:, None] * radius >= least - SLACK
                if visit is not None and visit < len(cells):
                    go &= base >= -np.partition(-base, visit - 1, axis=1)[:, visit - 1, None]
                q, c = np.nonzero(go)
                q, c = np.repeat(q, slices[c]), np.repeat(c, slices[c])
                at = np.arange(len(c)) - np.maximum.accumulate(np.where(np.r_[True, (q[1:] != q[:-1]) | (c[1:] != c[:-1])], np.arange(len(c)), 0)) if len(c) else c
                more = [pa.array(cells[c], pa.int32()), pa.array(at, pa.int32()), pa.array(base[q, c])]
                yield pa.RecordBatch.from_arrays([some.column("query_id").take(pa.array(q)), some.column("vector").take(pa.array(q)), *more], ["query_id", "vector", "cell", "slice", "base"])

    return run


def _likely(rows: pa.RecordBatch, keys: pa.Array, codes: np.ndarray, scale: np.ndarray, k: int, least: float | None) -> tuple[np.ndarray, pa.Array] | None:
    """Places of queries, and keys of the rows that may be among the best ``k`` of each."""
    x, base = _matrix(rows.column("vector")), rows.column("base").to_numpy()
    near = base[:, None] + (x.astype(np.float32) @ codes.T) * scale
    width = np.abs(codes).max() if codes.size else 0
    # Half a step of each component, and what single precision loses.
    room = scale * np.abs(x).sum(1)[:, None] * (0.5 + 1e-5 * width) + SLACK + 1e-6 * np.abs(base)[:, None]
    low, high = near - room, near + room
    floor = np.full(len(x), -np.inf if least is None else least - SLACK)
    if low.shape[1] > k:
        floor = np.maximum(floor, -np.partition(-low, k - 1, axis=1)[:, k - 1])
    q, r = np.nonzero(high >= floor[:, None])
    return (q, keys.take(pa.array(r))) if len(q) else None


def _scanning(k: int, least: float | None):
    """A slice's codes come first and stay, then its queries pass by. Kept are the rows that may be among a query's best ``k``, whatever the codes leave out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ready = None, [], None
        for batch in _batches(batches):
            cell, part, ask = batch.column("cell").to_numpy(), batch.column("slice").to_numpy(), batch.column("ask").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (ask[1:] != ask[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)]):
                rows = batch.slice(a, b - a)
                if (cell[a], part[a]) != at:
                    at, held, ready = (cell[a], part[a]), [], None
                if not ask[a]:
                    held.append(rows)
                    continue
                if not held:
                    continue
                if ready is None:
                    own = pa.Table.from_batches(held)
                    codes = np.frombuffer(b"".join(own["code"].to_pylist()), np.int8).reshape(own.num_rows, -1).astype(np.float32)
                    ready = own["key"].combine_chunks(), codes, own["scale"].to_numpy()
                step = max(1, PAIRS // len(ready[0]))
                for first in range(0, rows.num_rows, step):
                    found = _likely(rows.slice(first, step), *ready, k, least)
                    if found is not None:
                        q, keys = found
                        one = lambda v: pa.array(np.full(len(q), v), pa.int32())
                        yield pa.RecordBatch.from_arrays([rows.column("query_id").take(pa.array(q + first)), keys, one(at[0]), one(at[1])], ["query_id", "key", "cell", "slice"])

    return run


@dataclass(frozen=True)
class VectorIndex:
    """Stored rows (key, other columns, embedding, cell, slice, scale, code, radius) by cell, with the cells' centroids.

    ``visit`` is how many cells a search visits where it isn't asked to be exact.
    """

    spark: SparkSession
    path: str
    key: str
    visit: int

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    @property
    def cells(self) -> DataFrame:
        """(cell, centroid, radius, n, slices): MOST_CELLS rows at most."""
        return self.spark.read.parquet(f"{self.path}/cells")

    @staticmethod
    def read(spark: SparkSession, path: str) -> VectorIndex:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        return VectorIndex(spark, path, about["key"], about["visit"])

    def _cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        found = self.cells.orderBy("cell").toArrow()
        return found["cell"].to_numpy(), _matrix(found["centroid"]), found["radius"].to_numpy(), found["slices"].to_numpy()

    def search(self, queries: DataFrame, k: int, least: float | None = None, exact: bool = False) -> DataFrame:
        """(query_id, key, other columns, score): the ``k`` rows of the largest inner product with each query (query_id, vector), ties by key.

        ``exact`` visits every cell that can hold a row of score ``least``: its centroid and
        radius bound the score. Otherwise the ``visit`` cells of the nearest centroids are
        visited. Scores are rounded to six places, as the order is by the rounded ones.
        """
        ship(self.spark)
        cells, centroids, radius, slices = self._cells()
        kind = self.rows.schema[self.key].dataType.simpleString()
        query = queries.schema["query_id"].dataType.simpleString()
        queries = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        routed = queries.mapInArrow(_routing(cells, centroids, radius, slices, least, None if exact else self.visit), f"query_id {query}, vector array<double>, cell int, slice int, base double")
        at = scratch.path(self.spark, "routed")
        routed.write.parquet(at)
        routed = self.spark.read.parquet(at)
        used = [r[0] for r in routed.select("cell").distinct().collect()]  # MOST_CELLS at most
        stored = self.rows.where(F.col("cell").isin(used))
        none = lambda t: F.lit(None).cast(t)
        own = stored.select("cell", "slice", F.lit(False).alias("ask"), F.col(self.key).alias("key"), "scale", "code", none(query).alias("query_id"), none("array<double>").alias("vector"), none("double").alias("base"))
        ask = routed.select("cell", "slice", F.lit(True).alias("ask"), none(kind).alias("key"), none("double").alias("scale"), none("binary").alias("code"), "query_id", "vector", "base")
        both = own.unionByName(ask).repartition("cell", "slice").sortWithinPartitions("cell", "slice", "ask")
        likely = both.mapInArrow(_scanning(k, least), f"query_id {query}, key {kind}, cell int, slice int")
        others = [c for c in self.rows.columns if c not in ("embedding", "cell", "slice", "scale", "code", "radius", self.key)]
        vectors = stored.select("cell", "slice", F.col(self.key).alias("key"), *others, "embedding")
        found = likely.join(vectors, ["cell", "slice", "key"]).join(queries, "query_id")
        score = F.aggregate(F.zip_with("embedding", "vector", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
        found = found.select("query_id", F.col("key").alias(self.key), *others, F.round(score, 6).alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), self.key)
        found = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")
        return found if least is None else found.where(F.col("score") >= least)

    def add(self, vectors: DataFrame) -> VectorIndex:
        """Appends rows to the cells that are there; centroids stay as they are."""
        cells, centroids, _, slices = self._cells()
        _store(vectors, self.path, self.key, centroids, dict(zip(cells.tolist(), slices.tolist())), "append")
        _summarise(self.spark, self.path, centroids)
        return self


def _store(vectors: DataFrame, path: str, key: str, centroids: np.ndarray, slices: dict[int, int] | None, mode: str) -> None:
    spark = vectors.sparkSession
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    coded = vectors.mapInArrow(_assigning(centroids, 0), f"{kinds}, cell int, scale double, code binary, radius double")
    at = scratch.path(spark, "coded")
    coded.write.parquet(at)  # read to count and to deal
    coded = spark.read.parquet(at)
    counts = coded.groupBy("cell").agg(F.count("*").alias("n")).collect()  # MOST_CELLS at most
    sizes = spark.createDataFrame([(r["cell"], max((slices or {}).get(r["cell"], 1), -(-r["n"] // SLICE))) for r in counts], "cell int, _slices int")
    coded = coded.join(F.broadcast(sizes), "cell").withColumn("slice", F.pmod(F.xxhash64(key), F.col("_slices")).cast("int")).drop("_slices")
    coded.repartition("cell", "slice").sortWithinPartitions("cell", "slice", key).write.mode(mode).partitionBy("cell").parquet(f"{path}/rows")


def _summarise(spark: SparkSession, path: str, centroids: np.ndarray) -> None:
    # The greatest slice that is in use, as rows added later can be in more slices than earlier ones.
    found = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.max("radius").alias("radius"), F.count("*").alias("n"), (F.max("slice") + 1).alias("slices"))
    have = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    have.join(F.broadcast(found), "cell", "left").fillna({"radius": 0.0, "n": 0, "slices": 1}).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def build(vectors: DataFrame, path: str, key: str = "chunk_id", cells: int | None = None) -> VectorIndex:
    """Write an index of ``vectors`` (``key``, unique and not null, embedding and whatever else is to be returned).

    Vectors that are null, empty or hold nulls or non-finite numbers are left out, and so are those of
    another length than most. K-means is fitted on a sample of bounded size, in one task;
    every row is stored. ``visit`` is set by trials: vectors of the sample are held
    against all rows, once.
    """
    spark = vectors.sparkSession
    ship(spark)
    good = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    vectors = vectors.where(good)
    length = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        raise ValueError("there are no vectors to index")
    vectors = vectors.where(F.size("embedding") == length["d"])
    n = vectors.count()
    cells = cells or max(1, min(MOST_CELLS, round(n**0.5)))
    sample = vectors.orderBy(F.xxhash64(key), key).limit(min(SAMPLE, SAMPLE_PER_CELL * cells)).select(F.col("embedding").cast("array<double>").alias("embedding"))
    fitted = sample.repartition(1).mapInArrow(_fit(cells), "cell long, centroid array<double>").toArrow()
    centroids = _matrix(fitted["centroid"])
    _store(vectors, path, key, centroids, None, "overwrite")
    _summarise(spark, path, centroids)
    trials = _matrix(sample.limit(TRIALS).toArrow()["embedding"])
    rows = spark.read.parquet(f"{path}/rows").select("embedding", "cell")
    tried = rows.mapInArrow(_trying(trials, centroids, DEPTH), "query long, score double, place long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "place")
    tried = tried.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= DEPTH)
    visit = 1 + (tried.agg(F.expr(f"percentile_disc({SHARE}) within group (order by place)")).first()[0] or 0)
    spark.createDataFrame([(json.dumps({"key": key, "visit": int(visit)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return VectorIndex(spark, path, key, int(visit))
