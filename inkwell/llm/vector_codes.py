"""Product codes of vectors: codebooks trained by integer means, nearest entries found in kd-trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release, tune

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components count as this at most, so that squared distances fit in 64 bits.
LARGEST = 1 << 28
#: Entries of a kd-tree's leaf; vectors that are searched together.
LEAF, BLOCK = 4, 8192


class KdTree:
    """The nearest of a codebook's entries, ties to the lowest index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._node(np.arange(len(entries)))

    def _node(self, index: np.ndarray) -> tuple:
        own = self.entries[index]
        low, high = own.min(0), own.max(0)
        if len(index) <= LEAF:
            return low, high, np.sort(index), None
        order = index[np.argsort(own[:, np.argmax(high - low)], kind="stable")]
        half = len(order) // 2
        return low, high, None, (self._node(order[:half]), self._node(order[half:]))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each point's entry.

        All points walk down together. A child whose box is as near as the best entry so
        far is still visited: it may hold an entry that is as near and of a lower index.
        """
        best = np.full(len(points), np.iinfo(np.int64).max)
        found = np.full(len(points), len(self.entries))

        def visit(node: tuple, rows: np.ndarray) -> None:
            if not len(rows):
                return
            _, _, leaf, children = node
            if leaf is not None:
                far = ((points[rows, None, :] - self.entries[leaf]) ** 2).sum(2)
                k = far.argmin(1)
                d, i = far[np.arange(len(rows)), k], leaf[k]
                better = (d < best[rows]) | ((d == best[rows]) & (i < found[rows]))
                best[rows[better]], found[rows[better]] = d[better], i[better]
                return
            bounds = []
            for low, high, _, _ in children:
                out = np.maximum(np.maximum(low - points[rows], points[rows] - high), 0)
                bounds.append((out * out).sum(1))
            left_first = bounds[0] <= bounds[1]
            for first in (0, 1):
                own = left_first if first == 0 else ~left_first
                visit(children[first], rows[own])
                other = rows[own]
                visit(children[1 - first], other[bounds[1 - first][own] <= best[other]])

        visit(self.root, np.arange(len(points)))
        return found, best


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, integer vectors) of about BLOCK rows each."""

    def vectors(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held)
        x = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        return table, np.clip(np.floor(SCALE * x), -LARGEST, LARGEST).astype(np.int64)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK:
            yield vectors(held)
            held = []
    if held:
        yield vectors(held)


def _summing(books: np.ndarray):
    """Of each part's entries: how many parts are nearest to it, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        trees, total = [KdTree(b) for b in books], np.zeros((parts, entries, width + 1), np.int64)
        for _, x in _blocks(batches, parts * width):
            for p, tree in enumerate(trees):
                own = x[:, p * width : (p + 1) * width]
                code, _ = tree.nearest(own)
                total[p, :, width] += np.bincount(code, minlength=entries)
                for j in range(width):
                    # Sums of a block are far below 2**53, so exact.
                    total[p, :, j] += np.bincount(code, own[:, j], entries).astype(np.int64)
        slots = np.flatnonzero(total[:, :, width].reshape(-1))
        if len(slots):
            places = (slots[:, None] * (width + 1) + np.arange(width + 1)).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(total.reshape(-1)[places])], ["place", "total"])
        release()

    return run


def _coding(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.shape
        trees = [KdTree(b) for b in books]
        for table, x in _blocks(batches, parts * width):
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p, tree in enumerate(trees):
                code, far = tree.nearest(x[:, p * width : (p + 1) * width])
                codes[:, p] = code
                error += far
            out = [table["vec_id"], table["label"], pa.array([c.tobytes().hex() for c in codes]), pa.array(error)]
            yield from pa.table(out, names=["vec_id", "label", "code", "error"]).to_batches()
        release()

    return run


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of each kept vector.

    Each component x becomes floor(256 * x), at most 2**28 either way. A codebook for each
    of ``parts`` equal parts starts as the parts of the ``entries`` smallest vec_ids (of
    rows with one vec_id those of the smaller vector first; null vec_ids last) and is moved ``rounds``
    times to the floors of its members' means. The codebooks, of fixed size, are what a
    round sends to the tasks, each as a kd-tree that is built there; tasks send back one
    sum for each component of an entry.

    Vectors that are null or hold nulls or non-finite numbers are left out, and so are
    those whose length isn't a multiple of ``parts`` or is rarer than another (of equally
    frequent ones the shortest is taken). Rows with null vec_ids or labels and repeated
    rows are coded like all others; null labels are one group. Other columns are ignored;
    no vector left gives an empty result.
    """
    if entries > 256:
        raise ValueError("an entry's index is one byte")
    spark = vectors.sparkSession
    tune(spark)
    kind = vectors.schema["label"].dataType.simpleString()
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    kept = kept.where(f"{finite} and size(embedding) % {parts} = 0")
    length = kept.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    columns = f"vec_id long, label {kind}, code string, error long, label_error long, codebooks_sha256 string"
    if length is None:
        return spark.createDataFrame([], columns)
    kept = kept.where(F.size("embedding") == length["d"])
    whole = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)).cast("long"))
    first = kept.select("vec_id", whole.alias("v")).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    width = length["d"] // parts
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = kept.select("embedding").mapInArrow(_summing(books), "place long, total long").groupBy("place").agg(F.sum("total").alias("total"))
        total = np.zeros(parts * len(first) * (width + 1), np.int64)
        for r in sums.collect():  # one for each component of an entry
            total[r["place"]] = r["total"]
        total = total.reshape(parts, len(first), width + 1)
        n = total[:, :, width:]
        books = np.where(n > 0, total[:, :, :width] // np.maximum(n, 1), books)
    named = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    scratch = Scratch(spark)
    coded = scratch.keep(kept.mapInArrow(_coding(books), f"vec_id long, label {kind}, code string, error long"))
    totals = scratch.keep(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(named).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB SQL for the same rows, each vector held against all entries."""
    steps = [
        f"""with kept as (
  select row_number() over () as rid, vec_id, label, [cast(floor({scale} * cast(x as double)) as bigint) for x in embedding] as v
  from embeddings where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
pieces as (select rid, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] as x from kept, range({parts}) t(p)),
book0 as (
  select p, e, x from pieces join (select rid, row_number() over (order by vec_id, v) - 1 as e from kept) using (rid) where e < {entries})"""
    ]

    def near(k: int) -> str:
        far = "cast(list_sum([(a.x[i] - b.x[i]) * (a.x[i] - b.x[i]) for i in range(1, len(a.x) + 1)]) as bigint)"
        return f"near{k} as (select a.rid, a.p, min({{'d': {far}, 'e': b.e}}) as best from pieces a join book{k} b using (p) group by a.rid, a.p)"

    for k in range(rounds):
        steps.append(near(k))
        steps.append(
            f"""flat{k} as (select p, n.best.e as e, i, x[i] as c from near{k} n join pieces using (rid, p), (select unnest(range(1, (select max(len(x)) from pieces) + 1)) as i)),
means{k} as (select p, e, list((s - ((s % n) + n) % n) // n order by i) as x from (select p, e, i, cast(sum(c) as bigint) as s, count(*) as n from flat{k} group by all) group by p, e),
book{k + 1} as (select b.p, b.e, coalesce(m.x, b.x) as x from book{k} b left join means{k} m on m.p = b.p and m.e = b.e)"""
        )
    steps.append(near(rounds))
    return (
        ",\n".join(steps)
        + f""",
coded as (select rid, string_agg(printf('%02x', best.e), '' order by p) as code, cast(sum(best.d) as bigint) as error from near{rounds} group by rid),
named as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as s from book{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, s as codebooks_sha256 from coded join kept using (rid), named"""
    )
