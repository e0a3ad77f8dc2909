"""What several corpus operators share: scratch tables, row filters, Arrow text buffers.

Only the shared folder named by ``spark.checkpoint.dir`` is written to, so every
executor (also one that replaces a lost one) can read what another has produced.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A RowFilter has 16 bits for each key, but 2**16 to 2**30 bits (128 MB) in all.
FILTER_BITS = (16, 30)
#: Bits of a RowFilter that one broadcast row holds, as a power of two.
CHUNK_BITS = 16
#: Bytes of text that an Arrow batch holds, but for its last row.
BATCH_BYTES = 32 << 20
#: Documents are handled in runs of about so many bytes of text.
RUN_BYTES = 2 << 20


def tune(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, so that very long texts fit in memory; workers find this package.

    These settings of the session stay, as a plan reads them only when it is run.
    """
    root = str(Path(__file__).resolve().parents[2])
    own = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in own.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [own, root]))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="inkwell-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


class Scratch:
    """Tables written to the shared folder, to cut lineage; gone at the latest when the JVM ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and read it again."""
        path = f"{shared_dir(self.spark)}/inkwell/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.deleteOnExit(at)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, fs, at)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for table in tables:
            _, fs, at = self.paths.pop(id(table))
            fs.delete(at, True)


class RowFilter:
    """Which rows may have a key of ``keys``: a bit set that is broadcast, of 16 bits a key and 128 MB at most.

    It has no false negatives and few false positives up to 10**8 keys; with more it lets
    ever more rows through, so an exact join must follow. ``keys`` is read twice.
    """

    def __init__(self, keys: DataFrame, *cols: str):
        least, most = FILTER_BITS
        self.bits = min(most, max(least, (16 * keys.count()).bit_length()))
        slot = self._slot(*(F.col(c) for c in cols))
        some = keys.select(slot.alias("s")).selectExpr("shiftright(s, 6) AS word", "shiftleft(1L, cast(s & 63 AS int)) AS bit")
        every = keys.sparkSession.range(1 << (self.bits - 6)).selectExpr("id AS word", "0L AS bit")
        words = some.unionByName(every).groupBy("word").agg(F.expr("bit_or(bit)").alias("bits"))
        chunks = words.groupBy(F.shiftright("word", CHUNK_BITS - 6).alias("__ink_chunk")).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w"))
        self.chunks = chunks.select("__ink_chunk", F.expr("transform(w, x -> x.bits)").alias("__ink_words"))

    def _slot(self, *cols: Column) -> Column:
        return F.pmod(F.xxhash64(*cols), F.lit(1 << self.bits))

    def mark(self, df: DataFrame, *cols: str) -> DataFrame:
        """``df`` and a boolean ``__ink_may``. No row moves."""
        slot = self._slot(*(df[c] for c in cols))
        out = df.withColumn("__ink_slot", slot).withColumn("__ink_chunk", F.shiftright("__ink_slot", CHUNK_BITS))
        bit = F.expr(f"coalesce(shiftright(get(__ink_words, cast(shiftright(__ink_slot, 6) & {(1 << (CHUNK_BITS - 6)) - 1} AS int)), cast(__ink_slot & 63 AS int)) & 1, 0) = 1")
        return out.join(F.broadcast(self.chunks), "__ink_chunk", "left").withColumn("__ink_may", bit).drop("__ink_chunk", "__ink_slot", "__ink_words")

    def some(self, df: DataFrame, *cols: str) -> DataFrame:
        """The rows of ``df`` that may have one of the keys."""
        return self.mark(df, *cols).where("__ink_may").drop("__ink_may")


def row_hash() -> Column:
    """Of a row's text: with doc_id it tells rows apart where ids are null or repeated."""
    return F.xxhash64(F.col("text").cast("string")).alias("row_hash")


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` less the rows whose (doc_id, row_hash) is in ``dropped``; only rows that may be dropped are shuffled.

    ``dropped`` is written once, as the filter and the join both read it.
    """
    # An int and a long of one value have different hashes.
    gone = dropped.select(F.col("doc_id").cast("long").alias("__ink_key"), F.col("row_hash").alias("__ink_hash")).distinct()
    gone = Scratch(docs.sparkSession).keep(gone)
    marked = RowFilter(gone, "__ink_key").mark(docs.withColumn("__ink_id", F.col("doc_id").cast("long")), "__ink_id").drop("__ink_id")
    unsure = marked.where("__ink_may").drop("__ink_may")
    same = unsure["doc_id"].cast("long").eqNullSafe(gone["__ink_key"]) & (F.xxhash64(unsure["text"].cast("string")) == gone["__ink_hash"])
    return marked.where("not __ink_may").drop("__ink_may").unionByName(unsure.join(gone, same, "left_anti"))


def release() -> None:
    """Gives memory that a task has freed back to the system: the worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch) or ()
        release()

    return df.mapInArrow(run, schema)


def sampled(docs: DataFrame, labels: DataFrame, label: str, rows: int, size: int, where: Column | None = None) -> DataFrame:
    """(doc_id, label, text) to train on: labelled documents in the order of a hash of doc_id, ``rows`` and ``size`` bytes of text at most.

    Null and other labels than 0 and 1 and null doc_ids don't count. Repeated doc_ids count as often as they are.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (F.lit(True) if where is None else where))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("label"), F.xxhash64("text")]
    found = found.orderBy(*order).limit(rows)
    so_far = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(*order))
    return found.withColumn("so_far", so_far).where(F.col("so_far") <= size).drop("so_far")


def learn(rows: DataFrame, train: Callable[[pa.Table], bytes]) -> bytes | None:
    """What ``train`` makes of all of ``rows``, a sample of bounded size, in one executor's task; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([train(pa.Table.from_batches(found))], pa.binary())], ["model"])
        found.clear()
        release()

    model = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return bytes(model[0]["model"]) if model else None


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of neighbouring rows with about ``most`` bytes together, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end
        first = end


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys, of batches that are sorted by them."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        cols = [table[k].combine_chunks().to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.zeros(table.num_rows, bool)
        for c in cols:
            cuts[1:] |= c[1:] != c[:-1]
        cuts[0] = bool(held) and any(held[-1][k][-1].as_py() != table[k][0].as_py() for k in keys)
        edges = [0, *np.flatnonzero(cuts).tolist(), table.num_rows] if not cuts[0] else [*np.flatnonzero(cuts).tolist(), table.num_rows]
        if cuts[0]:
            yield pa.concat_tables(held)
            held = []
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if a:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 128


def powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers or more of the base of running sums, and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, RUN_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.ones(size, np.uint64)
            out[1:] = np.uint64(base)
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from one running sum over all bytes."""
    up, down = powers_to(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    out = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    # Sums modulo 2**64 have known long collisions.
    for k in np.flatnonzero(ends - starts > LONG_SPAN).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the runs of true bytes; no run crosses a row's end."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    firsts = offsets[:-1]
    before[firsts[firsts < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    lasts = offsets[1:] - 1
    after[lasts[(lasts >= 0) & (offsets[1:] > offsets[:-1])]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, "right")
