"""Exact dedup by a Golomb-coded fingerprint exchange.

Every sender (a run of documents) sorts the 64-bit fingerprints of its texts and sends
each owner of a range of fingerprints its share, as one Golomb-Rice coded message with a
bit for each fingerprint that repeats within the sender. An owner decodes its messages,
finds the fingerprints held twice, and answers each message by a bitmap in the message's
order. Senders look their documents up in the bitmaps. Only the documents so suspected
have their texts shuffled, and texts are compared byte for byte.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RowFilter, Scratch, groups, row_hash, tune

#: Documents in a sender's run, and fingerprints that an owner has on average: both bound a task's
#: memory, and together they keep messages long (RUN * OWNED / documents fingerprints each).
RUN, OWNED = 1 << 18, 1 << 20


def golomb_encode(values: np.ndarray) -> bytes:
    """Ascending distinct unsigned 64-bit numbers as (n, k, Rice codes of the gaps).

    ``k`` follows the mean gap, so a code takes about 2 + log2(mean gap) bits.
    """
    n = len(values)
    if not n:
        return b"\0" * 5
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    k = max(0, int(math.log2(max(1, int(values[-1]) // n))))
    high, low = (gaps >> np.uint64(k)).astype(np.int64), gaps & np.uint64((1 << k) - 1)
    ends = np.cumsum(high + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    bits = ((low[:, None] >> np.arange(k, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.uint8)
    return n.to_bytes(4, "little") + k.to_bytes(1, "little") + np.packbits(np.concatenate([unary, bits.ravel()])).tobytes()


def golomb_decode(code: bytes) -> np.ndarray:
    """The numbers that :func:`golomb_encode` was given."""
    n, k = int.from_bytes(code[:4], "little"), code[4]
    if not n:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(code, np.uint8, offset=5))
    ends = np.flatnonzero(bits)[:n]  # the n-th 1 ends the unary part, whatever the low bits are
    high = np.diff(ends, prepend=-1) - 1
    first = int(ends[-1]) + 1
    low = bits[first : first + n * k].reshape(n, k).astype(np.uint64) << np.arange(k, dtype=np.uint64)[None, :]
    return np.cumsum((high.astype(np.uint64) << np.uint64(k)) + low.sum(axis=1, dtype=np.uint64), dtype=np.uint64)


def _lowered(batch: pa.RecordBatch) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in pc.ascii_lower(batch.column("text").cast(pa.large_string())).cast(pa.large_binary())]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    sender, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        digests = [hashlib.sha256(x).digest() for x in _lowered(batch)]
        runs = (seen + np.arange(len(digests))) // RUN
        seen += len(digests)
        prints = np.frombuffer(b"".join(x[:8] for x in digests), "<i8") if digests else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(prints), pa.array([x.hex() for x in digests], pa.string()), pa.array(sender * (1 << 31) + runs, pa.int64()), batch.column("row_hash")], ["doc_id", "fp", "text_sha256", "sender", "row_hash"])


def _sent(owners: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["sender"]):
            values, counts = np.unique(table["fp"].to_numpy().view(np.uint64), return_counts=True)
            owner = (values >> np.uint64(32)).astype(np.int64) * owners >> 32
            cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(values)]
            parts = [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([table["sender"][0].as_py()] * len(parts), pa.int64()), pa.array([int(owner[a]) for a, _ in parts], pa.int64()), pa.array([golomb_encode(values[a:b] - _base(int(owner[a]), owners)) for a, b in parts], pa.binary()), pa.array([np.packbits(counts[a:b] > 1).tobytes() for a, b in parts], pa.binary())], ["sender", "owner", "code", "twice"])

    return send


def _base(owner: int, owners: int) -> np.uint64:
    """The smallest fingerprint of an owner's range."""
    return np.uint64(-(-owner * (1 << 32) // owners) << 32)


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in groups(batches, ["owner"]):
        codes = [golomb_decode(x) for x in table["code"].to_pylist()]
        sizes = [len(x) for x in codes]
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table["twice"].to_pylist(), sizes)]).astype(bool)
        _, back, counts = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
        known = np.bincount(back, weights=twice) > 0
        known |= counts > 1
        bits = np.split(known[back], np.cumsum(sizes)[:-1])
        yield pa.RecordBatch.from_arrays([table["sender"].combine_chunks(), table["owner"].combine_chunks(), pa.array([np.packbits(x).tobytes() for x in bits], pa.binary())], ["sender", "owner", "bitmap"])


def _looked_up(owners: int):
    def look_up(prints: pa.Table, answers: pa.Table) -> pa.Table:
        own = prints["fp"].to_numpy().view(np.uint64)
        values, back = np.unique(own, return_inverse=True)
        owner = (values >> np.uint64(32)).astype(np.int64) * owners >> 32
        flags = np.zeros(len(values), bool)
        for at, bitmap in zip(answers["owner"].to_pylist(), answers["bitmap"].to_pylist()):
            a, b = np.searchsorted(owner, [at, at + 1])
            flags[a:b] = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=b - a)
        return pa.table({"doc_id": prints["doc_id"], "fp": prints["fp"], "text_sha256": prints["text_sha256"], "row_hash": prints["row_hash"], "suspect": pa.array(flags[back])})

    return look_up


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _lowered(batch)
        digests = [hashlib.sha256(x).digest() for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([int.from_bytes(x[:8], "little", signed=True) for x in digests], pa.int64()), pa.array([x.hex() for x in digests], pa.string()), pa.array(texts, pa.binary())], ["doc_id", "fp", "text_sha256", "body"])


def exact_dedup(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, row_hash.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with
    the largest doc_id stays. Null text counts as empty. A null doc_id is smaller than any
    other: such a row stays only where its whole group has no doc_id (keep_id is then
    null and kept true). Rows repeated with one doc_id all carry kept = true if it is
    the largest. Other columns are ignored, an empty table gives an empty result, and a
    text of any length is hashed whole.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_hash())
    prints = scratch.keep(docs.mapInArrow(_fingerprints, "doc_id long, fp long, text_sha256 string, sender long, row_hash long"))
    owners = owners or max(math.ceil(prints.count() / OWNED), min(200, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    held = prints.select("sender", "fp").repartition("sender").sortWithinPartitions("sender")
    sent = held.mapInArrow(_sent(owners), "sender long, owner long, code binary, twice binary")
    answers = sent.repartition("owner").sortWithinPartitions("owner").mapInArrow(_answered, "sender long, owner long, bitmap binary")
    flagged = scratch.keep(prints.groupBy("sender").cogroup(answers.groupBy("sender")).applyInArrow(_looked_up(owners), "doc_id long, fp long, text_sha256 string, row_hash long, suspect boolean"))
    scratch.drop(prints)

    suspects = flagged.where("suspect")
    texts = RowFilter(suspects, "doc_id").some(docs, "doc_id").select("doc_id", "text").mapInArrow(_texts, "doc_id long, fp long, text_sha256 string, body binary")
    ids = suspects.select(F.col("doc_id").alias("d"), F.col("fp").alias("f")).distinct()
    texts = texts.join(ids, texts["doc_id"].eqNullSafe(ids["d"]) & (texts["fp"] == ids["f"]), "left_semi")
    # Byte for byte: the body itself is the grouping key. Copies meet in the map-side aggregate first.
    bodies = texts.groupBy("text_sha256", "body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # One body for a digest, or the digest can't stand for the body: this stops rather than merge different texts.
    same = bodies.groupBy("text_sha256").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("bodies"))
    same = scratch.keep(same.withColumn("group_size", F.when(F.col("bodies") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts with one SHA-256")).cast("long"))).drop("bodies"))
    out = suspects.join(same, "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256", "row_hash")
    alone = flagged.where("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256", "row_hash")
    return out.unionByName(alone).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "row_hash")
