"""Packing along a space-filling curve.

Each document's tokens are hashed to a sparse vector, which a fixed random projection
takes to three dimensions; the cell it falls in gives a Hilbert key. Documents are
range-sorted by that key and laid end to end along the curve; the line is cut into
sequences, so that a sequence holds neighbouring documents and only the last has padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, mix, release, tune

LENGTH = 1024
DIMENSIONS, BITS, BUCKETS = 3, 16, 1024

#: Characters that all libraries class alike; texts with any other go to the tokenizer itself.
_NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-ɏ]|<\\|endoftext\\|>")
#: The pre-tokenizer's pattern, which byte-level files name by ``use_regex``.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _bytes_of() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them, as 16-bit numbers.

    A byte-level file whose merges are in the order of their ids is also read as ranks,
    which encode plain texts several times as fast; all else goes to the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.ranked = Tokenizer.from_file(path), None
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        spec = json.loads(self.tokenizer.to_str())
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        vocab, merges = model.get("vocab", {}), model.get("merges", [])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and spec.get("normalizer") is None
        if plain and model["type"] == "BPE" and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs)):
            import tiktoken

            byte = _bytes_of()
            special = {x["content"] for x in spec.get("added_tokens", [])}
            ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
            self.ranked = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.ranked is None or _NOT_PLAIN.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)
        try:
            return self.ranked.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.uint16)
        except ValueError:  # a run of a million blanks is too long for its pattern
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)


def projection() -> np.ndarray:
    """For each id its share of a document's point: a hashed bucket's random direction, rarer (larger) ids weighing more."""
    ids = np.arange(1 << 16, dtype=np.uint64)
    hashed = mix(ids + np.uint64(1))
    directions = np.random.default_rng(7).standard_normal((BUCKETS, DIMENSIONS))
    sign = np.where(hashed >> np.uint64(63), 1.0, -1.0)
    weight = np.log1p(ids.astype(float)) / np.log(1 << 16)
    return (directions[(hashed % np.uint64(BUCKETS)).astype(np.int64)] * (sign * weight)[:, None]).astype(np.float32)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions along the Hilbert curve of integer points (n, d) with ``bits`` bits a coordinate."""
    x = cells.astype(np.int64).copy()
    n, d = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            upper = (x[:, i] & q) != 0
            swap = np.where(upper, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(upper, p, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[:, d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def _encoded(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shares = Encoder(path), projection()
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for a in range(0, len(texts), 200):
                parts = [np.append(encoder(x), np.uint16(0)) for x in texts[a : a + 200]]
                n = np.array([len(x) for x in parts], np.int64)
                flat, codes = np.concatenate(parts), [x.astype("<u2").tobytes() for x in parts]
                edges = np.concatenate([[0], np.cumsum(n)[:-1]])
                point = np.add.reduceat(shares[flat], edges, axis=0) / n[:, None]
                cells = np.clip((1 << BITS) / (1 + np.exp(-6.0 * point)), 0, (1 << BITS) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, 200).cast(pa.int64()), pa.array(n), pa.array(hilbert_key(cells)), pa.array(codes, pa.binary())], ["doc_id", "n", "key", "ids"])
        del encoder, shares
        release()

    return encode


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, so_far = TaskContext.get().partitionId(), 0
    for batch in batches:
        ends = so_far + np.cumsum(batch.column("n").to_numpy())
        if len(ends):
            so_far = int(ends[-1])
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(np.full(batch.num_rows, part), pa.int64()), pa.array(ends)], ["uid", "part", "end"])


def _cut(length: int):
    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc, ids, at in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("at").to_pylist()):
            ids = np.frombuffer(ids.as_buffer(), "<u2").astype("<u4")
            done, n = 0, len(ids)
            while done < n:
                take = min(n - done, length - (at + done) % length)
                rows.append((doc, done, take, zlib.crc32(ids[done : done + take]), n, (at + done) // length, (at + done) % length))
                done += take
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return cut


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids by the tokenizer file and then id 0; null text counts as
    empty (id 0 alone). Pieces tile each document and each sequence without gaps; a
    sequence has ``length`` ids, only the very last may have fewer. Repeated rows and rows
    without doc_id are packed like any other; ties on the curve go by doc_id. Other
    columns are ignored; an empty table gives an empty result. Texts are encoded whole,
    however long. A vocabulary of more than 65,536 ids is refused with a ValueError.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = docs.mapInArrow(_encoded(tokenizer), "doc_id long, n long, key long, ids binary")
    coded = scratch.keep(coded.withColumn("uid", F.monotonically_increasing_id()))
    order = ["key", "doc_id", "uid"]
    line = coded.select("n", *order).repartitionByRange(*order).sortWithinPartitions(*order)
    line = scratch.keep(line.mapInArrow(_summed, "uid long, part long, end long"))
    # One number for each range partition is all that the driver sums up.
    parts = sorted((r["part"], r["e"]) for r in line.groupBy("part").agg(F.max("end").alias("e")).collect())
    bases = list(zip((p for p, _ in parts), accumulate((e for _, e in parts[:-1]), initial=0)))
    bases = spark.createDataFrame(bases, "part long, base long")
    ends = line.join(F.broadcast(bases), "part").select("uid", (F.col("end") + F.col("base")).alias("end"))
    placed = coded.select("uid", "doc_id", "n", "ids").join(ends, "uid").select("doc_id", "ids", (F.col("end") - F.col("n")).alias("at"))
    kinds = ", ".join(f"{c} long" for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))
    return map_arrow(placed, _cut(length), kinds)
