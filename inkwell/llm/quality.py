"""Quality classifier by supervised subword embeddings.

Words and character n-grams are hashed to learned vectors, a document is their average,
and a softmax over it gives the classes; vectors and softmax are trained together by
stochastic gradient descent on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import learn, map_arrow, runs, sampled, span_hashes, spans, strings, tune

#: log2 of the rows of the vector table, and a vector's length.
TABLE_BITS, WIDTH = 18, 8
GRAMS = (3, 4, 5)
#: Labelled documents that training sees at most, and passes over them.
SAMPLE, EPOCHS, RATE = 3000, 6, 0.5
#: Bytes of text that training sees at most.
SAMPLE_BYTES = 256 << 20

_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_GRAM = np.random.default_rng(11).integers(1, 2**31, (max(GRAMS) + 1, max(GRAMS)), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _mixed32(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h ^ (h >> np.uint32(12))) >> np.uint32(32 - TABLE_BITS)


def features(texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first row, end row, [(table rows, edges of the rows' features)]): words, word pairs, then n-grams of each length.

    Of a pair of words only whether they are equal is kept, in table rows 0 and 1.

    An n-gram is of bytes and may hold white space, so it knows where words begin and end.
    """
    data, offsets = strings(texts)
    for first, end in runs(offsets, 1 << 20):
        part, at = data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        starts, ends, row = spans(_NOT_SPACE[part], at)
        out = [((span_hashes(part, starts, ends) >> np.uint64(64 - TABLE_BITS)).astype(np.int64), np.searchsorted(row, np.arange(end - first + 1)))]
        again = np.zeros(len(starts), np.int64)
        again[1:] = out[0][0][1:] == out[0][0][:-1]
        firsts = out[0][1][:-1]
        again[firsts[firsts < len(again)]] = 0
        out.append((again, out[0][1]))
        wide = part.astype(np.uint32)
        for g in GRAMS:
            n = max(0, len(part) - g + 1)
            h = np.full(n, g, np.uint32)
            for k in range(g):
                h += wide[k : k + n] * _GRAM[g, k]
                h ^= h >> np.uint32(7)
            # A row has its n-grams but for those that reach into the next row.
            out.append((_mixed32(h), at))
        yield first, end, out


def counts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct table rows and their shares."""
    for first, end, kinds in features(texts):
        for r in range(end - first):
            found = [f[e[r] : max(e[r], e[r + 1] - (GRAMS[k - 2] - 1 if k > 1 else 0))] for k, (f, e) in enumerate(kinds)]
            rows, n = np.unique(np.concatenate([x.astype(np.int64) for x in found]), return_counts=True)
            yield rows, (n / max(1, n.sum())).astype(np.float32)


def train(texts: list[str], labels: list[int], seed: int = 5, epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """(one number per table row, bias): a document's log odds of label 1 are its features' mean plus the bias.

    The softmax is linear in the average of the vectors, so after training each vector
    is folded into its product with the difference of the two classes' weights.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << TABLE_BITS, WIDTH)).astype(np.float32)
    weights, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    docs = list(counts(pa.array(texts, pa.large_string())))
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)).tolist():
            rows, share = docs[i]
            own = vectors[rows]
            x = share @ own
            logits = weights @ x + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            now = rate * (1 - done / steps)
            back = p @ weights
            weights -= now * p[:, None] * x
            bias -= now * 0.1 * p
            # The mean's gradient is taken per feature, not per share: rare junk must move its vectors.
            vectors[rows] = own - now * np.minimum(1.0, share * 100)[:, None] * back
            done += 1
    return (vectors @ (weights[1] - weights[0])).astype(np.float32), float(bias[1] - bias[0])


def score(texts: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 of each text."""
    out = np.empty(len(texts))
    for first, end, kinds in features(texts):
        total, n = np.zeros(end - first), np.zeros(end - first)
        for k, (rows, edges) in enumerate(kinds):
            sums = np.concatenate([[0.0], np.cumsum(table[rows], dtype=np.float64)])
            start = np.minimum(edges[:-1], len(rows))
            last = np.maximum(start, edges[1:] - (GRAMS[k - 2] - 1 if k > 1 else 0))
            total += sums[last] - sums[start]
            n += last - start
        out[first:end] = 1 / (1 + np.exp(-(total / np.maximum(n, 1) + bias)))
    return out


def _fitted(rows: pa.Table) -> bytes:
    rows = rows.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("text", "ascending")])
    table, bias = train([x or "" for x in rows["text"].to_pylist()], rows["label"].to_pylist())
    return np.append(table, np.float32(bias)).tobytes()


def held_out(doc_id: str = "doc_id"):
    """Rows that no label is learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (of label 1), predicted.

    At most ``sample`` labelled documents of SAMPLE_BYTES in all, the first by a hash of
    doc_id, are trained on, in one task; a null label or doc_id is not. Null and empty texts have no
    features and get the bias's score; with no labelled rows every score is 0.5. A null
    doc_id is not held out. Repeated rows repeat. Other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = learn(sampled(docs, labels, "quality", sample, SAMPLE_BYTES, ~held_out()), lambda t: _fitted(t))
    both = np.frombuffer(model, np.float32) if model else np.zeros((1 << TABLE_BITS) + 1, np.float32)
    table, bias = both[:-1], float(both[-1])
    table = spark.sparkContext.broadcast(table)

    def scored(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(batch.column("text"), table.value, bias))], ["doc_id", "score"])

    out = map_arrow(docs, scored, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
