"""Toxicity by cumulative-link ordinal regression.

P(grade >= g) = sigmoid(w.x - cut_g): the thresholds share one weight vector over sparse
text features (words and their beginnings), and the expected grade is the severity. A part
of the labelled documents is held back from a first model: they tell how far the cuts must
be moved, all by one number, for the odds of a document at the first cut to be as wanted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import learn, map_arrow, row_hash, runs, sampled, span_hashes, spans, strings, tune

TABLE_BITS = 20
GRADES = 3
#: Labelled documents that training sees at most, and the steps it takes, in 8 to 200 passes.
SAMPLE, STEPS = 8000, 90_000
#: Pull of every weight towards 0, and the step of the weights.
SPARSE, RATE = 4e-2, 0.3
#: How many times as likely toxic as clean a document is at the first cut: a filter that takes a clean document costs more.
CAUTION = 3.0
#: One labelled document in so many is held back from training, to move the cuts by.
HELD_BACK = 5
#: Bytes of text that training sees at most.
SAMPLE_BYTES = 256 << 20
#: Marked words up to which a toxic document has grade 1, or grade 2.
MILD, STRONG = 2, 5

_WORD = np.zeros(256, bool)
_WORD[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text its features: whole lower-cased words, and words' first 4 and 5 bytes if longer."""
    data, offsets = strings(pc.utf8_lower(texts.cast(pa.large_string())))
    shift = np.uint64(64 - TABLE_BITS)
    for first, end in runs(offsets):
        part, at = data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        starts, ends, row = spans(_WORD[part], at)
        found = [span_hashes(part, starts, ends)]
        found += [np.where(ends - starts > k, span_hashes(part, starts, np.minimum(ends, starts + k)) * np.uint64(2 * k + 1), found[0]) for k in (4, 5)]
        found = (np.stack(found, axis=1) >> shift).astype(np.int32)
        edges = np.searchsorted(row, np.arange(end - first + 1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield found[a:b]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def grades_of(words: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Ordered grades 0 to 3 from labels that only say toxic or not.

    Features that stand in toxic documents at odds of e**3 or more are marked; the number
    of a toxic document's words with a marked feature gives its grade (at least 1).
    """
    n1, n0 = np.full(1 << TABLE_BITS, 0.5), np.full(1 << TABLE_BITS, 0.5)
    for found, t in zip(words, toxic):
        (n1 if t else n0)[np.unique(found)] += 1
    marked = (np.log(n1 / (toxic.sum() + 1)) - np.log(n0 / ((1 - toxic).sum() + 1)) >= 3) & (n1 >= 3)
    hits = np.array([int(marked[f].any(axis=1).sum()) if len(f) else 0 for f in words])
    return np.where(toxic == 0, 0, np.where(hits <= MILD, 1, np.where(hits <= STRONG, 2, 3)))


def moved(scores: np.ndarray, toxic: np.ndarray) -> float | None:
    """The score at which a document is CAUTION times as likely toxic as clean.

    A logistic curve of one slope and one offset over the scores, by Newton's method;
    None where a sort is missing or the slope is not positive.
    """
    if not 0 < toxic.sum() < len(toxic):
        return None
    x, b, least = np.stack([scores, np.ones(len(scores))], axis=1), np.zeros(2), 1e-3 * np.eye(2)
    for _ in range(50):
        p = _sigmoid(x @ b)
        b -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + least, x.T @ (p - toxic) / len(x) + least @ b)
    return float((np.log(CAUTION) - b[1]) / b[0]) if b[0] > 0 else None


def _descend(words: list[np.ndarray], toxic: np.ndarray, steps: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(weights, cuts) by stochastic gradients with per-feature rates and soft thresholds towards 0."""
    y, docs = grades_of(words, toxic), [np.unique(f) for f in words]
    seen = np.zeros(1 << TABLE_BITS, np.int64)
    for d in docs:
        seen[d] += 1
    docs = [d[seen[d] >= 2] for d in docs]  # a feature of one document says nothing of others
    w, past = np.zeros(1 << TABLE_BITS), np.full(1 << TABLE_BITS, 1e-2)
    cuts = np.arange(1.0, GRADES + 1)
    for epoch in range(min(200, max(8, steps // max(1, len(docs))))):
        for i in rng.permutation(len(docs)).tolist():
            d = docs[i]
            z = w[d].sum()
            slope = _sigmoid(z - cuts) - (y[i] >= np.arange(1, GRADES + 1))
            g = slope.sum()
            past[d] += g * g
            step = RATE / np.sqrt(past[d])
            now = w[d] - step * g
            w[d] = np.sign(now) * np.maximum(0, np.abs(now) - step * SPARSE)
            cuts = np.maximum.accumulate(cuts + 0.02 * slope / (1 + epoch))
    return w, cuts


def train(texts: pa.Array, toxic: list[int], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, cuts) of all the documents; the cuts are moved as far as those of a first model must be for what it has not seen."""
    rng = np.random.default_rng(seed)
    words, toxic = list(features(texts)), np.array(toxic)
    if not toxic.any():
        return np.zeros(1 << TABLE_BITS, np.float32), np.full(GRADES, 30.0)  # nothing is known of toxic texts
    back = np.arange(len(words)) % HELD_BACK == HELD_BACK - 1
    w, first = _descend([words[i] for i in np.flatnonzero(~back)], toxic[~back], STEPS, rng)
    least = moved(np.array([w[np.unique(words[i])].sum() for i in np.flatnonzero(back)]), toxic[back])
    w, cuts = _descend(words, toxic, STEPS, rng)
    return w.astype(np.float32), cuts if least is None else cuts + (least - first[0])


def _fitted(rows: pa.Table) -> bytes:
    rows = rows.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("text", "ascending")])
    weights, cuts = train(rows["text"].combine_chunks(), rows["label"].to_pylist())
    return np.concatenate([weights, cuts.astype(np.float32)]).tobytes()


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, severity (expected grade), grade, score (P(grade >= 1)), toxic, row_hash.

    At most ``sample`` labelled documents of SAMPLE_BYTES in all, the first by a hash of
    doc_id, are trained on; null labels and doc_ids are not. The grade is the last whose
    probability is a half, and a grade of 1 or more is toxic. Null and empty texts have no
    features; with no labelled toxic rows nothing is toxic. Repeated rows repeat. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_hash())
    model = learn(sampled(docs, labels, "toxic", sample, SAMPLE_BYTES), lambda t: _fitted(t))
    both = np.frombuffer(model, np.float32) if model else np.concatenate([np.zeros(1 << TABLE_BITS, np.float32), np.full(GRADES, 30, np.float32)])
    weights, cuts = both[: 1 << TABLE_BITS], both[1 << TABLE_BITS :].astype(float)
    weights = spark.sparkContext.broadcast(weights)

    def scored(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        z = np.array([weights.value[np.unique(f)].sum() for f in features(batch.column("text"))])
        p = _sigmoid(z[:, None] - cuts[None, :])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p.sum(axis=1)), pa.array((p >= 0.5).sum(axis=1), pa.int32()), pa.array(p[:, 0]), batch.column("row_hash")], ["doc_id", "severity", "grade", "score", "row_hash"])

    out = map_arrow(docs, scored, "doc_id long, severity double, grade int, score double, row_hash long")
    return out.select("doc_id", "severity", "grade", "score", (F.col("grade") >= 1).alias("toxic"), "row_hash")
