"""Exact and near dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import minhash
from inkwell.llm.exact_dedup import exact_dedup, golomb_decode, golomb_encode
from inkwell.llm.minhash import near_dedup

SCHEMA = "doc_id long, text string, node string, sender string, component string, n string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def frame(spark, rows):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)


def exact_expected(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(lower(text), []).append(doc)
    out = []
    for doc, text in rows:
        ids = [d for d in groups[lower(text)] if d is not None]
        keep = max(ids, default=None)
        out.append((doc, keep, len(groups[lower(text)]), doc == keep, hashlib.sha256(lower(text).encode()).hexdigest()))
    return sorted(out, key=str)


EDGE = [(1, "Same text"), (2, "same TEXT"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 300_000), (8, "X" * 300_000), (9, "one"), (9, "one"), (None, "same text"), (None, "lone"), (10, "ſame"), (11, "\t a b")]


def test_exact_edges(spark):
    got = exact_dedup(frame(spark, EDGE)).drop("row_hash").collect()
    assert sorted((tuple(r) for r in got), key=str) == exact_expected(EDGE)


def test_exact_empty(spark):
    out = exact_dedup(frame(spark, []))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "row_hash"] and out.count() == 0


def test_exact_hot_group(spark):
    rng = random.Random(1)
    rows = [(i, "copied everywhere" if i % 3 == 0 else f"text {rng.randrange(400)}") for i in range(1500)]
    got = exact_dedup(frame(spark, rows).repartition(7)).drop("row_hash").collect()
    assert sorted((tuple(r) for r in got), key=str) == exact_expected(rows)


@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=200))
@settings(max_examples=60, deadline=None)
def test_golomb_round_trip(values):
    v = np.array(sorted(values), np.uint64)
    assert (golomb_decode(golomb_encode(v)) == v).all()


def test_golomb_is_small():
    v = np.unique(np.random.default_rng(1).integers(0, 2**60, 20_000, dtype=np.uint64))
    assert len(golomb_encode(v)) < len(v) * 8 * 0.85


def near_expected(rows):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            both = len(a & b)
            if a and b and 100 * both >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    out = []
    for i, (d, s) in enumerate(sets):
        c = least.get(find(i)) if s else d
        out.append((d, len(s), c, d == c))
    return sorted(out, key=str)


def near(spark, rows, parts=3):
    got = near_dedup(frame(spark, rows).repartition(parts)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    return sorted((tuple(r) for r in got), key=str)


def test_near_edges(spark):
    rows = [*EDGE, (20, "a b"), (21, "A B"), (22, "b a"), (23, " \n "), (24, "a b c d e"), (25, "a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 4"), (26, "a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 5")]
    assert near(spark, rows) == near_expected(rows)


def test_near_empty(spark):
    assert near(spark, []) == []


@pytest.mark.parametrize("seed, block", [(1, None), (2, 24)])
def test_near_cloud(spark, seed, block, monkeypatch):
    """A large group around one text with all similarities from little to much, and texts that share a passage; also in many blocks."""
    if block:
        monkeypatch.setattr(minhash, "BLOCK", block)
        monkeypatch.setattr(minhash, "VISITORS", block // 2)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base, passage = [word() for _ in range(80)], [word() for _ in range(40)]
    rows = []
    for i in range(500):
        text = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 10])):
            text[rng.randrange(len(text))] = word()
        rows.append((i, " ".join(text)))
    rows += [(500 + i, " ".join([word() for _ in range(rng.randrange(1, 60))] + passage)) for i in range(200)]
    rows += [(700 + i, " ".join(word() for _ in range(rng.randrange(1, 90)))) for i in range(100)]
    assert near(spark, rows, 8) == near_expected(rows)
