"""The prefix trie, vector codes and nearest neighbours against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from inkwell.llm import neighbours, prefix_trie
from inkwell.llm.neighbours import InvertedFiles, PermutationIndex, Pivots, nearest_neighbours
from inkwell.llm.prefix_trie import conversation_trie
from inkwell.llm.vector_codes import LARGEST, KdTree, vector_codes

TURNS = "conv_id long, turn long, role string, text string, depth string, node string, len string, class string"
VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, id string, v string, query string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], TURNS)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "a", "b", "c", "d", "e") for i, v, label in rows], VECTORS)


# --- trie


def trie_expected(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), (r, x)))
    own = {c: [y[3] for y in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:])
    members, kids = defaultdict(list), defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    ends = {p: ",".join(map(str, sorted(c for c in m if len(full[c]) == len(p)))) for p, m in members.items()}
    rows = ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())
    return sorted(rows, key=str)


def trie(df):
    return sorted((tuple(r) for r in conversation_trie(df).collect()), key=str)


TRIES = {
    "nulls, ties, repeats": [(100, None, "user", "a"), (100, 1, None, "b"), (100, 1, "user", "b"), (101, 0, "user", None), (101, 0, "user", None), (None, 0, "user", "a"), (103, 3, None, None), (7, 0, "u", "é👍"), (107, 5, "x", "y")],
    "one conversation": [(250, i, "user", f"t{i}") for i in range(9)],
    "turnless": [(100 + k, 0, "user", "only") for k in range(1, 40)],
    "base shorter than what is shared": [(300, 0, "s", "base")] + [(300 + k, i, "u", f"{k % 3} {i}") for k in range(1, 30) for i in range(k % 9)],
    "negative ids": [(-c, i, "u", str(i)) for c in range(0, 260, 7) for i in range(4)],
    "copies of one long conversation": [(1000 * k, i, "u", f"turn {i}") for k in range(6) for i in range(150 - (k == 5))],
}


@pytest.mark.parametrize("name", TRIES)
def test_trie_edges(spark, name):
    rows = TRIES[name]
    assert trie(turns(spark, rows).repartition(5)) == trie_expected(rows)


def test_trie_of_few_turn_kinds(spark):
    rng = random.Random(3)
    rows = [(c, i, rng.choice("ua"), "hot" if i == 0 and c % 3 else rng.choice(["", "x", "yy"])) for c in range(400) for i in range(rng.randrange(1, 12))]
    assert trie(turns(spark, rows).repartition(7)) == trie_expected(rows)


def test_trie_empty_and_long(spark):
    out = conversation_trie(turns(spark, []))
    assert out.columns == prefix_trie.COLUMNS and out.count() == 0
    rows = [(1, 0, "u", "x" * 1_000_000), (2, 0, "u", "x" * 1_000_000), (2, 1, "u", "")]
    assert trie(turns(spark, rows)) == trie_expected(rows)


def test_trie_conversation_over_partitions(spark, monkeypatch):
    """One conversation holds most rows; chains and pieces of ids are cut small."""
    monkeypatch.setattr(prefix_trie, "CHAIN", 10)
    monkeypatch.setattr(prefix_trie, "PIECE", 64)
    rows = [(8, i, "u", str(i % 5)) for i in range(3000)] + [(9, i, "u", str(i % 5)) for i in range(2500)] + [(c, 0, "u", "0") for c in range(600, 700)]
    assert trie(turns(spark, rows).repartition(6)) == trie_expected(rows)


# --- codes


def codes_expected(rows, parts, entries, rounds):
    kept = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % parts == 0]
    lengths = sorted({len(v) for _, v, _ in kept}, key=lambda d: (-sum(len(v) == d for _, v, _ in kept), d))
    kept = [(i, [max(-LARGEST, min(LARGEST, math.floor(256 * float(np.float32(x))))) for x in v], lab) for i, v, lab in kept if len(v) == lengths[0]]
    w = lengths[0] // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k])] if k in own else e for k, e in enumerate(books[p])]
    named = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, total = [], defaultdict(int)
    for i, v, lab in kept:
        near = [nearest(cut(v, p), books[p]) for p in range(parts)]
        total[lab] += sum(d for d, _ in near)
        out.append((i, lab, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near)))
    return sorted(((*r, total[r[1]], named) for r in out), key=str)


def test_codes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.choice([-0.5, 0.0, 0.01, 0.25, 1.0], 32).tolist(), None if i % 7 == 0 else i % 3) for i in range(300)]
    rows += [(None, rng.random(32).tolist(), 1), (3, rows[3][1], 0), (3, rng.random(32).tolist(), 0), (-5, [1e30] * 32, 2), (400, None, 1), (401, [], 1), (402, [math.nan] * 32, 1), (403, [math.inf] * 32, 1), (404, [None] * 32, 1), (405, [0.5] * 16, 1), (406, [0.5] * 31, 1)]
    got = sorted((tuple(r) for r in vector_codes(frame(spark, rows).repartition(5)).collect()), key=str)
    assert got == codes_expected(rows, 16, 64, 2)


def test_codes_of_few_and_hot_rows(spark):
    rows = [(i, [0.5, -0.5] * 4 if i % 3 else [i / 100, 0.0] * 4, 1) for i in range(200)]
    got = sorted((tuple(r) for r in vector_codes(frame(spark, rows), parts=4, entries=8, rounds=3).collect()), key=str)
    assert got == codes_expected(rows, 4, 8, 3)
    few = rows[:3]
    assert sorted((tuple(r) for r in vector_codes(frame(spark, few), parts=2).collect()), key=str) == codes_expected(few, 2, 64, 2)
    out = vector_codes(frame(spark, [(1, None, 1)]))
    assert out.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_kd_tree_ties(seed):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-2, 3, (64, 1 + seed % 4))  # many equal ones
    points = rng.integers(-4, 5, (3000, entries.shape[1]))
    far = ((points[:, None, :] - entries) ** 2).sum(2)
    found, best = KdTree(entries).nearest(points)
    assert (found == far.argmin(1)).all() and (best == far.min(1)).all()


# --- neighbours


def product(a, b):
    """In the order of the components."""
    out = 0.0
    for x, y in zip(a, b):
        out += float(x) * float(y)
    return out


def nearest_expected(rows, k=20, every=20):
    kept = [(i, np.float32(v).astype(float)) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for a, (i, v) in enumerate(kept):
        if i is not None and i % every == 0:
            scores = [(-product(u, v), neighbours.NO_ID if j is None else j) for b, (j, u) in enumerate(kept) if b != a]
            out.setdefault(i, []).append([(None if j == neighbours.NO_ID else j, -s) for s, j in sorted(scores)[:k]])
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    return out


def recall(got, want):
    hits = total = 0
    for q, lists in want.items():
        have = [j for _, j, _ in got[q]]
        for w in lists:
            total += len(w)
            hits += sum(j in have for j, _ in w)
    return hits / total


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(11)
    rows = [(i, (rng.normal(size=24) * (1 + i % 5)).tolist(), 0) for i in range(2000)]
    got, want = found(nearest_neighbours(frame(spark, rows).repartition(4))), nearest_expected(rows)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    vectors = {i: np.float32(v).astype(float) for i, v, _ in rows}
    for q, hits in got.items():
        assert [r for r, _, _ in hits] == list(range(1, 21)) and q not in [j for _, j, _ in hits]
        assert [(-s, j) for _, j, s in hits] == sorted((-s, j) for _, j, s in hits)
        assert all(s == product(vectors[j], vectors[q]) for _, j, s in hits)


def test_neighbours_of_copies(spark):
    """A third of all rows are one vector, a third are near it: ties go to the smallest ids, and nothing is lost."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=16)
    rows = [(i, (base if i % 3 == 0 else base + 1e-3 * rng.normal(size=16) if i % 3 == 1 else rng.normal(size=16)).tolist(), 0) for i in range(1500)]
    got, want = found(nearest_neighbours(frame(spark, rows).repartition(6))), nearest_expected(rows)
    assert recall(got, want) >= 0.9
    copies = [i for i in want if i % 3 == 0]
    exact = [q for q in copies if [j for _, j, _ in got[q]] == [j for j, _ in want[q][0]]]
    assert len(exact) >= 0.9 * len(copies)


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0], 1), (20, [0.0, 2.0], 1), (20, [0.0, 2.0], 1), (20, [1.0, 1.0], 1), (None, [3.0, 3.0], 1), (3, None, 1), (40, [0.0, 0.0], 1), (60, [math.nan, 1.0], 1), (80, [None, 1.0], 1), (5, [-1.0, -0.0], 1), (100, [1.0, 2.0, 3.0], 1), (120, [], 1), (7, [math.inf, 0.0], 1)]
    clean = [r for r in rows if r[0] != 100]
    got, want = nearest_neighbours(frame(spark, rows)).collect(), nearest_expected(clean)
    have = defaultdict(list)
    for r in got:
        have[r.query_id].append((r["rank"], r.vec_id, r.score))
    expected = {q: sorted((k + 1, j, s) for w in lists for k, (j, s) in enumerate(w)) for q, lists in want.items()}
    assert {q: sorted(v, key=str) for q, v in have.items()} == {q: sorted(v, key=str) for q, v in expected.items()}
    for few in ([], [(20, [1.0, 1.0], 0)]):
        out = nearest_neighbours(frame(spark, few))
        assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.count() == 0


def test_likeness_is_the_footrule():
    rng = np.random.default_rng(1)
    pivots = Pivots(rng.normal(size=(40, 8)), 12)
    ranked = pivots.ranked(rng.normal(size=(50, 8)))
    like = pivots.likeness(InvertedFiles(ranked, 40), ranked[0])
    place = lambda r: {int(p): i for i, p in enumerate(r)}
    for row, got in zip(ranked, like):
        a, b = place(ranked[0]), place(row)
        footrule = sum(abs(a.get(p, 12) - b.get(p, 12)) for p in range(40))
        assert footrule == 12 * 13 - 2 * got


def test_shards_and_routes(spark, monkeypatch):
    """Many shards, summaries in blocks: the same rows as from one shard."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) + 6 * np.eye(8)[i % 8]).tolist(), 0) for i in range(900)]
    df = frame(spark, rows)
    one = sorted(map(tuple, nearest_neighbours(df).collect()))
    monkeypatch.setattr(neighbours, "SHARD", 64)
    monkeypatch.setattr(neighbours, "SUMMARIES", 4)
    many = sorted(map(tuple, nearest_neighbours(df).collect()))
    index = PermutationIndex(df.selectExpr("vec_id as id", "cast(embedding as array<double>) as v"))
    assert index.n_shards == 15 and {r[0] for r in index.shards.groupBy("shard").count().select("count").collect()} == {64, 4}
    assert sum(a == b for a, b in zip(one, many)) >= 0.97 * len(one) and len(one) == len(many)
