"""Label propagation over groups of nodes that no edge leaves: each is a task's work, and no vote is shuffled."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workers import ship
from ..sources import scratch

#: Edges that are dealt to a task at a time, and most edges of a group that is dealt as a whole.
PART_EDGES, GROUP_EDGES = 100_000, 1_000_000
#: Votes are compared when rounded to so many digits.
DIGITS = 6


def _rounded(values: np.ndarray) -> np.ndarray:
    """As F.round: by the shortest decimal of each value, halves up. Beyond 1e10 doubles have no more digits."""
    found, at = np.unique(values, return_inverse=True)
    unit = Decimal(1).scaleb(-DIGITS)
    return np.array([float(Decimal(repr(x)).quantize(unit, ROUND_HALF_UP)) if abs(x) < 1e10 else x for x in found.tolist()])[at]


def _spread(n: int, node: np.ndarray, near: np.ndarray, weight: np.ndarray, known: np.ndarray, rounds: int) -> np.ndarray:
    """The labels (places of nodes, which are sorted) of ``n`` nodes after ``rounds``; ``near`` votes at ``node``, and null weights count least."""
    label = np.arange(n)
    for _ in range(rounds if len(node) else 0):
        votes, at = np.unique(node * n + label[near], return_inverse=True)
        voter, given = np.divmod(votes, n)
        total, seen = np.bincount(at, weights=weight), np.bincount(at, weights=known) > 0
        starts = np.flatnonzero(np.r_[True, voter[1:] != voter[:-1]])
        of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(voter)]))
        best = np.maximum.reduceat(np.where(seen, total, -np.inf), starts)[of]
        # Few votes can be the greatest when rounded, and only where there are several must they be.
        first = np.flatnonzero((total >= best - 2 * 10.0**-DIGITS) | np.isnan(total) | ~seen)
        several = np.bincount(of[first], minlength=len(starts))[of[first]] > 1
        score = total[first]
        score[several] = _rounded(score[several])
        order = np.lexsort((-given[first], score, seen[first], of[first]))
        last = np.r_[of[first][order][1:] != of[first][order][:-1], True]
        won = first[order[last]]
        label = label.copy()
        label[voter[won]] = given[won]
    return label


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the row of each."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return pc.list_flatten(column).to_numpy(), np.repeat(np.arange(len(size)), size)


def _labelling(rounds: int) -> Callable[[pa.Table], pa.Table]:
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("node")
        node, copies = part["node"].to_numpy(), part["copies"].to_numpy()
        _, group = np.unique(part["place"].to_numpy(), return_inverse=True)
        heads, tail = _flat(part["heads"])
        blanks, bare = _flat(part["blanks"])
        weight = np.r_[_flat(part["weights"])[0], np.zeros(len(blanks))].astype(float)
        known, heads, tail = np.r_[np.ones(len(heads)), np.zeros(len(blanks))], np.r_[heads, blanks].astype(np.int64), np.r_[tail, bare]
        head = np.minimum(np.searchsorted(node, heads), len(node) - 1)
        inner = (node[head] == heads) & (group[head] == group[tail])
        # No edge leaves a group whose inner edges have as many ends as its nodes have edges.
        ends = np.bincount(group, weights=part["degree"].to_numpy())
        whole = ends == 2 * np.bincount(group[tail[inner]], minlength=len(ends))
        use = inner & whole[group[tail]] & (copies[head] > 0) & (copies[tail] > 0)
        a, b, known = np.r_[tail[use], head[use]], np.r_[head[use], tail[use]], np.r_[known[use], known[use]]
        label = _spread(len(node), a, b, np.r_[weight[use], weight[use]] * copies[b], known, rounds)
        return pa.table({"node": node, "copies": copies, "label": pa.array(node[label], mask=~whole[group])})

    return run


def whole_groups(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """(node, copies, label) of every end of ``edges`` (src, dst, weight): its label after ``rounds``, null where its group isn't closed.

    A node's place is the least of itself and its neighbours, and nodes of one place are a group. Where no
    edge leaves a group, no vote does, and it is labelled where it lies: edges are shuffled once to the list
    of their src, and lists once to their group. ``copies`` is how often ``nodes`` (node) holds the node;
    those it does not hold have no vote.
    """
    spark = edges.sparkSession
    ship(spark)
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("near")), F.struct(F.col("dst").alias("node"), F.col("src").alias("near")))).alias("e")).select("e.*")
    places = ends.groupBy("node").agg(F.least("node", F.min("near")).alias("place"), F.count("*").alias("degree"))
    held = nodes.groupBy("node").agg(F.count("*").alias("copies"))
    at = scratch.path(spark, "places")
    places.join(held, "node", "left").select("node", "place", "degree", F.coalesce("copies", F.lit(0)).cast("long").alias("copies")).write.parquet(at)
    places = spark.read.parquet(at)

    parts = 1 + (places.agg(F.sum("degree")).first()[0] or 0) // (2 * PART_EDGES)
    sizes = places.groupBy("place").agg(F.sum("degree").alias("ends"))
    large = F.broadcast(sizes.where(F.col("ends") > 2 * GROUP_EDGES).select("place"))  # a row for so many edges
    weighed = F.col("weight").isNotNull()
    lists = edges.groupBy(F.col("src").alias("node")).agg(
        F.collect_list(F.when(weighed, F.col("dst"))).alias("heads"), F.collect_list("weight").alias("weights"), F.collect_list(F.when(~weighed, F.col("dst"))).alias("blanks")
    )  # heads and weights are of the same rows
    rows = places.join(large, "place", "left_anti").join(lists, "node", "left").withColumn("part", F.pmod(F.xxhash64("place"), F.lit(parts)))
    at = scratch.path(spark, "labels")
    rows.groupBy("part").applyInArrow(_labelling(rounds), "node long, copies long, label long").write.parquet(at)
    return spark.read.parquet(at).unionByName(places.join(large, "place", "left_semi").select("node", "copies", F.lit(None).cast("long").alias("label")))
