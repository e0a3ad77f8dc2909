"""Communities of large graphs by contraction: rounds of merges that gain modularity and don't depend on each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch

#: The least gain, as a share of twice the edges squared, that is no rounding error.
LEAST = 5e-13
#: Passes over the whole, and rounds of moves in one.
PASSES, MOVES = 4, 6


def _keep(df: DataFrame) -> DataFrame:
    at = scratch.path(df.sparkSession, "contraction")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def communities(edges: DataFrame, total: float) -> DataFrame:
    """(node, community) of the nodes of ``edges`` (src, dst), each with weight 1; a community is named by its smallest node.

    ``total`` is twice the weight of the whole graph. Communities are contracted, then single
    nodes move to where they gain most, then the communities that come of it are contracted
    again, as long as modularity grows (PASSES times at most).
    """
    pairs = _keep(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("w")))
    ends = pairs.select(F.col("a").alias("c"), "w").unionByName(pairs.select(F.col("b").alias("c"), "w"))
    degree = _keep(ends.groupBy("c").agg(F.sum("w").alias("d")))
    best = contract(pairs, degree, total)
    score = _score(pairs, degree, best, total)
    for _ in range(PASSES):
        moved = refine(pairs, degree, best, total)
        of = lambda c: moved.select(F.col("node").alias(c), F.col("community").alias(f"{c}_c"))
        above = pairs.join(of("a"), "a").join(of("b"), "b").where("a_c <> b_c")
        above = _keep(above.groupBy(F.least("a_c", "b_c").alias("a"), F.greatest("a_c", "b_c").alias("b")).agg(F.sum("w").alias("w")))
        sizes = _keep(moved.join(degree, F.col("node") == F.col("c")).groupBy("community").agg(F.sum("d").alias("d")).withColumnRenamed("community", "c"))
        merged = contract(above, sizes, total)
        moved = _keep(moved.join(merged.toDF("community", "_to"), "community", "left").select("node", F.coalesce("_to", "community").alias("community")))
        new = _score(pairs, degree, moved, total)
        if new <= score + 1e-9:
            break
        best, score = moved, new
    names = best.groupBy("community").agg(F.min("node").alias("name"))
    return best.join(names, "community").select("node", F.col("name").alias("community"))


def _score(pairs: DataFrame, degree: DataFrame, members: DataFrame, total: float) -> float:
    """What these pairs add to the modularity of the whole graph."""
    of = lambda c: members.select(F.col("node").alias(c), F.col("community").alias(f"{c}_c"))
    inner = pairs.join(of("a"), "a").join(of("b"), "b").where("a_c = b_c").agg(F.sum("w")).first()[0] or 0
    square = members.join(degree, F.col("node") == F.col("c")).groupBy("community").agg(F.sum("d").cast("double").alias("d")).agg(F.sum(F.col("d") * F.col("d"))).first()[0] or 0.0
    return 2 * inner / total - square / total**2


def refine(pairs: DataFrame, degree: DataFrame, members: DataFrame, total: float, rounds: int = MOVES) -> DataFrame:
    """``members`` after rounds in which each second node, by a coin, moves to the community where it gains most."""
    both = _keep(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    for k in range(rounds):
        own = _keep(members.join(degree, F.col("node") == F.col("c")).select("node", "community", "d"))
        held = own.groupBy("community").agg(F.sum("d").alias("all_d"))
        to = both.join(own.select(F.col("node").alias("b"), F.col("community").alias("to")), "b").groupBy(F.col("a").alias("node"), "to").agg(F.sum("w").alias("w"))
        to = to.join(own, "node").join(held.toDF("to", "to_d"), "to")
        stays = F.col("to") == F.col("community")
        gain = F.col("w") * F.lit(float(total)) - F.col("d") * (F.col("to_d") - F.when(stays, F.col("d")).otherwise(0))
        best = to.groupBy("node").agg(F.max_by("to", F.struct(F.when(~stays, gain).alias("g"), -F.col("to"))).alias("to"), F.max(F.when(~stays, gain)).alias("gain"), F.max(F.when(stays, gain)).alias("stay"))
        # A node without a link into its own community leaves nothing but that community's degree behind.
        best = best.join(own, "node").join(held, "community")
        stay = F.coalesce("stay", -F.col("d") * (F.col("all_d") - F.col("d")).cast("double"))
        moves = _keep(best.where((F.col("gain") - stay > total**2 * LEAST) & (F.pmod(F.xxhash64("node", F.lit(k)), F.lit(2)) == 0)).select("node", "to"))
        if moves.isEmpty():
            break
        members = _keep(members.join(moves, "node", "left").select("node", F.coalesce("to", "community").alias("community")))
    return members


def contract(pairs: DataFrame, degree: DataFrame, total: float) -> DataFrame:
    """(node, community) after rounds of merges of ``pairs`` (a, b, w) of nodes of ``degree`` (c, d).

    Merging two communities of degrees d and e with w edges between them gains
    w * total - d * e. In a round each community looks for its best partner (ties to the
    smaller). Two that are each other's best merge. Others whose best is one of such two
    join them, if they would still gain by it had all others that want to join done so.
    Then edges are added up between the new communities. Every step is a join or a sum by
    community or pair; the pair of the greatest gain always merges, so it ends.
    """
    members = _keep(degree.select(F.col("c").alias("node"), F.col("c").alias("community")))
    least = total**2 * LEAST
    while True:
        both = pairs.select("a", "b", "w").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        both = both.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
        gain = F.col("w") * F.lit(float(total)) - F.col("da") * F.col("db")
        # A pair's gain is the same number from either side; of equal gains the pair of the least ends counts, for both.
        order = F.struct(gain.alias("gain"), -F.least("a", "b"), -F.greatest("a", "b"))
        best = both.where(gain > least).groupBy("a").agg(F.max_by(F.struct("b", "da"), order).alias("x"))
        best = _keep(best.select("a", "x.b", "x.da"))
        if best.isEmpty():
            return members
        mutual = best.join(best.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"])
        mutual = _keep(mutual.select("a", F.least("a", "b").alias("into")))
        # What wants to join a merging two, and by how many edges it hangs on both of them.
        wants = best.join(mutual.select(F.col("a").alias("b"), "into"), "b").join(mutual.select("a"), "a", "left_anti").select("a", "into", "da")
        wants = _keep(wants)
        core = mutual.join(degree.toDF("a", "da"), "a")
        held = core.unionByName(wants.select("a", "into", "da")).groupBy("into").agg(F.sum("da").alias("all_d"))
        hang = both.select("a", "b", "w").join(mutual.select(F.col("a").alias("b"), "into"), "b").groupBy("a", "into").agg(F.sum("w").alias("w"))
        joins = wants.join(hang, ["a", "into"]).join(held, "into").where(F.col("w") * F.lit(float(total)) - F.col("da") * (F.col("all_d") - F.col("da")) > least)
        moves = _keep(mutual.unionByName(joins.select("a", "into")).where("a <> into"))
        to = lambda df, c: df.join(moves.toDF(c, "_to"), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        members = _keep(to(members.withColumnRenamed("community", "c"), "c").withColumnRenamed("c", "community"))
        degree = _keep(to(degree, "c").groupBy("c").agg(F.sum("d").alias("d")))
        moved = to(to(pairs, "a"), "b").where("a <> b")
        pairs = _keep(moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")))
