"""Shortest paths from many sources at once, and what they give each node, as supersteps over (source, node) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch

#: Distances that differ by less are equal.
TIE = 1e-12
#: (source, node) rows of a block of sources that the supersteps hold at a time.
BLOCK_ROWS = 50_000_000


def _keep(df: DataFrame) -> DataFrame:
    """Written and read again, so that a superstep's plan does not hold all earlier ones."""
    spark: SparkSession = df.sparkSession
    at = scratch.path(spark, "paths")
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def distances(near: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, dist) of every node that a source reaches. ``near`` is (tail, head, weight), both ways, weights above zero.

    A superstep sends the nodes that came closer in the last one to their neighbours, and
    takes each node's least distance.
    """
    known = _keep(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("dist"), F.lit(True).alias("new")))
    while True:
        sent = known.where("new").join(near, F.col("node") == F.col("tail")).select("source", F.col("head").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"), F.lit(None).cast("double").alias("was"))
        both = known.select("source", "node", "dist", F.col("dist").alias("was")).unionByName(sent)
        best = both.groupBy("source", "node").agg(F.min("dist").alias("dist"), F.min("was").alias("was"))
        closer = F.col("was").isNull() | (F.col("dist") < F.col("was") - TIE)
        known = _keep(best.select("source", "node", F.when(closer, F.col("dist")).otherwise(F.col("was")).alias("dist"), closer.alias("new")))
        if known.where("new").isEmpty():
            return known.drop("new")


def _waves(links: DataFrame, start: DataFrame, value, combine) -> DataFrame:
    """(source, node, x) of all nodes of a directed graph without circles, (source, before, after, n).

    A node is settled, with ``combine`` of the sum of the ``value`` that came along its
    links, once all ``n`` of its links have brought theirs. ``start`` are those without any.
    """
    settled, done = _keep(start), []
    got = None
    while True:
        done.append(settled)
        came = settled.join(links.withColumnRenamed("before", "node"), ["source", "node"]).select("source", F.col("after").alias("node"), "n", value.alias("x"), F.lit(1).cast("long").alias("k"))
        if got is not None:
            came = came.unionByName(got)
        came = _keep(came.groupBy("source", "node").agg(F.max("n").alias("n"), F.sum("x").alias("x"), F.sum("k").alias("k")))
        ready = came.where("k = n")
        if ready.isEmpty():
            out = done[0]
            for d in done[1:]:
                out = out.unionByName(d)
            return out
        settled = _keep(combine(ready))
        got = _keep(came.where("k < n").select("source", "node", "n", "x", "k"))


def dependencies(near: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, b): what the shortest paths from ``sources`` give each node between their ends."""
    dist = _keep(distances(near, sources))
    tails = dist.select("source", F.col("node").alias("tail"), F.col("dist").alias("a"))
    heads = dist.select("source", F.col("node").alias("head"), F.col("dist").alias("b"))
    links = tails.join(near, "tail").join(heads, ["source", "head"]).where(F.abs(F.col("a") + F.col("weight") - F.col("b")) <= TIE)
    links = _keep(links.select("source", F.col("tail").alias("before"), F.col("head").alias("after")))
    # Numbers of paths, from the sources on.
    into = links.groupBy("source", "after").agg(F.count("*").alias("n"))
    ways = _waves(links.join(into, ["source", "after"]), sources.select("source", F.col("source").alias("node"), F.lit(1.0).alias("x")), F.col("x"), lambda df: df.select("source", "node", "x"))
    ways = _keep(ways.withColumnRenamed("x", "sigma"))
    # Dependencies, from the ends back: a node hands (1 + its own) / its paths to those before it.
    out_of = links.groupBy("source", F.col("before").alias("after")).agg(F.count("*").alias("n"))
    back = links.select("source", F.col("after").alias("before"), F.col("before").alias("after")).join(out_of, ["source", "after"])
    last = ways.join(out_of.withColumnRenamed("after", "node"), ["source", "node"], "left_anti")
    share = lambda df: df.join(ways, ["source", "node"]).select("source", "node", (F.col("sigma") * F.col("x")).alias("own"), "sigma")
    start = last.select("source", "node", F.lit(0.0).alias("own"), "sigma")
    settled = _waves(_keep(back), start, (1 + F.col("own")) / F.col("sigma"), share)
    return settled.where("source <> node").groupBy("node").agg(F.sum("own").alias("b"))
