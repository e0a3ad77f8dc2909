"""Similarity, co-occurrence and influence graphs over papers and techniques."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workers import ship
from ..sources import scratch
from ..sources.ranges import numbered
from . import aggregates as A
from . import modularity, pairs, paths, propagation
from .browse import induced

# Weights of what two papers share, factors of the idf tiers, weight of a technique without idf.
BASE = {"technique": 3.0, "dataset": 2.0, "category": 1.0, "methodology": 1.0}
TIER_FACTOR = {"GENERIC": 0.25, "SHARED": 1.0, "SPECIALIZED": 2.0}
NO_IDF = 6.0
#: Share of a paper's edges that lead out of its cluster, from which it is a bridge.
BRIDGE = 0.30
#: A work set of an entity of which more works than this know is joined in salted parts.
SALT_ROWS = 4096
#: Pairs of an entity of more papers than this are made in the join that reads them.
DENSE = 1024
#: So many pairs of entities that papers have together are a task's.
TASK_PAIRS = 1_000_000
#: So many of the heaviest pairs are listed.
LISTED = 10


def load_entities(entities: DataFrame) -> DataFrame:
    """(paper_id, kind, entity, name): one per case-folded name, the canonical spelling first.

    Categories and methodologies that are also a technique of the paper, whatever the
    case, are left out.
    """
    name = F.trim(F.coalesce("canonical_name", "name"))
    rows = entities.where(name != "").groupBy("paper_id", "kind", F.lower(name).alias("entity"))
    rows = rows.agg(F.max_by(name, F.struct(F.col("canonical_name").isNotNull(), name)).alias("name"), F.max(F.col("canonical_name").isNotNull()).alias("is_canonical"))
    tech = rows.where("kind = 'technique'").select("paper_id", "entity")
    others = rows.where("kind in ('category', 'methodology')").join(tech, ["paper_id", "entity"], "left_anti")
    return rows.where("kind in ('technique', 'dataset')").unionByName(others)


def entity_weights(entities: DataFrame, n_papers: int | Column) -> DataFrame:
    """(kind, entity, w): what sharing the entity adds to an edge."""
    df = entities.groupBy("kind", "entity").agg(F.count("*").alias("df"), F.max("is_canonical").alias("known"))
    n = n_papers if isinstance(n_papers, Column) else F.lit(n_papers)
    tier = A.idf_tier(F.log(n / F.col("df")))
    factor = F.when(tier == "GENERIC", TIER_FACTOR["GENERIC"]).when(tier == "SHARED", TIER_FACTOR["SHARED"]).otherwise(TIER_FACTOR["SPECIALIZED"])
    w = F.when(F.col("kind") == "technique", F.when(F.col("known"), BASE["technique"] * factor).otherwise(NO_IDF))
    for kind in ("dataset", "category", "methodology"):
        w = w.when(F.col("kind") == kind, BASE[kind])
    return df.select("kind", "entity", "df", w.alias("w"))


def _salted(rows: DataFrame, keys: list[str], carry: list[str], other: list[str] = ()) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows (paper_id, *keys, df, ...) as both sides of a join with themselves, and the columns to join them on.

    An entity of very many papers is cut into parts, and each pair of parts is a task's
    work of its own, so no single key bounds the run time.
    """
    parts = F.ceil(F.col("df") / SALT_ROWS).cast("int")
    cut = rows.withColumn("_parts", parts).withColumn("_part", F.pmod(F.xxhash64("paper_id"), F.col("_parts")))
    left = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(F.col("paper_id").alias("src"), *keys, *carry, "_other")
    right = cut.select(F.col("paper_id").alias("dst"), *keys, *other, F.col("_part").alias("_other"))
    return left, right, [*keys, "_other"]


class Shared:
    """What papers share, by rows (paper_id, *keys, df, *values) that are unique; an entity has one df and one of each value.

    The pairs of an entity of up to DENSE papers are lists that go to their smaller paper, where the sums are made
    (:mod:`.pairs`). A pair of a denser entity belongs to the first dense one it shares (``_e``), and what it shares
    besides comes to it there. So what is shuffled are numbers of papers, and of dense entities only the rows.
    Of ``touched`` papers (paper_id) only pairs that hold one are made. With ``kinds`` (rows have kind and name) the names
    that a pair shares are listed as the first spells them.
    """

    def __init__(self, rows: DataFrame, keys: list[str], values: list[str], touched: DataFrame | None = None, kinds: tuple[str, ...] = ()):
        self.spark, self.keys, self.values, self.kinds = rows.sparkSession, keys, values, list(kinds)
        ship(self.spark)
        self.names, self.mark = ["name"] if kinds else [], [] if touched is None else ["_t"]
        rows = rows.where("df > 1 and paper_id is not null").select("paper_id", *keys, "df", *values, *self.names)
        if touched is not None:
            rows = rows.join(touched.select("paper_id", F.lit(True).alias("_t")).distinct(), "paper_id", "left").withColumn("_t", F.col("_t").isNotNull())
        self.rows = self._kept(rows)  # read several times
        self.types = {f.name: f.dataType.simpleString() for f in rows.schema}
        thick = self.rows.where(F.col("df") > DENSE)
        ids = numbered(thick.select(*keys).distinct(), keys, "_e")
        kind = ["kind"] if kinds else []
        self.thick = thick.join(ids, keys).select("paper_id", F.col("_e").cast("long").alias("_e"), "df", *values, *kind, *self.names, *self.mark)
        own = self.thick.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("_e", *values, *kind, *self.names))).alias("_own"))
        self.own = own.select("paper_id", "_own", F.transform("_own", lambda x: x["_e"]).alias("_hot"))

    def _kept(self, df: DataFrame) -> DataFrame:
        at = scratch.path(self.spark, "shared")
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    @cached_property
    def _lists(self) -> DataFrame:
        """For each paper and entity the larger papers that have it, and their dense entities: rows in the order of src."""
        keys = [k for k in self.keys if k != "kind" or not self.kinds]
        carry = [*self.values, *(["kind"] if self.kinds else [])]
        one = F.struct("paper_id", "_hot", *self.names, *self.mark)
        lists = self.rows.where(F.col("df") <= DENSE).join(self.own.select("paper_id", "_hot"), "paper_id", "left")
        lists = lists.groupBy(*keys, *carry).agg(F.sort_array(F.collect_list(one)).alias("_all"))
        each = lists.select(*carry, "_all", F.posexplode("_all").alias("_at", "_a"))
        rest = F.slice("_all", F.col("_at") + 2, F.size("_all"))
        rest = F.when(F.col("_a._t"), rest).otherwise(F.filter(rest, lambda x: x["_t"])) if self.mark else rest
        each = each.select(F.col("_a.paper_id").alias("src"), F.col("_a._hot").alias("_hot"), *(F.col(f"_a.{n}").alias(n) for n in self.names), rest.alias("_rest"), *carry).where(F.size("_rest") > 0)
        hot = lambda x: F.when(x["_hot"].isNull(), pairs.NONE).when(F.size(x["_hot"]) > 1, pairs.SEVERAL).otherwise(F.get(x["_hot"], F.lit(0)).cast("int"))
        several = F.exists("_rest", lambda x: x["_hot"].isNotNull() & (F.size(x["_hot"]) > 1))
        each = each.select("src", "_hot", *self.names, *carry, F.transform("_rest", lambda x: x["paper_id"]).alias("_dst"), F.transform("_rest", hot).alias("_one"), F.when(several, F.transform("_rest", lambda x: x["_hot"])).alias("_more"))
        return each.repartition("src").sortWithinPartitions("src")

    def _sums(self, beside: bool) -> DataFrame:
        of = self.types["paper_id"]
        columns = [f"src {of}, dst {of}", *(["_e long"] if beside else []), *(f"{v} {self.types[v]}" for v in self.values), *(f"shared_{k} array<string>" for k in self.kinds)]
        return self._lists.mapInArrow(pairs.summing(self.values, self.kinds, beside), ", ".join(columns))

    @cached_property
    def _figures(self) -> DataFrame:
        """What :func:`.pairs.figured` says, in one run over the lists."""
        value, of = self.values[0], self.types["paper_id"]
        return self._kept(self._lists.mapInArrow(pairs.summing([value], [], None, pairs.figured(value, LISTED)), f"src {of}, dst {of}, {value} double, n long"))

    def sums(self) -> DataFrame:
        """(src, dst, *values, [shared_kind, ...]): of each pair the sums of ``values`` over all that it shares."""
        if self.thick.isEmpty():
            return self._sums(False)
        values, mark, lists = self.values, self.mark, [f"shared_{k}" for k in self.kinds]
        kind = ["kind"] if self.kinds else []
        besides = self._sums(True).groupBy("src", "_e").agg(F.map_from_entries(F.collect_list(F.struct("dst", F.struct(*values, *lists)))).alias("_besides"))
        some = self.thick.join(self.own, "paper_id").join(besides.withColumnRenamed("src", "paper_id"), ["paper_id", "_e"], "left")
        extra = F.element_at("_besides", F.col("dst"))
        more = lambda v: F.coalesce(extra[v], F.lit(0))
        listed = lambda own, x: F.when(extra.isNull(), own).otherwise(F.array_sort(F.concat(own, extra[x])))

        def meet(rows: DataFrame, carry: list[str], other: list[str]) -> DataFrame:
            left, right, on = _salted(rows, ["_e"], ["_besides", *carry, *mark], [*other, *(F.col(m).alias("_u") for m in mark)])
            return left.join(right.hint("shuffle_hash"), on).where("src < dst and (_t or _u)" if mark else "src < dst")

        some = some.withColumn("_single", F.size("_hot") == 1)
        single = meet(some.drop("_own", "_hot"), [*values, *kind, *self.names, "_single"], [F.col("_single").alias("_alone")]).where("_single or _alone")
        none = F.array().cast("array<string>")
        single = single.select("src", "dst", *((F.col(v) + more(v)).alias(v) for v in values), *(listed(F.when(F.col("kind") == k, F.array("name")).otherwise(none), f"shared_{k}").alias(f"shared_{k}") for k in self.kinds))
        many = meet(some.where("not _single"), ["_own", "_hot"], [F.col("_hot").alias("_near")])
        both = many.withColumn("_both", F.filter("_own", lambda x: F.array_contains("_near", x["_e"]))).where(F.col("_both")[0]["_e"] == F.col("_e"))
        zero = {v: F.lit(0).cast(self.types[v]) for v in values}
        of = lambda k: F.array_sort(F.transform(F.filter("_both", lambda x: x["kind"] == k), lambda x: x["name"]))
        both = both.select("src", "dst", *((F.aggregate(F.transform("_both", lambda x: x[v]), zero[v], lambda s, x: s + x) + more(v)).alias(v) for v in values), *(listed(of(k), f"shared_{k}").alias(f"shared_{k}") for k in self.kinds))  # noqa: B023
        return self._sums(False).unionByName(single).unionByName(both)

    def _groups(self, k: int) -> DataFrame:
        """Papers of the same dense entities as one row (_own, _hot, size, first): how many, and the ``k`` smallest."""
        rows = self.own.withColumn("_r", F.row_number().over(Window.partitionBy("_own").orderBy("paper_id"))) if k else self.own.withColumn("_r", F.lit(1))
        return rows.groupBy("_own", "_hot").agg(F.count("*").alias("size"), F.sort_array(F.collect_list(F.when(F.col("_r") <= k, F.col("paper_id")))).alias("first"))

    def _dense(self, k: int = 0) -> DataFrame:
        """(weight, n, first, other): groups of papers that share dense entities, what these add up to, and the pairs there are."""
        groups = self._kept(self._groups(k))
        weight = lambda rows: F.aggregate(F.transform(rows, lambda x: x[self.values[0]]), F.lit(0.0), lambda s, x: s + x)
        same = groups.where("size > 1").select(weight("_own").alias("weight"), F.expr("size * (size - 1) div 2").alias("n"), "first", F.col("first").alias("other"))
        some = groups.where((F.size("_hot") > 0)).withColumn("_e", F.explode("_hot"))
        a, b = some, some.select("_e", F.col("_own").alias("_own_b"), F.col("_hot").alias("_hot_b"), F.col("size").alias("_size"), F.col("first").alias("other"))
        apart = a.join(b, "_e").where("_own < _own_b").where(F.array_min(F.array_intersect("_hot", "_hot_b")) == F.col("_e"))
        apart = apart.select(weight(F.filter("_own", lambda x: F.array_contains("_hot_b", x["_e"]))).alias("weight"), (F.col("size") * F.col("_size")).alias("n"), "first", "other")
        return same.unionByName(apart)

    def _beside(self) -> DataFrame:
        """(src, dst, weight, dense): pairs of dense entities that share others too, the sum over all and that over the dense."""
        value = self.values[0]
        a, b = self.own.select(F.col("paper_id").alias("src"), "_own"), self.own.select(F.col("paper_id").alias("dst"), F.col("_hot").alias("_near"))
        rows = self._figures.where("n < 0").select("src", "dst", value).join(a, "src").join(b, "dst")
        dense = F.aggregate(F.transform(F.filter("_own", lambda x: F.array_contains("_near", x["_e"])), lambda x: x[value]), F.lit(0.0), lambda s, x: s + x)
        return rows.withColumn("dense", dense).select("src", "dst", (F.col(value) + F.col("dense")).alias("weight"), "dense")

    def counts(self) -> DataFrame:
        """(weight, n): how many pairs have each sum of the first value. Pairs of dense entities are not made: their groups are multiplied."""
        value, four = self.values[0], lambda c: F.round(c, 4)
        thin = self._figures.where("n > 0").select(F.col(value).alias("weight"), "n")
        beside = self._beside().select(F.explode(F.array(F.struct(four("weight").alias("weight"), F.lit(1).cast("long").alias("n")), F.struct(four("dense").alias("weight"), F.lit(-1).cast("long").alias("n")))).alias("x")).select("x.weight", "x.n")
        all_ = thin.unionByName(beside).unionByName(self._dense().select(four("weight").alias("weight"), "n"))
        return all_.groupBy("weight").agg(F.sum("n").alias("n")).where("n > 0 and weight > 0")

    def heaviest(self, k: int = LISTED) -> DataFrame:
        """(src, dst, weight): the ``k`` pairs (LISTED at most) of most weight, then of the smaller ends.

        Of two groups of papers that share the same dense entities only the ``k`` smallest of either can be among them:
        the pairs of those before a paper come first.
        """
        value = self.values[0]
        best = lambda df: df.orderBy(F.desc("weight"), "src", "dst").limit(k)
        thin = self._figures.where("n = 0").select("src", "dst", F.col(value).alias("weight"))
        groups = self._dense(k).select("weight", F.explode("first").alias("_a"), "other").select("weight", "_a", F.explode("other").alias("_b")).where("_a <> _b")
        groups = groups.select(F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst"), "weight")
        rows = best(thin).unionByName(self._beside().select("src", "dst", "weight")).unionByName(groups)
        return best(rows.groupBy("src", "dst").agg(F.round(F.max("weight"), 4).alias("weight")).where("weight > 0"))


def shared_sums(rows: DataFrame, keys: list[str], values: list[str], touched: DataFrame | None = None) -> DataFrame:
    """(src, dst, *values): of each pair src < dst with equal ``keys`` the sums of ``values`` over all that they share (:class:`Shared`)."""
    return Shared(rows, keys, values, touched).sums()


SCORES = ["weight", "technique_score", "dataset_score", "category_score"]


def summed_edges(rows: DataFrame, touched: DataFrame | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Edges of rows (paper_id, kind, entity, df, w), of ``touched`` papers only those that lead to or from one; with ``kinds`` (rows have name) lists of names."""
    part = lambda kind: F.when(F.col("kind") == kind, F.col("w"))
    name = ["name"] if kinds else []
    rows = rows.select("paper_id", "kind", "entity", "df", *name, F.col("w").alias("weight"), *(F.coalesce(part(x[:-6]), F.lit(0.0)).alias(x) for x in SCORES[1:]), F.lit(1).cast("long").alias("shared"))
    out = Shared(rows, ["kind", "entity"], [*SCORES, "shared"], touched, kinds).sums().select("src", "dst", *(F.round(x, 4).alias(x) for x in SCORES), "shared", *(f"shared_{k}" for k in kinds))
    return out.where("weight > 0")


def weighted(entities: DataFrame, n_papers: int | Column) -> DataFrame:
    """(paper_id, kind, entity, name, df, w): entities of several papers, with their weights."""
    at = scratch.path(entities.sparkSession, "entities")
    entities.write.parquet(at)  # read twice
    entities = entities.sparkSession.read.schema(entities.schema).parquet(at)
    w = entity_weights(entities, n_papers).where("df > 1")
    return entities.join(w, ["kind", "entity"]).select("paper_id", "kind", "entity", "name", "df", "w")


def weights_of(rows: DataFrame) -> Shared:
    """What counts and heaviest pairs of edges are found by, of rows (paper_id, kind, entity, df, w)."""
    return Shared(rows.select("paper_id", "kind", "entity", "df", F.col("w").alias("weight")), ["kind", "entity"], ["weight"])


def paper_edges(entities: DataFrame, n_papers: int | Column, lists: bool = True) -> DataFrame:
    """Undirected edges src < dst between papers that share an entity, with the weight and, with ``lists``, the sorted names of what is shared.

    An inverted-index self-join on entities; entities of one paper make no rows.
    """
    return summed_edges(weighted(entities, n_papers), kinds=tuple(BASE) if lists else ())


def shared_names(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """A few ``pairs`` (src, dst, ...) that share something, read once, with sorted lists of the names of each kind that they share, as the first spells them."""
    mine = entities.select(F.col("paper_id").alias("src"), "kind", "entity", "name").join(F.broadcast(pairs), "src")
    both = entities.select(F.col("paper_id").alias("dst"), "kind", "entity").join(F.broadcast(mine), ["dst", "kind", "entity"])
    named = [F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("name")))).alias(f"shared_{k}") for k in BASE]
    return both.groupBy(*pairs.columns).agg(*named)


def named_edges(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """A few ``pairs`` (src, dst) that share something, written and read once, with all columns of :func:`paper_edges`, of rows (:func:`weighted`)."""
    at = scratch.path(rows.sparkSession, "pairs")
    pairs.select("src", "dst").write.parquet(at)
    pairs = F.broadcast(rows.sparkSession.read.schema(pairs.select("src", "dst").schema).parquet(at))
    mine = rows.select(F.col("paper_id").alias("src"), "kind", "entity", "name", "w").join(pairs, "src")
    both = rows.select(F.col("paper_id").alias("dst"), "kind", "entity").join(F.broadcast(mine), ["dst", "kind", "entity"])
    total = lambda of: F.round(F.coalesce(F.sum(F.when(of, F.col("w"))), F.lit(0.0)), 4)
    named = [F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("name")))).alias(f"shared_{k}") for k in BASE]
    scores = [total(F.col("kind") == x[:-6]).alias(x) for x in SCORES[1:]]
    return both.groupBy("src", "dst").agg(total(F.lit(True)).alias("weight"), *scores, F.count("*").alias("shared"), *named)


def build_stats(papers: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """One row: papers, possible pairs, edges, greatest and mean weight, papers without an edge."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias(key)).distinct()
    n = papers.agg(F.count("*").alias("papers"))
    e = edges.agg(F.count("*").alias("edges"), F.max("weight").alias("max_weight"), F.round(F.avg("weight"), 4).alias("avg_weight"))
    linked = ends.agg(F.count("*").alias("_linked"))
    out = n.crossJoin(e).crossJoin(linked)  # one row each
    return out.select("papers", F.expr("papers * (papers - 1) div 2").alias("pairs"), "edges", "max_weight", "avg_weight", (F.col("papers") - F.col("_linked")).alias("isolated"))


def counted_stats(papers: DataFrame, rows: DataFrame, counts: DataFrame, key: str = "id") -> DataFrame:
    """:func:`build_stats` of numbers of edges by weight (weight, n); ``rows`` (:func:`weighted`) say which papers have any."""
    n = papers.agg(F.count("*").alias("papers"))
    some = F.coalesce(F.sum("n"), F.lit(0)).alias("edges")
    e = counts.agg(some, F.max("weight").alias("max_weight"), F.round(F.sum(F.col("weight") * F.col("n")) / F.sum("n"), 4).alias("avg_weight"))
    linked = rows.select(F.col("paper_id").alias(key)).distinct()
    alone = papers.select(key).join(linked, key, "left_anti").agg(F.count("*").alias("isolated"))
    out = n.crossJoin(e).crossJoin(alone)  # one row each
    return out.select("papers", F.expr("papers * (papers - 1) div 2").alias("pairs"), "edges", "max_weight", "avg_weight", "isolated")


def cooccurrence(entities: DataFrame, kinds: tuple[str, ...] = ("technique", "dataset", "category", "methodology")) -> DataFrame:
    """(kind, a, b, n): papers that have both entities of one kind, a < b.

    What is shuffled is, for each entity of a paper, the list of those after it; pairs are made and counted where the
    first of them is, in as many tasks as their number asks for, and never move.
    """
    spark, at = entities.sparkSession, scratch.path(entities.sparkSession, "together")
    rows = entities.where(F.col("kind").isin(*kinds) & F.col("paper_id").isNotNull() & F.col("entity").isNotNull())
    own = rows.groupBy("paper_id", "kind").agg(F.sort_array(F.collect_set("entity")).alias("_all"))
    own.where("size(_all) > 1").select("kind", "_all").write.parquet(at)  # read twice
    own = spark.read.schema("kind string, _all array<string>").parquet(at)
    n = own.agg(F.sum(F.size("_all").cast("long") * (F.size("_all") - 1) / 2)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n) // TASK_PAIRS))
    each = own.select("kind", "_all", F.posexplode("_all").alias("_at", "a")).where(F.col("_at") + 1 < F.size("_all"))
    each = each.select("kind", "a", F.slice("_all", F.col("_at") + 2, F.size("_all")).alias("_rest")).repartition(tasks, "kind", "a")
    return each.select("kind", "a", F.explode("_rest").alias("b")).groupBy("kind", "a", "b").agg(F.count("*").alias("n"))


def symmetrise(edges: DataFrame) -> DataFrame:
    """Each undirected edge from either end: (node, neighbour, weight)."""
    a = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), "weight")
    return a.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), "weight"))


def degree_centrality(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """(id, degree, degree_centrality = degree / (n - 1)); 1 for a graph of one node."""
    deg = symmetrise(edges).groupBy(F.col("node").alias(key)).agg(F.count("*").alias("degree"))
    n = F.broadcast(nodes.agg(F.count("*").alias("_n")))
    d = F.coalesce("degree", F.lit(0))
    return nodes.select(key).join(deg, key, "left").crossJoin(n).select(key, d.alias("degree"), F.when(F.col("_n") <= 1, 1.0).otherwise(d / (F.col("_n") - 1)).alias("degree_centrality"))


def paper_metrics(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """Number of neighbours and total edge weight of each node."""
    m = symmetrise(edges).groupBy(F.col("node").alias(key)).agg(F.count("*").alias("neighbors_count"), F.round(F.sum("weight"), 6).alias("total_edge_weight"))
    return nodes.select(key).join(m, key, "left").select(key, F.coalesce("neighbors_count", F.lit(0)).alias("neighbors_count"), F.coalesce("total_edge_weight", F.lit(0.0)).alias("total_edge_weight"))


def technique_metrics(techniques: DataFrame, edges: DataFrame, co: DataFrame | None = None, k: int = 5) -> DataFrame:
    """Per canonical name: papers that have it, papers connected to those, and its ``k`` most frequent companions."""
    named = techniques.where("canonical_name is not null").select("paper_id", "canonical_name").distinct()
    usage = named.groupBy("canonical_name").agg(F.count("*").alias("usage_count"))
    near = named.join(symmetrise(edges).select(F.col("node").alias("paper_id"), "neighbour"), "paper_id").select("canonical_name", F.col("neighbour").alias("paper_id"))
    reach = named.select("canonical_name", "paper_id").unionByName(near).distinct().groupBy("canonical_name").agg(F.count("*").alias("connected_papers_count"))
    if co is None:
        co = cooccurrence(named.select("paper_id", F.lit("technique").alias("kind"), F.col("canonical_name").alias("entity")), ("technique",))
    both = co.select(F.col("a").alias("canonical_name"), F.col("b").alias("other"), "n").unionByName(co.select(F.col("b").alias("canonical_name"), F.col("a").alias("other"), "n"))
    best = both.withColumn("r", F.row_number().over(Window.partitionBy("canonical_name").orderBy(F.desc("n"), "other"))).where(F.col("r") <= k)
    best = best.groupBy("canonical_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "other", "n"))), lambda x: F.struct(x["other"].alias("name"), x["n"].alias("count"))).alias("top_cooccurring"))
    return usage.join(reach, "canonical_name").join(best, "canonical_name", "left")


def _nearest(edges: DataFrame, node, min_weight: float, k: int) -> DataFrame:
    rows = symmetrise(edges.where((F.col("src") == node) | (F.col("dst") == node))).where((F.col("node") == node) & (F.col("weight") >= min_weight))
    return rows.orderBy(F.desc("weight"), "neighbour").limit(k)


def related(edges: DataFrame, papers: DataFrame, entities: DataFrame, node, min_weight: float, k: int) -> DataFrame:
    """The ``k`` nearest neighbours of a paper, with their columns of ``papers`` and sorted lists of the names of each kind they share."""
    top = F.broadcast(_nearest(edges, node, min_weight, k).select(F.col("neighbour").alias("id"), "weight"))  # k rows
    mine = entities.where(F.col("paper_id") == node).select("kind", "name").distinct()
    theirs = entities.join(top.select(F.col("id").alias("paper_id")), "paper_id").join(mine, ["kind", "name"])
    lists = theirs.groupBy(F.col("paper_id").alias("id")).agg(*(F.array_sort(F.collect_set(F.when(F.col("kind") == x, F.col("name")))).alias(f"shared_{x}") for x in BASE))
    none = F.array().cast("array<string>")
    out = papers.join(top, "id").join(lists, "id", "left")
    return out.withColumns({f"shared_{x}": F.coalesce(f"shared_{x}", none) for x in BASE})


def view(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A graph to draw as one table, told apart by ``part``: its nodes, its edges (src, dst, weight), and one row of totals."""
    weights = edges.agg(F.count("*").alias("edge_count"), F.coalesce(F.min("weight"), F.lit(0.0)).alias("min_weight"), F.coalesce(F.max("weight"), F.lit(0.0)).alias("max_weight"))
    meta = nodes.agg(F.count("*").alias("node_count")).crossJoin(weights)  # one row each
    out = nodes.withColumn("part", F.lit("node")).unionByName(edges.select("src", "dst", "weight", F.lit("edge").alias("part")), allowMissingColumns=True)
    return out.unionByName(meta.withColumn("part", F.lit("meta")), allowMissingColumns=True)


def ego(nodes: DataFrame, edges: DataFrame, node, min_weight: float, k: int) -> DataFrame:
    """The 1-hop graph around ``node`` as a :func:`view`: itself, its ``k`` nearest neighbours and the edges to them."""
    top = _nearest(edges, node, min_weight, k)
    near = F.broadcast(top.select(F.col("neighbour").alias("id")))  # k rows
    own = nodes.where(F.col("id") == node).withColumn("is_ego", F.lit(True)).unionByName(nodes.join(near, "id", "left_semi").withColumn("is_ego", F.lit(False)))
    return view(own, top.select(F.least("node", "neighbour").alias("src"), F.greatest("node", "neighbour").alias("dst"), "weight"))


def full_graph(nodes: DataFrame, edges: DataFrame, min_weight: float, cluster: int | None = None) -> DataFrame:
    """The nodes of a cluster (or all) and the edges of ``min_weight`` or more among them, as a :func:`view`."""
    keep = nodes if cluster is None else nodes.where(F.col("cluster_id") == cluster)
    return view(keep, induced(edges.where(F.col("weight") >= min_weight), keep.select(F.col("id").alias("paper_id"))))


def technique_graph(metrics: DataFrame, co: DataFrame, min_usage: int, min_weight: float) -> DataFrame:
    """Techniques of ``min_usage`` papers or more and the pairs (a, b, n) of ``min_weight`` papers or more among them, as a :func:`view`."""
    nodes = metrics.where(F.col("usage_count") >= min_usage).withColumnRenamed("canonical_name", "name")
    name = nodes.select("name")
    edges = co.where(F.col("n") >= min_weight).join(name.toDF("a"), "a", "left_semi").join(name.toDF("b"), "b", "left_semi")
    return view(nodes, edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("n").cast("double").alias("weight")))


def technique_related(techniques: DataFrame, papers: DataFrame, metrics: DataFrame, co: DataFrame, asked: DataFrame, k: int = 20) -> DataFrame:
    """For each name ``asked`` its technique (of that very name, else whatever the case), its figures, ``k`` of its papers, the most cited first, and ``k`` companions.

    Names that no technique has give no row; of several that differ in case only the first is taken.
    """
    asked = asked.select("asked").distinct()
    known = metrics.select(F.col("canonical_name").alias("technique"))
    exact = asked.join(known, F.col("asked") == F.col("technique"))
    loose = asked.join(exact.select("asked"), "asked", "left_anti").join(known, F.lower("asked") == F.lower("technique")).groupBy("asked").agg(F.min("technique").alias("technique"))
    found = exact.unionByName(loose)
    wanted = found.select("technique").distinct()
    users = techniques.select("paper_id", F.col("canonical_name").alias("technique")).unionByName(techniques.select("paper_id", F.col("name").alias("technique")))
    users = users.join(wanted, "technique").distinct()
    users = users.withColumn("r", F.row_number().over(Window.partitionBy("technique").orderBy("paper_id"))).where(F.col("r") <= k)
    users = users.join(papers.select(F.col("id").alias("paper_id"), F.coalesce("citation_count", F.lit(0)).alias("cited")), "paper_id")
    listed = users.groupBy("technique").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("cited")).alias("c"), "paper_id"))), lambda x: x["paper_id"].cast("string")), ",").alias("papers"))
    both = co.select(F.col("a").alias("technique"), F.col("b").alias("other"), "n").unionByName(co.select(F.col("b").alias("technique"), F.col("a").alias("other"), "n")).join(wanted, "technique")
    both = both.withColumn("r", F.row_number().over(Window.partitionBy("technique").orderBy(F.desc("n"), "other"))).where(F.col("r") <= k)
    near = both.groupBy("technique").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "other", "n"))), lambda x: F.concat(x["other"], F.lit(":"), x["n"].cast("string"))), "; ").alias("companions"))
    figures = metrics.select(F.col("canonical_name").alias("technique"), "usage_count", "connected_papers_count")
    return found.join(figures, "technique").join(listed, "technique").join(near, "technique", "left").select("asked", "technique", "usage_count", "connected_papers_count", "papers", F.coalesce("companions", F.lit("")).alias("companions"))


def bridge_papers(edges: DataFrame, metrics: DataFrame, threshold: float = BRIDGE) -> DataFrame:
    """Papers of which ``threshold`` or more of the edges lead to other clusters."""
    c = metrics.select("paper_id", "cluster_id")
    rows = symmetrise(edges).join(c.toDF("node", "own"), "node").join(c.toDF("neighbour", "other"), "neighbour")
    out = rows.groupBy("node", "own").agg(F.count("*").alias("degree"), F.count_if(F.col("own") != F.col("other")).alias("cross"))
    return out.withColumn("ratio", F.round(F.col("cross") / F.col("degree"), 3)).where(F.col("ratio") >= threshold)


def _between(edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """Edges with the clusters a and b of their ends."""
    c = metrics.select("paper_id", "cluster_id")
    return edges.select("src", "dst", "weight").join(c.toDF("src", "a"), "src").join(c.toDF("dst", "b"), "dst")


def crossing(edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """(paper_id, cross): the edges that lead to other clusters, of papers that have one. Only such edges are seen from either end."""
    out = _between(edges, metrics).where("a <> b")
    return out.select(F.explode(F.array("src", "dst")).alias("paper_id")).groupBy("paper_id").agg(F.count("*").alias("cross"))


def cohesion(edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per cluster the mean weight of inner edges, of edges that start in it and lead out, and their ratio."""
    rows = _between(edges, metrics)
    inner, outer = F.when(F.col("a") == F.col("b"), F.col("weight")), F.when(F.col("a") != F.col("b"), F.col("weight"))
    out = rows.groupBy(F.col("a").alias("cluster_id")).agg(F.round(F.avg(inner), 4).alias("intra"), F.round(F.avg(outer), 4).alias("inter"))
    return out.withColumn("cohesion", F.round(F.col("intra") / F.nullif(F.col("inter"), F.lit(0.0)), 3))


def influence_edges(techniques: DataFrame) -> DataFrame:
    """Directed (source, target, weight): papers that introduce source and use target without introducing it."""
    name = A.effective_name().alias("t")
    intro = techniques.where("role = 'introduces'").select("paper_id", name).distinct()
    uses = techniques.where("role = 'uses'").select("paper_id", name).distinct().join(intro, ["paper_id", "t"], "left_anti")
    rows = intro.withColumnRenamed("t", "source").join(uses.withColumnRenamed("t", "target"), "paper_id").where("source <> target")
    return rows.groupBy("source", "target").agg(F.count("*").alias("weight"))


def stage(introduces: Column, uses: Column, cross_adoption: Column, tier: Column) -> Column:
    """Where a technique stands: introduced and adopted by others, introduced only, or used without an introduction here."""
    return (
        F.when((introduces > 0) & (cross_adoption > 0), "Emerging").when(introduces > 0, "Novel")
        .when((uses > 0) & (tier == "GENERIC"), "Foundational").when(uses > 0, "Established").otherwise("Referenced")
    )


# What a task does with a small connected component.


def _brandes(starts: np.ndarray, indptr: np.ndarray, indices: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Betweenness that shortest paths from ``starts`` give each node; weights are distances."""
    import heapq

    n = len(indptr) - 1
    total = np.zeros(n)
    for s in starts:
        dist, sigma, done = {s: 0.0}, {s: 1.0}, []
        before: dict[int, list[int]] = {s: []}
        heap, closed = [(0.0, int(s))], set()
        while heap:
            d, v = heapq.heappop(heap)
            if v in closed:
                continue
            closed.add(v)
            done.append(v)
            for j in range(indptr[v], indptr[v + 1]):
                w, far = int(indices[j]), d + weights[j]
                if w in closed:
                    continue
                if w not in dist or far < dist[w] - 1e-12:
                    dist[w], sigma[w], before[w] = far, sigma[v], [v]
                    heapq.heappush(heap, (far, w))
                elif abs(far - dist[w]) <= 1e-12:
                    sigma[w] += sigma[v]
                    before[w].append(v)
        delta = dict.fromkeys(done, 0.0)
        for w in reversed(done):
            for v in before[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                total[w] += delta[w]
    return total


#: Edges of a connected component that one task takes as a whole, and edges that are dealt to a task.
WHOLE_GRAPH_EDGES, SOURCE_EDGES = 2_000, 10_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges``; a component is named by its smallest node."""
    def kept(df: DataFrame) -> DataFrame:
        path = scratch.path(edges.sparkSession, "components")
        df.write.parquet(path)
        return edges.sparkSession.read.parquet(path)

    both = kept(edges.select(F.col("src").alias("node"), F.col("dst").alias("near")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("near"))))
    labels = kept(both.groupBy("node").agg(F.least("node", F.min("near")).alias("component")))
    while True:
        least = both.join(labels.toDF("near", "other"), "near").groupBy("node").agg(F.min("other").alias("other"))
        new = labels.join(least, "node").select("node", "component", F.least("component", "other").alias("new"))
        # A label is a node as well: take over its label of before.
        new = kept(new.join(labels.toDF("new", "further"), "new").select("node", "component", F.least("new", "further").alias("new")))
        labels = new.select("node", F.col("new").alias("component"))
        if new.where("new <> component").isEmpty():
            return labels


def _by_component(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` of the components that a task can hold, dealt to parts, and those of the larger ones."""
    found = components(edges)
    at = scratch.path(edges.sparkSession, "parts")
    edges.join(found.withColumnRenamed("node", "src"), "src").write.parquet(at)
    parts = edges.sparkSession.read.parquet(at)
    sizes = parts.groupBy("component").agg((F.count("*") > WHOLE_GRAPH_EDGES).alias("large"))
    parts = parts.join(sizes, "component")
    buckets = 1 + edges.count() // SOURCE_EDGES
    return parts.where("not large").withColumn("part", F.pmod(F.xxhash64("component"), F.lit(buckets))), parts.where("large")


def _adjacent(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tail, head, both = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    order = np.argsort(tail, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(tail, minlength=n))]), head[order], both[order]


def betweenness(nodes: DataFrame, edges: DataFrame, key: str = "id", invert_weight: bool = False) -> DataFrame:
    """(id, betweenness_centrality), normalised; edge weights, above zero, are taken as distances unless inverted.

    No path leaves a connected component. Components of WHOLE_GRAPH_EDGES edges or fewer are
    dealt over the tasks; larger ones go through supersteps (:mod:`.paths`), a block of
    sources at a time, of which no task holds more than its share of rows.
    """
    spark = edges.sparkSession
    ship(spark)
    edges = edges.select("src", "dst", (1 / F.col("weight") if invert_weight else F.col("weight")).cast("double").alias("weight"))
    size = nodes.count()
    scale = 1 / ((size - 1) * (size - 2)) if size > 2 else 1.0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found, at = np.unique(pdf[["src", "dst"]].to_numpy(), return_inverse=True)
        a, b = at.reshape(-1, 2).T
        return pd.DataFrame({key: found, "b": _brandes(np.arange(len(found)), *_adjacent(a, b, pdf["weight"].to_numpy(float), len(found)))})

    small, large = _by_component(edges)
    sums = small.groupBy("part").applyInPandas(run, f"{key} long, b double")
    if not large.isEmpty():
        at = scratch.path(spark, "near")
        near = large.select("component", F.col("src").alias("tail"), F.col("dst").alias("head"), "weight")
        near.unionByName(near.select("component", F.col("head").alias("tail"), F.col("tail").alias("head"), "weight")).where("tail <> head").write.parquet(at)
        near = spark.read.parquet(at)
        sources = near.select("component", F.col("tail").alias("source")).distinct()
        # A source reaches its component: so many (source, node) rows there are in all.
        rows = sources.groupBy("component").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
        blocks = max(1, -(-rows // paths.BLOCK_ROWS))
        for k in range(blocks):
            own = sources.where(F.pmod(F.xxhash64("source"), F.lit(blocks)) == k).select("source")
            at = scratch.path(spark, "dependencies")
            paths.dependencies(near.drop("component"), own).write.parquet(at)
            sums = sums.unionByName(spark.read.parquet(at).select(F.col("node").alias(key), "b"))
    sums = sums.groupBy(key).agg(F.sum("b").alias("b"))
    return nodes.select(key).join(sums, key, "left").select(key, F.round(F.coalesce("b", F.lit(0.0)) * scale, 9).alias("betweenness_centrality"))


def greedy_modularity(edges: list[tuple[int, int, float]], total: float | None = None) -> list[set[int]]:
    """Clauset-Newman-Moore: merge the pair of communities of largest gain until none gains; ties go to the smaller ids.

    ``total`` is twice the weight of the whole graph where ``edges`` are some of its components.
    """
    degree: dict[int, float] = {}
    near: dict[int, dict[int, float]] = {}
    for a, b, w in edges:
        if a == b:
            continue
        degree[a], degree[b] = degree.get(a, 0) + w, degree.get(b, 0) + w
        near.setdefault(a, {})[b] = near.setdefault(a, {}).get(b, 0) + w
        near.setdefault(b, {})[a] = near.setdefault(b, {}).get(a, 0) + w
    total = sum(degree.values()) if total is None else total
    least = 0 if isinstance(total, int) else total**2 * 5e-13  # whole numbers are compared exactly
    members, changed = {v: {v} for v in degree}, dict.fromkeys(degree, 0)
    heap: list[tuple[float, int, int, int, int]] = []

    def offer(a: int, b: int) -> None:
        a, b = min(a, b), max(a, b)
        gain = near[a][b] * total - degree[a] * degree[b]
        if gain > least:
            heapq.heappush(heap, (-round(gain / least) if least else -gain, a, b, changed[a], changed[b]))

    for a in near:
        for b in near[a]:
            if a < b:
                offer(a, b)
    while heap:
        _, a, b, at_a, at_b = heapq.heappop(heap)
        # An offer is void once either side has grown: what grows makes its offers anew.
        if a not in members or b not in members or (changed[a], changed[b]) != (at_a, at_b):
            continue
        members[a] |= members.pop(b)
        degree[a] += degree.pop(b)
        changed[a] += 1
        for c, w in near.pop(b).items():
            near[c].pop(b)
            if c != a:
                near[a][c] = near[a].get(c, 0) + w
                near[c][a] = near[c].get(a, 0) + w
        for c in near[a]:
            offer(a, c)
    return sorted(members.values(), key=lambda s: (-len(s), min(s)))


def communities(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """(id, cluster_id) by modularity over all weights 1; ids by size, isolated nodes get one each after them.

    Communities merge only within a connected component, by gains that depend on the rest of
    the graph by its number of edges alone. So each component of WHOLE_GRAPH_EDGES edges or
    fewer is a task's, by the best gain of all; larger ones are contracted in rounds
    (:mod:`.modularity`).
    """
    spark = edges.sparkSession
    edges = edges.select("src", "dst").where("src <> dst")
    total = 2 * edges.count()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [s for _, part in pdf.groupby("component") for s in greedy_modularity(list(zip(part["src"].tolist(), part["dst"].tolist(), [1] * len(part))), total)]
        return pd.DataFrame([(v, min(s)) for s in found for v in sorted(s)], columns=[key, "least"])

    ship(spark)
    small, large = _by_component(edges)
    found = small.groupBy("part").applyInPandas(run, f"{key} long, least long")
    if not large.isEmpty():
        found = found.unionByName(modularity.communities(large, total).select(F.col("node").alias(key), F.col("community").alias("least")))
    at = scratch.path(spark, "communities")
    found.write.parquet(at)
    found = spark.read.parquet(at)
    sizes = found.groupBy("least").agg(F.count("*").alias("size"))
    numbers = numbered(sizes, [F.desc("size"), F.asc("least")], "cluster_id").select("least", "cluster_id")
    named = found.join(numbers, "least").select(key, "cluster_id")
    alone = nodes.select(key).join(edges.select(F.explode(F.array("src", "dst")).alias(key)).distinct(), key, "left_anti")
    alone = numbered(alone, [key], "_place").select(key, (F.col("_place") + sizes.count()).alias("cluster_id"))
    return named.unionByName(alone)


def label_propagation(nodes: DataFrame, edges: DataFrame, key: str = "id", rounds: int = 5) -> DataFrame:
    """(id, cluster_id): each node takes the label of most weight around it, ``rounds`` times; ties go to the smaller.

    Groups that no edge leaves are labelled where they lie (:func:`.propagation.whole_groups`); the votes of
    all other nodes are shuffled in each round.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        at = scratch.path(spark, name)
        df.write.parquet(at)
        return spark.read.parquet(at)

    ids = nodes.select(F.col(key).cast("long").alias("node"))
    edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight"))
    edges = kept(edges.where("src is not null and dst is not null"), "propagation")  # read several times
    found = propagation.whole_groups(ids, edges, rounds)
    done = found.where("label is not null").select("node", "label")
    rest = found.where("label is null").select("node", "copies")
    if not rest.isEmpty():
        both = kept(symmetrise(edges.join(rest.select(F.col("node").alias("src")), "src", "left_semi")), "propagation")  # read again in each round
        labels = rest.where("copies > 0").select("node", "copies", F.col("node").alias("label"))
        for _ in range(rounds):
            votes = both.join(labels.withColumnRenamed("node", "neighbour"), "neighbour").groupBy("node", "label").agg(F.round(F.sum(F.col("weight") * F.col("copies")), 6).alias("w"))
            best = votes.groupBy("node").agg(F.max_by("label", F.struct(F.col("w"), -F.col("label"))).alias("new"))
            # Kept, or each round would plan all before it.
            labels = kept(labels.join(best, "node", "left").select("node", "copies", F.coalesce("new", "label").alias("label")), "labels")
        done = done.unionByName(labels.select("node", "label"))
    label = F.coalesce("label", key).cast(nodes.schema[key].dataType)
    return nodes.select(key).join(done.withColumnRenamed("node", key), key, "left").select(key, label.alias("cluster_id"))
