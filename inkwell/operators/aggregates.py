"""Counts, distributions and rankings over the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Idf below GENERIC_IDF is generic, below SHARED_IDF shared, else specialised.
GENERIC_IDF, SHARED_IDF = 3.00, 3.69
#: Papers from which a technique is core, or shared.
CORE, SHARED = 5, 2


def effective_name(trim: bool = True) -> Column:
    name = F.coalesce("canonical_name", "name")
    return F.trim(name) if trim else name


def corpus_counts(papers: DataFrame, techniques: DataFrame, categories: DataFrame, datasets: DataFrame) -> DataFrame:
    """One row of totals."""
    parts = [
        papers.agg(F.count("*").alias("papers"), F.count("pdf_path").alias("with_pdf")),
        techniques.agg(F.count_distinct("canonical_name").alias("techniques"), F.count_distinct("paper_id").alias("papers_with_techniques")),
        categories.agg(F.count_distinct("name").alias("categories")),
        datasets.agg(F.count_distinct("name").alias("datasets")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))  # each side is one row
    return out


def frequency(rows: DataFrame, name: Column) -> DataFrame:
    """For each name its rows and distinct papers."""
    return rows.groupBy(name.alias("name")).agg(F.count("*").alias("n_rows"), F.count_distinct("paper_id").alias("papers"))


def idf_tier(idf: Column) -> Column:
    return F.when(idf < GENERIC_IDF, "GENERIC").when(idf < SHARED_IDF, "SHARED").otherwise("SPECIALIZED")


def idf(techniques: DataFrame, papers: DataFrame) -> DataFrame:
    """(canonical_name, df, idf, tier) with idf = ln(papers / df)."""
    df = techniques.where("canonical_name is not null").groupBy("canonical_name").agg(F.count_distinct("paper_id").alias("df"))
    total = papers.agg(F.count("*").alias("_n"))
    out = df.crossJoin(F.broadcast(total)).withColumn("idf", F.log(F.col("_n") / F.col("df"))).drop("_n")
    return out.withColumn("tier", idf_tier(F.col("idf")))


def role_aggregation(techniques: DataFrame) -> DataFrame:
    """Papers of each role of each technique, and how far it is used by those that did not introduce it."""
    flag = lambda role: F.max((F.col("role") == role).cast("int"))
    each = techniques.groupBy(effective_name().alias("technique"), "paper_id").agg(*(flag(r).alias(r) for r in ("introduces", "uses", "compares", "critiques")))
    out = each.groupBy("technique").agg(*(F.sum(r).alias(r) for r in ("introduces", "uses", "compares", "critiques")), F.count("*").alias("papers"), F.count_if((F.col("uses") == 1) & (F.col("introduces") == 0)).alias("cross_adoption"))
    return out.withColumn("adoption_ratio", F.round(F.col("cross_adoption") / F.greatest("introduces", F.lit(1)), 3))


def buckets(value: Column, edges: list[float]) -> Column:
    """'a-b' for the half-open bucket of a value, 'z+' for the last."""
    out = None
    for a, b in zip(edges, edges[1:]):
        label, test = f"{a:g}-{b:g}", (value >= a) & (value < b)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(f"{edges[-1]:g}+")


#: Least edge weight of each bucket.
WEIGHTS = [0, 1, 2, 4, 8]


def weight_buckets(edges: DataFrame) -> DataFrame:
    return edges.groupBy(buckets(F.col("weight"), WEIGHTS).alias("bucket")).agg(F.count("*").alias("edges"))


def floor_percentiles(rows: DataFrame, column: str, quantiles: list[float]) -> DataFrame:
    """One row per quantile q: the element at int(q * (n - 1)) of the sorted values.

    Values are counted first, so what is ranked is as short as there are distinct values.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c"))
    ranked = counts.select(column, F.expr(f"sum(c) over (order by {column})").alias("upto"), F.expr("sum(c) over ()").alias("n"))
    wanted = F.explode(F.array(*(F.lit(float(q)) for q in quantiles))).alias("q")
    return ranked.select(column, "upto", "n", wanted).where(F.col("upto") > F.floor(F.col("q") * (F.col("n") - 1))).groupBy("q").agg(F.min(column).alias("value"))


def conference_year(papers: DataFrame, editions: DataFrame, conferences: DataFrame) -> DataFrame:
    e, c = editions.select(F.col("id").alias("e"), "conference_id", F.col("year").alias("ey")), conferences.select(F.col("id").alias("c"), "short_name")
    rows = papers.join(e, F.col("edition_id") == F.col("e"), "left").join(c, F.col("conference_id") == F.col("c"), "left")
    return rows.groupBy(F.coalesce("short_name", F.lit("Unknown")).alias("conference"), F.coalesce("ey", "year").alias("year")).agg(F.count("*").alias("papers"))


def category_stats(categories: DataFrame, papers: DataFrame, metrics: DataFrame, techniques: DataFrame) -> DataFrame:
    """Averages are over (paper, category) rows, as the joins give them."""
    rows = categories.select("paper_id", "name").join(papers.select("id", "citation_count"), F.col("paper_id") == F.col("id")).join(metrics, "paper_id", "left")
    out = rows.groupBy("name").agg(F.count_distinct("paper_id").alias("papers"), F.round(F.avg("citation_count"), 2).alias("avg_citations"), F.max("citation_count").alias("max_citations"), F.round(F.avg("degree_centrality"), 4).alias("avg_degree"), F.round(F.avg("betweenness_centrality"), 4).alias("avg_betweenness"))
    tech = categories.select("paper_id", "name").join(techniques.select("paper_id", effective_name().alias("t")), "paper_id").groupBy(F.col("name").alias("_n")).agg(F.count_distinct("t").alias("technique_diversity"))
    return out.join(tech, out["name"].eqNullSafe(tech["_n"]), "left").drop("_n").withColumn("technique_diversity", F.coalesce("technique_diversity", F.lit(0)))


def entity_records(techniques: DataFrame) -> DataFrame:
    """Per canonical name its rows, papers and raw spellings; flags singletons and over-merged names."""
    out = techniques.where("canonical_name is not null").groupBy("canonical_name").agg(F.count("*").alias("n_rows"), F.count_distinct("paper_id").alias("papers"), F.array_sort(F.collect_set("name")).alias("variants"))
    return out.withColumn("singleton", F.col("papers") == 1).withColumn("over_merged", F.size("variants") > 3)


def signal_tiers(techniques: DataFrame, n_papers: DataFrame) -> DataFrame:
    """Core, shared and singleton techniques with the share of papers that have them."""
    used = techniques.where("canonical_name is not null").groupBy("canonical_name").agg(F.count_distinct("paper_id").alias("papers"))
    tier = F.when(F.col("papers") >= CORE, "core").when(F.col("papers") >= SHARED, "shared").otherwise("singleton")
    return used.crossJoin(F.broadcast(n_papers.agg(F.count("*").alias("_n")))).select("canonical_name", "papers", tier.alias("tier"), F.round(100 * F.col("papers") / F.col("_n"), 2).alias("pct"))


def share_by(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Sum of ``value`` per group and its share of the total in percent."""
    out = rows.groupBy(group).agg(F.sum(value).alias("total"))
    return out.withColumn("share", F.round(100 * F.col("total") / F.sum("total").over(_all()), 2))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()


def graph_stats(edges: DataFrame, papers: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row about the paper graph."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    a = edges.agg(F.count("*").alias("edges"), F.round(F.avg("weight"), 4).alias("avg_weight"), F.max("weight").alias("max_weight"))
    b = papers.join(ends, "id", "left_anti").agg(F.count("*").alias("isolated"))
    c = metrics.agg(F.count_distinct("cluster_id").alias("clusters"), F.max_by("paper_id", F.struct(F.col("degree_centrality"), -F.col("paper_id"))).alias("most_central"))
    d = metrics.groupBy("cluster_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("largest_cluster"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)  # one row each


def top_clusters(metrics: DataFrame, papers: DataFrame, categories: DataFrame, least: int, k: int) -> DataFrame:
    """Clusters of ``least`` papers or more: size, the papers of most betweenness, and dominant categories."""
    size = metrics.groupBy("cluster_id").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    top = metrics.withColumn("r", F.expr("row_number() over (partition by cluster_id order by betweenness_centrality desc, paper_id)")).where(F.col("r") <= k)
    top = top.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "paper_id"))), lambda x: x["paper_id"].cast("string")), ",").alias("top_papers"))
    cats = metrics.join(categories, "paper_id").groupBy("cluster_id", "name").agg(F.count("*").alias("n"))
    cats = cats.withColumn("r", F.expr("row_number() over (partition by cluster_id order by n desc, name)")).where("r <= 4")
    cats = cats.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), "; ").alias("categories"))
    return size.join(top, "cluster_id", "left").join(cats, "cluster_id", "left")


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows) of some tables."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"))
        out = part if out is None else out.unionByName(part)
    return out.select("name", "n_rows")


def snapshot_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, before, n_rows, delta) of two snapshots; a table that one of them lacks has 0 rows there."""
    out = before.withColumnRenamed("n_rows", "before").join(after, "name", "full_outer").fillna(0)
    return out.select("name", "before", "n_rows", (F.col("n_rows") - F.col("before")).alias("delta"))


def technique_browser(techniques: DataFrame, metrics: DataFrame | None, min_papers: int = 1) -> DataFrame:
    """(canonical_name, usage_count, connected_papers_count, top_cooccurring, introduces, uses) of names in ``min_papers`` and more.

    ``metrics`` is what ``graph.technique_metrics`` gives. Without it (None) names are
    counted afresh, with no connections, companions or roles.
    """
    named = techniques.where("canonical_name is not null")
    if metrics is None:
        usage = named.groupBy("canonical_name").agg(F.count_distinct("paper_id").alias("usage_count")).where(F.col("usage_count") >= min_papers)
        none = F.array().cast("array<struct<name:string,count:bigint>>")
        return usage.select("canonical_name", "usage_count", F.lit(0).cast("long").alias("connected_papers_count"), none.alias("top_cooccurring"), F.lit(0).cast("long").alias("introduces"), F.lit(0).cast("long").alias("uses"))
    roles = named.groupBy("canonical_name").agg(F.count_if(F.col("role") == "introduces").alias("introduces"), F.count_if(F.col("role") == "uses").alias("uses"))
    known = metrics.where(F.col("usage_count") >= min_papers).join(roles, "canonical_name", "left")
    return known.select("canonical_name", "usage_count", "connected_papers_count", "top_cooccurring", F.coalesce("introduces", F.lit(0)).alias("introduces"), F.coalesce("uses", F.lit(0)).alias("uses"))
