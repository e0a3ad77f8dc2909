"""Vector search, hybrid ranking, rank fusion and coverage."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workers import ship
from . import fts
from .vector_index import VectorIndex

# Fixed values.
SEMANTIC_WEIGHT, CHUNKS, PAPERS, LEAST_COSINE, CHUNK_CHARS, CHUNKS_PER_PAPER = 40.0, 200, 50, 0.30, 2000, 5
RRF_K, DENSE_WEIGHT, TECHNIQUE_WEIGHT, CATEGORY_WEIGHT = 60, 1.0, 1.4, 0.7
MAX_RRF = (DENSE_WEIGHT + TECHNIQUE_WEIGHT + CATEGORY_WEIGHT) / RRF_K
BREADTH, QUALITY = 0.6, 0.4
REFERENTIAL = (
    r"(?i)\b(that|those|it|its|them|they|this|these|the (first|second|third|fourth|fifth|last|previous|other|same|above)|paper \d|tell me more|"
    r"elaborate|explain (more|further)|what about|can you expand|go deeper|more (detail|info|context)|summarise|summarize)\b"
)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_topk(index: VectorIndex, queries: DataFrame, k: int = CHUNKS, least: float = LEAST_COSINE, exact: bool = True) -> DataFrame:
    """(query_id, chunk_id, paper_id, score): the ``k`` nearest chunks of each query (query_id, vector), then those below ``least`` go.

    Queries are rows that are sent to the index's cells, so any number of them is one plan.
    """
    return index.search(queries, k, least, exact)


def max_pool(hits: DataFrame, k: int = PAPERS) -> DataFrame:
    """(query_id, paper_id, score): the best chunk of each paper, the ``k`` best papers of each query."""
    best = hits.groupBy("query_id", "paper_id").agg(F.max("score").alias("score"))
    return best.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "paper_id"))).where(F.col("_r") <= k).drop("_r")


def build_chunks(papers: DataFrame, sections: list[str], key: str = "id") -> DataFrame:
    """(id, position, field, chunk): up to five non-empty sections in order, title first and cut; the title alone if there is none."""
    pieces = [F.struct(F.lit(i).alias("position"), F.lit(s).alias("field"), F.trim(F.col(s)).alias("body")) for i, s in enumerate(sections)]
    kept = F.slice(F.filter(F.array(*pieces), lambda x: F.coalesce(x["body"], F.lit("")) != ""), 1, CHUNKS_PER_PAPER)
    alone = F.array(F.struct(F.lit(0).alias("position"), F.lit("title").alias("field"), F.lit("").alias("body")))
    rows = papers.select(key, "title", F.explode(F.when(F.size(kept) > 0, kept).otherwise(alone)).alias("c"))
    text = F.when(F.col("c.field") == "title", F.coalesce("title", F.lit(""))).otherwise(F.concat_ws(". ", F.nullif(F.coalesce("title", F.lit("")), F.lit("")), "c.body"))
    return rows.select(key, F.col("c.position").alias("position"), F.col("c.field").alias("field"), F.substring(text, 1, CHUNK_CHARS).alias("chunk"))


def encode(chunks: DataFrame, encoder: Callable[[list[str]], list[list[float]]], text: str = "chunk") -> DataFrame:
    """Adds L2-normalised vectors of an encoder that workers call with batches of texts."""
    ship(chunks.sparkSession)

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        v = np.asarray(encoder(texts.fillna("").tolist()), np.float32)
        return pd.Series(list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)))

    return chunks.withColumn("embedding", run(text))


def hybrid(keyword: DataFrame, semantic: DataFrame, papers: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, score, rank): keyword score + 40 * cosine + ln(1 + citations) over either's candidates."""
    k = keyword.select("query_id", "id", F.col("score").alias("_k"))
    s = semantic.select("query_id", F.col("paper_id").alias("id"), F.col("score").alias("_s"))
    both = k.join(s, ["query_id", "id"], "full_outer")
    both = both.join(papers.select("id", "citation_count"), "id")
    score = F.coalesce("_k", F.lit(0.0)) + SEMANTIC_WEIGHT * F.coalesce("_s", F.lit(0.0)) + F.log1p(F.coalesce("citation_count", F.lit(0)))
    ranked = both.select("query_id", "id", F.round(score, 6).alias("score"), F.col("_s").isNotNull().alias("semantic"))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= limit)


def retrieve(index: fts.Index | None, papers: DataFrame, entities: DataFrame, queries: DataFrame, semantic: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, score, semantic, rank, labels): the whole search, with where each of the ``limit`` best was found.

    ``queries`` is (query_id, text), ``semantic`` (query_id, paper_id, score), ``papers``
    (id, title, abstract, citation_count). Without an index (there is none, or
    ``fts.health`` finds it lacking) the substring search ranks alone; its score is
    then without the citations that it is ordered by.
    """
    if index is None:
        found = fts.like_score(papers, entities, queries).join(papers.select("id", "citation_count"), "id")
        order = F.round(F.col("score") + F.log1p(F.coalesce("citation_count", F.lit(0))), 6)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(order), "id"))).where(F.col("rank") <= limit)
        return found.select("query_id", "id", "score", F.lit(False).alias("semantic"), "rank", "labels")
    top = hybrid(fts.fts_score(index, entities, queries), semantic, papers, limit)
    top = top.join(fts.matched_in(index, entities, queries), ["query_id", "id"], "left")
    none = F.array().cast("array<string>")
    labels = F.concat(F.when(F.col("semantic"), F.array(F.lit("semantic"))).otherwise(none), F.coalesce("labels", none))
    return top.withColumn("labels", F.array_distinct(labels))


def name_matches(rows: DataFrame, wanted: DataFrame, papers: DataFrame) -> DataFrame:
    """(feature_id, paper_id, matches, position): papers by how many of a feature's names they have, whatever the case."""
    named = rows.select("paper_id", F.lower("name").alias("n")).distinct()
    hits = named.join(wanted.select("feature_id", F.lower("name").alias("n")).distinct(), "n").groupBy("feature_id", "paper_id").agg(F.count("*").alias("matches"))
    hits = hits.join(papers.select(F.col("id").alias("paper_id"), "citation_count"), "paper_id")
    w = Window.partitionBy("feature_id").orderBy(F.desc("matches"), F.desc_nulls_last("citation_count"), "paper_id")
    return hits.select("feature_id", "paper_id", "matches", (F.row_number().over(w) - 1).alias("position"))


def rrf(signals: dict[str, tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """(feature_id, paper_id, score, fired): weighted reciprocal ranks; signals have (feature_id, paper_id, position from 0)."""
    rows = None
    for name, (df, weight) in signals.items():
        part = df.select("feature_id", "paper_id", F.lit(name).alias("signal"), (F.lit(weight) / (k + F.col("position"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("feature_id", "paper_id").agg(F.round(F.sum("part"), 9).alias("score"), F.array_sort(F.collect_set("signal")).alias("fired"))


def top_fused(fused: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("feature_id").orderBy(F.desc("score"), "paper_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def coverage(features: DataFrame, dense: DataFrame, tech: DataFrame, cat: DataFrame, top: DataFrame) -> DataFrame:
    """(feature_id, coverage, tier): breadth of the signals and mean of the top scores next to the best possible."""
    out = features.select("feature_id").distinct()
    for name, df, least in (("d", dense, 3), ("t", tech, 2), ("c", cat, 2)):
        n = df.groupBy("feature_id").agg((F.count("*") >= least).cast("int").alias(name))
        out = out.join(n, "feature_id", "left")
    out = out.join(top.groupBy("feature_id").agg(F.avg("score").alias("q")), "feature_id", "left").fillna(0)
    score = F.round(BREADTH * (F.col("d") + F.col("t") + F.col("c")) / 3 + QUALITY * F.least(F.lit(1.0), F.col("q") / MAX_RRF), 3)
    tier = F.when(F.col("coverage") > 0.65, "strong").when(F.col("coverage") > 0.40, "moderate").when(F.col("coverage") > 0.15, "weak").otherwise("novel")
    return out.select("feature_id", score.alias("coverage")).withColumn("tier", tier)


def follow_up_query(turns: DataFrame, limit: int = 300) -> DataFrame:
    """User turns with the text to search for: short or referential ones get the user turn before them put in front."""
    users = turns.where("role = 'user'").withColumn("anchor", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    short = F.size(F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != "")) <= 4
    needs = (short | F.col("text").rlike(REFERENTIAL)) & F.col("anchor").isNotNull()
    return users.select("conv_id", "turn", F.when(needs, F.substring(F.concat_ws(" ", "anchor", "text"), 1, limit)).otherwise(F.col("text")).alias("query"))


def context_block(papers: DataFrame, key: str = "query_id", title: str = "title", body: str = "abstract", chars: int = 400) -> DataFrame:
    """(query_id, context): numbered blocks of title and cut body, joined by rules."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col(title), F.lit("\n"), F.substring(F.coalesce(body, F.lit("")), 1, chars))
    return papers.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n---\n").alias("context"))


def recall_gate(results: DataFrame, expected: DataFrame, k: int = 5, least: float = 0.80) -> DataFrame:
    """One row: cases, cases with an expected title piece among the first ``k``, pass rate and verdict."""
    hits = expected.join(results.where(F.col("rank") <= k), "query_id", "left").groupBy("query_id").agg(F.coalesce(F.bool_or(F.contains(F.lower("title"), F.lower("piece"))), F.lit(False)).alias("hit"))
    return hits.agg(F.count("*").alias("cases"), F.count_if("hit").alias("passed")).withColumn("rate", F.round(F.col("passed") / F.col("cases"), 4)).withColumn("ok", F.col("rate") >= least)
