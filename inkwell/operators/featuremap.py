"""Mapping a document's features to papers: evidence, recommendations and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workers import ship

FEATURE_KINDS = ["capability", "data", "evaluation", "infrastructure", "interface", "model", "training", "other"]
MOST_FEATURES, CANDIDATES, KEPT, EVIDENCE, ITEM_CHARS = 10, 8, 3, 2, 60


def coerce_features(parsed: DataFrame, key: str = "project_id", features: str = "features", kinds: list[str] | None = None) -> DataFrame:
    """(project_id, position, name, category, description): nameless ones out, unknown categories 'other', ten at most."""
    kinds = kinds or FEATURE_KINDS
    rows = parsed.select(key, F.posexplode(features).alias("p", "f")).where(F.trim(F.coalesce("f.name", F.lit(""))) != "")
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("p"))).where(F.col("position") <= MOST_FEATURES)
    category = F.lower(F.trim(F.coalesce("f.category", F.lit(""))))
    return rows.select(key, "position", F.trim("f.name").alias("name"), F.when(category.isin(kinds), category).otherwise("other").alias("category"), F.coalesce("f.description", F.lit("")).alias("description"))


def query_text(name: Column, description: Column, techniques: Column) -> Column:
    return F.concat(name, F.lit(". "), description, F.lit(". "), F.array_join(techniques, " "))


def blob(*texts: Column) -> Column:
    """What a feature already says, for 'already present' tests."""
    return F.lower(F.concat_ws(" ", *texts))


def missing_items(matches: DataFrame, items: DataFrame, features: DataFrame, item: str = "name", k: int = CANDIDATES) -> DataFrame:
    """(feature_id, name, papers, rank): items of a feature's papers that its text does not hold, by papers.

    ``matches`` (feature_id, paper_id), ``items`` (paper_id, name), ``features`` (feature_id, blob).
    Either is made distinct where its papers are, so papers are counted in the join that finds them.
    """
    matches, items = (x.repartition("paper_id").distinct() for x in (matches.select("feature_id", "paper_id"), items.select("paper_id", F.col(item).alias("name"))))
    rows = matches.join(items, "paper_id").groupBy("feature_id", "name").agg(F.count("*").alias("papers"))
    rows = rows.join(features.select("feature_id", "blob"), "feature_id").where(~F.contains("blob", F.lower("name"))).drop("blob")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("feature_id").orderBy(F.desc("papers"), "name"))).where(F.col("rank") <= k)


def evaluation_items(datasets: DataFrame, findings: DataFrame) -> DataFrame:
    """(paper_id, name): datasets, and the first two parts of 'benchmark :: metric :: scores', up to 60 characters."""
    parts = F.slice(F.split("finding", " :: "), 1, 2)
    f = findings.select("paper_id", F.explode(F.transform(parts, lambda x: F.trim(x))).alias("name"))
    return datasets.select("paper_id", "name").unionByName(f).where((F.length("name") > 0) & (F.length("name") <= ITEM_CHARS)).distinct()


def evidence_filter(candidates: DataFrame) -> DataFrame:
    """Of a feature's candidates those with two papers or more, or else the first three; three at most."""
    strong = F.max((F.col("papers") >= EVIDENCE).cast("int")).over(Window.partitionBy("feature_id")) == 1
    rows = candidates.withColumn("_s", strong).where(~F.col("_s") | (F.col("papers") >= EVIDENCE)).drop("_s")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("feature_id").orderBy("rank"))).where(F.col("rank") <= KEPT)


def template_recommendations(kept: DataFrame, kind: str) -> DataFrame:
    """(feature_id, kind, rank, title, rationale): deterministic text, for when no model writes it."""
    verb = {"technique": "Consider", "evaluation": "Evaluate on"}.get(kind, "Consider")
    return kept.select(
        "feature_id", F.lit(kind).alias("kind"), "rank", F.concat(F.lit(f"{verb} "), "name").alias("title"),
        F.format_string("%s is used by %d of the matched papers and is not part of this feature yet.", "name", F.col("papers").cast("int")).alias("rationale"),
    )


def known_recommendations(written: DataFrame, kept: DataFrame, k: int = KEPT) -> DataFrame:
    """Written recommendations (feature_id, kind, position, name, text) that name a known candidate, ``k`` of each kind, ranked anew."""
    names = kept.select("feature_id", "kind", F.lower("name").alias("_n")).distinct()
    rows = written.withColumn("_n", F.lower(F.trim("name"))).join(names, ["feature_id", "kind", "_n"], "left_semi").drop("_n")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("feature_id", "kind").orderBy("position"))).where(F.col("rank") <= k)


def apply_by_index(matches: DataFrame, explanations: DataFrame) -> DataFrame:
    """Adds ``explanation`` to matches (feature_id, rank): by the paper number given (from 1), or else by position; the last wins."""
    e = explanations.select("feature_id", F.coalesce("paper", F.col("position") + 1).alias("rank"), "position", "text").groupBy("feature_id", "rank").agg(F.max_by("text", "position").alias("explanation"))
    return matches.join(e, ["feature_id", "rank"], "left")


def prompt_context(papers: DataFrame, key: str = "feature_id") -> DataFrame:
    """(feature_id, prompt): a block per paper with its title and cut summary."""
    block = F.concat(F.lit("Paper "), F.col("rank").cast("string"), F.lit(": "), F.col("title"), F.lit("\n"), F.substring(F.coalesce("summary", F.lit("")), 1, 400))
    return papers.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("prompt"))


def why_related(techniques: Column, datasets: Column, categories: Column, methodologies: Column) -> Column:
    """At most five distinct shared names: three techniques, two datasets, two categories, one methodology."""
    return F.slice(F.array_distinct(F.concat(F.slice(techniques, 1, 3), F.slice(datasets, 1, 2), F.slice(categories, 1, 2), F.slice(methodologies, 1, 1))), 1, 5)


def llm_cost(tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars at 0.075 and 0.30 a million tokens."""
    return (tokens_in * 0.075 + tokens_out * 0.30) / 1e6


def call_model(prompts: DataFrame, model: Callable[[str], str] | None, key: str = "id", prompt: str = "prompt") -> DataFrame:
    """(id, answer, failed): a model called for each prompt in the workers; a failure or no model gives a null answer.

    The model must be picklable. Callers fall back to their templates where failed is true.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text in part[prompt]:
                try:
                    out.append(model(text) if model else None)
                except Exception:  # noqa: BLE001  whatever an outside service raises, the row goes on without it
                    out.append(None)
            yield pd.DataFrame({key: part[key], "answer": pd.Series(out, dtype=object), "failed": [a is None for a in out]})

    ship(prompts.sparkSession)
    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, prompt).mapInPandas(run, f"{key} {kind}, answer string, failed boolean")


def project_report(features: DataFrame, matches: DataFrame, recommendations: DataFrame, papers: DataFrame) -> DataFrame:
    """(project_id, features): each project's features with their papers and recommendations nested in order."""
    m = matches.join(papers.select(F.col("id").alias("paper_id"), "title"), "paper_id", "left").groupBy("feature_id").agg(F.array_sort(F.collect_list(F.struct("rank", "paper_id", "title", "score"))).alias("papers"))
    r = recommendations.groupBy("feature_id").agg(F.array_sort(F.collect_list(F.struct("kind", "rank", "title"))).alias("recommendations"))
    rows = features.join(m, "feature_id", "left").join(r, "feature_id", "left")
    return rows.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("feature_id", "name", "tier", "papers", "recommendations"))).alias("features"))


def fallback_prose(features: DataFrame, key: str = "project_id") -> DataFrame:
    """(project_id, prose): how many features of each tier, and which are novel."""
    count = lambda t: F.count_if(F.coalesce("tier", F.lit("unknown")) == t).cast("int")
    novel = F.array_join(F.array_sort(F.collect_list(F.when(F.col("tier") == "novel", F.col("name")))), ", ")
    text = F.format_string("%d features: %d strongly, %d moderately and %d weakly covered, %d novel.", F.count("*").cast("int"), count("strong"), count("moderate"), count("weak"), count("novel"))
    return features.groupBy(key).agg(F.concat(text, F.when(F.length(novel) > 0, F.concat(F.lit(" Novel: "), novel, F.lit("."))).otherwise("")).alias("prose"))
