"""From raw documents to packed training sequences, in stages that can each be rerun."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm.common import Scratch, without
from inkwell.llm.decontaminate import contaminated
from inkwell.llm.exact_dedup import exact_dedup
from inkwell.llm.minhash import near_dedup
from inkwell.llm.packing import pack
from inkwell.llm.queries import tokenizer_path
from inkwell.llm.toxicity import toxicity_scores


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of severity grade 1 and more go."""
    scored = toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, scored.where("toxic").select("doc_id", "row_hash"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return without(docs, exact_dedup(docs).where("not kept").select("doc_id", "row_hash"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays."""
    return without(docs, near_dedup(docs).where("not kept").select("doc_id", "row_hash"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half or more of a benchmark item go."""
    return without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "row_hash"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences."""
    return pack(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each reading what its predecessor has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained model, a tokenizer and greedy tiling decide in most stages, which SQL can't express.
ORACLE_SQL = None
