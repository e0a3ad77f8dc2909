"""One query for each operator of this subpackage, over its whole table, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import chat_format
from .decontaminate import contaminated
from .exact_dedup import exact_dedup
from .html_extract import extract
from .license_scan import license_scan, oracle_sql as license_sql
from .minhash import near_dedup
from .neighbours import nearest_neighbours
from .packing import pack
from .prefix_trie import conversation_trie, oracle_sql as trie_sql
from .quality import quality_scores
from .secrets import secret_scan
from .toxicity import toxicity_scores
from .vector_codes import oracle_sql as codes_sql, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies by signature-coordinate lists, confirmed on full shingle sets."""
    return near_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def tokenizer_path() -> str:
    """The byte-level vocabulary that packing uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences by a positional rare-token index."""
    return license_scan(_table(spark, sf_dir, "documents"))


def op3_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens along a Hilbert curve."""
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality by supervised subword embeddings."""
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets, judged by who holds them over the corpus."""
    return secret_scan(_table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, by greedy string tiling."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("row_hash")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity grades by cumulative-link regression."""
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("row_hash")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text by message passing over the DOM."""
    return extract(_table(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies by a Golomb-coded fingerprint exchange."""
    return exact_dedup(_table(spark, sf_dir, "documents")).drop("row_hash")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply-ordered conversations without quotes."""
    return chat_format(_table(spark, sf_dir, "conversations"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, by partition refinement."""
    return conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors, entries found in kd-trees."""
    return vector_codes(_table(spark, sf_dir, "embeddings")).drop("label")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every twentieth, by a permutation index."""
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"))


_ALL = (
    op1_minhash_near_dedup, op2_license_scan, op3_hilbert_packing, op4_quality_classifier, op5_secret_scan, op6_benchmark_decontamination, op7_toxicity,
    op8_html_extraction, op9_exact_dedup, op10_chat_formatting, op11_prefix_trie, op12_vector_codes, op13_nearest_neighbours,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": license_sql(),
    "op11_prefix_trie": trie_sql(),
    "op12_vector_codes": codes_sql(),
    "op1_minhash_near_dedup": f"""
with recursive w as (
  select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as (
  select doc_id, list_distinct(case when len(ws) >= 5
    then [array_to_string(ws[i:i+4], ' ') for i in range(1, len(ws) - 3)]
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh from w),
n as (select doc_id, len(sh) as n from s),
x as (select doc_id, unnest(sh) as g from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select p.a, p.b from p join n na on na.doc_id = p.a join n nb on nb.doc_id = p.b where 100 * i >= 75 * (na.n + nb.n - i)),
both_ways as (select a, b from e union all select b, a from e),
reach as (select doc_id as u, doc_id as v from documents union select r.u, k.b from reach r join both_ways k on k.a = r.v),
c as (select u as doc_id, min(v) as component_id from reach group by u)
select n.doc_id, n.n::bigint as n_shingles, c.component_id, c.component_id = n.doc_id as kept from n join c using (doc_id)""",
    "op9_exact_dedup": f"""
with t as (select doc_id, {_LOWER} as body from documents)
select doc_id, max(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size,
       doc_id = max(doc_id) over (partition by body) as kept, sha256(body) as text_sha256 from t""",
}
