"""Snapshots of a column as sketches of bounded size, which are stored and merged without reading the rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of the quantile sketch (a rank is off by 1.33 % of the rows at most, with 99 % confidence), bits of the distinct counter, items that are tracked.
QUANTILE_SIZE, DISTINCT_BITS, TRACKED = 200, 12, 1000


def sketch(rows: DataFrame, by: list[str], number: str, item: str) -> DataFrame:
    """(by, n, quantiles, distinct, items): for each group sketches of a number's quantiles and of an item's kinds and frequencies.

    Partial sketches are merged on the way, so a group of very many rows is no task's work alone.
    Nulls count in ``n`` only.
    """
    number, item = f"cast(`{number}` as double)", f"cast(`{item}` as string)"
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.expr(f"kll_sketch_agg_double({number}, {QUANTILE_SIZE})").alias("quantiles"),
        F.expr(f"hll_sketch_agg({item}, {DISTINCT_BITS})").alias("distinct"), F.expr(f"approx_top_k_accumulate({item}, {TRACKED})").alias("items"),
    )


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of coarser groups, or of several snapshots together."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.expr("kll_merge_agg_double(quantiles)").alias("quantiles"),
        F.expr("hll_union_agg(distinct)").alias("distinct"), F.expr(f"approx_top_k_combine(items, {TRACKED})").alias("items"),
    )


def figures(sketches: DataFrame, by: list[str], shares: list[float], k: int = 10) -> DataFrame:
    """(by, n, kinds, quantiles array, top array of (item, count)) as the sketches have them."""
    at = F.array(*(F.expr(f"kll_sketch_get_quantile_double(quantiles, {s}D)") for s in shares))
    return sketches.select(*by, "n", F.expr("hll_sketch_estimate(distinct)").alias("kinds"), at.alias("quantiles"), F.expr(f"approx_top_k_estimate(items, {k})").alias("top"))
