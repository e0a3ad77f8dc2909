"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str) -> None:
    """A report as CSV with a header; reports are short, so one file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A derived table, rebuilt whole."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def append_errors(errors: DataFrame, path: str) -> None:
    """(paper_id, stage, error_type, error_msg, retryable) appended with the time."""
    errors.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """The first ``limit`` rows of a sorted report as a Markdown table."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    rows = df.limit(limit).collect()
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)])


def markdown_report(title: str, sections: dict[str, DataFrame | str], limit: int = 1000) -> str:
    """A heading for each section and its table or text."""
    return "\n\n".join([f"# {title}", *(f"## {k}\n\n{v if isinstance(v, str) else markdown_table(v, limit)}" for k, v in sections.items())]) + "\n"


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def rollback_sql(changes: DataFrame, table_: str = "paper_techniques") -> DataFrame:
    """Statements that set written canonical names back to null."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return changes.select(F.concat(F.lit(f"UPDATE {table_} SET canonical_name = NULL WHERE paper_id = "), quoted("paper_id"), F.lit(" AND name = "), quoted("name"), F.lit(";")).alias("statement"))
