"""Where queries and the SQL that checks them are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of a Corpus under its name; ``sql`` sees the corpus tables by their names."""

    def put(f: Callable[[corpus.Corpus], DataFrame]):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are called {key}")
        QUERIES[key] = lambda spark, sf_dir: f(corpus.Corpus(spark, sf_dir))
        if sql:
            text = sql.strip()
            ORACLE_SQL[key] = f"{corpus.VIEWS.strip()}, {text[5:].lstrip()}" if text.lower().startswith("with ") else f"{corpus.VIEWS.strip()}\n{text}"
        return f

    return put
