"""Every query against its SQL on the smallest tables."""

import datetime
import math
import os

import pytest

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _names():
    from inkwell.plans import aggregate_queries, browse_queries, graph_queries, pipeline_queries, registry, report_queries, search_queries, text_queries  # noqa: F401

    return list(registry.QUERIES)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 8) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not there")
@pytest.mark.parametrize("name", _names())
def test_query(spark, duck, name):
    from inkwell.plans import registry

    df = registry.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(map(_plain, r)) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    if name in registry.ORACLE_SQL:
        quoted = ", ".join(f'"{c}"' for c in cols)
        want = sorted(tuple(map(_plain, r)) for r in duck.sql(f"select {quoted} from ({registry.ORACLE_SQL[name]})").fetchall())
        assert got == want


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not there")
@pytest.mark.parametrize("name", ["gr_betweenness", "gr_communities"])
def test_graph_of_papers(spark, name):
    from inkwell.plans import registry

    papers = {r[0] for r in spark.read.parquet(f"{DIR}/orders.parquet").select("o_orderkey").collect()}
    assert {r.id for r in registry.QUERIES[name](spark, DIR).select("id").collect()} == papers


def test_sections_are_whole(spark, tmp_path):
    """Texts of more than 100,000 characters come back as they are."""
    from inkwell.plans import registry

    rows = [(1, "x" * 100_001, "en", "a"), (2, "é " * 90_000 + "end", "de", "b"), (3, None, "en", "c"), (4, "", None, "d")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, registry.QUERIES["ups_sections_simple"](spark, str(tmp_path)).select("id", "introduction", "methodology").collect()))
    assert got == [(d, t, s if lang == "en" else None) for d, t, lang, s in rows]
