"""The research corpus as views over the warehouse tables.

Papers are orders, editions customers, conferences nations, authors suppliers, and a
paper's techniques, categories, datasets and methodologies come from its line items.
The similarity graph is built over ``works``, the customers, whose entities are the
parts they order: the number of works that share one grows with the corpus only slowly.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLE = {"A": "introduces", "N": "uses", "R": "compares"}


class Corpus:
    """DataFrames over the tables in one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def papers(self) -> DataFrame:
        o = self.table("orders")
        kind = F.when(F.col("o_orderpriority").startswith("1"), "oral").when(F.col("o_orderpriority").startswith("2"), "spotlight").when(F.col("o_orderpriority").startswith("3"), "poster").when(F.col("o_orderpriority").startswith("4"), "workshop").otherwise("other")
        return o.select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("edition_id"), F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"),
            F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("An order of priority "), F.lower("o_orderpriority"), F.lit(" placed by customer "), F.col("o_custkey"))).alias("abstract"),
            F.year("o_orderdate").alias("year"), F.to_date("o_orderdate").alias("publication_date"), kind.alias("presentation_type"),
            F.floor(F.col("o_totalprice") / 1000).alias("citation_count"), F.floor(F.col("o_totalprice") / 20000).alias("influential_citation_count"),
            (F.col("o_orderstatus") != "P").alias("is_open_access"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("pdf/"), F.col("o_orderkey"), F.lit(".pdf"))).alias("pdf_path"),
            F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("https://papers.example/"), F.col("o_orderkey"))).alias("pdf_url"), F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def editions(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("conference_id"), (1990 + F.col("c_nationkey") % 10).alias("year"), F.col("c_mktsegment").alias("location"))

    @cached_property
    def conferences(self) -> DataFrame:
        n = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("short_name"), F.concat(F.lit("Conference of "), F.col("n_name")).alias("full_name"), F.col("r_name").alias("field"))

    @cached_property
    def authors(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("full_name"), F.col("s_nationkey").alias("affiliation_id"))

    @cached_property
    def paper_authors(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_orderkey").alias("paper_id"), F.col("l_suppkey").alias("author_id")).agg(F.min("l_linenumber").alias("position"))

    @cached_property
    def _lines(self) -> DataFrame:
        l, p = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_discount"), self.table("part")
        return l.join(p, l["l_partkey"] == p["p_partkey"])

    @cached_property
    def techniques(self) -> DataFrame:
        """One row per (paper, name); of several roles the first of introduces, uses, compares."""
        role = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
        rows = self._lines.groupBy(F.col("l_orderkey").alias("paper_id"), F.concat_ws(" ", "p_brand", "p_name").alias("name"))
        rows = rows.agg(F.min(role).alias("r"), F.max(F.when(F.col("p_size") <= 45, F.lower("p_name"))).alias("canonical_name"))
        return rows.select("paper_id", "name", "canonical_name", F.when(F.col("r") == 1, "introduces").when(F.col("r") == 2, "uses").otherwise("compares").alias("role"))

    @cached_property
    def categories(self) -> DataFrame:
        rows = self._lines.groupBy(F.col("l_orderkey").alias("paper_id"), F.col("p_type").alias("name"))
        return rows.agg(F.max(F.when(F.col("p_size") <= 25, F.initcap("p_type"))).alias("canonical_name"), F.round(1 - F.min("l_discount"), 4).alias("confidence"))

    @cached_property
    def datasets(self) -> DataFrame:
        l, s = self.table("lineitem").select("l_orderkey", "l_suppkey"), self.table("supplier")
        return l.distinct().join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("paper_id"), F.col("s_name").alias("name"))

    @cached_property
    def methodologies(self) -> DataFrame:
        return self._lines.select(F.col("l_orderkey").alias("paper_id"), F.col("p_brand").alias("name")).distinct()

    @cached_property
    def metrics(self) -> DataFrame:
        o = F.col("o_orderkey")
        return self.table("orders").select(
            o.alias("paper_id"), F.round((o % 97) / 97.0, 6).alias("degree_centrality"), F.round((o % 89) / 89.0, 6).alias("betweenness_centrality"),
            (F.col("o_custkey") % 10).cast("int").alias("cluster_id"), (o % 31).cast("int").alias("neighbors_count"),
        )

    @cached_property
    def edges(self) -> DataFrame:
        """Papers of one edition are related, the more the closer their prices."""
        a = self.table("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("src"), F.col("o_totalprice").alias("x"))
        b = a.select("k", F.col("src").alias("dst"), F.col("x").alias("y"))
        return a.join(b, "k").where("src < dst").select("src", "dst", F.round(1 + F.abs(F.col("x") - F.col("y")) / 50000, 8).alias("weight"))

    @cached_property
    def works(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.floor("c_acctbal").alias("citation_count"))

    @cached_property
    def work_entities(self) -> DataFrame:
        """(paper_id, kind, name, canonical_name) of the works."""
        c, o = self.table("customer"), self.table("orders")
        l, p = self.table("lineitem").select("l_orderkey", "l_partkey"), self.table("part")
        parts = o.join(l, o["o_orderkey"] == l["l_orderkey"]).join(p, l["l_partkey"] == p["p_partkey"])
        tech = parts.select(F.col("o_custkey").alias("paper_id"), F.lit("technique").alias("kind"), F.concat_ws(" ", "p_brand", "p_type", "p_partkey").alias("name"), F.when(F.col("p_size") <= 45, F.concat_ws(" ", "p_type", "p_partkey")).alias("canonical_name")).distinct()
        n = self.table("nation")
        home = c.join(n, c["c_nationkey"] == n["n_nationkey"])
        data = home.select(F.col("c_custkey").alias("paper_id"), F.lit("dataset").alias("kind"), F.concat_ws(" ", "n_name", "c_mktsegment").alias("name"), F.lit(None).cast("string").alias("canonical_name"))
        cat = home.select(F.col("c_custkey").alias("paper_id"), F.lit("category").alias("kind"), F.concat(F.lit("area "), F.floor("c_acctbal")).alias("name"), F.lit(None).cast("string").alias("canonical_name"))
        meth = home.select(F.col("c_custkey").alias("paper_id"), F.lit("methodology").alias("kind"), F.concat(F.lit("bucket "), F.floor(F.col("c_custkey") / 12)).alias("name"), F.lit(None).cast("string").alias("canonical_name"))
        return tech.unionByName(data).unionByName(cat).unionByName(meth)

    @cached_property
    def texts(self) -> DataFrame:
        """The text papers: title is the first sentence's first 80 characters."""
        d = self.table("documents")
        title = F.substring(F.split_part(F.col("text"), F.lit("."), F.lit(1)), 1, 80)
        return d.select(F.col("doc_id").alias("id"), title.alias("title"), F.col("text").alias("abstract"), F.col("source").alias("venue"), F.col("lang").alias("field"))


#: The same views for DuckDB.
VIEWS = """
with papers as (
  select o_orderkey as id, o_custkey as edition_id, 'Order ' || o_orderkey as title,
    case when o_orderstatus <> 'P' then 'An order of priority ' || lower(o_orderpriority) || ' placed by customer ' || o_custkey end as abstract,
    year(o_orderdate)::int as year, o_orderdate::date as publication_date,
    case substr(o_orderpriority, 1, 1) when '1' then 'oral' when '2' then 'spotlight' when '3' then 'poster' when '4' then 'workshop' else 'other' end as presentation_type,
    floor(o_totalprice / 1000)::bigint as citation_count, floor(o_totalprice / 20000)::bigint as influential_citation_count,
    o_orderstatus <> 'P' as is_open_access, case when o_orderstatus = 'F' then 'pdf/' || o_orderkey || '.pdf' end as pdf_path,
    case when o_orderstatus <> 'O' then 'https://papers.example/' || o_orderkey end as pdf_url, o_orderdate as created_at from orders),
editions as (select c_custkey as id, c_nationkey as conference_id, (1990 + c_nationkey % 10)::int as year, c_mktsegment as location from customer),
conferences as (select n_nationkey as id, n_name as short_name, 'Conference of ' || n_name as full_name, r_name as field from nation join region on n_regionkey = r_regionkey),
authors as (select s_suppkey as id, s_name as full_name, s_nationkey as affiliation_id from supplier),
paper_authors as (select l_orderkey as paper_id, l_suppkey as author_id, min(l_linenumber) as position from lineitem group by all),
lines_ as (select l_orderkey, l_suppkey, l_returnflag, l_discount, part.* from lineitem join part on l_partkey = p_partkey),
techniques as (
  select paper_id, name, canonical_name, case r when 1 then 'introduces' when 2 then 'uses' else 'compares' end as role from (
    select l_orderkey as paper_id, p_brand || ' ' || p_name as name, max(case when p_size <= 45 then lower(p_name) end) as canonical_name,
      min(case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end) as r from lines_ group by 1, 2)),
categories as (
  select l_orderkey as paper_id, p_type as name, max(case when p_size <= 25 then upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) end) as canonical_name,
    round(1 - min(l_discount), 4) as confidence from lines_ group by 1, 2),
datasets as (select distinct l_orderkey as paper_id, s_name as name from lineitem join supplier on l_suppkey = s_suppkey),
methodologies as (select distinct l_orderkey as paper_id, p_brand as name from lines_),
metrics as (
  select o_orderkey as paper_id, round((o_orderkey % 97) / 97.0, 6) as degree_centrality, round((o_orderkey % 89) / 89.0, 6) as betweenness_centrality,
    (o_custkey % 10)::int as cluster_id, (o_orderkey % 31)::int as neighbors_count from orders),
edges as (
  select a.o_orderkey as src, b.o_orderkey as dst, round(1 + abs(a.o_totalprice - b.o_totalprice) / 50000, 8) as weight
  from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey),
works as (select c_custkey as id, c_name as title, floor(c_acctbal)::bigint as citation_count from customer),
work_entities as (
  select distinct o_custkey as paper_id, 'technique' as kind, p_brand || ' ' || p_type || ' ' || p_partkey as name, case when p_size <= 45 then p_type || ' ' || p_partkey end as canonical_name
  from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey
  union all select c_custkey, 'dataset', n_name || ' ' || c_mktsegment, null from customer join nation on c_nationkey = n_nationkey
  union all select c_custkey, 'category', 'area ' || floor(c_acctbal)::bigint, null from customer join nation on c_nationkey = n_nationkey
  union all select c_custkey, 'methodology', 'bucket ' || floor(c_custkey / 12)::bigint, null from customer join nation on c_nationkey = n_nationkey),
texts as (select doc_id as id, substr(split_part(text, '.', 1), 1, 80) as title, text as abstract, source as venue, lang as field from documents)
"""
