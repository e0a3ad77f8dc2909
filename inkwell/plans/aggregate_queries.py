"""Totals, frequencies, distributions and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from .registry import query

NAME = "trim(coalesce(canonical_name, name))"


@query("select (select count(*) from papers) as papers, (select count(pdf_path) from papers) as with_pdf, (select count(distinct canonical_name) from techniques) as techniques, (select count(distinct paper_id) from techniques) as papers_with_techniques, (select count(distinct name) from categories) as categories, (select count(distinct name) from datasets) as datasets")
def agg_corpus_counts(c):
    return A.corpus_counts(c.papers, c.techniques, c.categories, c.datasets)


@query("select canonical_name, count(distinct paper_id) as papers from techniques where canonical_name is not null group by 1 order by papers desc, canonical_name limit 15")
def agg_top_techniques(c):
    return c.techniques.where("canonical_name is not null").groupBy("canonical_name").agg(F.count_distinct("paper_id").alias("papers")).orderBy(F.desc("papers"), "canonical_name").limit(15)


@query("select cluster_id, count(*) as papers, round(avg(degree_centrality), 4) as avg_degree, round(avg(betweenness_centrality), 4) as avg_betweenness from metrics group by 1")
def agg_cluster_overview(c):
    return c.metrics.groupBy("cluster_id").agg(F.count("*").alias("papers"), F.round(F.avg("degree_centrality"), 4).alias("avg_degree"), F.round(F.avg("betweenness_centrality"), 4).alias("avg_betweenness"))


@query("select coalesce(short_name, 'Unknown') as conference, coalesce(e.year, p.year) as year, count(*) as papers from papers p left join editions e on p.edition_id = e.id left join conferences c on e.conference_id = c.id group by 1, 2")
def agg_conference_year(c):
    return A.conference_year(c.papers, c.editions, c.conferences)


@query("select coalesce(short_name, 'Unknown') as conference, count(*) as papers from papers p left join editions e on p.edition_id = e.id left join conferences c on e.conference_id = c.id group by 1")
def agg_papers_per_conf(c):
    return A.conference_year(c.papers, c.editions, c.conferences).groupBy("conference").agg(F.sum("papers").alias("papers"))


@query("select coalesce(e.year, p.year) as year, count(*) as papers from papers p left join editions e on p.edition_id = e.id group by 1")
def agg_papers_per_year(c):
    return A.conference_year(c.papers, c.editions, c.conferences).groupBy("year").agg(F.sum("papers").alias("papers"))


@query("select name, sum(n)::bigint as n_rows, max(n)::bigint as most_in_role from (select coalesce(canonical_name, name) as name, role, count(*) as n from techniques group by 1, 2) group by 1 order by n_rows desc, name limit 100")
def agg_freq_technique(c):
    each = c.techniques.groupBy(A.effective_name(False).alias("name"), "role").agg(F.count("*").alias("n"))
    return each.groupBy("name").agg(F.sum("n").alias("n_rows"), F.max("n").alias("most_in_role")).orderBy(F.desc("n_rows"), "name").limit(100)


@query("select name, count(*) as n_rows, count(distinct paper_id) as papers from datasets where contains(lower(name), '1') group by 1")
def agg_freq_dataset(c):
    return A.frequency(c.datasets.where(F.contains(F.lower("name"), F.lit("1"))), F.col("name"))


@query("select coalesce(canonical_name, name) as name, count(*) as n_rows, count(distinct paper_id) as papers from categories group by 1")
def agg_freq_category(c):
    return A.frequency(c.categories, A.effective_name(False))


@query("select name, count(*) as n_rows, count(distinct paper_id) as papers from methodologies group by 1")
def agg_freq_methodology(c):
    return A.frequency(c.methodologies, F.col("name"))


@query("select (select count(*) from edges) as edges, (select round(avg(weight), 4) from edges) as avg_weight, (select max(weight) from edges) as max_weight, (select count(*) from papers where id not in (select src from edges union select dst from edges)) as isolated, (select count(distinct cluster_id) from metrics) as clusters, (select paper_id from metrics order by degree_centrality desc, paper_id limit 1) as most_central, (select max(n) from (select count(*) as n from metrics group by cluster_id)) as largest_cluster")
def agg_graph_stats(c):
    return A.graph_stats(c.edges, c.papers, c.metrics)


@query("""with top as (select cluster_id, string_agg(paper_id::varchar, ',' order by r) as top_papers from (select *, row_number() over (partition by cluster_id order by betweenness_centrality desc, paper_id) as r from metrics) where r <= 5 group by 1),
cats as (select cluster_id, string_agg(name, '; ' order by r) as categories from (select cluster_id, name, row_number() over (partition by cluster_id order by count(*) desc, name) as r from metrics join categories using (paper_id) group by 1, 2) where r <= 4 group by 1)
select cluster_id, count(*) as size, any_value(top_papers) as top_papers, any_value(categories) as categories from metrics left join top using (cluster_id) left join cats using (cluster_id) group by 1 having count(*) >= 10""")
def agg_top_clusters(c):
    return A.top_clusters(c.metrics, c.papers, c.categories, 10, 5)


@query(f"""with r as (select g.name, paper_id, citation_count, degree_centrality, betweenness_centrality from categories g join papers on id = paper_id left join metrics using (paper_id))
select r.name, count(distinct r.paper_id) as papers, round(avg(citation_count), 2) as avg_citations, max(citation_count) as max_citations, round(avg(degree_centrality), 4) as avg_degree, round(avg(betweenness_centrality), 4) as avg_betweenness,
  (select count(distinct trim(coalesce(t.canonical_name, t.name))) from categories k join techniques t using (paper_id) where k.name = r.name) as technique_diversity from r group by r.name""")
def agg_category_stats(c):
    return A.category_stats(c.categories, c.papers, c.metrics, c.techniques)


ROLES_SQL = f"""each_ as (select {NAME} as technique, paper_id, max((role = 'introduces')::int) as i, max((role = 'uses')::int) as u, max((role = 'compares')::int) as k, max((role = 'critiques')::int) as q from techniques group by 1, 2),
roles as (select technique, sum(i)::bigint as introduces, sum(u)::bigint as uses, sum(k)::bigint as compares, sum(q)::bigint as critiques, count(*) as papers, count_if(u = 1 and i = 0) as cross_adoption from each_ group by 1),
ratio as (select *, round(cross_adoption / greatest(introduces, 1), 3) as adoption_ratio from roles)"""


@query(f"with {ROLES_SQL} select * from ratio")
def agg_role_aggregation(c):
    return A.role_aggregation(c.techniques)


IDF_SQL = "idf as (select canonical_name, count(distinct paper_id) as df, ln((select count(*) from papers) / count(distinct paper_id)) as idf from techniques where canonical_name is not null group by 1)"
TIER_SQL = "case when idf < 3.0 then 'GENERIC' when idf < 3.69 then 'SHARED' else 'SPECIALIZED' end"


@query(f"with {IDF_SQL} select canonical_name, df, round(idf, 6) as idf, {TIER_SQL} as tier from idf")
def agg_idf(c):
    return A.idf(c.techniques, c.papers).withColumn("idf", F.round("idf", 6))


@query("select case when weight < 1 then '0-1' when weight < 2 then '1-2' when weight < 4 then '2-4' when weight < 8 then '4-8' else '8+' end as bucket, count(*) as edges from edges group by 1")
def agg_weight_buckets(c):
    return A.weight_buckets(c.edges)


@query("select q, citation_count as value from (select citation_count, row_number() over (order by citation_count) - 1 as i, count(*) over () as n from papers) cross join (select unnest([0.5, 0.75, 0.9, 0.99])::double as q) where i = floor(q * (n - 1))")
def agg_citation_distribution(c):
    return A.floor_percentiles(c.papers, "citation_count", [0.5, 0.75, 0.9, 0.99])


@query("select case when citation_count < 1 then '0-1' when citation_count < 10 then '1-10' when citation_count < 50 then '10-50' when citation_count < 100 then '50-100' when citation_count < 500 then '100-500' when citation_count < 1000 then '500-1000' else '1000+' end as bucket, count(*) as papers, round(100.0 * count(*) / (select count(*) from papers), 2)::double as pct from papers group by 1")
def agg_citation_buckets(c):
    rows = c.papers.groupBy(A.buckets(F.col("citation_count"), [0, 1, 10, 50, 100, 500, 1000]).alias("bucket")).agg(F.count("*").alias("papers"))
    return rows.crossJoin(F.broadcast(c.papers.agg(F.count("*").alias("n")))).select("bucket", "papers", F.round(100.0 * F.col("papers") / F.col("n"), 2).alias("pct"))


@query("select presentation_type, quantile_cont(citation_count, 0.75) as p75 from papers group by 1")
def agg_percentile_linear(c):
    return c.papers.groupBy("presentation_type").agg(F.percentile("citation_count", F.lit(0.75)).alias("p75"))


@query("select paper_id, string_agg(canonical_name, ', ' order by canonical_name) as names from techniques where canonical_name is not null group by 1")
def agg_group_concat(c):
    return c.techniques.where("canonical_name is not null").groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list("canonical_name")), ", ").alias("names"))


@query("select canonical_name, count(*) as n_rows, count(distinct paper_id) as papers, string_agg(distinct name, '; ' order by name) as variants, count(distinct paper_id) = 1 as singleton, count(distinct name) > 3 as over_merged from techniques where canonical_name is not null group by 1")
def agg_entity_records(c):
    return A.entity_records(c.techniques).withColumn("variants", F.array_join("variants", "; "))


@query("select canonical_name, count(distinct paper_id) as papers, case when count(distinct paper_id) >= 5 then 'core' when count(distinct paper_id) >= 2 then 'shared' else 'singleton' end as tier, round(100 * count(distinct paper_id) / (select count(*) from papers), 2) as pct from techniques where canonical_name is not null group by 1")
def agg_signal_tiers(c):
    return A.signal_tiers(c.techniques, c.papers)


CONCEPT_SQL = f"{IDF_SQL}, concept as (select canonical_name, df, {TIER_SQL} as tier, case {TIER_SQL} when 'GENERIC' then 0.25 when 'SHARED' then 1.0 else 2.0 end::double as weight from idf)"


def _concepts(c):
    weight = F.when(F.col("tier") == "GENERIC", 0.25).when(F.col("tier") == "SHARED", 1.0).otherwise(2.0)
    return A.idf(c.techniques, c.papers).select("canonical_name", "df", "tier", weight.alias("weight"))


@query(f"with {CONCEPT_SQL} select *, df * weight as contribution from concept")
def agg_concept_selection(c):
    return _concepts(c).withColumn("contribution", F.col("df") * F.col("weight"))


@query(f"with {CONCEPT_SQL} select tier, round(100 * sum(df) / (select sum(df) from concept), 2) as before, round(100 * sum(df * weight) / (select sum(df * weight) from concept), 2) as after from concept group by 1")
def agg_effective_contrib(c):
    rows = _concepts(c).groupBy("tier").agg(F.sum("df").alias("a"), F.sum(F.col("df") * F.col("weight")).alias("b"))
    total = rows.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return rows.crossJoin(F.broadcast(total)).select("tier", F.round(100 * F.col("a") / F.col("ta"), 2).alias("before"), F.round(100 * F.col("b") / F.col("tb"), 2).alias("after"))


TABLES = ["conferences", "editions", "papers", "authors", "paper_authors", "techniques", "categories", "datasets", "methodologies", "metrics", "edges"]
#: Tables whose rows belong to a paper; the snapshot before has the papers of before 1998.
OF_PAPERS = ["paper_authors", "techniques", "categories", "datasets", "methodologies", "metrics"]


def _snapshot_sql(t):
    before = f"{t} where year < 1998" if t == "papers" else f"{t} where paper_id in (select id from papers where year < 1998)" if t in OF_PAPERS else t
    return f"select '{t}' as name, (select count(*) from {before}) as before, (select count(*) from {t}) as n_rows"


@query("select *, n_rows - before as delta from (" + " union all ".join(map(_snapshot_sql, TABLES)) + ")")
def agg_snapshot_counts(c):
    old = c.papers.where("year < 1998")
    now = {t: getattr(c, t) for t in TABLES}
    before = now | {t: now[t].join(old.select(F.col("id").alias("paper_id")), "paper_id", "left_semi") for t in OF_PAPERS} | {"papers": old}
    return A.snapshot_delta(A.snapshot(before), A.snapshot(now))


@query("select canonical_name, count(distinct name) as merged, string_agg(distinct name, '; ' order by name) as names from techniques where canonical_name is not null group by 1 having count(distinct name) > 1")
def agg_norm_report(c):
    rows = c.techniques.where("canonical_name is not null").groupBy("canonical_name").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return rows.where(F.size("names") > 1).select("canonical_name", F.size("names").cast("long").alias("merged"), F.array_join("names", "; ").alias("names"))


@query("select count(*) as total, count_if(pdf_url is not null) as attempted, count_if(pdf_path is not null) as matched, count_if(pdf_url is not null and pdf_path is null) as failed, round(100.0 * count_if(pdf_path is not null) / count_if(pdf_url is not null), 2)::double as match_rate from papers")
def agg_enrich_report(c):
    has, got = F.col("pdf_url").isNotNull(), F.col("pdf_path").isNotNull()
    return c.papers.agg(F.count("*").alias("total"), F.count_if(has).alias("attempted"), F.count_if(got).alias("matched"), F.count_if(has & ~got).alias("failed"), F.round(100.0 * F.count_if(got) / F.nullif(F.count_if(has), F.lit(0)), 2).alias("match_rate"))


@query("select source, count(*) as documents, round(avg(case when n_chars > 1000 then n_chars end), 2) as avg_chars_of_long, count_if(n_chars > 1000) as long from documents group by 1")
def agg_pdf_report(c):
    long = F.col("n_chars") > 1000
    return c.table("documents").groupBy("source").agg(F.count("*").alias("documents"), F.round(F.avg(F.when(long, F.col("n_chars"))), 2).alias("avg_chars_of_long"), F.count_if(long).alias("long"))


@query(f"with {IDF_SQL} select {TIER_SQL} as tier, count(*) as n from idf group by 1")
def agg_coverage_summary(c):
    return A.idf(c.techniques, c.papers).groupBy("tier").agg(F.count("*").alias("n"))


@query("select name, sum(w)::bigint as score from (select name, 2 * count(*) as w from categories where confidence > 0.95 group by 1 union all select name, count(distinct paper_id) from categories group by 1) group by 1 order by score desc, name limit 8")
def agg_research_areas(c):
    strong = c.categories.where("confidence > 0.95").groupBy("name").agg((2 * F.count("*")).alias("w"))
    return strong.unionByName(c.categories.groupBy("name").agg(F.count_distinct("paper_id").alias("w"))).groupBy("name").agg(F.sum("w").alias("score")).orderBy(F.desc("score"), "name").limit(8)


RANKED_SQL = "ranked as (select name as feature, paper_id, row_number() over (partition by name order by confidence desc, paper_id) as rank from categories)"


@query(f"with {RANKED_SQL} select paper_id, count(distinct feature) as hits, round(sum(1.0 / rank), 6)::double as score from ranked where rank <= 50 group by 1 order by hits desc, score desc, paper_id limit 10")
def agg_cross_feature_papers(c):
    ranked = c.categories.withColumn("rank", F.expr("row_number() over (partition by name order by confidence desc, paper_id)")).where("rank <= 50")
    return ranked.groupBy("paper_id").agg(F.count_distinct("name").alias("hits"), F.round(F.sum(1.0 / F.col("rank")), 6).alias("score")).orderBy(F.desc("hits"), F.desc("score"), "paper_id").limit(10)


@query("select lower(trim(name)) as key, max(confidence) as confidence, arg_max(paper_id, (confidence, paper_id)) as paper_id from categories group by 1")
def agg_collect_recs(c):
    best = F.max_by("paper_id", F.struct("confidence", "paper_id"))
    return c.categories.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.max("confidence").alias("confidence"), best.alias("paper_id"))


@query("select kind, id from (select 'papers' as kind, id, row_number() over (order by created_at, id) as r from papers) where r <= 10 union all select kind, id from (select 'authors' as kind, id, row_number() over (order by id) as r from authors) where r <= 10")
def agg_inspect(c):
    a = c.papers.orderBy("created_at", "id").limit(10).select(F.lit("papers").alias("kind"), "id")
    return a.unionByName(c.authors.orderBy("id").limit(10).select(F.lit("authors").alias("kind"), "id"))


@query("select 'documents' as name, (select count(*) from documents) as source, (select count(*) from documents where regexp_matches(lower(text), '[a-z0-9]')) as indexed union all select 'labels', (select count(*) from labels), (select count(*) from labels where doc_id in (select doc_id from documents))")
def agg_index_counts(c):
    d, l = c.table("documents"), c.table("labels")
    a = d.agg(F.lit("documents").alias("name"), F.count("*").alias("source"), F.count_if(F.lower("text").rlike("[a-z0-9]")).alias("indexed"))
    known = l.join(d.select("doc_id"), "doc_id", "left_semi").agg(F.count("*").alias("indexed"))
    return a.unionByName(l.agg(F.lit("labels").alias("name"), F.count("*").alias("source")).crossJoin(known))


@query("select (select count(*) from papers) as n_papers, (select count(distinct title) from papers) as n_titles")
def agg_corpus_size(c):
    return c.papers.agg(F.count("*").alias("n_papers"), F.count_distinct("title").alias("n_titles"))


@query("select id, title from papers")
def dim_titles(c):
    return c.papers.select("id", "title")


@query("select r_name, n_name, grouping(r_name, n_name)::int as level, count(*) as customers, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def agg_rollup(c):
    n = c.table("customer").join(c.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(c.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.rollup("r_name", "n_name").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
