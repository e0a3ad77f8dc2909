"""Queries over single papers and lists of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import browse as B
from .registry import query

BASE_SQL = """base as (
  select p.*, e.conference_id, e.year as edition_year, c.short_name as conference, c.field, m.degree_centrality, m.betweenness_centrality, m.cluster_id, m.neighbors_count
  from papers p left join editions e on p.edition_id = e.id left join conferences c on e.conference_id = c.id left join metrics m on m.paper_id = p.id)"""


def _base(c):
    return B.base_papers(c.papers, c.editions, c.conferences, c.metrics)


@query("select * from papers")
def src_table_scan(c):
    return c.papers


@query(f"with {BASE_SQL} select id, title, year, conference, field, cluster_id, citation_count from base")
def join_base_paper(c):
    return _base(c).select("id", "title", "year", "conference", "field", "cluster_id", "citation_count")


@query("select p.id, p.title, c.short_name as conference from papers p join editions e on p.edition_id = e.id join conferences c on e.conference_id = c.id")
def join_inner_conf(c):
    e, v = c.editions.select(F.col("id").alias("e"), "conference_id"), c.conferences.select(F.col("id").alias("c"), F.col("short_name").alias("conference"))
    return c.papers.join(e, F.col("edition_id") == F.col("e")).join(v, F.col("conference_id") == F.col("c")).select("id", "title", "conference")


@query("select paper_id, position, author_id, full_name from paper_authors join authors on author_id = id")
def join_authors(c):
    return c.paper_authors.join(c.authors, F.col("author_id") == F.col("id")).select("paper_id", "position", "author_id", "full_name")


@query("select id, title from papers where id in (select paper_id from techniques where role = 'introduces')")
def join_semi_in(c):
    ids = c.techniques.where("role = 'introduces'").select(F.col("paper_id").alias("id"))
    return c.papers.join(ids, "id", "left_semi").select("id", "title")


@query("select id, title from papers p where not exists (select 1 from techniques t where t.paper_id = p.id and role = 'introduces')")
def join_anti_exists(c):
    ids = c.techniques.where("role = 'introduces'").select(F.col("paper_id").alias("id"))
    return c.papers.join(ids, "id", "left_anti").select("id", "title")


@query(f"with {BASE_SQL} select id, title, conference, citation_count from base where contains(lower(title), '1') and lower(conference) = 'nation_3' and cluster_id = 3 and citation_count >= 10 and presentation_type = 'oral' and edition_year = 1993 and id in (select paper_id from techniques where contains(lower(coalesce(canonical_name, name)), 'e')) order by citation_count desc nulls last, id limit 20")
def flt_list_papers_v1(c):
    rows = B.filter_papers(_base(c), title="1", conference="Nation_3", cluster=3, min_citations=10, presentation_type="oral", year=1993, technique="E", techniques=c.techniques)
    return B.sort_papers(rows).limit(20).select("id", "title", "conference", "citation_count")


@query(f"with {BASE_SQL} select id, title, citation_count from base where citation_count <= 100 and pdf_path is null and id in (select paper_id from methodologies)")
def flt_list_papers_legacy(c):
    return B.filter_papers(_base(c), max_citations=100, has_pdf=False, analysed=c.methodologies).select("id", "title", "citation_count")


@query(f"with {BASE_SQL} select id, title, field from base where lower(field) = 'asia' and citation_count >= 200")
def flt_search_papers(c):
    return B.filter_papers(_base(c), field="ASIA", min_citations=200).select("id", "title", "field")


@query("select id, title, year from papers where id = 7")
def flt_get_by_id(c):
    return c.papers.where("id = 7").limit(1).select("id", "title", "year")


@query("select id, title from papers where contains(lower(abstract), 'urgent')")
def flt_substring_ci(c):
    return c.papers.where(B.contains_ci("abstract", "URGENT")).select("id", "title")


@query("select id, short_name from conferences where lower(field) = 'europe'")
def flt_eq_ci(c):
    return c.conferences.where(B.equals_ci("field", "Europe")).select("id", "short_name")


@query("select id, short_name from conferences where lower(short_name) in ('nation_1', 'nation_2')")
def flt_in_list_ci(c):
    return c.conferences.where(B.in_list_ci("short_name", ["Nation_1", "NATION_2"])).select("id", "short_name")


@query("select doc_id, source, regexp_matches(lower(text), 'submitted|withdrawn|rejected') = false and trim(text) <> '' as accepted from documents")
def flt_accepted_venue(c):
    return c.table("documents").select("doc_id", "source", B.accepted(F.col("text")).alias("accepted"))


@query("select event_id, case when contains(lower(props), 'oral') then 'oral' when contains(lower(props), 'spotlight') then 'spotlight' when contains(lower(props), 'poster') then 'poster' when contains(lower(props), 'workshop') then 'workshop' else 'other' end as kind from events")
def prj_presentation_type(c):
    return c.table("events").select("event_id", B.presentation_type(F.col("props")).alias("kind"))


TOP_SQL = """named as (select distinct paper_id, coalesce(canonical_name, name) as technique from techniques),
used as (select technique, count(*) as n from named group by 1),
best as (select paper_id, list(technique order by n desc, technique)[1:3] as top_techniques from named join used using (technique) group by 1),
prim as (select paper_id, arg_max(coalesce(canonical_name, name), (confidence, coalesce(canonical_name, name))) as primary_category from categories group by 1)"""


@query(f"""with {BASE_SQL}, {TOP_SQL} select id, title, coalesce(edition_year, year) as year, conference, presentation_type, coalesce(citation_count, 0) as citation_count,
  coalesce(is_open_access, false) as is_open_access, pdf_path is not null as has_pdf, nullif(substr(abstract, 1, 300), '') as abstract_snippet, cluster_id, round(degree_centrality, 6) as degree_centrality,
  array_to_string(coalesce(top_techniques, []), '; ') as top_techniques, primary_category from base left join best on best.paper_id = id left join prim on prim.paper_id = id""")
def prj_paper_summary(c):
    return B.paper_summary(_base(c), c.techniques, c.categories).withColumn("top_techniques", F.array_join("top_techniques", "; "))


@query(f"with {BASE_SQL} select id, title, abstract, year, publication_date::varchar as publication_date, presentation_type, citation_count, influential_citation_count, is_open_access, pdf_path, pdf_url, conference, field, edition_year, degree_centrality, betweenness_centrality, cluster_id, neighbors_count from base")
def prj_dict_hydrate(c):
    return _base(c).select("id", "title", "abstract", "year", F.col("publication_date").cast("string"), "presentation_type", "citation_count", "influential_citation_count", "is_open_access", "pdf_path", "pdf_url", "conference", "field", "edition_year", "degree_centrality", "betweenness_centrality", "cluster_id", "neighbors_count")


@query("select id, citation_count from papers where coalesce(pdf_url, '') <> '' and id not in (select paper_id from techniques where role = 'introduces') and id not in (select paper_id from categories where confidence > 0.99) and id not in (select paper_id from metrics where cluster_id = 1) order by citation_count desc nulls last, id limit 30")
def flt_unprocessed_top(c):
    done = [c.techniques.where("role = 'introduces'"), c.categories.where("confidence > 0.99"), c.metrics.where("cluster_id = 1")]
    return B.unprocessed_top(c.papers, done).select("id", "citation_count")


@query("select id, title from papers where id not in (select paper_id from categories where confidence > 0.95)")
def flt_not_in(c):
    return B.not_in(c.papers, "id", c.categories.where("confidence > 0.95"), "paper_id").select("id", "title")


@query("select p.id, p.year, e.year as edition_year from papers p join editions e on p.edition_id = e.id where abs(p.year - e.year) <= 1")
def flt_year_window(c):
    e = c.editions.select(F.col("id").alias("e"), F.col("year").alias("edition_year"))
    return c.papers.join(e, F.col("edition_id") == F.col("e")).where(B.year_window("year", "edition_year")).select("id", "year", "edition_year")


@query("select paper_id, role, string_agg(name, '; ' order by name) as names from techniques group by 1, 2")
def prj_role_group(c):
    return c.techniques.groupBy("paper_id", "role").agg(F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("names"))


@query("select id, citation_count from papers where pdf_path is null order by citation_count desc nulls last, id limit 50")
def flt_select_top_pending(c):
    return B.select_top_pending(c.papers, 50).select("id", "citation_count")


@query("select case when src = 5 then dst else src end as neighbour, weight from edges where src = 5 or dst = 5")
def join_edge_bidirectional(c):
    return B.neighbours(c.edges, 5)


@query("select cluster_a, cluster_b, count(*) as edges, round(avg(weight), 4) as avg_weight from (select a.cluster_id as cluster_a, b.cluster_id as cluster_b, weight from edges join metrics a on a.paper_id = src join metrics b on b.paper_id = dst where a.cluster_id = b.cluster_id or a.cluster_id <> b.cluster_id) group by 1, 2")
def join_edge_cluster(c):
    a, b = (c.metrics.select(F.col("paper_id").alias(f"p{x}"), F.col("cluster_id").alias(f"cluster_{x}")) for x in "ab")
    rows = c.edges.join(a, F.col("src") == F.col("pa")).join(b, F.col("dst") == F.col("pb"))
    return rows.groupBy("cluster_a", "cluster_b").agg(F.count("*").alias("edges"), F.round(F.avg("weight"), 4).alias("avg_weight"))


@query(f"with {BASE_SQL} select p.id, p.citation_count, p.total from (select id, citation_count, count(*) over () as total, row_number() over (order by citation_count desc nulls last, id) as r from base where presentation_type = 'poster') p where r between 21 and 40")
def srt_page(c):
    rows = B.filter_papers(_base(c), presentation_type="poster")
    return B.page_with_total(rows, "citations_desc", 2, 20).select("id", "citation_count", "total")


@query(f"with {BASE_SQL}, s as (select *, 'citations_desc' as sort, row_number() over (order by citation_count desc nulls last, id) as r from base union all select *, 'citations_asc', row_number() over (order by citation_count asc nulls last, id) from base union all select *, 'year_desc', row_number() over (order by year desc nulls last, id) from base union all select *, 'year_asc', row_number() over (order by year asc nulls last, id) from base union all select *, 'title_asc', row_number() over (order by title asc nulls last, id) from base union all select *, 'centrality_desc', row_number() over (order by degree_centrality desc nulls last, id) from base) select sort, id from s where r <= 10")
def srt_sort_map(c):
    out = None
    for name in B.SORTS:
        part = B.first_papers(c.papers, c.editions, c.conferences, c.metrics, name, 10).select(F.lit(name).alias("sort"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("select id, title, citation_count, row_number() over (order by citation_count desc nulls last, id)::int as rank from papers order by rank limit 25")
def srt_top_cited(c):
    top = c.papers.orderBy(F.desc_nulls_last("citation_count"), "id").limit(25)
    return top.select("id", "title", "citation_count").withColumn("rank", F.expr("cast(row_number() over (order by citation_count desc nulls last, id) as int)"))


@query("with t as (select *, round(0.7 * degree_centrality + 0.3 * betweenness_centrality, 6) as importance from metrics), top as (select paper_id from t order by importance desc, paper_id limit 500) select src, dst, weight from edges where src in (from top) and dst in (from top)")
def srt_importance(c):
    return B.importance(c.metrics, c.edges, 500)[1].select("src", "dst", "weight")


@query("""select p.id, (select string_agg(position || ':' || full_name, '; ' order by position, author_id) from paper_authors join authors a on author_id = a.id where paper_id = p.id) as authors,
  (select string_agg(role || ':' || name, '; ' order by role, name) from techniques where paper_id = p.id) as techniques,
  (select string_agg(name, '; ' order by name) from datasets where paper_id = p.id) as datasets,
  (select string_agg(name, '; ' order by confidence desc, name) from categories where paper_id = p.id) as categories,
  (select string_agg(name, '; ' order by name) from methodologies where paper_id = p.id) as methodologies from papers p""")
def join_paper_detail(c):
    rows = B.paper_detail(c.papers, c.authors, c.paper_authors, c.techniques, c.datasets, c.categories, c.methodologies)
    text = lambda col, expr: F.expr(f"array_join(transform({col}, x -> {expr}), '; ')").alias(col)
    return rows.select("id", text("authors", "concat(x.position, ':', x.full_name)"), text("techniques", "concat(x.role, ':', x.name)"), text("datasets", "x"), text("categories", "x.name"), text("methodologies", "x"))


#: Analyses of every third paper; some of their lists are no JSON.
ANALYSIS_SQL = """analyses as (select id as paper_id, 'm' || id % 4 as model, 'On ' || title as summary, case when id % 2 = 0 then 'By hand' end as methodology,
  case when id % 9 = 0 then [] else ['clear', 'seen in ' || year] end as strengths, case when id % 5 = 0 then 'B' || id % 7 || ' m 1' end as findings from papers where id % 3 = 0)"""


def _analyses(c):
    p = c.papers.where("id % 3 = 0")
    strengths = F.when(F.col("id") % 9 == 0, F.lit("not a list")).otherwise(F.to_json(F.array(F.lit("clear"), F.lit(" "), F.concat(F.lit("seen in "), "year"))))
    found = F.struct(F.concat(F.lit("B"), F.col("id") % 7).alias("benchmark"), F.lit("m").alias("metric"), F.lit("1").alias("scores"))
    none = F.struct(F.lit("").alias("benchmark"), F.lit("m").alias("metric"), F.lit("0").alias("scores"))
    findings = F.when(F.col("id") % 5 == 0, F.to_json(F.array(none, found)))
    lists = {x: F.lit(None).cast("string").alias(x) for x in B.ANALYSIS_LISTS} | {"strengths": strengths.alias("strengths")}
    rows = p.select(F.col("id").alias("paper_id"), F.concat(F.lit("m"), F.col("id") % 4).alias("model"), F.concat(F.lit("On "), "title").alias("summary"), F.when(F.col("id") % 2 == 0, "By hand").alias("methodology"), findings.alias("experimental_findings"), *lists.values())
    return rows.unionByName(rows.where("paper_id % 6 = 0").withColumn("model", F.lit("")).withColumn("summary", F.lit("An earlier one")))


@query(f"""with {BASE_SQL}, {ANALYSIS_SQL} select p.id, p.title, p.abstract, p.year, p.conference, p.edition_year, p.presentation_type, p.citation_count, p.influential_citation_count, p.is_open_access, p.pdf_url,
  (select string_agg(position || ':' || full_name, '; ' order by position, author_id) from paper_authors join authors a on author_id = a.id where paper_id = p.id) as authors,
  (select string_agg(role || ':' || name || coalesce('=' || canonical_name, ''), '; ' order by role, name) from techniques where paper_id = p.id) as techniques,
  (select string_agg(name, '; ' order by name) from datasets where paper_id = p.id) as datasets,
  (select string_agg(name || ' ' || round(confidence * 100)::int, '; ' order by confidence desc, name) from categories where paper_id = p.id) as categories,
  (select string_agg(name, '; ' order by name) from methodologies where paper_id = p.id) as methodologies,
  n.summary, n.methodology, n.model, array_to_string(n.strengths, '; ') as strengths, case when n.model is not null then coalesce(n.findings, '') end as findings,
  p.degree_centrality, p.betweenness_centrality, p.cluster_id, p.neighbors_count from base p left join analyses n on n.paper_id = p.id""")
def join_paper_full(c):
    """The whole page of each paper: where it appeared, its lists, its analysis and its place in the graph."""
    rows = B.paper_detail(_base(c), c.authors, c.paper_authors, c.techniques, c.datasets, c.categories, c.methodologies)
    rows = B.with_analysis(rows, _analyses(c))
    text = lambda col, expr, name=None: F.expr(f"array_join(transform({col}, x -> {expr}), '; ')").alias(name or col)
    return rows.select(
        "id", "title", "abstract", "year", "conference", "edition_year", "presentation_type", "citation_count", "influential_citation_count", "is_open_access", "pdf_url",
        text("authors", "concat(x.position, ':', x.full_name)"), text("techniques", "concat(x.role, ':', x.name, coalesce(concat('=', x.canonical_name), ''))"), text("datasets", "x"),
        text("categories", "concat(x.name, ' ', cast(round(x.confidence * 100) as int))"), text("methodologies", "x"), "analysis.summary", "analysis.methodology", "analysis.model",
        text("analysis.strengths", "x", "strengths"), text("analysis.experimental_findings", "concat_ws(' ', x.benchmark, x.metric, x.scores)", "findings"),
        "degree_centrality", "betweenness_centrality", "cluster_id", "neighbors_count",
    )


@query(f"with {TOP_SQL} select paper_id, array_to_string(top_techniques, '; ') as top_techniques from best")
def agg_grouped_topk_list(c):
    return B.top_techniques(c.techniques).withColumn("top_techniques", F.array_join("top_techniques", "; "))


@query(f"with {TOP_SQL} select * from prim")
def agg_first_by_max(c):
    return B.primary_category(c.categories)


@query("select paper_id, name, rank from (select paper_id, name, row_number() over (partition by paper_id order by confidence desc, name)::int as rank from categories) where rank <= 2")
def win_topn_per_group(c):
    return B.top_per_group(c.categories, ["paper_id"], [F.desc("confidence"), F.col("name")], 2).select("paper_id", "name", "rank")


@query("select edition_id, id, row_number() over (partition by edition_id order by citation_count desc nulls last, id)::int as rank from papers")
def win_rank_list(c):
    return c.papers.select("edition_id", "id", F.expr("row_number() over (partition by edition_id order by citation_count desc nulls last, id)").alias("rank"))


@query("select paper_id as id, coalesce(canonical_name, name) as entity, 'technique' as kind from techniques union all select paper_id, coalesce(canonical_name, name), 'category' from categories")
def set_union_all(c):
    one = lambda df, kind: df.select(F.col("paper_id").alias("id"), F.coalesce("canonical_name", "name").alias("entity"), F.lit(kind).alias("kind"))
    return one(c.techniques, "technique").unionByName(one(c.categories, "category"))


@query("select paper_id from techniques where role = 'compares' union select paper_id from categories where confidence > 0.97")
def set_union_distinct(c):
    return c.techniques.where("role = 'compares'").select("paper_id").union(c.categories.where("confidence > 0.97").select("paper_id")).distinct()


@query("with s as (select paper_id, list(distinct name) as names from methodologies group by 1) select src, dst, array_to_string(list_sort(list_intersect(a.names, b.names)), '; ') as shared from edges join s a on a.paper_id = src join s b on b.paper_id = dst")
def set_intersect_lists(c):
    s = c.methodologies.groupBy("paper_id").agg(F.collect_set("name").alias("names"))
    a, b = s.toDF("pa", "na"), s.toDF("pb", "nb")
    rows = c.edges.join(a, F.col("src") == F.col("pa")).join(b, F.col("dst") == F.col("pb"))
    return rows.select("src", "dst", F.array_join(F.array_sort(F.array_intersect("na", "nb")), "; ").alias("shared"))


@query("select distinct lower(coalesce(canonical_name, name)) as entity from categories where lower(coalesce(canonical_name, name)) not in (select lower(name) from methodologies)")
def set_difference(c):
    a = c.categories.select(F.lower(F.coalesce("canonical_name", "name")).alias("entity")).distinct()
    return a.join(c.methodologies.select(F.lower("name").alias("entity")), "entity", "left_anti")


@query("with w as (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as ws from documents), u as (select doc_id, unnest(ws) as t, generate_subscripts(ws, 1) as i from w), f as (select doc_id, t, min(i) as i from u group by 1, 2) select doc_id, string_agg(t, ' ' order by i) as terms from f group by 1")
def set_dedupe_ordered(c):
    terms = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return c.table("documents").select("doc_id", F.array_join(terms, " ").alias("terms")).where("terms <> ''")


@query("select coalesce(a.paper_id, b.paper_id) as paper_id, coalesce(a.n, 0) as techniques, coalesce(b.n, 0) as datasets from (select paper_id, count(*) as n from techniques where role = 'introduces' group by 1) a full join (select paper_id, count(*) as n from datasets group by 1) b on a.paper_id = b.paper_id")
def set_union_candidates(c):
    a = c.techniques.where("role = 'introduces'").groupBy("paper_id").agg(F.count("*").alias("a"))
    b = c.datasets.groupBy("paper_id").agg(F.count("*").alias("b"))
    return a.join(b, "paper_id", "full_outer").select("paper_id", F.coalesce("a", F.lit(0)).alias("techniques"), F.coalesce("b", F.lit(0)).alias("datasets"))


@query("select id, score from (select id, score, row_number() over (partition by id order by part) as r from (select id, citation_count as score, 1 as part from papers where year = 1995 union all select id, citation_count, 2 from papers where presentation_type = 'oral')) where r = 1 order by score desc, id limit 5")
def set_merge_results(c):
    first = c.papers.where("year = 1995").select("id", F.col("citation_count").alias("score"), F.lit(1).alias("part"))
    both = first.unionByName(c.papers.where("presentation_type = 'oral'").select("id", F.col("citation_count").alias("score"), F.lit(2).alias("part")))
    return B.top_per_group(both, ["id"], [F.col("part")], 1).select("id", "score").orderBy(F.desc("score"), "id").limit(5)


@query("select paper_id, max(coalesce(canonical_name, name)) as any_name, count(*) as n from techniques group by 1 order by n desc, paper_id limit 5")
def agg_richest_samples(c):
    return c.techniques.groupBy("paper_id").agg(F.max(F.coalesce("canonical_name", "name")).alias("any_name"), F.count("*").alias("n")).orderBy(F.desc("n"), "paper_id").limit(5)


@query("select id, title, upper(short_name) || ' ' || coalesce(e.year::varchar, '') as venue from papers p left join (select editions.id as eid, year, short_name from editions join conferences c on conference_id = c.id) e on e.eid = p.edition_id")
def txt_venue_label(c):
    e = c.editions.join(c.conferences.select(F.col("id").alias("c"), "short_name"), F.col("conference_id") == F.col("c")).select(F.col("id").alias("e"), F.col("year").alias("y"), "short_name")
    rows = c.papers.join(e, F.col("edition_id") == F.col("e"), "left")
    return rows.select("id", "title", F.concat(F.upper(F.coalesce("short_name", F.lit("Unknown"))), F.lit(" "), F.coalesce(F.col("y").cast("string"), F.lit(""))).alias("venue"))
