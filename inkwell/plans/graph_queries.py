"""Graphs over works, papers and techniques, and the corpus-intelligence reports on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import browse as B
from ..operators import graph as G
from ..operators import intel as I
from ..sources import scratch
from .aggregate_queries import IDF_SQL, ROLES_SQL, TIER_SQL
from .registry import query

ENTITY_SQL = """ents0 as (
  select paper_id, kind, lower(trim(coalesce(canonical_name, name))) as entity,
    arg_max(trim(coalesce(canonical_name, name)), ((canonical_name is not null)::int, trim(coalesce(canonical_name, name)))) as name, max((canonical_name is not null)::int) = 1 as is_canonical
  from work_entities group by 1, 2, 3),
ents as (select * from ents0 e where kind in ('technique', 'dataset') or not exists (select 1 from ents0 t where t.kind = 'technique' and t.paper_id = e.paper_id and t.entity = e.entity))"""
WEIGHT_SQL = f"""{ENTITY_SQL},
wts as (select *, case kind when 'technique' then case when known then 3.0 * case when i < 3.0 then 0.25 when i < 3.69 then 1.0 else 2.0 end else 6.0 end when 'dataset' then 2.0 else 1.0 end::double as w
  from (select kind, entity, count(*) as df, max(is_canonical::int) = 1 as known, ln((select count(*) from works) / count(*)) as i from ents group by 1, 2))"""
EDGE_SQL = f"""{WEIGHT_SQL},
shared as (select a.paper_id as src, b.paper_id as dst, a.kind, a.name, w from ents a join ents b on a.kind = b.kind and a.entity = b.entity and a.paper_id < b.paper_id join wts on wts.kind = a.kind and wts.entity = a.entity),
gedges as (select src, dst, round(sum(w), 4) as weight, round(coalesce(sum(w) filter (kind = 'technique'), 0), 4) as technique_score, round(coalesce(sum(w) filter (kind = 'dataset'), 0), 4) as dataset_score,
  round(coalesce(sum(w) filter (kind = 'category'), 0), 4) as category_score, count(*) as shared from shared group by 1, 2)"""


def _entities(c):
    return G.load_entities(c.work_entities)


def _count(c):
    """How many works there are, as one number: it is a constant of the plan."""
    return c.works.count()


def _edges(c):
    """Edges with the names that are shared."""
    return G.paper_edges(_entities(c), _count(c))


def _stored_rows(c):
    at = scratch.path(c.spark, "rows")
    G.weighted(_entities(c), _count(c)).write.parquet(at)
    return c.spark.read.parquet(at)


@query(f"with {ENTITY_SQL} select paper_id, kind, entity, name, is_canonical from ents")
def gr_entity_load(c):
    return _entities(c).select("paper_id", "kind", "entity", "name", "is_canonical")


@query(f"with {WEIGHT_SQL} select kind, entity, df, w from wts")
def gr_idf_weights(c):
    return G.entity_weights(_entities(c), _count(c))


LISTS = {"technique": "techniques", "dataset": "datasets", "category": "categories", "methodology": "methodologies"}
LISTS_SQL = "lists as (select src, dst, " + ", ".join(f"coalesce(string_agg(name, '; ' order by name) filter (kind = '{k}'), '') as {v}" for k, v in LISTS.items()) + " from shared group by 1, 2)"


def _listed():
    return (F.array_join(f"shared_{k}", "; ").alias(v) for k, v in LISTS.items())


@query(f"with {EDGE_SQL}, {LISTS_SQL} select gedges.*, techniques, datasets, categories, methodologies from gedges join lists using (src, dst)")
def gr_paper_edges(c):
    return _edges(c).select("src", "dst", *G.SCORES, "shared", *_listed())


@query(f"""with {EDGE_SQL}, {LISTS_SQL}
select src, dst, a.title as title_src, b.title as title_dst, weight, technique_score, dataset_score, category_score, techniques, datasets, categories, methodologies
from gedges join lists using (src, dst) left join works a on a.id = src left join works b on b.id = dst order by weight desc, src, dst limit 10""")
def gr_graph_report(c):
    """The ten heaviest pairs with their titles, scores and all names that they share; :func:`.report_queries.gr_version_report` compares versions."""
    rows = _stored_rows(c)
    top = G.named_edges(G.weights_of(rows).heaviest(), rows)
    titles = lambda end: F.broadcast(top.select(end)).join(c.works.select(F.col("id").alias(end), F.col("title").alias(f"title_{end}")), end).distinct()
    top = top.join(titles("src"), "src", "left").join(titles("dst"), "dst", "left")
    return top.select("src", "dst", "title_src", "title_dst", *G.SCORES, *_listed())


@query(f"with {EDGE_SQL} select (select count(*) from works) as papers, (select (count(*) * (count(*) - 1) // 2)::bigint from works) as pairs, count(*) as edges, max(weight) as max_weight, round(avg(weight), 4) as avg_weight, (select count(*) from works where id not in (select src from gedges union select dst from gedges)) as isolated from gedges")
def gr_build_stats(c):
    shared = G.weights_of(G.weighted(_entities(c), _count(c)))
    return G.counted_stats(c.works, shared.rows, shared.counts())


@query(f"with {ENTITY_SQL} select a.kind, a.entity as a, b.entity as b, count(*) as n from ents a join ents b on a.paper_id = b.paper_id and a.kind = b.kind and a.entity < b.entity group by 1, 2, 3")
def gr_cooccurrence(c):
    return G.cooccurrence(_entities(c))


SYM_SQL = "sym as (select src as node, dst as neighbour, weight from edges union all select dst, src, weight from edges)"


@query("select src as node, dst as neighbour, weight from edges union all select dst, src, weight from edges")
def gr_symmetrise(c):
    return G.symmetrise(c.edges)


@query(f"with {SYM_SQL}, d as (select node, count(*) as degree from sym group by 1) select id, coalesce(degree, 0) as degree, round(coalesce(degree, 0) / ((select count(*) from papers) - 1), 9) as degree_centrality from papers left join d on node = id")
def gr_degree_centrality(c):
    return G.degree_centrality(c.papers, c.edges).withColumn("degree_centrality", F.round("degree_centrality", 9))


@query(f"with {SYM_SQL}, d as (select node, count(*) as n, round(sum(weight), 6) as w from sym group by 1) select id, coalesce(n, 0) as neighbors_count, coalesce(w, 0) as total_edge_weight from papers left join d on node = id")
def gr_paper_metrics(c):
    return G.paper_metrics(c.papers, c.edges)


TECH_SQL = f"""{SYM_SQL}, named as (select distinct paper_id, canonical_name from techniques where canonical_name is not null),
reach as (select canonical_name, count(*) as connected_papers_count from (select canonical_name, paper_id from named union select canonical_name, neighbour from named join sym on node = paper_id) group by 1),
co as (select a.canonical_name, b.canonical_name as other, count(*) as n from named a join named b on a.paper_id = b.paper_id and a.canonical_name <> b.canonical_name group by 1, 2),
tops as (select canonical_name, string_agg(other || ':' || n, '; ' order by r) as top from (select *, row_number() over (partition by canonical_name order by n desc, other) as r from co) where r <= 5 group by 1),
tm as (select canonical_name, count(*) as usage_count from named group by 1)"""


def _technique_metrics(c):
    return G.technique_metrics(c.techniques, c.edges)


@query(f"with {TECH_SQL} select canonical_name, usage_count, connected_papers_count, top from tm join reach using (canonical_name) left join tops using (canonical_name)")
def gr_technique_metrics(c):
    top = F.array_join(F.transform("top_cooccurring", lambda x: F.concat(x["name"], F.lit(":"), x["count"].cast("string"))), "; ")
    return _technique_metrics(c).select("canonical_name", "usage_count", "connected_papers_count", top.alias("top"))


@query(f"""with {TECH_SQL}, roles as (select canonical_name, count_if(role = 'introduces') as introduces, count_if(role = 'uses') as uses from techniques where canonical_name is not null group by 1)
select canonical_name, usage_count, connected_papers_count, top, introduces, uses from tm join reach using (canonical_name) left join tops using (canonical_name) join roles using (canonical_name) where usage_count >= 3""")
def agg_technique_browser(c):
    top = F.array_join(F.transform("top_cooccurring", lambda x: F.concat(x["name"], F.lit(":"), x["count"].cast("string"))), "; ")
    return A.technique_browser(c.techniques, _technique_metrics(c), 3).withColumn("top", top).drop("top_cooccurring")


@query(f"with {SYM_SQL}, reach as (select distinct canonical_name, neighbour as paper_id from techniques join sym on node = paper_id where canonical_name is not null) select canonical_name, count(*) as neighbours from reach group by 1")
def join_technique_neighbors(c):
    named = c.techniques.where("canonical_name is not null").select("paper_id", "canonical_name").distinct()
    near = named.join(G.symmetrise(c.edges).select(F.col("node").alias("paper_id"), "neighbour"), "paper_id")
    return near.groupBy("canonical_name").agg(F.count_distinct("neighbour").alias("neighbours"))


NAMED_SQL = """nodes as (select p.id, title, short_name as conference, p.year, coalesce(p.citation_count, 0) as citation_count, cluster_id, coalesce(degree_centrality, 0) as degree_centrality, coalesce(betweenness_centrality, 0) as betweenness_centrality
  from papers p left join editions e on e.id = p.edition_id left join conferences c on c.id = e.conference_id left join metrics m on m.paper_id = p.id),
named as (select paper_id, 'technique' as kind, coalesce(canonical_name, name) as name from techniques union select paper_id, 'dataset', name from datasets
  union select paper_id, 'category', coalesce(canonical_name, name) from categories union select paper_id, 'methodology', name from methodologies)"""


def _nodes(c):
    """Papers as nodes of a drawing."""
    conf = c.conferences.select(F.col("id").alias("conference_id"), F.col("short_name").alias("conference"))
    venue = c.editions.select(F.col("id").alias("edition_id"), "conference_id").join(conf, "conference_id", "left").drop("conference_id")
    rows = c.papers.select("id", "title", "edition_id", "year", "citation_count").join(venue, "edition_id", "left")
    rows = rows.join(c.metrics.select(F.col("paper_id").alias("id"), "cluster_id", "degree_centrality", "betweenness_centrality"), "id", "left")
    zero = {x: F.coalesce(x, F.lit(0)) for x in ("citation_count", "degree_centrality", "betweenness_centrality")}
    return rows.withColumns(zero).drop("edition_id")


def _named(c):
    one = lambda df, kind, name: df.select("paper_id", F.lit(kind).alias("kind"), name.alias("name"))
    rows = one(c.techniques, "technique", A.effective_name(False)).unionByName(one(c.datasets, "dataset", F.col("name")))
    return rows.unionByName(one(c.categories, "category", A.effective_name(False))).unionByName(one(c.methodologies, "methodology", F.col("name")))


_SHARED_SQL = ", ".join(f"coalesce(string_agg(s.name, '; ' order by s.name) filter (s.kind = '{k}'), '') as shared_{k}" for k in G.BASE)


@query(f"""with {SYM_SQL}, {NAMED_SQL}, near as (select neighbour as id, weight from sym where node = 7 and weight >= 1.5 order by weight desc, neighbour limit 10),
s as (select t.paper_id, t.kind, t.name from named t join named m on m.paper_id = 7 and m.kind = t.kind and m.name = t.name where t.paper_id in (select id from near))
select nodes.*, near.weight, {_SHARED_SQL} from near join nodes using (id) left join s on s.paper_id = nodes.id group by all""")
def gr_related(c):
    rows = G.related(c.edges, _nodes(c), _named(c), 7, 1.5, 10)
    return rows.withColumns({f"shared_{k}": F.array_join(f"shared_{k}", "; ") for k in G.BASE})


def _view_sql(nodes, edges):
    cols = "id, title, conference, year, citation_count, cluster_id, degree_centrality, betweenness_centrality"
    return f"""n as ({nodes}), e as ({edges})
select 'node' as part, n.*, null::bigint as src, null::bigint as dst, null::double as weight, null::bigint as node_count, null::bigint as edge_count, null::double as min_weight, null::double as max_weight from n
union all by name select 'edge' as part, src, dst, weight from e
union all by name select 'meta' as part, (select count(*) from n) as node_count, count(*) as edge_count, coalesce(min(weight), 0) as min_weight, coalesce(max(weight), 0) as max_weight from e"""


@query(f"with {SYM_SQL}, {NAMED_SQL}, near as (select neighbour, weight from sym where node = 7 and weight >= 1.0 order by weight desc, neighbour limit 30), " + _view_sql(
    "select *, id = 7 as is_ego from nodes where id = 7 or id in (select neighbour from near)", "select least(7, neighbour) as src, greatest(7, neighbour) as dst, weight from near"))
def gr_ego(c):
    return G.ego(_nodes(c), c.edges, 7, 1.0, 30)


@query(f"with {NAMED_SQL}, " + _view_sql("select * from nodes where cluster_id = 3", "select src, dst, weight from edges where weight >= 1.5 and src in (select id from n) and dst in (select id from n)"))
def gr_full_graph(c):
    return G.full_graph(_nodes(c), c.edges, 1.5, 3)


NODES_SQL = "tn as (select canonical_name as name, usage_count, connected_papers_count, top from tm join reach using (canonical_name) left join tops using (canonical_name))"


def _tops(df):
    return df.withColumn("top", F.array_join(F.transform("top_cooccurring", lambda x: F.concat(x["name"], F.lit(":"), x["count"].cast("string"))), "; ")).drop("top_cooccurring")


def _technique_pairs(c):
    named = c.techniques.where("canonical_name is not null").select("paper_id", F.lit("technique").alias("kind"), F.col("canonical_name").alias("entity"))
    return G.cooccurrence(named)


@query(f"with {TECH_SQL}, {NODES_SQL}, " + _view_sql("select * from tn where usage_count >= 2", "select canonical_name as src, other as dst, n::double as weight from co where canonical_name < other and n >= 2 and canonical_name in (select name from n) and other in (select name from n)"))
def gr_technique_graph(c):
    co = _technique_pairs(c)
    return _tops(G.technique_graph(G.technique_metrics(c.techniques, c.edges, co), co, 2, 2))


@query(f"""with {TECH_SQL}, {NODES_SQL}, q as (select min(canonical_name) as asked from techniques union select upper(max(canonical_name)) from techniques union select 'no technique'),
f as (select asked, coalesce((select min(name) from tn where name = asked), (select min(name) from tn where lower(name) = lower(asked))) as technique from q),
u as (select technique, paper_id, row_number() over (partition by technique order by paper_id) as r from (select distinct technique, paper_id from f join techniques on canonical_name = technique or name = technique)),
ul as (select technique, string_agg(paper_id::varchar, ',' order by citation_count desc, paper_id) as papers from u join papers on id = paper_id where r <= 20 group by 1),
cl as (select canonical_name as technique, string_agg(other || ':' || n, '; ' order by r) as companions from (select *, row_number() over (partition by canonical_name order by n desc, other) as r from co) where r <= 20 group by 1)
select asked, technique, usage_count, connected_papers_count, papers, coalesce(companions, '') as companions from f join tn on name = technique join ul using (technique) left join cl using (technique)""")
def gr_technique_related(c):
    co = _technique_pairs(c)
    names = c.techniques.agg(F.min("canonical_name").alias("a"), F.upper(F.max("canonical_name")).alias("b"))
    asked = names.select(F.explode(F.array("a", "b", F.lit("no technique"))).alias("asked"))
    return G.technique_related(c.techniques, c.papers, G.technique_metrics(c.techniques, c.edges, co), co, asked)


@query(f"with {SYM_SQL}, r as (select node, o.cluster_id as own, count(*) as degree, count_if(o.cluster_id <> n.cluster_id) as cross_ from sym join metrics o on o.paper_id = node join metrics n on n.paper_id = neighbour group by 1, 2) select node, own, degree, cross_ as cross, round(cross_ / degree, 3) as ratio from r where round(cross_ / degree, 3) >= 0.0")
def gr_bridge_papers(c):
    return G.bridge_papers(c.edges, c.metrics, 0.0)


@query("with r as (select a.cluster_id, avg(weight) filter (a.cluster_id = b.cluster_id) as i, avg(weight) filter (a.cluster_id <> b.cluster_id) as o from edges join metrics a on a.paper_id = src join metrics b on b.paper_id = dst group by 1) select cluster_id, round(i, 4) as intra, round(o, 4) as inter, round(round(i, 4) / nullif(round(o, 4), 0), 3) as cohesion from r")
def gr_cohesion(c):
    return G.cohesion(c.edges, c.metrics)


@query("select cluster_id, paper_id, r::int as r from (select cluster_id, paper_id, row_number() over (partition by cluster_id order by betweenness_centrality desc, paper_id) as r from metrics) where r <= 5")
def gr_top_by_bc(c):
    return B.top_per_group(c.metrics, ["cluster_id"], [F.desc("betweenness_centrality"), F.col("paper_id")], 5, "r").select("cluster_id", "paper_id", "r")


@query("select (select count(*) from papers) as nodes, count(*) as edges, round(2.0 * count(*) / ((select count(*) from papers) * ((select count(*) from papers) - 1)), 9) as density from edges")
def gr_density(c):
    n, e = c.papers.agg(F.count("*").alias("nodes")), c.edges.agg(F.count("*").alias("edges"))
    return n.crossJoin(e).select("nodes", "edges", F.round(2.0 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 9).alias("density"))


INFLUENCE_SQL = """intro as (select distinct paper_id, trim(coalesce(canonical_name, name)) as t from techniques where role = 'introduces'),
uses as (select distinct paper_id, trim(coalesce(canonical_name, name)) as t from techniques where role = 'uses'),
infl as (select i.t as source, u.t as target, count(*) as weight from intro i join uses u on i.paper_id = u.paper_id and i.t <> u.t where not exists (select 1 from intro x where x.paper_id = u.paper_id and x.t = u.t) group by 1, 2)"""


@query(f"with {INFLUENCE_SQL} select * from infl")
def gr_influence_edges(c):
    return G.influence_edges(c.techniques)


@query(f"""with {ROLES_SQL}, {INFLUENCE_SQL}, o as (select source, count(*) as out_degree from infl group by 1), i as (select target, count(*) as in_degree from infl group by 1),
fu as (select t, count(*) as f from uses u where paper_id in (select paper_id from intro) and not exists (select 1 from intro x where x.paper_id = u.paper_id and x.t = u.t) group by 1),
n as (select technique, introduces as introduced_by, coalesce(out_degree, 0) as out_degree, coalesce(in_degree, 0) as in_degree, coalesce(f, 0) as foundation_use_count,
  coalesce(out_degree, 0) / greatest(introduces, 1) as exact from ratio left join o on source = technique left join i on target = technique left join fu on t = technique),
p as (select quantile_cont(exact, 0.75) filter (out_degree > 0 and introduced_by > 0) as po, quantile_cont(in_degree, 0.75) filter (in_degree > 0) as pi, greatest(max(in_degree), 1) as mi, greatest(max(out_degree), 1) as mo from n)
select technique, introduced_by, out_degree, in_degree, foundation_use_count, round(exact, 4) as normalized_out,
  case when in_degree > 0 and in_degree >= pi then 'Foundational' when introduced_by > 0 and out_degree > 0 and round(exact, 4) >= po then 'Cutting-edge' when introduced_by > 0 and out_degree = 0 then 'Isolated' when introduced_by = 0 and in_degree > 0 then 'Versatile' else 'Pure-user' end as class,
  round(in_degree / mi, 4) as foundation_score, round(out_degree / mo, 4) as derivative_score from n, p""")
def gr_influence_nodes(c):
    return I.influence_nodes(A.role_aggregation(c.techniques), G.influence_edges(c.techniques), c.techniques)


STAGE_SQL = "case when introduces > 0 and cross_adoption > 0 then 'Emerging' when introduces > 0 then 'Novel' when uses > 0 and ln((select count(*) from papers) / papers) < 3.0 then 'Foundational' when uses > 0 then 'Established' else 'Referenced' end"


def _stages(c):
    n = F.broadcast(c.papers.agg(F.count("*").alias("_n")))
    rows = A.role_aggregation(c.techniques).crossJoin(n)
    tier = A.idf_tier(F.log(F.col("_n") / F.col("papers")))
    return rows.withColumn("stage", G.stage(F.col("introduces"), F.col("uses"), F.col("cross_adoption"), tier)).drop("_n")


@query(f"with {ROLES_SQL} select technique, papers, {STAGE_SQL} as stage from ratio")
def gr_stage_classify(c):
    return _stages(c).select("technique", "papers", "stage")


@query(f"with {ROLES_SQL}, s as (select {STAGE_SQL} as stage from ratio), d as (select unnest(['Emerging', 'Novel', 'Established', 'Foundational', 'Referenced']) as stage) select d.stage, count(s.stage) as n, round(100.0 * count(s.stage) / (select count(*) from s), 2)::double as pct from d left join s using (stage) group by 1")
def agg_stage_distribution(c):
    return I.distribution(_stages(c), "stage", I.STAGES)


@query(f"with {ROLES_SQL}, s as (select technique, papers, {STAGE_SQL} as stage from ratio), r as (select *, row_number() over (partition by stage order by papers desc, technique)::int as rank from s) select stage, rank, technique, papers from r where rank <= 10")
def srt_stage_toplists(c):
    return B.top_per_group(_stages(c), ["stage"], [F.desc("papers"), F.col("technique")], 10).select("stage", "rank", "technique", "papers")


@query(f"with {ROLES_SQL}, s as (select technique, papers, {STAGE_SQL} as stage from ratio) select technique, papers, stage, row_number() over (order by case stage when 'Emerging' then 1 when 'Novel' then 2 when 'Established' then 3 when 'Foundational' then 4 else 5 end, papers desc, technique)::int as position from s order by position limit 200")
def srt_multi_key(c):
    top = I.by_stage(_stages(c)).limit(200)
    rank = "cast(row_number() over (order by case stage when 'Emerging' then 1 when 'Novel' then 2 when 'Established' then 3 when 'Foundational' then 4 else 5 end, papers desc, technique) as int)"
    return top.select("technique", "papers", "stage", F.expr(rank).alias("position"))


@query(f"with {ROLES_SQL} select technique, introduces, uses, introduces - uses as momentum, case when introduces > uses then 'Positive' when introduces < uses then 'Negative' else 'Neutral' end as label from ratio")
def gr_momentum(c):
    return I.momentum(A.role_aggregation(c.techniques)).select("technique", "introduces", "uses", "momentum", "label")


@query(f"with {ROLES_SQL}, m as (select technique, introduces - uses as momentum from ratio) select * from (select technique, momentum from m where momentum > 0 order by momentum desc, technique limit 10) union all select * from (select technique, momentum from m where momentum < 0 order by momentum, technique limit 10)")
def srt_momentum_extremes(c):
    m = I.momentum(A.role_aggregation(c.techniques)).select("technique", "momentum")
    return m.where("momentum > 0").orderBy(F.desc("momentum"), "technique").limit(10).unionByName(m.where("momentum < 0").orderBy("momentum", "technique").limit(10))


@query("""with s as (select name, count(distinct paper_id) as papers, avg(citation_count) as avg_citations, max(citation_count) as max_citations from categories join papers on id = paper_id group by 1),
u as (select name, 'papers' as metric, papers::double as v from s union all select name, 'avg_citations', round(avg_citations, 2) from s union all select name, 'max_citations', max_citations::double from s)
select metric, name, v as value, row_number() over (partition by metric order by v desc, name)::int as rank from u""")
def srt_category_rankings(c):
    stats = A.category_stats(c.categories, c.papers, c.metrics, c.techniques)
    long = stats.select("name", F.expr("stack(3, 'papers', cast(papers as double), 'avg_citations', avg_citations, 'max_citations', cast(max_citations as double)) as (metric, value)"))
    return long.withColumn("rank", F.expr("row_number() over (partition by metric order by value desc, name)"))


PROFILE_SQL = f"""{IDF_SQL}, prof as (select cluster_id, count(*) as papers, round(avg(citation_count), 2) as avg_citations, round(avg(degree_centrality), 4) as avg_degree, round(avg(betweenness_centrality), 5) as avg_betweenness from metrics join papers on id = paper_id group by 1),
tn as (select cluster_id, canonical_name as name, {TIER_SQL} = 'GENERIC' as generic, count(distinct paper_id) as n from metrics join techniques using (paper_id) join idf using (canonical_name) group by 1, 2, 3),
tr as (select *, row_number() over (partition by cluster_id, generic order by n desc, name) as r from tn),
te as (select cluster_id, coalesce(string_agg(name || ':' || n, '; ' order by r) filter (not generic and r <= 10), '') as techniques, coalesce(string_agg(name || ':' || n, '; ' order by r) filter (generic and r <= 5), '') as generic_techniques from tr group by 1),
co as (select a.cluster_id, coalesce(round(avg(weight) filter (a.cluster_id = b.cluster_id), 4), 0) as intra, coalesce(round(avg(weight) filter (a.cluster_id <> b.cluster_id), 4), 0) as inter from edges join metrics a on a.paper_id = src join metrics b on b.paper_id = dst group by 1),
ends as (select src as p, dst as q from edges union all select dst, src from edges),
br as (select cluster_id, count(*) as bridges from (select a.cluster_id, a.paper_id from ends join metrics a on a.paper_id = p join metrics b on b.paper_id = q group by a.cluster_id, a.paper_id, a.neighbors_count having count_if(a.cluster_id <> b.cluster_id) / greatest(a.neighbors_count, 1) >= 0.3) group by 1),
cats as (select cluster_id, string_agg(name || ':' || n, '; ' order by r) as categories from (select cluster_id, name, count(*) as n, row_number() over (partition by cluster_id order by count(*) desc, name) as r from metrics join categories using (paper_id) group by 1, 2) where r <= 8 group by 1),
profile as (select prof.*, categories, coalesce(techniques, '') as techniques, coalesce(generic_techniques, '') as generic_techniques, coalesce(intra, 0) as intra, coalesce(inter, 0) as inter, case when inter > 0 then round(intra / inter, 3) else 0 end as cohesion, coalesce(bridges, 0) as bridges
from prof left join cats using (cluster_id) left join te using (cluster_id) left join co using (cluster_id) left join br using (cluster_id))"""
CLUSTER_SQL = f"""{PROFILE_SQL}, sz as (select cluster_id, count(*) as size from metrics group by 1),
crs as (select p as paper_id, count_if(a.cluster_id <> b.cluster_id) as crossing from ends join metrics a on a.paper_id = p join metrics b on b.paper_id = q group by 1),
bridge_rows as (select cluster_id, m.paper_id, title, crossing, round(crossing / greatest(neighbors_count, 1), 4) as strength, betweenness_centrality as bc from metrics m join papers on id = m.paper_id join crs on crs.paper_id = m.paper_id),
report as (
  select cluster_id, 'overview' as part, unnest(range(1, 9))::int as rank, unnest(['Papers', 'Average citations', 'Average betweenness centrality', 'Average degree centrality', 'Average edge weight within', 'Average edge weight to others', 'Cohesion ratio', 'Bridge papers']) as name,
    unnest([papers::double, avg_citations, avg_betweenness, avg_degree, intra, inter, cohesion, bridges::double]) as a, null::double as b, null::double as c from profile
  union all select cluster_id, 'categories', r::int, name, n, round(100 * n / size, 0), null from (select cluster_id, name, count(*) as n, row_number() over (partition by cluster_id order by count(*) desc, name) as r from metrics join categories using (paper_id) group by 1, 2) join sz using (cluster_id) where r <= 8
  union all select cluster_id, case when generic then 'generic techniques' else 'techniques' end, r::int, name, n, null, null from tr where r <= case when generic then 5 else 8 end
  union all select cluster_id, 'central papers', r::int, title, betweenness_centrality, citation_count, null from (select *, row_number() over (partition by cluster_id order by betweenness_centrality desc, paper_id) as r from metrics join papers on id = paper_id) where r <= 5
  union all select cluster_id, 'bridges', r::int, title, crossing, strength, bc from (select *, row_number() over (partition by cluster_id order by strength desc, paper_id) as r from bridge_rows where strength >= 0.3) where r <= 5)"""


@query(f"with {PROFILE_SQL} select * from profile")
def gr_community_profile(c):
    return I.community_profile(c.metrics, c.papers, c.categories, c.techniques, c.edges)


@query(f"with {CLUSTER_SQL} select cluster_id, part, rank, name, a, b, c from report")
def gr_cluster_report(c):
    """All that a report says of each cluster, line by line."""
    return I.cluster_report(c.metrics, c.papers, c.categories, c.techniques, c.edges)


@query("""with n as (select cluster_id, name, count(*) as n, row_number() over (partition by cluster_id order by count(*) desc, name) as r from metrics join categories using (paper_id) group by 1, 2),
t as (select cluster_id, max(n) filter (r = 1) as n1, max(name) filter (r = 1) as c1, coalesce(max(n) filter (r = 2), 0) as n2, max(name) filter (r = 2) as c2, max(name) filter (r = 3) as c3 from n group by 1),
z as (select cluster_id, count(*) as n, avg(citation_count) as a from metrics join papers on id = paper_id group by 1)
select cluster_id, case when n < 5 then 'Satellite cluster: ' || coalesce(nullif(concat_ws(' and ', c1, c2), ''), 'Unknown') else
  case when n1 / n >= 0.8 then c1 || '-dominated' when (n1 + n2) / n >= 0.6 then concat_ws(' and ', c1, c2) when c3 is not null then c1 || ', ' || c2 || ', and ' || c3 else coalesce(c1, 'Mixed') end || ' research community' ||
  case when a >= 1.5 * (select avg(citation_count) from papers) then ' with high external impact' when a <= 0.35 * (select avg(citation_count) from papers) then ' with foundational theoretical focus (low citation count)' else '' end end as label from z left join t using (cluster_id)""")
def gr_identity(c):
    return I.identity(c.metrics, c.categories, c.papers)


@query(f"with {INFLUENCE_SQL}, top as (select source, sum(weight) as w from infl group by 1 order by w desc, source limit 10), r as (select source, target, weight, row_number() over (partition by source order by weight desc, target) as r from infl where source in (select source from top)) select source, string_agg(target || ' ×' || weight, '; ' order by r) as chain from r where r <= 6 group by 1")
def gr_evolution_chains(c):
    return I.evolution_chains(G.influence_edges(c.techniques), 10, 6)


EXPLAIN_SQL = """df as (select canonical_name as name, case when ln((select count(*) from papers) / count(distinct paper_id)) < 3.0 then 'GENERIC' when ln((select count(*) from papers) / count(distinct paper_id)) < 3.69 then 'SHARED' else 'SPECIALIZED' end as tier from techniques where canonical_name is not null group by 1),
rl as (select paper_id, canonical_name as name, case when bool_or(role = 'introduces') then 'introduces' else min(role) end as role from techniques where canonical_name is not null group by 1, 2),
tl as (select paper_id, list(name order by name) as ns, list(name order by name) filter (role = 'introduces') as intro, list(name order by name) filter (role <> 'introduces') as uses from rl group by 1),
ml as (select paper_id, list(distinct name order by name) as ms from methodologies group by 1), cl as (select paper_id, list(distinct name order by name) as cs from categories group by 1),
ow as (select id, title, abstract, coalesce(ns, []) as ns, coalesce(intro, []) as intro, coalesce(uses, []) as uses, coalesce(ms, []) as ms, coalesce(cs, []) as cs from papers left join tl on tl.paper_id = id left join ml on ml.paper_id = id left join cl on cl.paper_id = id),
one_end as materialized (select src, dst, name, role from edges join rl on paper_id = src),
sh as (select src, dst, string_agg(a.name || ':' || tier || ':' || a.role || ':' || b.role, '; ' order by case tier when 'SPECIALIZED' then 0 when 'SHARED' then 1 else 2 end, a.name) as shared, list(a.name order by a.name) as sn from one_end a join rl b on b.paper_id = a.dst and a.name = b.name join df on df.name = a.name group by 1, 2)"""


def _apart_sql(x, y):
    return (
        f"'**' || substr({x}.title, 1, 65) || case when length({x}.title) > 65 then '…' else '' end || '** — ' || case "
        f"when len(list_filter({x}.intro, lambda n: not list_contains({y}.ns, n))) > 0 then 'Introduces ' || array_to_string(list_filter({x}.intro, lambda n: not list_contains({y}.ns, n))[1:2], ', ') "
        f"when len(list_filter({x}.uses, lambda n: not list_contains({y}.ns, n))) > 0 then 'Applies ' || array_to_string(list_filter({x}.uses, lambda n: not list_contains({y}.ns, n))[1:2], ', ') "
        f"when len(list_filter({x}.ms, lambda n: not list_contains({y}.ms, n))) > 0 then 'Uses ' || array_to_string(list_filter({x}.ms, lambda n: not list_contains({y}.ms, n))[1:2], ', ') "
        f"else coalesce(nullif(trim(substr({x}.abstract, 1, 200)), ''), substr({x}.title, 1, 80)) end"
    )


@query(f"""with {EXPLAIN_SQL} select e.src, e.dst, e.weight, coalesce(shared, '') as shared, {_apart_sql('a', 'b')} as difference_src, {_apart_sql('b', 'a')} as difference_dst,
  case when len(list_filter(a.cs, lambda n: list_contains(b.cs, n))) > 0 then 'Both papers work in the intersection of ' || array_to_string(list_filter(a.cs, lambda n: list_contains(b.cs, n))[1:3], ' and ')
    when sn is not null then 'Both papers apply ' || array_to_string(sn[1:2], ' and ') else 'Both papers share overlapping research contributions' end || '.' as connection
from edges e join ow a on a.id = e.src join ow b on b.id = e.dst left join sh on sh.src = e.src and sh.dst = e.dst""")
def gr_explain(c):
    rows = I.explain_pairs(c.edges, c.papers, c.techniques, c.categories, c.methodologies)
    text = F.array_join(F.transform("shared", lambda x: F.concat_ws(":", x["name"], x["tier"], x["role_a"], x["role_b"])), "; ")
    return rows.select("src", "dst", "weight", text.alias("shared"), "difference_src", "difference_dst", "connection")


@query()
def gr_betweenness(c):
    return G.betweenness(c.papers, c.edges)


@query()
def gr_communities(c):
    return G.communities(c.papers, c.edges)


@query()
def gr_label_propagation(c):
    return G.label_propagation(c.papers, c.edges)
