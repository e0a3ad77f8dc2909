"""Full-text, vector and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fts as T
from ..operators import impact as I
from ..operators import retrieval as R
from ..operators import segments as S
from ..operators import vector_index as V
from ..sources import scratch
from ..streaming import streams as ST
from .registry import query
from .stem_sql import stems_sql

#: The benchmark's texts are the searches: their first three words.
QUERIES_SQL = "qs as (select item_id as query_id, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')[1:3], ' ') as text from benchmark where text is not null)"
WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
PLAIN_SQL = f"""occ as (select id, 'title' as field, unnest({WORDS.format('title')}) as term from texts union all select id, 'abstract', unnest({WORDS.format('abstract')}) from texts)"""
#: Postings of stems, and the stems that are asked for.
POST_SQL = f"""{QUERIES_SQL},
{PLAIN_SQL}, said as (select distinct query_id, unnest({WORDS.format('text')}) as term from qs), known as (select term from occ union select term from said),
{stems_sql('known')},
post as (select id, field, stem as term, count(*) as tf from occ join stems using (term) group by all),
asked as (select distinct query_id, stem as term from said join stems using (term))"""


def _bm25_sql(asked, name, weighted=True):
    """CTEs that end in ``name`` (query_id, id, score): documents with all terms of ``asked``, 200 a query."""
    tf = "case field when 'title' then 10.0 else 5.0 end"
    return f"""{name}_nt as (select query_id, count(*) as n_terms from {asked} group by 1),
{name}_hit as (select query_id, id, term, sum(tf * {tf})::double as tf, sum(tf)::double as plain from post join {asked} using (term) group by all),
{name}_part as (select query_id, id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) as idf, tf, plain, 1.2 * (0.25 + 0.75 * dl / avgdl) as k from {name}_hit join dfs using (term) join dls using (id) cross join tot),
{name}_sum as (select query_id, id, sum(idf * tf * 2.2 / (tf + k)) as score, sum(idf * plain * 2.2 / (plain + k)) as cut from {name}_part join {name}_nt using (query_id) group by query_id, id, n_terms having count(*) = n_terms),
{name} as (select query_id, id, score from (select *, row_number() over (partition by query_id order by round(cut, 9) desc, id) as r from {name}_sum) where r <= 200)"""


STATS_SQL = f"""dfs as (select term, count(distinct id) as df from post group by 1),
dls as (select id, coalesce(len({WORDS.format('title')}), 0) + coalesce(len({WORDS.format('abstract')}), 0) + len({WORDS.format('id::varchar')}) as dl from texts), tot as (select count(*) as n, avg(dl) as avgdl from dls)"""
BM25_SQL = f"{POST_SQL},\n{STATS_SQL},\n{_bm25_sql('asked', 'bm')}"


def _queries(c):
    words = T.words(F.col("text"))
    return c.table("benchmark").where("text is not null").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(words, 1, 3), " ").alias("text"))


def _asked(c):
    return _queries(c).select("query_id", F.explode(T.words(F.col("text"))).alias("term"))


def _post(c):
    return T.postings(c.texts, ["title", "abstract"])


_STORED: dict[tuple, str] = {}


def _version(c, table):
    """What tells a table's versions apart: the paths, times and lengths of all its files."""
    at = c.spark._jvm.org.apache.hadoop.fs.Path(f"{c.sf_dir}/{table}.parquet")
    files = at.getFileSystem(c.spark._jsc.hadoopConfiguration()).listFiles(at, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getModificationTime(), f.getLen()))
    return c.spark.sparkContext.applicationId, table, tuple(sorted(found))


def _index(c, again=False):
    """The stemmed index of the text papers; written once for each version of the table, then read by every search."""
    key = _version(c, "documents")
    if again or key not in _STORED:
        path = scratch.path(c.spark, "index")
        T.write_index(c.texts, ["title", "abstract"], path)
        _STORED[key] = path
    return T.read_index(c.spark, _STORED[key])


@query(f"with {PLAIN_SQL} select id, field, term, count(*) as tf from occ group by all")
def fts_build_index(c):
    return _post(c)


@query(f"with {POST_SQL} select * from post")
def fts_build_index_stemmed(c):
    """Writes the index that the searches read."""
    return _index(c, again=True).post.select("id", "field", "term", "tf")


@query(f"with {BM25_SQL} select query_id, id, round(score, 6) as score from bm")
def fts_match_papers(c):
    return T.bm25(_index(c), _asked(c)).withColumn("score", F.round("score", 6))


WHOLE_SQL = BM25_SQL.replace("[1:3]", "")
FIRST_SQL = BM25_SQL.replace("[1:3]", "[1:1]")


def _impact(c):
    """The blocks of the stemmed index."""
    index, key = _index(c), ("impact", *_version(c, "documents"))
    if key not in _STORED:
        _STORED[key] = scratch.path(c.spark, "impact")
        I.write_impact(index, _STORED[key])
    return I.ImpactIndex.read(c.spark, _STORED[key])


def _of_words(c, n):
    words = T.words(F.col("text"))
    rows = c.table("benchmark").where("text is not null")
    return rows.select(F.col("item_id").alias("query_id"), F.explode(F.slice(words, 1, n) if n else words).alias("term"))


@query(f"with {WHOLE_SQL} select query_id, id, round(score, 6) as score from bm")
def fts_match_whole_texts(c):
    """All words of each benchmark text as a search."""
    return I.best(_impact(c), _of_words(c, 0))[0].withColumn("score", F.round("score", 6))


@query(f"with {FIRST_SQL} select query_id, id, round(score, 6) as score from bm")
def fts_best_blocks(c):
    """Searches of one word each, some of them in most documents: only blocks that can hold one of the 200 best are read."""
    return I.best(_impact(c), _of_words(c, 1))[0].withColumn("score", F.round("score", 6))


@query()
def fts_blocks_read(c):
    """How many of a word's blocks were read for its 200 best."""
    return I.best(_impact(c), _of_words(c, 1))[1]


def _field_sql(field):
    return f"with {POST_SQL}, nt as (select query_id, count(*) as n_terms from asked group by 1) select query_id, id from post join asked using (term) join nt using (query_id) where field = '{field}' group by query_id, id, n_terms having count(*) = n_terms"


@query(_field_sql("title"))
def fts_match_title(c):
    return T.match_field(_index(c), _asked(c), "title")


@query(_field_sql("abstract"))
def fts_match_abstract(c):
    return T.match_field(_index(c), _asked(c), "abstract")


ENTITY_QUERIES = [(1, "economy"), (2, "steel"), (3, "brand"), (4, "small"), (5, "promo")]
ENTITY_SQL = "eq as (select * from (values (1, 'economy'), (2, 'steel'), (3, 'brand'), (4, 'small'), (5, 'promo')) v(query_id, text)), ents as (select paper_id, 'technique' as kind, coalesce(canonical_name, name) as name from techniques union select paper_id, 'category', coalesce(canonical_name, name) from categories)"


def _entities(c):
    one = lambda df, kind: df.select("paper_id", F.lit(kind).alias("kind"), F.coalesce("canonical_name", "name").alias("name")).distinct()
    return one(c.techniques, "technique").unionByName(one(c.categories, "category"))


def _entity_queries(c):
    return c.spark.createDataFrame(ENTITY_QUERIES, "query_id int, text string")


@query(f"with {ENTITY_SQL} select query_id, paper_id, kind, name from (select query_id, paper_id, kind, name, row_number() over (partition by query_id order by paper_id, kind, name) as r from ents join eq on list_contains(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}]+'), text)) where r <= 500")
def fts_match_entities(c):
    asked = _entity_queries(c).select("query_id", F.col("text").alias("term"))
    return T.match_entities(_entities(c), asked)


@query("with ix as (select distinct id from texts where regexp_matches(lower(abstract), '[\\p{L}\\p{N}]')) select (select count(*) from texts) as papers, (select count(*) from ix) as indexed, 0 as orphans, round((select count(distinct doc_id) from labels where doc_id in (from ix)) / (select count(distinct doc_id) from labels), 4) as entity_coverage, (select count(*) from ix) = (select count(*) from texts) and (select count(distinct doc_id) from labels where doc_id in (from ix)) / (select count(distinct doc_id) from labels) >= 0.9 as healthy")
def fts_health(c):
    post = _post(c)
    labels = c.table("labels").select(F.col("doc_id").alias("paper_id"))
    known = labels.join(post.select(F.col("id").alias("paper_id")).distinct(), "paper_id", "left_semi")
    return T.health(c.texts, post, labels, known)


def _tagged(c):
    """Entities of the text papers: their source as technique, their language as category."""
    t = c.texts
    return t.select(F.col("id").alias("paper_id"), F.lit("technique").alias("kind"), F.col("venue").alias("name")).unionByName(t.select("id", F.lit("category"), "field").toDF("paper_id", "kind", "name"))


TAGGED_SQL = "ents as (select id as paper_id, 'technique' as kind, venue as name from texts union all select id, 'category', field from texts)"
#: Passes are numbered texts: the whole query, then each of its other tokens.
PASSES_SQL = f"""passes as (select query_id, '' as pass, text, 1.0::double as boost from qs union all
  select query_id, w, w, case when list_contains({T.GENERIC_TOKENS}, w) then 0.2 else 0.5 end from (select query_id, text, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[\\s\\-_/.,;:!?()\\[\\]]+'), lambda w: length(w) >= 2 and not list_contains({T.STOP_WORDS}, w)))) as w from qs) where w <> lower(trim(text))),
words as (select distinct (query_id, pass) as query_id, unnest({WORDS.format('text')}) as term from passes),
stemmed as (select distinct query_id, stem as term from words join stems using (term)),
boosts as (select (query_id, pass) as query_id, boost from passes),
{_bm25_sql('stemmed', 'pm')},
titled as (select query_id, id from post join stemmed using (term) join pm_nt using (query_id) where field = 'title' group by query_id, id, n_terms having count(*) = n_terms)"""


def _entities_sql(asked, name):
    """CTEs that end in ``name``: entities whose names have all terms of ``asked``, 500 a query."""
    return f"""{name}_names as (select distinct name, unnest({WORDS.format('name')}) as term from (select distinct name from ents)),
{name}_nt as (select query_id, count(*) as n_terms from {asked} group by 1),
{name}_found as (select query_id, name from {name}_names join {asked} using (term) join {name}_nt using (query_id) group by query_id, name, n_terms having count(*) = n_terms),
{name} as (select query_id, paper_id, kind, name from (select *, row_number() over (partition by query_id order by paper_id, kind, name) as r from (select distinct query_id, paper_id, kind, name from ents join {name}_found using (name))) where r <= 500)"""


SCORE_SQL = f"""{POST_SQL}, {STATS_SQL}, {TAGGED_SQL}, {PASSES_SQL}, {_entities_sql('words', 'em')},
points as (select query_id, id, boost * case when t.id is not null then 20 + least(score, 20) else 15 + least(score, 15) end as p from pm left join titled t using (query_id, id) join boosts using (query_id)
  union all select query_id, paper_id, boost * case kind when 'category' then 15 when 'technique' then 12 else 0 end from em join boosts using (query_id)),
fs as (select query_id[1] as query_id, id, round(sum(p), 6) as score from points group by 1, 2)"""
LABEL_SQL = f"""{_bm25_sql('asked', 'bm')}, {_entities_sql('said', 'lm')},
title as (select query_id, id from post join asked using (term) join bm_nt using (query_id) where field = 'title' group by query_id, id, n_terms having count(*) = n_terms),
labels as (select query_id, id, 0 as o, 'title' as label from title union select query_id, id, 1, 'abstract' from bm anti join title using (query_id, id) union select query_id, paper_id, 2, kind || ':' || name from lm),
found_in as (select query_id, id, string_agg(label, '; ' order by o, label) as labels from labels group by 1, 2)"""


@query(f"with {SCORE_SQL} select * from fs")
def fts_score(c):
    return T.fts_score(_index(c), _tagged(c), _queries(c))


@query(f"with {POST_SQL}, {STATS_SQL}, {TAGGED_SQL}, {LABEL_SQL} select * from found_in")
def ret_matched_in(c):
    return T.matched_in(_index(c), _tagged(c), _queries(c)).withColumn("labels", F.array_join("labels", "; "))


@query(f"with {BM25_SQL} select query_id, id, title, round(score, 6) as score from bm join texts using (id)")
def join_fts_papers(c):
    return T.bm25(_index(c), _asked(c)).join(c.texts.select("id", "title"), "id").select("query_id", "id", "title", F.round("score", 6).alias("score"))


@query("with t as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[\\s\\-_/.,;:!?()\\[\\]]+'), lambda w: length(w) >= 2 and not list_contains(" + str(T.STOP_WORDS) + ", w)) as ws from documents), u as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from t), f as (select doc_id, w, min(i) as i from u group by 1, 2) select t.doc_id, coalesce(string_agg(w, ' ' order by i), '') as tokens from t left join f using (doc_id) group by 1")
def txt_query_tokenize(c):
    return c.table("documents").select("doc_id", F.array_join(T.query_tokens(F.col("text")), " ").alias("tokens"))


@query(f"with {QUERIES_SQL}, said as (select unnest({WORDS.format('text')}) as term from qs) select distinct term, case when list_contains({T.GENERIC_TOKENS}, term) then 0.2 else 0.5 end::double as boost from said")
def txt_token_boost(c):
    return _asked(c).select("term").distinct().withColumn("boost", T.token_boost(F.col("term")))


LIKE_SQL = f"""lq as (select item_id as query_id, lower(array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')[1:2], ' ')) as t from benchmark where text is not null),
ents as (select id as paper_id, 'technique' as kind, venue as name from texts union all select id, 'category', field from texts),
own as (select query_id, id, case when lower(title) = t then 40.0 when contains(lower(title), t) then 20.0 end as tp, case when contains(lower(coalesce(abstract, '')), t) then 15.0 end as ap from texts, lq where contains(lower(title), t) or contains(lower(coalesce(abstract, '')), t)),
sig as (select query_id, id, 'title' as label, tp as p from own where tp is not null union all select query_id, id, 'abstract', ap from own where ap is not null
  union all select distinct query_id, paper_id, kind || ':' || name, case kind when 'category' then 15.0 else 12.0 end from ents, lq where contains(lower(name), t))"""


def _like_queries(c):
    return _queries(c).select("query_id", F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("text"))


@query(f"with {LIKE_SQL} select query_id, id, round(sum(p), 6)::double as score, string_agg(label, '; ' order by label) as labels from sig group by 1, 2")
def ret_search_v1(c):
    return T.like_score(c.texts, _tagged(c), _like_queries(c), tokens=False).withColumn("labels", F.array_join("labels", "; "))


@query(f"with {LIKE_SQL} select query_id, id, round(sum(p), 6)::double as score, string_agg(label, '; ' order by label) as labels from sig where label <> 'abstract' group by 1, 2")
def ret_search_legacy(c):
    rows = T.like_score(c.texts, _tagged(c), _like_queries(c), ("title_exact", "title", "category", "technique", "dataset"), tokens=False)
    return rows.withColumn("labels", F.array_join("labels", "; "))


@query(f"""with {LIKE_SQL}, term as (select query_id, t, 1.0::double as boost from lq union all
  select query_id, w, case when list_contains({T.GENERIC_TOKENS}, w) then 0.2 else 0.5 end from (select query_id, t, unnest(list_distinct(list_filter(regexp_split_to_array(t, '[\\s\\-_/.,;:!?()\\[\\]]+'), lambda w: length(w) >= 2 and not list_contains({T.STOP_WORDS}, w)))) as w from lq) where w <> t),
each as (select query_id, id, 'title' as label, boost * case when lower(title) = t then 40 else 20 end as p from texts join term on contains(lower(title), t)
  union all select query_id, id, 'abstract', boost * 15 from texts join term on contains(lower(abstract), t)
  union all select query_id, paper_id, kind || ':' || name, boost * case kind when 'category' then 15 else 12 end from (select distinct * from ents) join term on contains(lower(name), t)),
best as (select query_id, id, label, max(p) as p from each group by all)
select query_id, id, round(sum(p), 6)::double as score, string_agg(label, '; ' order by label) as labels from best group by 1, 2""")
def ret_like_legacy(c):
    return T.like_score(c.texts, _tagged(c), _like_queries(c)).withColumn("labels", F.array_join("labels", "; "))


VEC_SQL = "sims as (select q.vec_id as query_id, e.vec_id as chunk_id, e.label as paper_id, round(list_dot_product(e.embedding::double[], q.embedding::double[]), 6) as score from embeddings e, (select * from embeddings where vec_id % 20 = 0) q), top as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as r from sims) where r <= 200 and score >= 0.30)"


def _vector_index(c, again=False):
    """The index of all vectors; written once for each version of the table, then read by every search."""
    key = _version(c, "embeddings")
    if again or key not in _STORED:
        path = scratch.path(c.spark, "vectors")
        V.build(c.table("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("paper_id"), "embedding"), path)
        _STORED[key] = path
    return V.VectorIndex.read(c.spark, _STORED[key])


def _vector_queries(c):
    return c.table("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _vectors(c):
    return R.vector_topk(_vector_index(c), _vector_queries(c)).select("query_id", "chunk_id", "paper_id", "score")


@query("select vec_id as chunk_id, label as paper_id from embeddings")
def vec_index_build(c):
    """Writes the index that the searches read."""
    return _vector_index(c, again=True).rows.select("chunk_id", "paper_id")


@query("select count(*) as queries, true as found_nine_tenths, true as cells_hold_all from embeddings where vec_id % 20 = 0")
def vec_index_recall(c):
    """Of the rows that the exact search finds, what the search of the nearest cells alone finds."""
    index, queries = _vector_index(c), _vector_queries(c)
    exact, near = (index.search(queries, R.CHUNKS, R.LEAST_COSINE, exact=e).select("query_id", "chunk_id") for e in (True, False))
    both = exact.join(near.withColumn("_found", F.lit(True)), ["query_id", "chunk_id"], "left").agg(F.coalesce(F.avg(F.coalesce("_found", F.lit(False)).cast("int")), F.lit(1.0)).alias("share"))
    sizes = index.cells.agg(F.sum("n").alias("n"))
    total = c.table("embeddings").agg(F.count("*").alias("all"))
    out = queries.agg(F.count("*").alias("queries")).crossJoin(both).crossJoin(sizes).crossJoin(total)  # one row each
    return out.select("queries", (F.col("share") >= 0.9).alias("found_nine_tenths"), (F.col("n") == F.col("all")).alias("cells_hold_all"))


@query(f"with {VEC_SQL} select query_id, chunk_id, paper_id, score from top")
def vec_topk(c):
    return _vectors(c)


@query(f"with {VEC_SQL}, best as (select query_id, paper_id, max(score) as score from top group by 1, 2) select query_id, paper_id, score from (select *, row_number() over (partition by query_id order by score desc, paper_id) as r from best) where r <= 50")
def vec_maxpool(c):
    return R.max_pool(_vectors(c))


@query("with p as (select id, title, unnest([{'position': 0, 'field': 'title', 'body': trim(title)}, {'position': 1, 'field': 'abstract', 'body': trim(abstract)}]) as s from papers), k as (select id, title, s.position, s.field, s.body from p where coalesce(s.body, '') <> '') select id, position::int as position, field, substr(case when field = 'title' then title else title || '. ' || body end, 1, 2000) as chunk from k")
def vec_chunk_build(c):
    return R.build_chunks(c.papers, ["title", "abstract"])


@query()
def vec_encode(c):
    """Vectors of a hashing encoder: the seam for any model that turns texts into vectors."""
    return R.encode(R.build_chunks(c.papers, ["title", "abstract"]), hashing_encoder).select("id", "position", F.size("embedding").alias("width"), F.round(R.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm"))


def hashing_encoder(texts, width: int = 64):
    """Counts of words in ``width`` buckets by CRC-32."""
    from zlib import crc32

    import numpy as np

    out = np.zeros((len(texts), width), np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            out[i, crc32(w.encode()) % width] += 1
    return out


HYBRID_SQL = f"""{SCORE_SQL}, {LABEL_SQL}, sims as (select q.vec_id as query_id, e.vec_id as id, round(list_dot_product(e.embedding::double[], q.embedding::double[]), 6) as score from embeddings e, (select * from embeddings where vec_id % 20 = 0) q),
near as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as r from sims) where r <= 200 and score >= 0.30),
ss as (select query_id, id, score as s from (select *, row_number() over (partition by query_id order by score desc, id) as r from near) where r <= 50),
hy as (select query_id, id, round(coalesce(fs.score, 0) + 40 * coalesce(s, 0) + ln(1 + coalesce(n_chars, 0)), 6) as score, s is not null as semantic from fs full join ss using (query_id, id) join documents on doc_id = id)"""


@query(f"""with {HYBRID_SQL} select query_id, id, score, semantic, rank, concat_ws('; ', case when semantic then 'semantic' end, labels) as labels
from (select *, row_number() over (partition by query_id order by score desc, id)::int as rank from hy) left join found_in using (query_id, id) where rank <= 20""")
def ret_hybrid(c):
    # Here each chunk is a paper of its own.
    semantic = R.max_pool(_vectors(c).withColumn("paper_id", F.col("chunk_id")))
    papers = c.table("documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("citation_count"))
    found = R.retrieve(_index(c), papers, _tagged(c), _queries(c), semantic, 20)
    return found.withColumn("labels", F.array_join("labels", "; "))


# Features are the categories; their names are matched against methodologies and categories of the papers.
FEATURE_SQL = """f1 as (select name as feature_id, paper_id, row_number() over (partition by name order by confidence desc, paper_id) - 1 as position from categories),
f2 as (select feature_id, paper_id, matches, row_number() over (partition by feature_id order by matches desc, citation_count desc nulls last, paper_id) - 1 as position from
  (select c.name as feature_id, m.paper_id, count(distinct lower(m.name)) as matches, any_value(citation_count) as citation_count from (select distinct name from categories) c join (select 'Brand#' || (i + 10) as brand, i from range(1, 46) t(i)) b on (length(c.name) + i) % 3 = 0 join methodologies m on lower(m.name) = lower(b.brand) join papers p on p.id = m.paper_id group by 1, 2)),
f3 as (select feature_id, paper_id, matches, row_number() over (partition by feature_id order by matches desc, citation_count desc nulls last, paper_id) - 1 as position from
  (select a.name as feature_id, k.paper_id, count(distinct lower(k.name)) as matches, any_value(citation_count) as citation_count from (select distinct name from categories) a join categories k on split_part(a.name, ' ', 1) = split_part(k.name, ' ', 1) and split_part(a.name, ' ', 2) = split_part(k.name, ' ', 2) join papers p on p.id = k.paper_id group by 1, 2)),
rr as (select feature_id, paper_id, round(sum(part), 9) as score from (select feature_id, paper_id, 1.0 / (60 + position) as part from f1 where position < 50 union all select feature_id, paper_id, 1.4 / (60 + position) from f2 where position < 50
  union all select feature_id, paper_id, 0.7 / (60 + position) from f3 where position < 50) group by 1, 2)"""


def _dense(c):
    w = Window.partitionBy("feature_id").orderBy(F.desc("confidence"), "paper_id")
    return c.categories.select(F.col("name").alias("feature_id"), "paper_id", "confidence").withColumn("position", F.row_number().over(w) - 1)


def _named(c):
    names = c.categories.select(F.col("name").alias("feature_id")).distinct()
    brands = c.spark.range(1, 46).select(F.concat(F.lit("Brand#"), F.col("id") + 10).alias("name"), "id")
    wanted = names.join(F.broadcast(brands), (F.length("feature_id") + F.col("id")) % 3 == 0).select("feature_id", "name")
    return R.name_matches(c.methodologies, wanted, c.papers)


def _of_family(c):
    """A feature's categories are those that share its first two words."""
    names, family = c.categories.select("name").distinct(), F.substring_index("name", " ", 2).alias("family")
    wanted = names.select(F.col("name").alias("feature_id"), family).join(names.select("name", family), "family").select("feature_id", "name")
    return R.name_matches(c.categories, wanted, c.papers)


def _fused(c):
    signals = {"dense": (_dense(c), R.DENSE_WEIGHT), "technique": (_named(c), R.TECHNIQUE_WEIGHT), "category": (_of_family(c), R.CATEGORY_WEIGHT)}
    return R.rrf({name: (rows.where("position < 50"), weight) for name, (rows, weight) in signals.items()})


@query(f"with {FEATURE_SQL} select feature_id, paper_id, matches, position::int as position from f2 where position < 200")
def ret_technique_rows(c):
    return _named(c).where("position < 200")


@query(f"with {FEATURE_SQL} select feature_id, paper_id, matches, position::int as position from f3 where position < 200")
def ret_category_rows(c):
    return _of_family(c).where("position < 200")


@query(f"with {FEATURE_SQL} select feature_id, paper_id, position::int as position from f1")
def win_rrf_position(c):
    return _dense(c).select("feature_id", "paper_id", "position")


@query(f"with {FEATURE_SQL} select * from rr")
def ret_rrf(c):
    return _fused(c).select("feature_id", "paper_id", "score")


@query(f"with {FEATURE_SQL} select feature_id, paper_id, score, rank from (select *, row_number() over (partition by feature_id order by score desc, paper_id)::int as rank from rr) where rank <= 5")
def ret_for_feature(c):
    return R.top_fused(_fused(c)).select("feature_id", "paper_id", "score", "rank")


@query(f"""with {FEATURE_SQL}, t as (select feature_id, avg(score) as q from (select *, row_number() over (partition by feature_id order by score desc, paper_id) as rank from rr) where rank <= 5 group by 1),
b as (select t.feature_id, q, (select (count(*) >= 3)::int from f1 where f1.feature_id = t.feature_id) as d, (select (count(*) >= 2)::int from f2 where f2.feature_id = t.feature_id) as e, (select (count(*) >= 2)::int from f3 where f3.feature_id = t.feature_id) as g from t),
s as (select feature_id, round(0.6 * (d + e + g) / 3 + 0.4 * least(1.0, q / (3.1 / 60)), 3) as coverage from b) select feature_id, coverage, case when coverage > 0.65 then 'strong' when coverage > 0.4 then 'moderate' when coverage > 0.15 then 'weak' else 'novel' end as tier from s""")
def ret_coverage(c):
    dense = _dense(c)
    return R.coverage(dense, dense, _named(c), _of_family(c), R.top_fused(_fused(c)))


@query(f"with {FEATURE_SQL}, g as (select feature_id, paper_id, string_agg(signal, ',' order by signal) as fired from (select feature_id, paper_id, 'dense' as signal from f1 where position < 50 union all select feature_id, paper_id, 'technique' from f2 where position < 50 union all select feature_id, paper_id, 'category' from f3 where position < 50) group by 1, 2) select feature_id, paper_id, score, fired from (select *, row_number() over (partition by feature_id order by score desc, paper_id) as r from rr join g using (feature_id, paper_id)) where r <= 20")
def ret_debug(c):
    return R.top_fused(_fused(c), 20).select("feature_id", "paper_id", "score", F.array_join("fired", ",").alias("fired"))


@query("""with u as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as anchor from conversations where role = 'user')
select conv_id, turn, case when anchor is not null and (len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 4 or regexp_matches(lower(text), '\\b(that|those|it|its|them|they|this|these|the (first|second|third|fourth|fifth|last|previous|other|same|above)|paper \\d|tell me more|elaborate|explain (more|further)|what about|can you expand|go deeper|more (detail|info|context)|summarise|summarize)\\b'))
  then substr(anchor || ' ' || text, 1, 300) else text end as query from u""")
def ret_followup_query(c):
    return R.follow_up_query(c.table("conversations"))


@query("with r as (select lang as query_id, doc_id, text, source, row_number() over (partition by lang order by n_chars desc, doc_id) as rank from documents) select query_id, string_agg('[' || rank || '] ' || source || chr(10) || substr(coalesce(text, ''), 1, 400), chr(10) || '---' || chr(10) order by rank) as context from r where rank <= 5 group by 1")
def ret_context_block(c):
    rows = c.table("documents").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))).where("rank <= 5")
    return R.context_block(rows.withColumnRenamed("lang", "query_id"), title="source", body="text")


@query(f"""with {FEATURE_SQL}, k as (select feature_id, paper_id, row_number() over (partition by feature_id order by score desc, paper_id) as rank from rr), e as (select feature_id, title as piece from f1 join papers on id = paper_id where position = 0),
h as (select e.feature_id, coalesce(bool_or(contains(lower(title), lower(piece))), false) as hit from e left join k on k.feature_id = e.feature_id and rank <= 5 left join papers on id = k.paper_id group by 1)
select count(*) as cases, count_if(hit) as passed, round(count_if(hit) / count(*), 4) as rate, round(count_if(hit) / count(*), 4) >= 0.8 as ok from h""")
def ret_recall_gate(c):
    """Whether the retrieval for a feature brings the title of its surest paper among the first five."""
    titles = c.papers.select(F.col("id").alias("paper_id"), "title")
    results = R.top_fused(_fused(c)).join(titles, "paper_id").select(F.col("feature_id").alias("query_id"), "rank", "title")
    expected = _dense(c).where("position = 0").join(titles, "paper_id").select(F.col("feature_id").alias("query_id"), F.col("title").alias("piece"))
    return R.recall_gate(results, expected)


@query(f"with {PLAIN_SQL} select id, field, term, count(*) as tf from occ group by all")
def snk_fts_sync(c):
    """The index after the rows of one language were stored with other words, put right, and all segments merged."""
    index = S.SegmentedIndex.create(c.spark, scratch.path(c.spark, "segments"), ["title", "abstract"], stemmed=False)
    some = F.col("field") == "fr"
    index.apply("all", c.texts.withColumn("abstract", F.when(some, F.lit("not yet")).otherwise(F.col("abstract"))))
    index.apply("french", c.texts.where(some))
    index.merge(index.segments())
    return index.live().post.select("id", "field", "term", "tf")


#: Every fiftieth text is taken out again, those of one language are revised.
LATER_SQL = f"""texts2 as (select id, title, case when field = 'fr' then abstract || ' revised' else abstract end as abstract from texts where id % 50 <> 0),
occ2 as (select id, 'title' as field, unnest({WORDS.format('title')}) as term from texts2 union all select id, 'abstract', unnest({WORDS.format('abstract')}) from texts2)"""


def _changes(c):
    """A folder into which changes of the texts come in three lots: all texts, revised ones, removals."""
    at = scratch.path(c.spark, "changes")
    t = c.texts.select("id", "title", "abstract", "field")
    lots = [(t, "abstract", False), (t.where("field = 'fr'"), F.concat("abstract", F.lit(" revised")), False), (t.where("id % 50 = 0"), "abstract", True)]
    for k, (rows, text, gone) in enumerate(lots):
        rows = rows.select("id", "title", (F.col(text) if isinstance(text, str) else text).alias("abstract"), F.lit(k).alias("at"), F.lit(gone).alias("removed"))
        rows.write.mode("append").parquet(at)
    return at


@query(f"with {LATER_SQL} select id, field, term, count(*) as tf from occ2 group by all")
def str_incremental_sync(c):
    """An index kept in step by a stream of changed rows, a segment for each batch, merged now and then."""
    index = S.SegmentedIndex.create(c.spark, scratch.path(c.spark, "segments"), ["title", "abstract"], stemmed=False)
    schema = "id long, title string, abstract string, at int, removed boolean"
    changes = c.spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(_changes(c))
    ST.sync_segments(changes, index, scratch.path(c.spark, "sync")).awaitTermination()
    return index.live().post.select("id", "field", "term", "tf")


@query("select 'papers' as index_name, count(*) as n from texts where regexp_matches(lower(abstract), '[\\p{L}\\p{N}]') union all select 'entities', count(*) from (select distinct paper_id, 't', coalesce(canonical_name, name) from techniques union all select distinct paper_id, 'c', coalesce(canonical_name, name) from categories)")
def snk_fts_rebuild(c):
    a = _post(c).agg(F.lit("papers").alias("index_name"), F.count_distinct("id").alias("n"))
    return a.unionByName(_entities(c).agg(F.lit("entities").alias("index_name"), F.count("*").alias("n")))
