"""Text processing, names, topics, upserts, validation, feature maps and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import featuremap as M
from ..operators import fts
from ..operators import normalize as N
from ..operators import text as X
from ..operators import upsert as U
from ..sources import readers, writers
from ..streaming import streams
from .registry import query

WORDS_SQL = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"


def _docs(c):
    return c.table("documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


#: A paper-like text of each document: its lines under numbered headings.
PAPER_SQL = "'1 Introduction' || chr(10) || text || chr(10) || '2. Method' || chr(10) || source || ' ' || text || chr(10) || 'Conclusion' || chr(10) || lang || '.'"


def _papers(c):
    nl = F.lit("\n")
    t = F.concat(F.lit("1 Introduction"), nl, "text", nl, F.lit("2. Method"), nl, "source", F.lit(" "), "text", nl, F.lit("Conclusion"), nl, "lang", F.lit("."))
    return _docs(c).select("id", t.alias("text"))


@query("select doc_id as id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^\\s*\\d{1,3}\\s*$', '', 'g'), '(?im)^\\s*(Preprint\\.|Under review|NeurIPS\\s+\\d{4}|ICML\\s+\\d{4}|ICLR\\s+\\d{4}|Published as a|Advances in Neural Information|\\d{1,4}\\s*$)', '', 'g'), '(?is)\\nReferences\\s*\\n.*', ''), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as clean from documents")
def txt_clean_pdf(c):
    return _docs(c).select("id", X.clean_pdf(F.col("text")).alias("clean"))


@query("select doc_id as id, length(regexp_replace(text, '[^∀-⋿×·]', '', 'g')) > 30 as has_equations from documents")
def txt_math_heuristic(c):
    return _docs(c).select("id", X.has_equations(F.col("text")).alias("has_equations"))


@query(f"select doc_id as id, len({WORDS_SQL.format('text')})::int as words from documents")
def txt_word_count(c):
    return _docs(c).select("id", X.word_count(F.col("text")).alias("words"))


@query(f"select doc_id as id, case when len({WORDS_SQL.format('text')}) <= 100 then text else array_to_string({WORDS_SQL.format('text')}[1:100], ' ') || chr(10) || '[truncated]' end as cut from documents")
def txt_truncate_words(c):
    return _docs(c).select("id", X.truncate_words(F.col("text"), 100).alias("cut"))


@query()
def txt_segment(c):
    return X.segment(_papers(c)).withColumn("sections_found", F.array_join("sections_found", ","))


@query()
def txt_segment_simple(c):
    return X.segment_simple(_papers(c))


@query()
def txt_llm_context(c):
    return X.segment(_papers(c)).select("id", X.llm_context(None).alias("context"))


@query()
def txt_quality_report(c):
    rows = X.segment(_papers(c))
    q = X.quality_report(F.col("sections_found"))
    return rows.select("id", *(F.array_join(v, ",").alias(k) if k != "coverage_pct" else v.alias(k) for k, v in q.items()))


HEADINGS = ["Abstract", "1 Introduction", "2. Related Work", "3.1 Method", "Experimental Setup", "4 Results", "Error Analysis", "Conclusions", "Limitations", "Future Work", "Appendix"]


@query("select * from (values ('Abstract', 'abstract'), ('1 Introduction', 'introduction'), ('2. Related Work', 'related_work'), ('3.1 Method', 'methodology'), ('Experimental Setup', 'experiments'), ('4 Results', 'results'), ('Error Analysis', 'discussion'), ('Conclusions', 'conclusion'), ('Limitations', 'limitations'), ('Future Work', 'future_work'), ('Appendix', 'other')) v(heading, key)")
def txt_header_key(c):
    return c.spark.createDataFrame([(h,) for h in HEADINGS], "heading string").select("heading", X.header_key(F.col("heading")).alias("key"))


@query("select doc_id as id, '# ' || source as t, source as title from documents")
def txt_md_title(c):
    rows = _docs(c).select("id", F.concat(F.lit("# "), "source").alias("t"))
    return rows.select("id", "t", X.markdown_title(F.col("t")).alias("title"))


@query()
def txt_md_sections(c):
    md = F.concat(F.lit("# "), "source", F.lit("\n"), "text", F.lit("\n## Notes\n"), "text", F.lit("\n### Short\na b"))
    return X.markdown_sections(_docs(c).select("id", md.alias("text")))


@query("""with a as (select paper_id, string_agg(full_name, ', ' order by position, author_id) as authors from (select paper_id, author_id, position, full_name, row_number() over (partition by paper_id order by position, author_id) as r from paper_authors join authors on author_id = id) where r <= 6 group by 1)
select p.id, 'PAPER: ' || title || chr(10) || 'AUTHORS: ' || coalesce(authors, 'Unknown') || chr(10) || 'CITATIONS: ' || citation_count || case when abstract is not null then chr(10) || chr(10) || 'ABSTRACT:' || chr(10) || abstract else '' end as source from papers p left join a on a.paper_id = p.id""")
def txt_source_doc(c):
    w = Window.partitionBy("paper_id").orderBy("position", "author_id")
    a = c.paper_authors.join(c.authors, F.col("author_id") == F.col("id")).withColumn("r", F.row_number().over(w)).where("r <= 6")
    a = a.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "full_name"))), lambda x: x["full_name"]), ", ").alias("authors"))
    body = F.when(F.col("abstract").isNotNull(), F.concat(F.lit("\n\nABSTRACT:\n"), "abstract")).otherwise("")
    rows = c.papers.join(a, F.col("id") == F.col("paper_id"), "left")
    return rows.select("id", F.concat(F.lit("PAPER: "), "title", F.lit("\nAUTHORS: "), F.coalesce("authors", F.lit("Unknown")), F.lit("\nCITATIONS: "), F.col("citation_count").cast("string"), body).alias("source"))


#: An answer for each edition: one block per paper, in order.
ANSWER_SQL = "answers as (select edition_id as answer_id, string_agg('PAPER: ' || title || chr(10) || 'INTRODUCES: ' || presentation_type || ' [1] | NONE' || chr(10) || 'SUMMARY: Of ' || year || '.' || chr(10) || 'More on it.', chr(10) || '===' || chr(10) order by id) as answer, count(*) + 1 as expected from papers group by 1)"


def _answers(c):
    block = F.concat(F.lit("PAPER: "), "title", F.lit("\nINTRODUCES: "), "presentation_type", F.lit(" [1] | NONE\nSUMMARY: Of "), F.col("year").cast("string"), F.lit(".\nMore on it."))
    rows = c.papers.groupBy(F.col("edition_id").alias("answer_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", block.alias("b")))), lambda x: x["b"]).alias("bs"))
    return rows.select("answer_id", F.array_join("bs", "\n===\n").alias("answer"), (F.size("bs") + 1).cast("long").alias("expected"))


@query("select edition_id as answer_id, (row_number() over (partition by edition_id order by id) - 1)::int as block, title from papers")
def txt_block_split(c):
    return X.blocks(_answers(c)).select("answer_id", "block", "title")


@query("select edition_id as answer_id, title, 'Of ' || year || '. More on it.' as summary, presentation_type as introduces from papers")
def txt_field_parsers(c):
    return X.extract_fields(_answers(c)).select("answer_id", "title", "summary", F.array_join("introduces", "; ").alias("introduces"))


@query("select edition_id as answer_id, title, id as paper_id from papers")
def txt_extract_all(c):
    """Blocks with the papers they are about: by exact title, which match_titles relaxes."""
    found = X.blocks(_answers(c)).select("answer_id", "title")
    return found.join(c.papers.select("title", F.col("id").alias("paper_id"), F.col("edition_id").alias("answer_id")), ["answer_id", "title"])


@query(f"with {ANSWER_SQL} select answer_id, (expected - 1)::int as found, expected, round((expected - 1) / expected, 4) as ratio, round((expected - 1) / expected, 4) >= 0.8 as ok from answers")
def txt_coverage_check(c):
    return X.coverage_check(_answers(c), "answer_id", "answer", "expected")


@query("select c.id, array_to_string(list_filter([name, 'LLM', 'Graph'], lambda x: x in ('LLM', 'Graph')), ',') as kept from (select paper_id as id, name from categories) c")
def txt_category_whitelist(c):
    known = F.array(*(F.lit(x) for x in X.CATEGORIES))
    listed = F.array(F.col("name"), F.lit("LLM"), F.lit("Graph"))
    return c.categories.select(F.col("paper_id").alias("id"), F.array_join(F.filter(listed, lambda x: F.array_contains(known, x)), ",").alias("kept"))


# Names.

ALIASES = [("economy", "Economy Goods"), ("promo", "Promotional"), ("standard", "Standard Goods")]
ALIAS_SQL = "aliases as (select * from (values ('economy', 'Economy Goods'), ('promo', 'Promotional'), ('standard', 'Standard Goods')) v(key, canonical))"
RAW_SQL = "raw as (select name || case when n % 2 = 0 then ' [1, 2]' else ' (ABC)' end as name, n from (select name, count(*) as n from categories group by 1))"


def _raw_names(c):
    rows = c.categories.groupBy("name").agg(F.count("*").alias("n"))
    return rows.select(F.concat("name", F.when(F.col("n") % 2 == 0, " [1, 2]").otherwise(" (ABC)")).alias("name"), "n")


def _aliases(c):
    return c.spark.createDataFrame(ALIASES, "key string, canonical string")


CLEAN_SQL = "lower(trim(regexp_replace(regexp_replace(name, '\\s*\\[\\d+(?:[,\\s]\\d+)*\\]\\s*', '', 'g'), '\\s*\\([A-Z][A-Za-z0-9\\-]+\\)\\s*$', '')))"


@query(f"with {ALIAS_SQL}, {RAW_SQL} select name, n, canonical as alias from raw left join aliases on key = {CLEAN_SQL}")
def txt_alias_resolve(c):
    return N.resolve_alias(_raw_names(c), _aliases(c)).select("name", "n", "alias")


@query("with v as (select name, count(*) as n from (select case when paper_id % 2 = 0 then upper(name) else name end as name from categories) group by 1), r as (select *, row_number() over (partition by lower(name) order by n desc, regexp_matches(substr(name, 1, 1), '[A-Z]') desc, name) as r from v) select v.name, r.name as canonical from v join r on lower(v.name) = lower(r.name) and r = 1")
def txt_casefold_canonical(c):
    rows = c.categories.select(F.when(F.col("paper_id") % 2 == 0, F.upper("name")).otherwise(F.col("name")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return N.case_fold(rows)


@query(f"with {ALIAS_SQL}, {RAW_SQL}, a as (select name, n, canonical from raw left join aliases on key = {CLEAN_SQL}), k as (select *, lower(trim(regexp_replace(name, '\\s*\\([A-Z][A-Za-z0-9\\-]+\\)\\s*$', ''))) as k from a where canonical is null), b as (select k, arg_max(name, n) as best from k group by 1) select name, canonical from a where canonical is not null union all select name, best from k join b using (k)")
def txt_normalize_all(c):
    return N.normalize_all(_raw_names(c), _aliases(c))


@query("with known as (select canonical_name, count(distinct paper_id) as n from techniques where canonical_name is not null group by 1), t as (select paper_id, case when paper_id % 2 = 0 then upper(substr(name, length(split_part(name, ' ', 1)) + 2)) else lower(substr(name, length(split_part(name, ' ', 1)) + 2)) end as name from techniques where canonical_name is null) select paper_id, t.name, canonical_name as proposed, case when t.name = canonical_name then 'exact' else 'case_insensitive' end as match_type from t join known on lower(t.name) = canonical_name")
def txt_backfill_canonical(c):
    bare = F.expr("substr(name, length(split_part(name, ' ', 1)) + 2)")
    rows = c.techniques.withColumn("name", F.when(F.col("canonical_name").isNotNull(), F.col("name")).when(F.col("paper_id") % 2 == 0, F.upper(bare)).otherwise(F.lower(bare)))
    return N.backfill(rows)


@query("with ix as (select 'technique' as kind, canonical_name as name, count(distinct paper_id) as papers from techniques where canonical_name is not null group by 1, 2 union all select 'category', name, count(distinct paper_id) from categories group by 1, 2), t as (select distinct unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from benchmark), r as (select term, kind, name, row_number() over (partition by term, kind order by papers desc, name) as rank from t join ix on contains(lower(name), term)) select term, kind, name, rank::int as rank from r where rank <= case kind when 'technique' then 3 else 2 end")
def txt_term_resolve(c):
    tech = c.techniques.where("canonical_name is not null").groupBy(F.col("canonical_name").alias("name")).agg(F.count_distinct("paper_id").alias("papers")).withColumn("kind", F.lit("technique"))
    cats = c.categories.groupBy("name").agg(F.count_distinct("paper_id").alias("papers")).withColumn("kind", F.lit("category"))
    terms = c.table("benchmark").select(F.explode(fts.words(F.col("text"))).alias("term"))
    return N.resolve_terms(terms, tech.unionByName(cats), {"technique": 3, "category": 2})


@query("with ix as (select canonical_name as name, count(distinct paper_id) as papers from techniques where canonical_name is not null group by 1) select name, papers, row_number() over (order by papers desc, name)::int as rank from ix where contains(lower(name), 'e') order by rank limit 3")
def txt_like_fallback(c):
    tech = c.techniques.where("canonical_name is not null").groupBy(F.col("canonical_name").alias("name")).agg(F.count_distinct("paper_id").alias("papers")).withColumn("kind", F.lit("technique"))
    found = N.resolve_terms(c.spark.createDataFrame([("e",)], "term string"), tech, {"technique": 3})
    return found.join(tech.select("name", "papers"), "name").select("name", "papers", "rank")


ENTITY_NAMES = ["GPT-4", "PyTorch", "AdamW", "BLEU", "ImageNet", "Vision Transformer (ViT)", "Monte Carlo dropout", "Custom optimizer", "Chat model X", "Data platform", "Speech corpus", "Error rate", "Curriculum learning", "Something else"]
ENTITY_CLASSES = ["Model", "Framework", "Optimizer", "Metric", "Dataset", "Architecture", "Algorithm", "Optimizer", "Model", "Tool", "Dataset", "Metric", "Technique", "Unknown"]


@query("select * from (values " + ", ".join(f"('{n}', '{k}')" for n, k in zip(ENTITY_NAMES, ENTITY_CLASSES)) + ") v(name, kind)")
def txt_entity_classify(c):
    return c.spark.createDataFrame([(n,) for n in ENTITY_NAMES], "name string").select("name", N.classify(F.col("name")).alias("kind"))


@query("select distinct name, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda w: length(w) > 1 and w not in ('a', 'an', 'the', 'of', 'for', 'and', 'with', 'in', 'on', 'to')))), ' ') as tokens from techniques")
def txt_token_set(c):
    return c.techniques.select("name").distinct().select("name", F.array_join(N.token_set(F.col("name")), " ").alias("tokens"))


@query("""with n as (select distinct lower(p_name) as n from part), t as (select n, list_sort(list_distinct(list_filter(regexp_extract_all(n, '[a-z0-9]+'), lambda w: length(w) > 1 and w not in ('a', 'an', 'the', 'of', 'for', 'and', 'with', 'in', 'on', 'to')))) as ts from n),
p as (select a.n as a, b.n as b, case when length(a.n) <> length(b.n) and (contains(a.n, b.n) or contains(b.n, a.n)) and least(length(a.n), length(b.n)) / greatest(length(a.n), length(b.n)) > 0.6 then 'substring' when len(a.ts) >= 2 and len(b.ts) >= 2 and len(list_intersect(a.ts, b.ts)) / len(list_distinct(a.ts || b.ts)) >= 0.8 then 'token-overlap' end as reason from t a join t b on a.n < b.n) select * from p where reason is not null""")
def join_name_pairs(c):
    return N.suspected_duplicates(c.table("part").select(F.lower("p_name").alias("name")))


@query("""with k as (select distinct p_name as title, min(p_partkey) as id from part group by 1), r as (select p_partkey as raw_id, p_name || ' extra' as title from part),
ta as (select raw_id, list_distinct(list_transform(list_filter(regexp_split_to_array(title, '\\s+'), lambda w: length(w) > 2), lambda w: lower(w))) as t from r), tb as (select id, list_distinct(list_transform(list_filter(regexp_split_to_array(title, '\\s+'), lambda w: length(w) > 2), lambda w: lower(w))) as t from k),
ea as (select raw_id, len(t) as na, unnest(t) as w from ta), eb as (select id, len(t) as nb, unnest(t) as w from tb), m as (select raw_id, id, count(*) / greatest(na, nb) as score from ea join eb using (w) group by raw_id, id, na, nb)
select raw_id, id, round(score, 6) as score from (select *, row_number() over (partition by raw_id order by score desc, id) as rn from m where score >= 0.5) where rn = 1""")
def join_title_fuzzy(c):
    known = c.table("part").groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("id"))
    raw = c.table("part").select(F.col("p_partkey").alias("raw_id"), F.concat("p_name", F.lit(" extra")).alias("title"))
    return N.match_titles(raw, known)


# Topics.

TOPICS = {
    "fast": {"domain": "a", "primary": ["urgent", "high"], "secondary": ["customer"]},
    "slow": {"domain": "b", "primary": ["low", "not specified"], "secondary": ["order", "placed"]},
    "mid": {"domain": "b", "primary": ["medium"], "secondary": ["priority"]},
    "_note": {"primary": ["ignored"]},
}
TOPIC_SQL = "topics as (select * from (values ('fast', 'urgent', 2), ('fast', 'high', 2), ('fast', 'customer', 1), ('slow', 'low', 2), ('slow', 'not specified', 2), ('slow', 'order', 1), ('slow', 'placed', 1), ('mid', 'medium', 2), ('mid', 'priority', 1)) v(slug, keyword, weight)), tscore as (select id, slug, sum(weight) / any_value(most) as score from papers join topics on contains(lower(title || ' ' || coalesce(abstract, '')), keyword) join (select slug, sum(weight) as most from topics group by 1) using (slug) group by 1, 2)"


def _topic_docs(c):
    return c.papers.select("id", F.concat_ws(" ", "title", F.coalesce("abstract", F.lit(""))).alias("text"))


def _topic_scores(c):
    return X.topic_scores(_topic_docs(c), readers.topics(c.spark, TOPICS))


@query("select * from (values ('fast', 'a', 'urgent', 2), ('fast', 'a', 'high', 2), ('fast', 'a', 'customer', 1), ('slow', 'b', 'low', 2), ('slow', 'b', 'not specified', 2), ('slow', 'b', 'order', 1), ('slow', 'b', 'placed', 1), ('mid', 'b', 'medium', 2), ('mid', 'b', 'priority', 1)) v(slug, domain, keyword, weight)")
def src_topic_keywords(c):
    return readers.topics(c.spark, TOPICS)


@query(f"with {TOPIC_SQL} select id, slug, round(score, 6) as score from tscore")
def txt_topic_score(c):
    return _topic_scores(c).withColumn("score", F.round("score", 6))


ASSIGN_SQL = f"{TOPIC_SQL}, rk as (select *, row_number() over (partition by id order by score desc, slug desc) as r, max(score) over (partition by id) as top from tscore), asg as (select id, slug, round(score, 6) as score, case when r = 1 and score >= 0.15 then 'high' else 'medium' end as confidence from rk where r <= 2 and top >= 0.08 and (r = 1 or score >= 0.04) union all select id, 'mid', round(coalesce((select max(score) from tscore t where t.id = p.id), 0), 6), 'low' from papers p where id not in (select id from rk where top >= 0.08))"


def _assigned(c):
    return X.assign_topics(_topic_docs(c), _topic_scores(c), "mid")


@query(f"with {ASSIGN_SQL} select * from asg")
def txt_topic_assign(c):
    return _assigned(c)


@query(f"with {ASSIGN_SQL} select id, slug, score, confidence, ((row_number() over (partition by slug order by id) - 1) // 45 + 1)::int as notebook from asg")
def txt_capacity_batching(c):
    return X.capacity_batches(_assigned(c))


@query(f"with {ASSIGN_SQL} select slug, count(*) as source_count, count(distinct id) as papers from asg group by 1")
def ups_notebook_counter(c):
    return _assigned(c).groupBy("slug").agg(F.count("*").alias("source_count"), F.count_distinct("id").alias("papers"))


@query(f"with {ASSIGN_SQL} select * from asg where id not in (select paper_id from categories where confidence > 0.98)")
def txt_topic_batch(c):
    done = c.categories.where("confidence > 0.98").select(F.col("paper_id").alias("id"))
    return _assigned(c).join(done, "id", "left_anti")


# Small texts.


@query("select paper_id, trim(split_part(f, ' :: ', 1)) as benchmark, trim(split_part(f, ' :: ', 2)) as metric, trim(split_part(f, ' :: ', 3)) as scores from (select paper_id, name || ' :: ' || coalesce(canonical_name, '') || ' :: ' || confidence as f from categories)")
def txt_findings_parse(c):
    f = F.concat_ws(" :: ", "name", F.coalesce("canonical_name", F.lit("")), F.col("confidence").cast("string"))
    return c.categories.select("paper_id", X.triple(f).alias("t")).select("paper_id", "t.*")


@query("select event_id, props, json_extract_string(props, '$.k') as k from events where json_valid(props)")
def txt_json_repair(c):
    rows = c.table("events").select("event_id", "props", X.repaired_json(F.concat(F.lit("Answer: "), "props", F.lit(" done")), "struct<k: string>").alias("x"))
    return rows.select("event_id", "props", F.col("x.k").alias("k"))


@query("select doc_id as id, trim(case when strpos(text, '. ') > 0 then substr(text, 1, strpos(text, '. ')) when strpos(text, '.' || chr(10)) > 0 then substr(text, 1, strpos(text, '.' || chr(10))) else substr(text, 1, 200) end) as s from documents")
def txt_first_sentence(c):
    return _docs(c).select("id", X.first_sentence(F.col("text")).alias("s"))


@query()
def txt_prose_paragraphs(c):
    return _docs(c).select("id", F.array_join(X.prose_paragraphs(F.col("text")), "\n\n").alias("prose"))


@query("with t as (select doc_id as id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from documents) select id, case when length(t) <= 50 then t else regexp_extract(substr(t, 1, 50), '^(.*?)(?:\\s+\\S*)?$', 1) || '…' end as title from t")
def txt_session_title(c):
    return _docs(c).select("id", X.session_title(F.col("text")).alias("title"))


@query("select id, case when has then presentation_type else '' end as joined from (select id, presentation_type, true as has from papers)")
def txt_join_list_field(c):
    value = F.when(F.col("id") % 2 == 0, F.to_json(F.array("presentation_type"))).otherwise(F.col("presentation_type"))
    return c.papers.select("id", X.list_field(value).alias("joined"))


@query("select id, presentation_type || '|' || title as listed from papers")
def txt_str_list(c):
    value = F.to_json(F.array(F.concat(F.lit(" "), "presentation_type"), F.lit(" "), F.col("title")))
    return c.papers.select("id", F.array_join(X.string_list(value), "|").alias("listed"))


@query("select id, title from papers")
def txt_unwrap_field(c):
    wrapped = F.when(F.col("id") % 2 == 0, F.to_json(F.struct(F.struct(F.col("title").alias("value")).alias("title")))).otherwise(F.to_json(F.struct("title")))
    return c.papers.select("id", X.unwrap(wrapped, "title").alias("title"))


@query("select id, round((citation_count * 0.075 + year * 0.30) / 1e6, 9) as cost from papers")
def txt_llm_cost(c):
    return c.papers.select("id", F.round(M.llm_cost(F.col("citation_count"), F.col("year")), 9).alias("cost"))


@query("select src, dst, a.presentation_type || case when b.presentation_type <> a.presentation_type then ';' || b.presentation_type else '' end || ';x' as names from edges join papers a on a.id = src join papers b on b.id = dst")
def txt_why_related(c):
    a, b = c.papers.select(F.col("id").alias("a"), F.col("presentation_type").alias("ka")), c.papers.select(F.col("id").alias("b"), F.col("presentation_type").alias("kb"))
    rows = c.edges.join(a, F.col("src") == F.col("a")).join(b, F.col("dst") == F.col("b"))
    return rows.select("src", "dst", F.array_join(M.why_related(F.array("ka"), F.array("kb"), F.array(F.lit("x")), F.array("ka")), ";").alias("names"))


# Feature maps.


def _features(c):
    """Categories as features; their own name is what they already say."""
    return c.categories.select(F.col("name").alias("feature_id")).distinct().withColumn("blob", M.blob(F.col("feature_id")))


def _matches(c):
    return c.categories.select(F.col("name").alias("feature_id"), "paper_id")


MISSING_SQL = "miss as (select feature_id, name, papers, row_number() over (partition by feature_id order by papers desc, name)::int as rank from (select k.name as feature_id, m.name, count(distinct k.paper_id) as papers from categories k join methodologies m using (paper_id) where not contains(lower(k.name), lower(m.name)) group by 1, 2)), kept as (select feature_id, name, papers, rank from miss where rank <= 8)"


def _missing(c):
    return M.missing_items(_matches(c), c.methodologies, _features(c))


@query("with m as (select k.name as feature_id, t.canonical_name as name, count(distinct k.paper_id) as papers from categories k join techniques t using (paper_id) where trim(t.canonical_name) <> '' and not contains(lower(k.name), lower(t.canonical_name)) group by 1, 2) select feature_id, name, papers, rank from (select *, row_number() over (partition by feature_id order by papers desc, name)::int as rank from m) where rank <= 8")
def txt_missing_techniques(c):
    """Canonical techniques of a feature's papers that its text does not hold."""
    return M.missing_items(_matches(c), c.techniques.where("trim(canonical_name) <> ''"), _features(c), "canonical_name")


@query("with i as (select paper_id, name from datasets union select paper_id, name from categories), k as (select name as feature_id, paper_id from categories), m as (select feature_id, name, count(distinct paper_id) as papers from k join i using (paper_id) where not contains(lower(feature_id), lower(name)) group by 1, 2) select feature_id, name, papers, rank from (select *, row_number() over (partition by feature_id order by papers desc, name)::int as rank from m) where rank <= 8")
def txt_eval_candidates(c):
    findings = c.categories.select("paper_id", F.concat_ws(" :: ", "name", "name", F.lit("1")).alias("finding"))
    return M.missing_items(_matches(c), M.evaluation_items(c.datasets, findings), _features(c))


EVIDENCE_SQL = f"{MISSING_SQL}, ev as (select feature_id, name, papers, row_number() over (partition by feature_id order by rank)::int as rank from (select *, max(papers) over (partition by feature_id) >= 2 as s from kept) where not s or papers >= 2)"


@query(f"with {EVIDENCE_SQL} select * from ev where rank <= 3")
def txt_evidence_filter(c):
    return M.evidence_filter(_missing(c))


@query(f"with {EVIDENCE_SQL} select feature_id, 'technique' as kind, rank, 'Consider ' || name as title, name || ' is used by ' || papers || ' of the matched papers and is not part of this feature yet.' as rationale from ev where rank <= 3")
def txt_template_recs(c):
    return M.template_recommendations(M.evidence_filter(_missing(c)), "technique")


@query(f"with {EVIDENCE_SQL} select feature_id, 'technique' as kind, rank, name from ev where rank <= 2")
def txt_build_recs(c):
    kept = M.evidence_filter(_missing(c)).withColumn("kind", F.lit("technique"))
    written = kept.where("rank <= 2").select("feature_id", "kind", F.col("rank").alias("position"), F.upper("name").alias("shout"), "name")
    wrong = written.select("feature_id", "kind", (F.col("position") + 10).alias("position"), "shout", F.lit("made up").alias("name"))
    rows = M.known_recommendations(written.withColumn("name", F.col("shout")).unionByName(wrong), kept)
    names = kept.select("feature_id", "name", F.upper("name").alias("u"))
    return rows.join(names.withColumnsRenamed({"name": "real", "feature_id": "f"}), (F.col("f") == F.col("feature_id")) & (F.col("u") == F.col("name"))).select("feature_id", "kind", "rank", F.col("real").alias("name"))


@query("select name as project_id, 1 as position, name, 'other' as category, '' as description from (select distinct name from categories)")
def txt_feature_coerce(c):
    f = F.array(F.struct(F.col("name"), F.lit("nonsense").alias("category"), F.lit(None).cast("string").alias("description")), F.struct(F.lit(" ").alias("name"), F.lit("model").alias("category"), F.lit("x").alias("description")))
    return M.coerce_features(c.categories.select("name").distinct().select(F.col("name").alias("project_id"), f.alias("features")))


@query("select name as feature_id, 1 as rank, 'about ' || name as explanation from (select distinct name from categories) union all select name, 2, null from (select distinct name from categories)")
def txt_apply_by_index(c):
    f = c.categories.select(F.col("name").alias("feature_id")).distinct()
    matches = f.select("feature_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"))
    e = f.select("feature_id", F.lit(None).cast("int").alias("paper"), F.lit(0).alias("position"), F.concat(F.lit("about "), "feature_id").alias("text"))
    return M.apply_by_index(matches, e)


@query("select name || '. ' || lower(name) || '. a b' as q from (select distinct name from categories)")
def txt_query_text(c):
    return c.categories.select("name").distinct().select(M.query_text(F.col("name"), F.lower("name"), F.array(F.lit("a"), F.lit("b"))).alias("q"))


@query("select distinct lower(name || ' ' || coalesce(canonical_name, '')) as b from categories where canonical_name is not null")
def txt_blob(c):
    return c.categories.where("canonical_name is not null").select(M.blob(F.col("name"), F.col("canonical_name")).alias("b")).distinct()


@query("select lang as feature_id, string_agg('Paper ' || rank || ': ' || source || chr(10) || substr(text, 1, 400), chr(10) || chr(10) order by rank) as prompt from (select *, row_number() over (partition by lang order by n_chars desc, doc_id) as rank from documents) where rank <= 3 group by 1")
def txt_prompt_context(c):
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    rows = c.table("documents").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select(F.col("lang").alias("feature_id"), "rank", F.col("source").alias("title"), F.col("text").alias("summary"))
    return M.prompt_context(rows)


@query("select n_regionkey as project_id, count(*) || ' features: ' || count_if(n_nationkey % 4 = 0) || ' strongly, ' || count_if(n_nationkey % 4 = 1) || ' moderately and ' || count_if(n_nationkey % 4 = 2) || ' weakly covered, ' || count_if(n_nationkey % 4 = 3) || ' novel.' || coalesce(' Novel: ' || nullif(string_agg(n_name, ', ' order by n_name) filter (n_nationkey % 4 = 3), '') || '.', '') as prose from nation group by 1")
def txt_fallback_prose(c):
    tier = F.element_at(F.array(*(F.lit(t) for t in ("strong", "moderate", "weak", "novel"))), F.col("n_nationkey") % 4 + 1)
    return M.fallback_prose(c.table("nation").select(F.col("n_regionkey").alias("project_id"), F.col("n_name").alias("name"), tier.alias("tier")))


@query("select n_regionkey as project_id, string_agg(n_nationkey || ':' || n_name, ';' order by n_nationkey) as features from nation group by 1")
def join_project_report(c):
    n = c.table("nation")
    f = n.select(F.col("n_regionkey").alias("project_id"), F.col("n_nationkey").alias("feature_id"), F.col("n_name").alias("name"), F.lit("weak").alias("tier"))
    m = n.select(F.col("n_nationkey").alias("feature_id"), F.lit(1).alias("rank"), F.col("n_nationkey").cast("long").alias("paper_id"), F.lit(1.0).alias("score"))
    r = n.select(F.col("n_nationkey").alias("feature_id"), F.lit("technique").alias("kind"), F.lit(1).alias("rank"), F.lit("t").alias("title"))
    rows = M.project_report(f, m, r, c.papers)
    return rows.select("project_id", F.array_join(F.transform("features", lambda x: F.concat(x["feature_id"].cast("string"), F.lit(":"), x["name"])), ";").alias("features"))


@query("select n_nationkey as id, null::varchar as answer, true as failed from nation")
def udf_llm(c):
    """Without a model every row fails softly, and its caller's template stands."""
    return M.call_model(c.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("prompt")), None)


@query(f"select doc_id, greatest(1, floor(coalesce(len({WORDS_SQL.format('text')}), 0) / 200 + 0.5))::bigint as minutes from documents")
def txt_reading_time(c):
    return c.table("documents").select("doc_id", X.reading_minutes(F.col("text")).alias("minutes"))


# Upserts and validation.


def _known_editions(c):
    return c.conferences.where("field <> 'ASIA'").select("id", "short_name")


@query("select id, short_name from conferences where field <> 'ASIA' union all select null, short_name from conferences where field = 'ASIA'")
def ups_conference(c):
    return U.get_or_create(_known_editions(c), c.conferences.select("short_name"), ["short_name"])


@query("with known as (select id, conference_id, year, location from editions where conference_id % 2 = 0) from known union all select distinct null, conference_id, year, null from editions where (conference_id, year) not in (select (conference_id, year) from known)")
def ups_edition(c):
    return U.get_or_create(c.editions.where("conference_id % 2 = 0"), c.editions.select("conference_id", "year"), ["conference_id", "year"])


@query("with known as (select id, full_name from authors where id % 3 = 0) from known union all select distinct null, full_name from paper_authors join authors on id = author_id where full_name not in (select full_name from known)")
def ups_author(c):
    names = c.paper_authors.join(c.authors.select(F.col("id").alias("author_id"), "full_name"), "author_id").select("full_name")
    return U.get_or_create(c.authors.where("id % 3 = 0").select("id", "full_name"), names, ["full_name"])


UP_SQL = "old as (select id, title, year, abstract from papers where presentation_type <> 'oral'), inc as (select id as row, title, year, 'new ' || title as abstract from papers where presentation_type in ('oral', 'poster'))"


def _upsert_tables(c):
    p = c.papers
    none = F.lit(None).cast("string")
    old = p.where("presentation_type <> 'oral'").select("id", none.alias("openreview_id"), none.alias("s2_id"), "title", "year", "abstract")
    inc = p.where("presentation_type in ('oral', 'poster')").select(F.col("id").alias("row"), none.alias("openreview_id"), none.alias("s2_id"), "title", "year", F.concat(F.lit("new "), "title").alias("abstract"))
    return old, inc


@query(f"with {UP_SQL} select coalesce(o.title, i.title) as title, coalesce(o.year, i.year) as year, coalesce(i.abstract, o.abstract) as abstract, o.id is null as created from old o full join inc i on o.title = i.title and o.year = i.year")
def ups_paper(c):
    old, inc = _upsert_tables(c)
    return U.upsert_papers(old, inc, ["abstract"]).select("title", "year", "abstract", "created")


@query("select paper_id, author_id, position from paper_authors where position > 1 union all select paper_id, author_id, row_number() over (partition by paper_id order by author_id) from paper_authors where position = 1")
def ups_paper_authors(c):
    have = c.paper_authors.where("position > 1")
    inc = c.paper_authors.where("position = 1").groupBy("paper_id").agg(F.array_sort(F.collect_list("author_id")).alias("authors"))
    return U.link_authors(have, inc)


@query("select id, case when length('Summary ' || title) >= length(coalesce(abstract, '')) or abstract is null then 'Summary ' || title else abstract end as summary from papers")
def ups_analysis(c):
    table = c.papers.select("id", F.col("abstract").alias("summary"))
    return U.merge(table, c.papers.select("id", F.concat(F.lit("Summary "), "title").alias("summary")), ["id"], longer=["summary"])


@query("select paper_id, name, case when role = 'compares' then 'uses' else role end as role from techniques")
def ups_techniques(c):
    t = c.techniques.select("paper_id", "name", "role")
    return U.merge_techniques(t, t.where("role = 'compares'").withColumn("role", F.lit("uses")))


@query("select paper_id, name, name as task from datasets")
def ups_datasets(c):
    table = c.datasets.select("paper_id", "name", F.lit(None).cast("string").alias("task"))
    return U.merge(table, c.datasets.select("paper_id", "name", F.col("name").alias("task")), ["paper_id", "name"])


@query("select paper_id, name, confidence from categories")
def ups_categories(c):
    table = c.categories.where("confidence > 0.95").select("paper_id", "name", "confidence")
    return U.merge(table, c.categories.select("paper_id", "name", "confidence"), ["paper_id", "name"], insert_only=True)


@query("select id, case when presentation_type = 'oral' then 999 else citation_count end as citation_count, true as stamped from papers")
def ups_enrich(c):
    found = c.papers.where("presentation_type = 'oral'").select("id", F.lit(999).cast("long").alias("citation_count"))
    out = U.stamp(c.papers.select("id", "citation_count").withColumn("last_enriched_at", F.lit(None).cast("timestamp")), found, "id", "citation_count", "last_enriched_at", F.current_timestamp())
    return out.select("id", "citation_count", F.col("last_enriched_at").isNotNull().alias("stamped"))


@query("select distinct edition_id from papers p where created_at > (select max(created_at) from papers q where q.edition_id = p.edition_id and q.presentation_type = 'oral')")
def join_latest_gt(c):
    done = c.papers.where("presentation_type = 'oral'").select("edition_id", F.col("created_at").alias("at"))
    return U.stale_groups(done, c.papers.select("edition_id", F.col("created_at").alias("at")), "edition_id")


@query("with r as (select edition_id as group_id from papers group by 1 having count_if(presentation_type = 'workshop') = 0 and count_if(presentation_type = 'oral') > 0) select group_id, prompt from r, (select unnest(['summary', 'techniques']) as prompt) where not (prompt = 'summary' and group_id % 2 = 0)")
def flt_state_gate_synth(c):
    status = F.when(F.col("presentation_type") == "workshop", "pending").when(F.col("presentation_type") == "oral", "uploaded").otherwise("error")
    items = c.papers.select(F.col("edition_id").alias("group_id"), status.alias("status"))
    answered = c.editions.where("id % 2 = 0").select(F.col("id").alias("group_id"), F.lit("summary").alias("prompt"))
    return U.ready_groups(items, answered, ["summary", "techniques"])


@query("select distinct paper_id from techniques where canonical_name is null")
def flt_state_gate_extract(c):
    return c.techniques.where("canonical_name is null").select("paper_id").distinct()


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def val_unique(c):
    return U.unique_violations(c.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment <> 'BUILDING')")
def val_foreign_key(c):
    return U.foreign_key_violations(c.table("orders").select("o_orderkey", "o_custkey"), "o_custkey", c.table("customer").where("c_mktsegment <> 'BUILDING'"), "c_custkey")


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus not in ('F', 'O')")
def val_constraints(c):
    return U.check_violations(c.table("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O"])


@query(f"select doc_id, case when length(text) > 50000 then 'too_long' when len({WORDS_SQL.format('text')}) < 50 then 'too_short' else 'ok' end as status from documents")
def val_request_limits(c):
    return U.request_status(c.table("documents")).select("doc_id", "status")


# Sources and sinks.


@query("select o_orderkey as id, 'https://aclanthology.org/' || o_orderkey || '.pdf' as url, 'acl_anthology' as source from orders where o_orderstatus = 'F' union all select o_orderkey, 'https://arxiv.org/pdf/' || o_orderkey, 'arxiv' from orders where o_orderstatus = 'O' union all select o_orderkey, 'u' || o_orderkey, 'pdf_url' from orders where o_orderstatus = 'P'")
def src_pdf_url_choice(c):
    o, key = c.table("orders"), F.col("o_orderkey").cast("string")
    url, source = readers.pdf_url(F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("10.18653/v1/"), key)), F.when(F.col("o_orderstatus") == "O", key), F.concat(F.lit("u"), key))
    return o.select(F.col("o_orderkey").alias("id"), url.alias("url"), source.alias("source"))


@query("select * from (values ('NeurIPS', 2022), ('NeurIPS', 2023), ('ACL', 2023)) v(conference, year)")
def src_conf_config(c):
    return readers.venue_catalogue(c.spark, {"NeurIPS": [2022, 2023], "ACL": [2023]})


@query("select r_regionkey, r_name from region union all select 99, 'ATLANTIS'")
def src_seed_values(c):
    return readers.seed(c.table("region"), [(99, "ATLANTIS"), (1, "AGAIN")], ["r_regionkey"])


@query("select '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' as json from region")
def snk_json_stdout(c):
    return writers.json_lines(c.table("region"))


@query("select 'UPDATE paper_techniques SET canonical_name = NULL WHERE paper_id = ''' || paper_id || ''' AND name = ''' || replace(name, '''', '''''') || ''';' as statement from techniques where canonical_name is not null")
def snk_rollback_sql(c):
    return writers.rollback_sql(c.techniques.where("canonical_name is not null"))


# Windows over events, as batches; streams give the same rows.


@query("select time_bucket(interval '1 hour', ts) as start, time_bucket(interval '1 hour', ts) + interval '1 hour' as end, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def str_windows(c):
    return streams.windowed(c.table("events"), "1 hour")


@query("""select s as start, s + interval '2 hours' as end, event_type, count(*) as n, round(sum(value), 4) as total from (select *, unnest([time_bucket(interval '1 hour', ts), time_bucket(interval '1 hour', ts) - interval '1 hour']) as s from events) group by all""")
def str_windows_sliding(c):
    return streams.windowed(c.table("events"), "2 hours", "1 hour")


@query("""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as new_ from events), s as (select *, sum(new_) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select min(ts) as start, max(ts) + interval '30 minutes' as end, user_id, count(*) as n, round(sum(value), 4) as total from s group by user_id, k""")
def str_windows_session(c):
    return streams.sessions(c.table("events"), "30 minutes")


@query("select user_id, arg_max(event_type, (ts, event_id)) as event_type, max(ts) as ts from events group by 1")
def str_upload_state(c):
    rows = streams.latest_state(c.table("events").select("user_id", "event_type", "ts", "event_id"), "user_id", F.struct("ts", "event_id"))
    return rows.select("user_id", "event_type", "ts")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def str_resume(c):
    return streams.unprocessed(c.table("documents").select("doc_id"), c.table("labels"), "doc_id")
