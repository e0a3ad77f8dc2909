"""Filters, projections, joins, sorting and paging over papers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNIPPET = 300
#: Sort orders by name; each ends in the id, so pages are stable.
SORTS = {
    "citations_desc": lambda: [F.col("citation_count").desc_nulls_last()],
    "citations_asc": lambda: [F.col("citation_count").asc_nulls_last()],
    "year_desc": lambda: [F.col("year").desc_nulls_last()],
    "year_asc": lambda: [F.col("year").asc_nulls_last()],
    "title_asc": lambda: [F.col("title").asc_nulls_last()],
    "centrality_desc": lambda: [F.col("degree_centrality").desc_nulls_last()],
}


def contains_ci(column: Column | str, term: str) -> Column:
    """The column holds ``term``, whatever the case; the term has no wildcards."""
    return F.contains(F.lower(F.col(column) if isinstance(column, str) else column), F.lit(term.lower()))


def equals_ci(column: str, value: str) -> Column:
    return F.lower(F.col(column)) == value.lower()


def in_list_ci(column: str, values: Sequence[str]) -> Column:
    return F.lower(F.col(column)).isin([v.lower() for v in values])


def base_papers(papers: DataFrame, editions: DataFrame, conferences: DataFrame, metrics: DataFrame) -> DataFrame:
    """Papers with their edition, conference and metrics; each may be missing."""
    e = editions.select(F.col("id").alias("_e"), "conference_id", F.col("year").alias("edition_year"))
    c = conferences.select(F.col("id").alias("_c"), F.col("short_name").alias("conference"), "field")
    m = metrics.withColumnRenamed("paper_id", "_m")
    out = papers.join(e, papers["edition_id"] == e["_e"], "left").join(c, F.col("conference_id") == c["_c"], "left")
    return out.join(m, out["id"] == m["_m"], "left").drop("_e", "_c", "_m")


def filter_papers(
    rows: DataFrame, *, title: str | None = None, conference: str | None = None, field: str | None = None, year: int | None = None, cluster: int | None = None,
    min_citations: int | None = None, max_citations: int | None = None, presentation_type: str | None = None, has_pdf: bool | None = None,
    technique: str | None = None, techniques: DataFrame | None = None, analysed: DataFrame | None = None,
) -> DataFrame:
    """Rows of :func:`base_papers` that meet every condition given."""
    conditions = [
        title is not None and contains_ci("title", title), conference is not None and equals_ci("conference", conference), field is not None and equals_ci("field", field),
        year is not None and F.col("edition_year") == year, cluster is not None and F.col("cluster_id") == cluster, min_citations is not None and F.col("citation_count") >= min_citations,
        max_citations is not None and F.col("citation_count") <= max_citations, presentation_type is not None and F.col("presentation_type") == presentation_type,
        has_pdf is not None and (F.col("pdf_path").isNotNull() if has_pdf else F.col("pdf_path").isNull()),
    ]
    for c in conditions:
        if c is not False:
            rows = rows.where(c)
    if technique is not None:
        found = techniques.where(contains_ci(F.coalesce("canonical_name", "name"), technique)).select(F.col("paper_id").alias("_p"))
        rows = rows.join(found, rows["id"] == found["_p"], "left_semi")
    if analysed is not None:
        found = analysed.select(F.col("paper_id").alias("_p"))
        rows = rows.join(found, rows["id"] == found["_p"], "left_semi")
    return rows


def sort_papers(rows: DataFrame, sort: str = "citations_desc") -> DataFrame:
    """Sorted by a known key, or by citations if the key isn't known."""
    return rows.orderBy(*SORTS.get(sort, SORTS["citations_desc"])(), "id")


def first_papers(papers: DataFrame, editions: DataFrame, conferences: DataFrame, metrics: DataFrame, sort: str, k: int) -> DataFrame:
    """The first ``k`` rows of :func:`sort_papers` over :func:`base_papers`, of which only papers that can be among them are joined.

    The joins lose no paper, so the first rows are of papers whose own sort key is among the
    first ``k``; only a key that metrics hold has to be looked up for all.
    """
    keyed = papers
    if sort == "centrality_desc":
        # Merged, as a table that is small on disk can be a large one in every task's memory.
        keyed = papers.select("id").join(metrics.select(F.col("paper_id").alias("_m"), "degree_centrality").hint("merge"), F.col("id") == F.col("_m"), "left")
    ids = F.broadcast(sort_papers(keyed, sort).limit(k).select(F.col("id").alias("_id")).distinct())
    few = papers.join(ids, F.col("id") == F.col("_id"), "left_semi")
    e = editions.join(F.broadcast(few.select(F.col("edition_id").alias("_e"))), F.col("id") == F.col("_e"), "left_semi")
    m = metrics.join(ids, F.col("paper_id") == F.col("_id"), "left_semi")
    return sort_papers(base_papers(few, F.broadcast(e), conferences, F.broadcast(m)), sort).limit(k)


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of sorted rows."""
    return rows.offset((number - 1) * size).limit(size)


def page_with_total(rows: DataFrame, sort: str, number: int, size: int) -> DataFrame:
    """A page and on each row the number of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    return page(sort_papers(rows, sort), number, size).crossJoin(F.broadcast(total))


def top_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank from 1."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def top_techniques(techniques: DataFrame, k: int = 3) -> DataFrame:
    """For each paper its ``k`` techniques that most papers have, as an array."""
    named = techniques.select("paper_id", F.coalesce("canonical_name", "name").alias("technique")).distinct()
    used = named.groupBy("technique").agg(F.count("*").alias("n"))
    best = top_per_group(named.join(used, "technique"), ["paper_id"], [F.col("n").desc(), F.col("technique")], k)
    return best.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "technique"))), lambda x: x["technique"]).alias("top_techniques"))


def primary_category(categories: DataFrame) -> DataFrame:
    """For each paper the category of highest confidence; ties go to the larger name."""
    name = F.coalesce("canonical_name", "name")
    return categories.groupBy("paper_id").agg(F.max_by(name, F.struct(F.col("confidence"), name)).alias("primary_category"))


def paper_summary(base: DataFrame, techniques: DataFrame, categories: DataFrame) -> DataFrame:
    """What a list shows of each paper."""
    out = base.join(top_techniques(techniques).withColumnRenamed("paper_id", "_t"), F.col("id") == F.col("_t"), "left")
    out = out.join(primary_category(categories).withColumnRenamed("paper_id", "_c"), F.col("id") == F.col("_c"), "left")
    return out.select(
        "id", "title", F.coalesce("edition_year", "year").alias("year"), "conference", "presentation_type", F.coalesce("citation_count", F.lit(0)).alias("citation_count"),
        F.coalesce("is_open_access", F.lit(False)).alias("is_open_access"), F.col("pdf_path").isNotNull().alias("has_pdf"), F.nullif(F.substring("abstract", 1, SNIPPET), F.lit("")).alias("abstract_snippet"),
        "cluster_id", F.round("degree_centrality", 6).alias("degree_centrality"), F.coalesce("top_techniques", F.array().cast("array<string>")).alias("top_techniques"), "primary_category",
    )


def paper_detail(base: DataFrame, authors: DataFrame, paper_authors: DataFrame, techniques: DataFrame, datasets: DataFrame, categories: DataFrame, methodologies: DataFrame) -> DataFrame:
    """Each paper with its ordered lists; every list is made by one aggregate."""
    pa = paper_authors.join(authors, paper_authors["author_id"] == authors["id"]).groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("position", "author_id", "full_name"))).alias("authors"))
    tech = techniques.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("role", "name", "canonical_name"))).alias("techniques"))
    data = datasets.groupBy("paper_id").agg(F.array_sort(F.collect_set("name")).alias("datasets"))
    cats = categories.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "name"))), lambda x: F.struct(x["name"].alias("name"), (-x["c"]).alias("confidence"))).alias("categories"))
    meth = methodologies.groupBy("paper_id").agg(F.array_sort(F.collect_set("name")).alias("methodologies"))
    out = base
    for part in (pa, tech, data, cats, meth):
        part = part.withColumnRenamed("paper_id", "_p")
        out = out.join(part, out["id"] == part["_p"], "left").drop("_p")
    return out


#: List fields of an analysis, as they are stored: JSON arrays of strings.
ANALYSIS_LISTS = ["strengths", "limitations", "practical_applications", "future_research_directions"]


def with_analysis(detail: DataFrame, analyses: DataFrame) -> DataFrame:
    """``detail`` with a struct ``analysis``, null for papers without one.

    ``analyses`` (paper_id, summary, methodology, experimental_findings, ANALYSIS_LISTS, model) has
    JSON in all but summary, methodology and model. What is no JSON array is an empty list; items that are null or empty are left
    out, as are findings without a benchmark. Of a paper's analyses the one of the greatest model name counts.
    """
    strings = lambda c: F.filter(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")), lambda x: F.coalesce(F.trim(x), F.lit("")) != "").alias(c)
    finding = "array<struct<benchmark: string, metric: string, scores: string>>"
    found = F.filter(F.coalesce(F.from_json("experimental_findings", finding), F.array().cast(finding)), lambda x: F.coalesce(x["benchmark"], F.lit("")) != "").alias("experimental_findings")
    one = analyses.select(F.col("paper_id").alias("_p"), F.struct("model", "summary", "methodology", found, *map(strings, ANALYSIS_LISTS)).alias("analysis"))
    one = one.groupBy("_p").agg(F.max_by("analysis", "analysis.model").alias("analysis"))
    return detail.join(one, detail["id"] == one["_p"], "left").drop("_p")


def unprocessed_top(papers: DataFrame, done: Sequence[DataFrame], limit: int = 30) -> DataFrame:
    """The most cited papers with a pdf_url that none of ``done`` has."""
    rows = papers.where(F.coalesce("pdf_url", F.lit("")) != "")
    for d in done:
        d = d.select(F.col("paper_id").alias("_p"))
        rows = rows.join(d, rows["id"] == d["_p"], "left_anti")
    return rows.orderBy(F.col("citation_count").desc_nulls_last(), "id").limit(limit)


def select_top_pending(papers: DataFrame, limit: int, force: bool = False) -> DataFrame:
    """The most cited papers without a local file (or of all, if forced)."""
    rows = papers if force else papers.where("pdf_path is null")
    return rows.orderBy(F.col("citation_count").desc_nulls_last(), "id").limit(limit)


def not_in(rows: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key is not in another table; null keys stay."""
    ids = other.select(F.col(other_key).alias("_k"))
    return rows.join(ids, rows[key] == ids["_k"], "left_anti")


def presentation_type(venue: Column) -> Column:
    """A venue's text to the kind of presentation; the first that fits."""
    v = F.lower(venue)
    out = F.when(F.contains(v, F.lit("oral")), "oral")
    for kind in ("spotlight", "poster", "workshop"):
        out = out.when(F.contains(v, F.lit(kind)), kind)
    return out.otherwise("other")


def accepted(venue: Column) -> Column:
    """The venue says that the paper was taken."""
    v = F.lower(F.coalesce(venue, F.lit("")))
    return (F.trim(v) != "") & ~v.rlike("submitted|withdrawn|rejected")


def year_window(a: str, b: str, years: int = 1) -> Column:
    return F.abs(F.col(a) - F.col(b)) <= years


def neighbours(edges: DataFrame, node) -> DataFrame:
    """(neighbour, weight) of one node of undirected edges."""
    a = edges.where(F.col("src") == node).select(F.col("dst").alias("neighbour"), "weight")
    return a.unionByName(edges.where(F.col("dst") == node).select(F.col("src").alias("neighbour"), "weight"))


def importance(nodes: DataFrame, edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The ``k`` nodes of most 0.7 * degree + 0.3 * betweenness, and the edges among them."""
    top = nodes.withColumn("importance", F.round(0.7 * F.col("degree_centrality") + 0.3 * F.col("betweenness_centrality"), 6)).orderBy(F.desc("importance"), "paper_id").limit(k)
    return top, induced(edges, top.select("paper_id"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes`` (one column)."""
    ids = nodes.toDF("_n")
    return edges.join(ids, edges["src"] == ids["_n"], "left_semi").join(ids, edges["dst"] == ids["_n"], "left_semi")
