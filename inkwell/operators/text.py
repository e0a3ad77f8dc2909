"""Cleaning, segmenting and parsing of document text, in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Section names and the headings that stand for them.
SECTIONS = {
    "abstract": r"abstract",
    "introduction": r"introduction",
    "related_work": r"related\s+work|literature\s+review|prior\s+work",
    "methodology": r"method(?:ology|s)?|approach|proposed\s+(?:method|model|framework|approach)|technical\s+approach",
    "experiments": r"experiment(?:s|al\s+(?:setup|evaluation|results?|details?))?|evaluation|empirical\s+(?:study|evaluation|results?)|(?:experimental\s+)?(?:setup|settings?|protocol)|benchmarks?",
    "results": r"results?|findings|quantitative\s+(?:analysis|results?)|performance\s+(?:analysis|evaluation)|main\s+results?",
    "discussion": r"discussion|analysis|(?:error|failure)\s+analysis",
    "conclusion": r"conclusions?\s*(?:and\s+future\s+work)?|summary(?:\s+and\s+conclusions?)?",
    "limitations": r"limitations?|failure\s+cases?|broader\s+impact|scope",
    "future_work": r"future\s+(?:work|directions?)|open\s+(?:problems?|questions?)",
}
NUMBERING = r"(?:\d+(?:\.\d+)*\.?\s+)?"
CONCLUSION_ENDS = [
    (r"(?is)\n\s*(?:acknowledgem?ents?|author\s+contributions?|ethical|funding|appendix).*", 0),
    (r"(?is)[.!?]\s+(?:acknowledgem?ents?|author\s+contributions?|ethical\s+considerations?|funding|disclosure\s+of\s+funding|appendix)\b.*", 1),
    (r"(?is)(?m:^)\s*(?:(?:\d+\.?\s*)?(?:ethical\s+considerations?|ethics|broader\s+impact)|(?:\d+\.?\s*)?acknowledgem?ents?|(?:\d+\.?\s*)?(?:funding|disclosure\s+of\s+funding)|(?:\d+\.?\s*)?appendix|author\s+contributions?|references?)\b.*", 0),
]
RESULTS_START = r"(?i)\n(?=\s*(?:(?:table|figure|tab\.)\s*\d|we\s+(?:report|present|show|observe)|(?:main\s+)?results?|performance\s+(?:of|on)|(?:our\s+)?(?:model|method|approach)\s+(?:achieves?|outperforms?|surpasses?)))"
CONTEXT_CAPS = [("abstract", 800), ("methodology", 1200), ("experiments", 700), ("results", 800), ("conclusion", 400), ("limitations", 300), ("future_work", 200)]
HIGH_VALUE = ["abstract", "conclusion", "experiments", "methodology", "results"]
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st"}
SIMPLE_SECTIONS = [
    (r"^abstract\b", "abstract"), (r"^1\.?\s+introduction\b", "introduction"), (r"^related\s+work\b", "related_work"),
    (r"^(2|3|4)\.?\s+.*(method|approach|model|framework|architecture)\b", "methodology"), (r"^(3|4|5)\.?\s+experiment", "experiments"),
    (r"^(4|5|6)\.?\s+result", "results"), (r"^discussion\b", "discussion"), (r"^conclusion\b", "conclusion"), (r"^limitation\b", "limitations"), (r"^future\b", "future_work"),
]
CATEGORIES = ["LLM", "Vision", "Multimodal", "Agentic-AI", "Safety", "Efficiency", "NLP", "RL", "Theory", "Graph", "Biomedical", "Robotics", "Code", "Retrieval", "Generative"]
CITATION = r"\s*\[\d+(?:[,\s]\d+)*\]\s*"
#: Words from which an embedded results part, a fallback abstract or conclusion counts.
RESULTS_WORDS, ABSTRACT_WORDS, CONCLUSION_WORDS, LEAST_CONCLUSION, LEAST_SECTION = 50, 600, 600, 40, 15


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(split_words(text)), F.lit(0))


def truncate_words(text: Column, n: int | Column) -> Column:
    """The first ``n`` words and a mark, or the text as it is if it has no more."""
    words = split_words(text)
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.size(words) <= n, text).otherwise(F.concat(F.array_join(F.slice(words, F.lit(1), n), " "), F.lit("\n[truncated]")))


def clean_pdf(text: Column) -> Column:
    """Ligatures spelt out; page numbers, running heads and the bibliography cut; blank lines collapsed."""
    for a, b in LIGATURES.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.regexp_replace(text, r"(?m)^\s*\d{1,3}\s*$", "")
    text = F.regexp_replace(text, r"(?im)^\s*(Preprint\.|Under review|NeurIPS\s+\d{4}|ICML\s+\d{4}|ICLR\s+\d{4}|Published as a|Advances in Neural Information|\d{1,4}\s*$)", "")
    text = F.regexp_replace(text, r"(?is)\nReferences\s*\n.*", "")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def has_equations(text: Column) -> Column:
    """More than 30 mathematical signs."""
    return F.length(F.regexp_replace(text, "[^∀-⋿×·]", "")) > 30


def header_key(header: Column) -> Column:
    """The section that a heading stands for, without its number; else 'other'."""
    bare = F.lower(F.trim(F.regexp_replace(header, r"^\s*\d+(?:\.\d+)*\.?\s+", "")))
    out = None
    for key, pattern in SECTIONS.items():
        test = bare.rlike(f"^(?:{pattern})$")
        out = F.when(test, key) if out is None else out.when(test, key)
    return out.otherwise("other")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def trim_conclusion(text: Column) -> Column:
    """Without acknowledgements and the like: the shortest of the cuts that leaves 20 words or more."""
    cuts = [text]
    for pattern, keep in CONCLUSION_ENDS:
        found = F.regexp_extract(text, pattern, 0)
        cuts.append(F.when(found != "", _strip(F.substring(text, F.lit(1), F.length(text) - F.length(found) + keep))))
    kept = F.filter(F.array(*cuts), lambda c: c.isNotNull() & (F.size(split_words(c)) >= 20))
    best = F.array_sort(F.transform(kept, lambda c: F.struct(F.length(c).alias("n"), c.alias("c"))))
    return F.coalesce(F.get(best, F.lit(0))["c"], text)


def segment(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """One row per document: its sections as columns, sections_found and word_count.

    A line that is a section's heading begins that section, once; it ends at the next.
    Results within the experiments are split off, and a long document without abstract or
    conclusion gets its first or last words for it.
    """
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("n", "line"))
    lines = lines.withColumn("k", header_key(F.trim("line")))
    first = Window.partitionBy(key, "k").orderBy("n")
    lines = lines.withColumn("_r", F.row_number().over(first))
    lines = lines.withColumn("head", F.when((F.col("k") != "other") & (F.col("_r") == 1), F.col("k")))
    sofar = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.last("head", ignorenulls=True).over(sofar)).where("section is not null and head is null")
    body = lines.groupBy(key, "section").agg(F.min("n").alias("at"), _strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")).alias("body")).where("body <> ''")
    body = body.withColumn("body", F.when(F.col("section") == "conclusion", trim_conclusion(F.col("body"))).otherwise(F.col("body")))
    found = body.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("section", "body"))).alias("m"), F.transform(F.array_sort(F.collect_list(F.struct("at", "section"))), lambda x: x["section"]).alias("sections_found"))
    out = docs.select(key, F.coalesce(text, F.lit("")).alias("_t")).join(found, key, "left")
    out = out.select(key, "_t", F.coalesce("sections_found", F.array().cast("array<string>")).alias("sections_found"), *(F.col("m")[s].alias(s) for s in SECTIONS))

    # A boundary is the first at or beyond 30 percent of the experiments.
    cutoff = F.floor(F.length("experiments") * 0.3)
    rest = F.substring("experiments", cutoff + 1, F.length("experiments"))
    head = F.get(F.split(rest, RESULTS_START), F.lit(0))
    at = cutoff + F.length(head)
    tail, front = _strip(F.substring("experiments", at + 1, F.length("experiments"))), _strip(F.substring("experiments", F.lit(1), at))
    splits = F.col("results").isNull() & F.col("experiments").isNotNull() & (at < F.length("experiments")) & (front != "") & (word_count(tail) >= RESULTS_WORDS)
    out = out.withColumn("_s", F.coalesce(splits, F.lit(False)))
    out = out.withColumns({"results": F.when(F.col("_s"), tail).otherwise(F.col("results")), "experiments": F.when(F.col("_s"), front).otherwise(F.col("experiments")), "sections_found": F.when(F.col("_s"), F.array_append("sections_found", F.lit("results_from_experiments"))).otherwise(F.col("sections_found"))})
    no_abstract = F.col("abstract").isNull() & (F.length("_t") > 500)
    words = split_words(F.col("_t"))
    last = trim_conclusion(F.array_join(F.slice(words, -CONCLUSION_WORDS, CONCLUSION_WORDS), " "))
    no_end = F.col("conclusion").isNull() & (F.size(words) > CONCLUSION_WORDS)
    no_end = no_end & (word_count(F.when(no_end, last)) >= LEAST_CONCLUSION)
    sections = F.when(no_abstract & ~F.array_contains("sections_found", "abstract"), F.array_prepend("sections_found", F.lit("abstract_fallback"))).otherwise(F.col("sections_found"))
    out = out.withColumn("sections_found", sections).withColumn("sections_found", F.when(no_end, F.array_append("sections_found", F.lit("conclusion_fallback"))).otherwise(F.col("sections_found")))
    return out.withColumns({"abstract": F.when(no_abstract, truncate_words(F.col("_t"), ABSTRACT_WORDS)).otherwise(F.col("abstract")), "conclusion": F.when(no_end, last).otherwise(F.col("conclusion")), "word_count": word_count(F.col("_t"))}).drop("_t", "_s")


def segment_simple(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, section, body) by short lines that look like headings; a later section of one name replaces an earlier."""
    h = F.lower(F.trim("line"))
    kind = F.lit(None).cast("string")
    for pattern, name in reversed(SIMPLE_SECTIONS):
        kind = F.when(h.rlike(pattern), name).otherwise(kind)
    kind = F.when((F.length(F.trim("line")) < 80) & ~F.trim("line").endswith("."), kind)
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("n", "line")).withColumn("head", kind)
    sofar = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"section": F.last("head", ignorenulls=True).over(sofar), "start": F.last(F.when(F.col("head").isNotNull(), F.col("n")), ignorenulls=True).over(sofar)})
    body = lines.where("section is not null and head is null").groupBy(key, "section", "start").agg(_strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.trim("line").alias("line")))), lambda x: x["line"]), "\n")).alias("body"))
    return body.where("body <> ''").groupBy(key, "section").agg(F.max_by("body", "start").alias("body"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often it is used: a lambda's variable, not its expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def llm_context(sections: DataFrame, budget: int = 4000) -> Column:
    """The sections of most value under their caps, until the budget has 50 words or fewer left."""
    parts = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(cap).alias("cap"), F.coalesce(F.col(s), F.lit("")).alias("t")) for s, cap in CONTEXT_CAPS))
    empty = F.struct(F.lit(0).alias("used"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        room = F.least(x["cap"], F.lit(budget) - acc["used"])
        chunk = truncate_words(x["t"], room)
        heading = F.concat(F.lit("=== "), F.upper(F.replace(x["s"], F.lit("_"), F.lit(" "))), F.lit(" ===\n"))
        added = _once(chunk, lambda c: F.struct((acc["used"] + word_count(c)).alias("used"), F.lit(False).alias("done"), F.array_append(acc["out"], F.concat(heading, c)).alias("out")))
        return F.when(acc["done"] | (x["t"] == ""), acc).when(room <= 50, F.struct(acc["used"].alias("used"), F.lit(True).alias("done"), acc["out"].alias("out"))).otherwise(added)

    return F.aggregate(parts, empty, step, lambda acc: F.array_join(acc["out"], "\n\n"))


def quality_report(found: Column) -> dict[str, Column]:
    """Coverage of the sections of most value, from sections_found."""
    known = F.transform(found, lambda s: F.replace(F.replace(s, F.lit("_fallback"), F.lit("")), F.lit("_from_experiments"), F.lit("")))
    high = F.array(*(F.lit(s) for s in HIGH_VALUE))
    have = F.array_sort(F.array_intersect(high, known))
    return {"high_value_found": have, "high_value_missing": F.array_sort(F.array_except(high, known)), "coverage_pct": F.round(100.0 * F.size(have) / len(HIGH_VALUE)).cast("int")}


# Markdown.


def strip_chrome(text: Column) -> Column:
    """Without code fences, rules, images and comments."""
    text = F.regexp_replace(text, r"(?s)(```|~~~).*?\1", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?m)^\s*([-*_])[ \t]*(\1[ \t]*){2,}$\n?", "")
    return _strip(F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", ""))


def markdown_title(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, r"(?m)^#\s+(.+?)\s*#*\s*$", 1)), F.lit(""))


def markdown_sections(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, position, heading, body) of sections with 15 words or more; a document without headings is one section."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("n", "line"))
    head = F.nullif(F.trim(F.regexp_extract("line", r"^#{1,3}\s+(.+?)\s*#*\s*$", 1)), F.lit(""))
    lines = lines.withColumn("heading", head).withColumn("position", F.count("heading").over(Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    rows = lines.groupBy(key, "position").agg(F.max("heading").alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("heading").isNull(), F.struct("n", "line")))), lambda x: x["line"]), "\n").alias("raw"))
    rows = rows.withColumn("body", strip_chrome(F.col("raw"))).withColumn("_n", F.max("position").over(Window.partitionBy(key)))
    return rows.where((word_count(F.col("body")) >= LEAST_SECTION) | ((F.col("_n") == 0) & (F.col("body") != ""))).select(key, "position", "heading", "body")


# Answers in blocks of labelled lines.

LABELS = ["PAPER", "SUMMARY", "ADVANTAGE", "LIMITATION", "FUTURE_WORK", "INTRODUCES", "USES", "DATASET", "CATEGORIES", "METHODOLOGY", "USE_CASE", "STRENGTH", "FINDING", "APPLICATION", "DIRECTION"]


def blocks(answers: DataFrame, key: str = "answer_id", text: str = "answer") -> DataFrame:
    """(answer_id, block, title, lines) of the blocks that begin with PAPER:."""
    rows = answers.select(key, F.posexplode(F.split(text, r"\n===+\n?")).alias("block", "raw"))
    rows = rows.withColumn("lines", F.filter(F.transform(F.split("raw", "\n"), lambda x: F.rtrim(x)), lambda x: F.trim(x) != ""))
    first = F.get("lines", F.lit(0))
    return rows.where(F.startswith(first, F.lit("PAPER:"))).select(key, "block", F.trim(F.substring(first, F.lit(7), F.length(first))).alias("title"), "lines")


def strip_citations(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, CITATION, ""))


def labelled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, label, value): a block's lines with their label; lines without one go on with the label before."""
    lines = rows.select(*keys, F.posexplode("lines").alias("n", "line"))
    label = F.nullif(F.regexp_extract("line", rf"^({'|'.join(LABELS)}):", 1), F.lit(""))
    sofar = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(label.isNotNull(), F.trim(F.regexp_replace("line", r"^[A-Z_]+:", ""))).otherwise(F.col("line"))
    return lines.select(*keys, "n", F.last(label, ignorenulls=True).over(sofar).alias("label"), label.isNotNull().alias("own"), value.alias("value"))


def pipe_list(value: Column) -> Column:
    """Items between pipes, without citation marks, empty items and NONE."""
    return F.filter(F.transform(F.split(value, r"\|"), strip_citations), lambda v: (v != "") & (F.upper(v) != "NONE"))


def triple(value: Column) -> Column:
    """'benchmark :: metric :: scores' to a struct; missing parts are empty."""
    parts = F.split(value, " :: ", 3)
    at = lambda i: F.trim(F.coalesce(F.get(parts, F.lit(i)), F.lit("")))
    return F.struct(at(0).alias("benchmark"), at(1).alias("metric"), at(2).alias("scores"))


def extract_fields(answers: DataFrame, key: str = "answer_id", text: str = "answer") -> DataFrame:
    """One row per block: prose fields joined, list fields split, findings as structs."""
    found = labelled(blocks(answers, key, text), [key, "block", "title"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.upper("value") != "NONE") & (F.col("value") != ""), F.struct("n", "value")))), lambda x: x["value"]), " ")
    per = found.groupBy(key, "block", "title", "label").agg(strip_citations(joined).alias("prose"), F.min_by("value", F.when(F.col("own"), F.col("n"))).alias("first"), F.transform(F.array_sort(F.collect_list(F.when(F.col("own"), F.struct("n", "value")))), lambda x: strip_citations(x["value"])).alias("all"))
    at = lambda label, c: F.max_by(c, F.when(F.col("label") == label, 1))
    lists = {x: pipe_list(at(x.upper(), "first")).alias(x) for x in ("introduces", "uses", "categories", "advantage", "limitation", "future_work")}
    real = lambda c: F.filter(c, lambda v: (v != "") & (F.upper(v) != "NONE"))
    out = per.groupBy(key, "block", "title").agg(at("SUMMARY", "prose").alias("summary"), at("METHODOLOGY", "prose").alias("methodology"), *lists.values(), real(at("DATASET", "all")).alias("_d"), real(at("FINDING", "all")).alias("_f"), real(at("USE_CASE", "all")).alias("use_cases"), real(at("STRENGTH", "all")).alias("strengths"))
    known = F.array(*(F.lit(c) for c in CATEGORIES))
    data = F.transform("_d", lambda x: F.struct(F.trim(F.split_part(x, F.lit(" :: "), F.lit(1))).alias("name"), F.trim(F.coalesce(F.get(F.split(x, " :: ", 2), F.lit(1)), F.lit(""))).alias("task")))
    return out.withColumn("categories", F.filter("categories", lambda c: F.array_contains(known, c))).withColumn("datasets", data).withColumn("findings", F.transform("_f", triple)).drop("_d", "_f")


def coverage_check(answers: DataFrame, key: str, text: str, expected: str, least: float = 0.8) -> DataFrame:
    """(id, found, expected, ratio, ok): PAPER blocks of an answer against how many it should have."""
    n = F.size(F.regexp_extract_all(F.col(text), F.lit(r"(?m)^PAPER:"), F.lit(0)))
    ratio = F.round(n / F.nullif(F.col(expected), F.lit(0)), 4)
    return answers.select(key, n.alias("found"), F.col(expected).alias("expected"), ratio.alias("ratio"), (ratio >= least).alias("ok"))


def first_sentence(text: Column) -> Column:
    """Up to the first '. ' (or else '.' before a line's end), or the first 200 characters."""
    at = F.locate(". ", text)
    line = F.locate(".\n", text)
    return F.trim(F.when(at > 0, F.substring(text, F.lit(1), at)).when(line > 0, F.substring(text, F.lit(1), line)).otherwise(F.substring(text, 1, 200)))


def session_title(text: Column) -> Column:
    """Up to 50 characters, cut at a word."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(clean) <= 50, clean).otherwise(F.concat(F.regexp_extract(F.substring(clean, 1, 50), r"^(.*?)(?:\s+\S*)?$", 1), F.lit("…")))


def repaired_json(text: Column, schema: str) -> Column:
    """JSON of the schema, or the outermost array or object within other text; null if neither parses.

    A text that is no JSON parses to a struct of nulls, so it is told by the parse itself.
    """
    sound = lambda t: F.when(F.try_parse_json(t).isNotNull(), F.from_json(t, schema))
    return F.coalesce(sound(text), sound(F.regexp_extract(text, r"(?s)\[.*\]", 0)), sound(F.regexp_extract(text, r"(?s)\{.*\}", 0)))


def string_list(value: Column) -> Column:
    """A JSON list of anything as its trimmed, non-empty strings."""
    return F.filter(F.transform(F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def list_field(value: Column) -> Column:
    """A JSON list joined by blanks, or plain text trimmed."""
    parsed = F.from_json(value, "array<string>")
    return F.coalesce(F.when(F.startswith(F.trim(value), F.lit("[")) & (F.size(parsed) > 0), F.array_join(parsed, " ")), F.trim(value), F.lit(""))


def unwrap(value: Column, path: str) -> Column:
    """{key: {value: x}} or {key: x}."""
    return F.coalesce(F.get_json_object(value, f"$.{path}.value"), F.get_json_object(value, f"$.{path}"))


def prose_paragraphs(text: Column, size: int = 3) -> Column:
    """Sentences regrouped by ``size``."""
    def regrouped(s: Column) -> Column:
        starts = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.floor((F.size(s) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(s, i * size + 1, F.lit(size)), " "))

    return _once(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda x: x != ""), regrouped)


# Topics and notebooks.


def topic_scores(docs: DataFrame, topics: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, slug, score): 2 for a primary and 1 for a secondary keyword found, over the most possible.

    ``topics`` (slug, domain, keyword, weight) is a vocabulary of fixed size and broadcast.
    """
    whole = topics.groupBy("slug").agg(F.sum("weight").alias("most"))
    t = docs.select(key, F.lower(F.regexp_replace(F.trim(text), r"\s+", " ")).alias("_t"))
    hits = t.join(F.broadcast(topics), F.contains("_t", "keyword")).groupBy(key, "slug").agg(F.sum("weight").alias("raw"))
    return hits.join(F.broadcast(whole), "slug").select(key, "slug", (F.col("raw") / F.col("most")).alias("score"))


def assign_topics(docs: DataFrame, scores: DataFrame, fallback: str, key: str = "id", primary: float = 0.08, secondary: float = 0.04, high: float = 0.15) -> DataFrame:
    """(id, slug, score, confidence): the best topic, a second if it is near, or the fallback."""
    ranked = scores.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.desc("slug")))).where("r <= 2")
    ranked = ranked.withColumn("top", F.max("score").over(Window.partitionBy(key)))
    kept = ranked.where((F.col("top") >= primary) & ((F.col("r") == 1) | (F.col("score") >= secondary)))
    kept = kept.select(key, "slug", F.round("score", 6).alias("score"), F.when((F.col("r") == 1) & (F.col("score") >= high), "high").otherwise("medium").alias("confidence"))
    best = scores.groupBy(key).agg(F.max("score").alias("score"))
    rest = docs.select(key).join(kept.select(key), key, "left_anti").join(best, key, "left")
    return kept.unionByName(rest.select(key, F.lit(fallback).alias("slug"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"), F.lit("low").alias("confidence")))


def capacity_batches(assigned: DataFrame, size: int = 45, group: str = "slug", key: str = "id") -> DataFrame:
    """Adds the notebook, from 1, that an assignment goes to: ``size`` of each topic in one."""
    return assigned.withColumn("notebook", (F.floor((F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1) / size) + 1).cast("int"))


def reading_minutes(text: Column) -> Column:
    """Minutes that a text takes at 200 words a minute, 1 at least; halves are rounded up."""
    words = word_count(F.coalesce(text, F.lit("")))
    return F.greatest(F.lit(1), F.floor(words / 200 + 0.5)).cast("long")
