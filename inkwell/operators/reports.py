"""Reports on runs of the pipeline for papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sections listed, and numbers of papers that the cost is projected to.
SECTIONS, PROJECTED = 10, (1000, 5000)
STAGES = ["download", "extract", "segment", "analyse"]
#: Means by the stage that must have gone well, with their number of places.
MEANS = {"pdf_kb": ("download", 0), "download_s": ("download", 1), "pdf_words": ("extract", 0), "extract_ms": ("extract", 0), "coverage_pct": ("segment", 0), "llm_context_words": ("segment", 0), "analyse_ms": ("analyse", 0)}


def pdf_report(measured: DataFrame) -> DataFrame:
    """(section, name, value) of a run's measurements, a row per paper.

    ``measured`` has <stage>_ok for each of STAGES, the columns of MEANS, sections_found,
    input_tokens, output_tokens, cost_usd and error. Sections: papers attempted and done by stage,
    means, the SECTIONS most frequent sections, tokens and cost with what PROJECTED papers
    would cost, and errors. Means of a stage that no paper passed are null; one scan
    gives all but the sections.
    """
    ok = lambda stage: F.coalesce(F.col(f"{stage}_ok"), F.lit(False))
    rows = [("papers", "attempted", F.count("*").cast("double"))]
    rows += [("papers", stage, F.count_if(ok(stage)).cast("double")) for stage in STAGES]
    rows += [("means", name, F.round(F.avg(F.when(ok(stage), F.col(name))), places)) for name, (stage, places) in MEANS.items()]
    done, cost = F.nullif(F.count_if(ok("analyse")), F.lit(0)), F.sum(F.when(ok("analyse"), F.col("cost_usd")))
    rows += [("tokens", name, F.sum(F.when(ok("analyse"), F.col(f"{name}_tokens"))).cast("double")) for name in ("input", "output")]
    rows += [("cost", "total", F.round(cost, 5)), ("cost", "per paper", F.round(cost / done, 5))]
    rows += [("cost", f"of {n} papers", F.round(cost / done * n, 3)) for n in PROJECTED]
    rows += [("papers", "errors", F.count_if(F.col("error").isNotNull()).cast("double"))]
    line = measured.agg(*(value.alias(f"v{i}") for i, (_, _, value) in enumerate(rows)))
    out = line.select(F.inline(F.array(*(F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), F.col(f"v{i}").alias("value")) for i, (s, n, _) in enumerate(rows)))))
    found = measured.where(ok("segment")).select(F.explode("sections_found").alias("name")).groupBy("name").agg(F.count("*").cast("double").alias("value"))
    top = found.orderBy(F.desc("value"), "name").limit(SECTIONS)
    return out.unionByName(top.select(F.lit("sections").alias("section"), "name", "value"))


def errors(measured: DataFrame, most: int = 50) -> DataFrame:
    """(title, error) of the papers that failed, titles cut."""
    return measured.where(F.col("error").isNotNull()).select(F.substring("title", 1, most).alias("title"), "error")


def match_in_groups(found: DataFrame, candidates: DataFrame, group: str, tokens, threshold: float = 0.5) -> DataFrame:
    """``found`` (group, block, title) with paper_id and score of the best of its group's candidates (group, id, title, place), or null below ``threshold``.

    The score is the number of tokens that both have over the longer's; of equally good
    candidates the first in the group's order counts. Titles meet by a token of the same
    group only, so groups of any size need no pairs without one.
    """
    a = found.select(group, "block", F.explode(tokens(F.col("title"))).alias("token"), F.size(tokens(F.col("title"))).alias("na"))
    b = candidates.select(group, "id", "place", F.explode(tokens(F.col("title"))).alias("token"), F.size(tokens(F.col("title"))).alias("nb"))
    score = F.count("*") / F.greatest(F.first("na"), F.first("nb"))
    pairs = a.join(b, [group, "token"]).groupBy(group, "block", "id", "place").agg(score.alias("score")).where(F.col("score") >= threshold)
    best = Window.partitionBy(group, "block").orderBy(F.desc("score"), "place")
    pairs = pairs.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == 1)
    return found.join(pairs.select(group, "block", F.col("id").alias("paper_id"), F.round("score", 6).alias("score")), [group, "block"], "left")


#: Names listed, names listed of one type, and variants from which a name may hold too much.
TOP_NAMES, TOP_OF_TYPE, VARIANTS = 30, 15, 3


def _line(*cells: str | Column) -> Column:
    parts = [c if not isinstance(c, str) else F.col(c) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), F.lit(" |"))


def entity_audit(records: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(section, rank, line): the audit of technique names, as lines of tables.

    ``records`` (name, kind, papers, n_rows, variants array) has a row for each name,
    ``duplicates`` (a, b, reason) one for each suspected pair. Sections: summary; types with their share; the TOP_NAMES names of most
    papers; the TOP_OF_TYPE of each type, with how many more there are; names of one
    paper; names of more than VARIANTS variants; duplicates. ``rank`` is the place in a
    list of bounded length; lists that grow with the corpus are rows without one, to be ordered by whoever
    prints them.
    """
    spread = F.size("variants")
    alone, wide = F.col("papers") == 1, spread > VARIANTS
    one = records.agg(F.count("*").alias("total"), F.count_if(~alone).alias("shared"), F.count_if(alone).alias("alone"), F.count_if(wide).alias("wide"))
    one = one.crossJoin(duplicates.agg(F.count("*").alias("pairs")))  # one row each
    names = {"Techniques": "total", "In two papers or more": "shared", "In one paper": "alone", f"Of more than {VARIANTS} variants": "wide", "Suspected duplicates": "pairs"}
    summary = one.select(F.inline(F.array(*(F.struct(F.lit("summary").alias("section"), F.lit(i).alias("rank"), _line(F.lit(n), c).alias("line")) for i, (n, c) in enumerate(names.items(), 1)))))
    kinds = records.groupBy("kind").agg(F.count("*").alias("n"))
    share = F.concat(F.format_number(100 * F.col("n") / F.col("total"), 1), F.lit("%"))
    types = kinds.crossJoin(F.broadcast(one.select("total"))).select(F.lit("types").alias("section"), F.lit(None).cast("int").alias("rank"), _line("kind", "n", share).alias("line"))
    best = [F.desc("papers"), F.asc("name")]
    top = records.orderBy(*best).limit(TOP_NAMES).withColumn("rank", F.row_number().over(Window.orderBy(*best)))  # TOP_NAMES rows
    top = top.select(F.lit("most papers").alias("section"), "rank", _line("rank", "name", "kind", "papers", "n_rows", spread).alias("line"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(*best))
    each = records.withColumn("rank", place).where(F.col("rank") <= TOP_OF_TYPE)
    each = each.select(F.concat(F.lit("type "), "kind").alias("section"), "rank", _line("name", "papers", spread).alias("line"))
    more = kinds.where(F.col("n") > TOP_OF_TYPE).select(F.concat(F.lit("type "), "kind").alias("section"), F.lit(TOP_OF_TYPE + 1).alias("rank"), F.concat(F.lit("*and "), F.col("n") - TOP_OF_TYPE, F.lit(" more*")).alias("line"))
    free = lambda df, section, line: df.select(F.lit(section).alias("section"), F.lit(None).cast("int").alias("rank"), line.alias("line"))
    out = [summary, types, top, each, more, free(records.where(alone), "one paper", _line("name", "kind", F.get("variants", F.lit(0))))]
    out += [free(records.where(wide), "many variants", _line("name", "kind", "papers", spread, F.concat_ws(", ", "variants"))), free(duplicates, "suspected duplicates", _line("a", "b", "reason"))]
    done = out[0]
    for part in out[1:]:
        done = done.unionByName(part)
    return done
