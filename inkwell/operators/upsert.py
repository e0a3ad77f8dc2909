"""Get-or-create, merge and validation over whole tables.

Each function gives the table as it is afterwards; writing it is the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def get_or_create(table: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` and the incoming rows whose natural key it lacks, one of each key."""
    fresh = incoming.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(fresh, allowMissingColumns=True)


def match_papers(incoming: DataFrame, table: DataFrame) -> DataFrame:
    """(row, id, matched_by): for each incoming row the paper with its openreview_id, else s2_id, else title and year."""
    out = incoming.select("row", "openreview_id", "s2_id", "title", "year")
    steps = [("openreview_id", ["openreview_id"]), ("s2_id", ["s2_id"]), ("title", ["title", "year"])]
    for name, keys in steps:
        known = table.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.min("id").alias(f"_{name}"))
        out = out.join(known, keys, "left")
    by = F.when(F.col("_openreview_id").isNotNull(), "openreview_id").when(F.col("_s2_id").isNotNull(), "s2_id").when(F.col("_title").isNotNull(), "title")
    return out.select("row", F.coalesce("_openreview_id", "_s2_id", "_title").alias("id"), by.alias("matched_by"))


def upsert_papers(table: DataFrame, incoming: DataFrame, mutable: list[str]) -> DataFrame:
    """The table with matched papers updated where the incoming row says something, and the rest added; ``created`` tells which.

    Of several incoming rows for one paper the last (by ``row``) counts.
    """
    found = match_papers(incoming, table)
    rows = incoming.join(found, "row")
    last = Window.partitionBy("id").orderBy(F.desc("row"))
    news = rows.where("id is not null").withColumn("_r", F.row_number().over(last)).where("_r = 1").select("id", *(F.col(c).alias(f"_{c}") for c in mutable))
    old = table.join(news, "id", "left")
    old = old.withColumns({c: F.coalesce(f"_{c}", c) for c in mutable}).drop(*(f"_{c}" for c in mutable)).withColumn("created", F.lit(False))
    fresh = rows.where("id is null").withColumn("_r", F.row_number().over(Window.partitionBy("title", "year").orderBy(F.desc("row")))).where("_r = 1")
    fresh = fresh.select(*(F.xxhash64("title", "year").alias("id") if c == "id" else F.col(c) for c in table.columns if c in fresh.columns), F.lit(True).alias("created"))
    return old.unionByName(fresh, allowMissingColumns=True)


def link_authors(links: DataFrame, incoming: DataFrame) -> DataFrame:
    """``links`` (paper_id, author_id, position) and the missing ones of (paper_id, authors), from position 1, each author once."""
    rows = incoming.select("paper_id", F.posexplode("authors").alias("p", "author_id")).groupBy("paper_id", "author_id").agg((F.min("p") + 1).alias("position"))
    return links.unionByName(rows.join(links, ["paper_id", "author_id"], "left_anti").select(*links.columns))


def merge(table: DataFrame, incoming: DataFrame, keys: list[str], longer: list[str] = (), insert_only: bool = False) -> DataFrame:
    """Full merge by key: incoming values that are given win, or for ``longer`` those at least as long."""
    cols = [c for c in table.columns if c not in keys]
    new = incoming.select(*keys, *(F.col(c).alias(f"_{c}") for c in cols if c in incoming.columns))
    out = table.withColumn("_old", F.lit(True)).join(new, keys, "full_outer")
    picked = []
    for c in cols:
        if f"_{c}" not in new.columns:
            picked.append(F.col(c))
        elif insert_only:
            picked.append(F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c))
        elif c in longer:
            picked.append(F.when(F.col(f"_{c}").isNotNull() & (F.col(c).isNull() | (F.length(f"_{c}") >= F.length(c))), F.col(f"_{c}")).otherwise(F.col(c)).alias(c))
        else:
            picked.append(F.coalesce(f"_{c}", c).alias(c))
    return out.select(*keys, *picked)


ROLE_ORDER = {"introduces": 1, "uses": 2, "compares": 3, "critiques": 4}


def merge_techniques(table: DataFrame, incoming: DataFrame) -> DataFrame:
    """(paper_id, name, role): of several roles the strongest stays, introduces first."""
    rank = F.lit(9)
    for role, i in ROLE_ORDER.items():
        rank = F.when(F.col("role") == role, i).otherwise(rank)
    both = table.select("paper_id", "name", "role").unionByName(incoming.select("paper_id", "name", "role"))
    return both.groupBy("paper_id", "name").agg(F.min_by("role", rank).alias("role"))


def stamp(table: DataFrame, found: DataFrame, key: str, value: str, stamp_column: str, now: Column) -> DataFrame:
    """Writes found values and stamps every row that was tried, those without a find too."""
    f = found.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    out = table.join(f, table[key] == f["_k"], "left")
    return out.withColumn(value, F.coalesce("_v", value)).withColumn(stamp_column, now).drop("_k", "_v")


def stale_groups(done: DataFrame, events: DataFrame, group: str) -> DataFrame:
    """Groups of ``events`` (group, at) with one later than the group's last ``done`` (group, at)."""
    last = done.groupBy(group).agg(F.max("at").alias("_last"))
    return events.join(last, group).where(F.col("at") > F.col("_last")).select(group).distinct()


def ready_groups(items: DataFrame, answered: DataFrame, prompts: list[str], group: str = "group_id") -> DataFrame:
    """(group, prompt) for groups with nothing pending and something uploaded, less what is answered."""
    ready = items.groupBy(group).agg(F.count_if(F.col("status") == "pending").alias("p"), F.count_if(F.col("status") == "uploaded").alias("u")).where("p = 0 and u > 0")
    asked = ready.select(group, F.explode(F.array(*(F.lit(p) for p in prompts))).alias("prompt"))
    return asked.join(answered, [group, "prompt"], "left_anti")


# Validation.


def unique_violations(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def foreign_key_violations(table: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    p = parent.select(F.col(parent_key).alias("_p"))
    return table.where(F.col(key).isNotNull()).join(p, F.col(key) == F.col("_p"), "left_anti")


def check_violations(table: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return table.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed))


def request_status(requests: DataFrame, text: str = "text", least_words: int = 50, most_chars: int = 50_000) -> DataFrame:
    """Adds ``status``: ok, too_short or too_long."""
    from .text import word_count

    t = F.coalesce(F.col(text), F.lit(""))
    return requests.withColumn("status", F.when(F.length(t) > most_chars, "too_long").when(word_count(t) < least_words, "too_short").otherwise("ok"))
