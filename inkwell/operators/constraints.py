"""Constraints as data: all checks of a table in one scan, each unique key and each reference by one exchange."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Constraint:
    """What rows of ``table`` must hold. ``key`` names a row in a report.

    ``kind`` is check (``rule`` is an SQL condition, that null meets), not_null, unique
    (rows with a null among ``columns`` are all different) or foreign_key (to
    ``parent_columns`` of ``parent``, unless a column is null).
    """

    name: str
    table: str
    kind: str
    key: str
    columns: tuple[str, ...] = ()
    rule: str = ""
    parent: str = ""
    parent_columns: tuple[str, ...] = ()

    def broken(self) -> Column:
        """Of a check or not_null: whether a row breaks it."""
        if self.kind == "check":
            return ~F.coalesce(F.expr(self.rule), F.lit(True))
        return reduce(lambda a, b: a | b, (F.col(c).isNull() for c in self.columns))


def one_of(column: str, values: list[str]) -> str:
    """The condition that a column has one of some values."""
    return f"{column} in ({', '.join(repr(v) for v in values)})"


def violations(tables: dict[str, DataFrame], constraints: list[Constraint]) -> DataFrame:
    """(name, table, kind, broken, first_key): how many rows break each constraint, and the least key of these, as a string.

    Of rows that are equal in a unique key all but one break it. Constraints that all rows meet have a row too.
    """
    by_table: dict[str, list[Constraint]] = defaultdict(list)
    parts = []
    for c in constraints:
        if c.kind in ("check", "not_null"):
            by_table[c.table].append(c)
        elif c.kind == "unique":
            rows = tables[c.table].where(reduce(lambda a, b: a & b, (F.col(x).isNotNull() for x in c.columns)))
            same = rows.groupBy(*c.columns).agg(F.count("*").alias("_n"), F.min(c.key).alias("_k")).where("_n > 1")
            parts.append(_row(c, same.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("broken"), F.min("_k").alias("_k"))))
        elif c.kind == "foreign_key":
            parent = tables[c.parent].select(*(F.col(x).alias(f"_p{i}") for i, x in enumerate(c.parent_columns)))
            held = reduce(lambda a, b: a & b, (F.col(x).isNotNull() for x in c.columns))
            on = reduce(lambda a, b: a & b, (F.col(x) == F.col(f"_p{i}") for i, x in enumerate(c.columns)))
            lost = tables[c.table].select(*dict.fromkeys([*c.columns, c.key])).where(held).join(parent, on, "left_anti")
            parts.append(_row(c, lost.agg(F.count("*").alias("broken"), F.min(c.key).alias("_k"))))
        else:
            raise ValueError(f"a constraint is no {c.kind}")
    for table, own in by_table.items():
        each = [x for i, c in enumerate(own) for x in (F.count_if(c.broken()).alias(f"n{i}"), F.min(F.when(c.broken(), F.col(c.key))).cast("string").alias(f"k{i}"))]
        line = tables[table].agg(*each)
        rows = F.array(*(F.struct(F.lit(c.name).alias("name"), F.lit(table).alias("table"), F.lit(c.kind).alias("kind"), F.col(f"n{i}").alias("broken"), F.col(f"k{i}").alias("first_key")) for i, c in enumerate(own)))
        parts.append(line.select(F.inline(rows)))
    return reduce(DataFrame.unionByName, parts)


def _row(c: Constraint, found: DataFrame) -> DataFrame:
    return found.select(F.lit(c.name).alias("name"), F.lit(c.table).alias("table"), F.lit(c.kind).alias("kind"), "broken", F.col("_k").cast("string").alias("first_key"))
