"""Which of many terms stand in texts, in one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of terms that one pass looks for; more of them take more passes.
BLOCK_CHARS = 4 << 20


def find(rows: DataFrame, key: str, fields: list[str], terms: DataFrame, block: int = BLOCK_CHARS) -> DataFrame:
    """(key, field, t, whole): the terms (t) that a field of a row contains, and whether the field is the term.

    The terms of a block make an automaton (Aho and Corasick, 1975) in each task, so the
    work grows with texts and finds, not with texts times terms. Blocks hold about
    ``block`` characters, however many terms there are. Null and empty terms and null
    fields give nothing.
    """
    terms = terms.select(F.col("t").cast("string").alias("t")).where("t <> ''").distinct()
    chars = terms.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks, out = max(1, -(-chars // block)), None
    slim = rows.select(key, *(F.col(f).cast("string").alias(f) for f in fields))
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, field string, t string, whole boolean"
    for b in range(blocks):
        some = [r[0] for r in terms.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).collect()]  # about block characters
        part = slim.mapInArrow(_scan(some, key, fields), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _scan(terms: list[str], key: str, fields: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t in terms:
            automaton.add_word(t, t)
        if terms:
            automaton.make_automaton()
        for batch in batches if terms else ():
            at, field, found, whole = [], [], [], []
            for f in fields:
                for i, text in enumerate(batch.column(f).to_pylist()):
                    here = {t for _, t in automaton.iter(text)} if text else ()
                    at.extend([i] * len(here))
                    field.extend([f] * len(here))
                    found.extend(here)
                    whole.extend(t == text for t in here)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), pa.array(field, pa.string()), pa.array(found, pa.string()), pa.array(whole, pa.bool_())], [key, "field", "t", "whole"])

    return scan
