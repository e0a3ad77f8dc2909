"""Licence scans by a positional rare-token index, in DataFrame operations only.

Licence templates are posted as (word, template, position). The words of a template's
mandatory key phrase are ranked by their document frequency over the whole corpus; the
two rarest are looked up in each file, their positions less their template positions
give the places where the template could lie, and the places that both agree on are
verified word for word on the key phrase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (label, mandatory key phrase): the phrases that every scan counts.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: (label, template, its mandatory key phrase).
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "you may not use this file except in compliance with the license"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license version", "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license version", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that", "redistribution and use in source and binary forms"),
    ("bsd", "released under the bsd license", "under the bsd license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike license", "creative commons attribution sharealike"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc0", "creative commons cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("all-rights-reserved", "copyright all rights reserved", "all rights reserved"),
]


def _find(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


#: (label, words, start of the key phrase in them, its words, is a base phrase).
PATTERNS = [(label, p.split(), 0, p.split(), True) for label, p in BASE] + [(label, t.split(), _find(t.split(), k.split()), k.split(), False) for label, t, k in TEMPLATES]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A place is template * 2**40 + its word number + 2**20 (it may begin before the file does).
_STEP, _SHIFT = 1 << 40, 1 << 20


def words_of(text: Column) -> Column:
    """The lower-cased (A-Z) words: runs of digits, letters a-z and all that is not ASCII."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def _strings(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    A place counts if its key phrase stands there whole, in order and without gaps; score is the
    largest share of a template's words found in line with its key phrase (1 for a base
    phrase, 0 with no place), ``places`` the number of all of them. Null text counts as empty.
    Repeated rows and null doc_ids are scanned like any other. Other columns are
    ignored. The templates are constants, so the index is of fixed size.
    """
    worded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text").cast("string")).alias("w"))
    vocabulary = sorted({w for _, _, _, key, _ in PATTERNS for w in key})
    seen = worded.select(F.explode(F.array_intersect("w", F.expr(_strings(vocabulary)))).alias("word"))
    df = {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}  # a row per licence word
    rarest = [sorted(set(key), key=lambda w: (df.get(w, 0), w))[:2] for _, _, _, key, _ in PATTERNS]

    postings: list[dict[str, list[int]]] = [{}, {}]
    for t, (_, words, start, key, _) in enumerate(PATTERNS):
        for rank, word in enumerate(rarest[t]):
            postings[rank].setdefault(word, []).extend(t * _STEP + _SHIFT - (start + k) for k, w in enumerate(key) if w == word)
    anchors = sorted({w for ws in rarest for w in ws})

    def places(rank: int) -> str:
        """Of every anchor of this rank in the file, the places it speaks for."""
        table = "map(" + ", ".join(f"'{w}', array({', '.join(f'{x}L' for x in xs)})" for w, xs in postings[rank].items()) + ")"
        return f"flatten(transform(filter(hits, h -> map_contains_key({table}, h.w)), h -> transform(element_at({table}, h.w), p -> p + h.i)))"

    hits = f"CASE WHEN arrays_overlap(w, {_strings(anchors)}) THEN filter(transform(w, (x, i) -> named_struct('i', i, 'w', x)), h -> array_contains({_strings(anchors)}, h.w)) ELSE array() END"
    out = worded.withColumn("hits", F.expr(hits))
    out = out.withColumn("agreed", F.expr(f"CASE WHEN size(hits) > 1 THEN array_intersect({places(0)}, {places(1)}) ELSE array() END"))
    whole = "array(" + ", ".join(_strings(words) for _, words, _, _, _ in PATTERNS) + ")"
    keys = "array(" + ", ".join(_strings(key) for _, _, _, key, _ in PATTERNS) + ")"
    starts = f"array({', '.join(str(start) for _, _, start, _, _ in PATTERNS)})"
    labels = _strings([label for label, *_ in PATTERNS])
    out = out.withColumn("at", F.expr(f"transform(agreed, p -> named_struct('t', cast(p div {_STEP} as int), 'i', cast(p % {_STEP} - {_SHIFT} as int)))"))
    # A file can begin inside a key phrase, whose place is then before its first word; slice() takes no 0.
    verified = f"filter(at, p -> CASE WHEN p.i + get({starts}, p.t) >= 0 THEN slice(w, p.i + get({starts}, p.t) + 1, size(get({keys}, p.t))) = get({keys}, p.t) ELSE false END)"
    out = out.withColumn("at", F.expr(f"CASE WHEN size(at) > 0 THEN {verified} ELSE at END"))
    out = out.withColumn("base", F.expr(f"filter(at, p -> p.t < {len(BASE)})"))
    share = f"transform(at, p -> size(filter(transform(get({whole}, p.t), (x, k) -> p.i + k >= 0 AND coalesce(get(w, p.i + k) = x, false)), x -> x)) / size(get({whole}, p.t)))"
    listed = lambda c: f"array_join(array_sort(array_distinct(transform({c}, p -> get({labels}, p.t)))), ',')"
    return out.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.expr("cast(array_min(transform(base, p -> p.i)) as long)").alias("first_word"),
        F.expr("cast(array_max(transform(base, p -> p.i)) as long)").alias("last_word"),
        F.expr(listed("base")).alias("base_labels"),
        F.expr(listed("at")).alias("labels"),
        F.expr(f"CASE WHEN size(at) > 0 THEN array_max({share}) ELSE 0D END").alias("score"),
        F.size("at").cast("long").alias("places"),
    )


def oracle_sql() -> str:
    """DuckDB SQL for the same rows, by trying every word of every file against every key phrase."""
    lit = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    found = []
    for t, (label, words, start, key, _) in enumerate(PATTERNS):
        same = " + ".join(f"(case when i - {start} + {k} >= 1 and ws[i - {start} + {k}] = '{w}' then 1 else 0 end)" for k, w in enumerate(words))
        found.append(f"list_transform(list_filter(range(1, len(ws) + 1), lambda i: ws[i] = '{key[0]}' and ws[i:i+{len(key) - 1}] = {lit(key)}), lambda i: {{'t': {t}, 'label': '{label}', 'i': i - 1 - {start}, 'share': ({same}) / {len(words)}.0}})")
    labels = lambda c: f"coalesce(array_to_string(list_sort(list_distinct(list_transform({c}, lambda p: p.label))), ','), '')"
    return f"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
f as (select doc_id, len(ws) as n_words, {' || '.join(found)} as places from w),
b as (select *, list_filter(places, lambda p: p.t < {len(BASE)}) as base from f)
select doc_id, n_words::bigint as n_words, len(base)::bigint as n_base, list_min(list_transform(base, lambda p: p.i))::bigint as first_word,
  list_max(list_transform(base, lambda p: p.i))::bigint as last_word, {labels('base')} as base_labels, {labels('places')} as labels,
  coalesce(list_max(list_transform(places, lambda p: p.share)), 0)::double as score, len(places)::bigint as places from b"""
