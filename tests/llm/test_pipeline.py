"""The pipeline's stages one by one and together, on planted cases."""

import random
import zlib

import corpus_pipeline
import numpy as np
import pytest

from inkwell.llm.packing import Encoder
from inkwell.llm.queries import tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices(["an", "er", "tion", "the", "is", "re", "ou"], k=rng.randrange(1, 5)))
    text = lambda n=60: " ".join(word() for _ in range(n))
    bad = ["zwubat", "zwubis", "grufton", "fumpel"]
    clean = [(i, text()) for i in range(300)]
    toxic = [(1000 + i, " ".join([*text().split(), *rng.choices(bad, k=5)])) for i in range(120)]
    exact = [(2000 + i, clean[i][1].upper() if i % 2 else clean[i][1]) for i in range(40)]
    near = [(3000 + i, clean[100 + i][1] + " extra") for i in range(40)]
    items = [text(25) for _ in range(10)]
    leaks = [(4000 + i, text(20) + " " + items[i % 10] + " " + text(20)) for i in range(30)]
    odd = [(None, text()), (None, clean[0][1]), (None, None), (5000, None), (5001, ""), (7, text())]
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [*clean, *toxic, *exact, *near, *leaks, *odd]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).repartition(5).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 1000)) for i, _ in [*clean[:200], *toxic[:80]]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows


def test_stages(spark, planted):
    d, rows = planted
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = lambda df: {(r.doc_id, r.text) for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    all_rows = set(rows)

    kept = stages["toxicity"](spark, docs, d)
    assert kept.columns == docs.columns
    gone = all_rows - ids(kept)
    caught = {i for i, _ in gone} & set(range(1000, 1120))  # by 80 labelled ones
    assert len(caught) >= 108 and len(gone) - len(caught) <= 2

    kept = stages["exact_dedup"](spark, docs, d)
    assert all_rows - ids(kept) == {(i, t) for i, t in rows if i is not None and i < 40 and (i, t) in set(rows[:40])} | {(None, rows[0][1]), (None, None), (5000, None)}

    kept = stages["near_dedup"](spark, docs, d)
    gone = {i for i, _ in all_rows - ids(kept)}
    assert gone == set(range(2000, 2040)) | set(range(3000, 3040)) | {None}
    assert (None, None) in ids(kept) and (5001, "") in ids(kept) and sum(i is None for i, _ in ids(kept)) == 2

    kept = stages["decontamination"](spark, docs, d)
    assert {i for i, _ in all_rows - ids(kept)} == set(range(4000, 4030))
    for f in list(stages.values())[:-1]:
        empty = f(spark, docs.limit(0), d)
        assert empty.columns == docs.columns and empty.count() == 0


def test_run(spark, planted):
    d, rows = planted
    out = corpus_pipeline.run(spark, d).collect()
    left = {r.doc_id for r in out}
    assert not left & (set(range(4000, 4030)) | set(range(3000, 3040))) and len(left & set(range(1000, 1120))) <= 12
    assert set(range(140, 295)) <= left and set(range(2000, 2040)) <= left
    encode, by = Encoder(tokenizer_path()), {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in rows[140:200]:
        ids, at = np.append(encode(t), np.uint16(0)).astype("<u4"), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_without_takes_ids_of_any_whole_type(spark):
    from inkwell.llm.common import row_hash, without

    docs = spark.createDataFrame([(i, f"t{i}") for i in range(20)] + [(None, "n")], "doc_id int, text string")
    gone = docs.where("doc_id % 2 = 0 or doc_id is null").select(docs["doc_id"].cast("long").alias("doc_id"), row_hash())
    left = without(docs, gone)
    assert left.schema == docs.schema and sorted(r.doc_id for r in left.collect()) == list(range(1, 20, 2))
