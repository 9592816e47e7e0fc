"""The pipeline's stages against plain versions of their decisions."""

from collections import defaultdict
from pathlib import Path

import pytest

import corpus_pipeline
from tableweave.llm import mixing, packing, quality, sanitise
from tableweave.llm.shared import stored

from .test_jaccard import brute
from .test_sanitise import base_spans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def test_stages_in_order(spark):
    before = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = before.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stages = dict(corpus_pipeline.STAGES)

    good = stored(stages["quality classifier"](spark, before, DATA))
    model = quality.train(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    wanted = {r.doc_id for r in quality.scored(before, model).collect() if r.predicted == 1}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == wanted

    single = stored(stages["n-gram Jaccard join"](spark, good, DATA))
    rows = [(r.doc_id, r.text) for r in good.collect()]
    firsts = {c for _, c in brute(rows, 5, 80).values()}
    assert single.columns == columns and {r.doc_id for r in single.collect()} == firsts

    clean = stored(stages["personal data"](spark, single, DATA))
    texts = {r.doc_id: r.text for r in single.collect()}
    assert clean.columns == columns and clean.count() == len(texts)
    touched = {r.doc_id for r in sanitise.personal_data(single).collect() if r.spans}
    for r in clean.collect():
        assert not base_spans(r.text) and r.n_chars == len(r.text)
        assert r.doc_id in touched or r.text == texts[r.doc_id]

    mixed = stored(stages["mix of sources"](spark, clean, DATA))
    taken = {r.doc_id: r.taken for r in mixing.taken_by_document(clean).collect()}
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    assert mixed.columns == columns and dict(words) == {i: n for i, n in taken.items() if n}

    packed = stages["best-fit packing"](spark, mixed, DATA).collect()
    total = defaultdict(int)
    for r in packed:
        total[r.doc_id] += r.length
    assert dict(total) == dict(words)
    assert {r.capacity for r in packed} <= set(packing.CAPACITIES)


def test_run_is_the_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA))
    assert sorted(map(str, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(str, docs.collect()))


def test_near_copies_by_rows(spark):
    """Two texts under one id, equal rows, rows without an id, and a table without n_chars."""
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w59", "end")
    rows = [(5, "another text under the same id", "a"), (5, near, "a"), (2, text, "b"), (2, text, "b"), (2, text, "c"),
            (None, near, "a"), (None, "only this one", None), (None, "only this one", None), (7, None, "a"), (8, "", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = corpus_pipeline.first_of_each_group(spark, df, DATA).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(
        [(2, text), (5, "another text under the same id"), (None, "only this one"), (7, None), (8, "")], key=str)
    assert corpus_pipeline.first_of_each_group(spark, df.limit(0), DATA).count() == 0
    assert corpus_pipeline.without_personal_data(spark, df, DATA).columns == df.columns
