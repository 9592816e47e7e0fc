import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tableweave.llm import quality
from tableweave.llm.arrays import LOWER, span_hashes


def one(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return quality.encode(raw, np.array([0, len(raw)]))


def test_passages_cover_every_word():
    words, first, form, rows = one("A bb  ccc\n" * 75)
    assert len(words) == 225 and list(first) == [0, 100, 200] and list(rows) == [0, 3] and form.shape == (3, quality.FORMS)
    words, first, form, rows = one("")
    assert len(words) == 0 and list(first) == [0] and list(rows) == [0, 1]


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    model = quality.Model(3)
    words = rng.integers(0, quality.BUCKETS, 40)
    passage, bag = np.sort(rng.integers(0, 6, 40)), np.array([0, 0, 1, 1, 1, 2])
    form, y = rng.normal(size=(6, quality.FORMS)), np.array([1.0, 0.0, 1.0])

    def loss():
        z = model.forward(words, passage, form, bag)[0]
        return np.mean(np.log1p(np.exp(-z * (2 * y - 1))))

    g = model.gradients(words, passage, form, bag, y)
    for k, value in model.p.items():
        at = (words[0], 2) if k == "E" else tuple(0 for _ in value.shape)
        was = value[at]
        value[at] = was + 1e-5
        up = loss()
        value[at] = was - 1e-5
        down = loss()
        value[at] = was
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6, k


def test_held_out_accuracy(spark):
    d = Path("/root/testdata/sf0.01")
    if not d.exists():
        pytest.skip("no test data")
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.scored(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    out = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = ([s for s, t in out if t == c] for c in (1, 0))
    assert len(bad) >= 4
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    right = np.mean([(s >= 0.3) == (t == 1) for s, t in out])
    assert auc > 0.95 and right > 0.93
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted == 1}


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs = spark.createDataFrame([(i, "a b c" if i % 2 else "X!! Y!! Z!!") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    flipped = spark.createDataFrame([(r.doc_id, 1 - r.quality if r.h else r.quality) for r in labels.select(
        "*", quality.held_out(labels["doc_id"]).alias("h")).collect()], "doc_id long, quality int")
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert all((a.p[k] == b.p[k]).all() for k in a.p)
    scores = {r.doc_id: r.score for r in quality.scored(docs, a).collect()}
    assert min(scores[i] for i in range(1, 60, 2)) > 0.9 > 0.1 > max(scores[i] for i in range(0, 60, 2))


def test_nulls_empty_and_no_labels(spark):
    df = spark.createDataFrame([(None, "a b", 1), (1, None, 2), (1, "", 3), (2, "word " * 50_000, 4)], "doc_id long, text string, score int")
    rows = quality.scored(df, None).collect()
    assert len(rows) == 4 and {r.score for r in rows} == {0.5}
    model = quality.Model()
    rows = quality.scored(df, model).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    assert quality.scored(df.limit(0), model).count() == 0
    assert quality.accepted(df, None).columns == df.columns and quality.accepted(df, None).count() == 4
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(df, none) is None


def plain_score(model, text):
    """The score from a loop over passages and words."""
    raw = text.encode()
    words = [(m.start(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    hashes = span_hashes(LOWER[np.frombuffer(raw, np.uint8)], *(np.array([f(w) for w in words], np.int64) for f in (lambda w: w[0], lambda w: w[0] + len(w[1]))))
    cells, gates = [], []
    for lo in range(0, max(len(words), 1), quality.PASSAGE):
        part = range(lo, min(lo + quality.PASSAGE, len(words)))
        n = max(len(part), 1)
        count = lambda w, low, high: sum(low <= b <= high for b in w)
        rows, embedded = [], np.zeros(quality._EMBED)
        for i in part:
            w = words[i][1]
            upper, lower = count(w, 65, 90), count(w, 97, 122)
            mark = sum(33 <= b <= 126 and not chr(b).isalnum() for b in w)
            gap = raw[words[i - 1][0] + len(words[i - 1][1]) : words[i][0]].count(b"\n") if i else 0
            rows.append([len(w), upper, count(w, 48, 57), mark, sum(b >= 0xC0 for b in w), upper > 1 and lower == 0, mark > 1,
                         len(w) == 1 and mark == 1, i > 0 and hashes[i] == hashes[i - 1], min(gap, 4)])
            embedded += model.p["E"][int(hashes[i] % np.uint64(quality.BUCKETS))]
        mean = np.array(rows, float).sum(0) / n if rows else np.zeros(10)
        size = max(mean[0], 1e-9)
        distinct = len({int(h & np.uint64(0xFFFFF)) for h in hashes[lo : lo + quality.PASSAGE]})
        form = np.array([mean[0] / 10, *(mean[1:5] / size), *mean[5:], distinct / n, np.log1p(len(part)) / 5]).astype(np.float32)
        x = np.concatenate([embedded / n, (form - model.center) / model.scale])
        h = np.tanh(x @ model.p["W"] + model.p["b"])
        cells.append(h)
        gates.append((np.tanh(h @ model.p["V"]) / (1 + np.exp(-(h @ model.p["U"])))) @ model.p["w"])
    weight = np.exp(np.array(gates) - max(gates))
    z = (weight / weight.sum()) @ np.array(cells)
    return 1 / (1 + np.exp(-(z @ model.p["c"] + model.p["c0"][0] + model.shift)))


def test_score_equals_a_plain_loop(spark):
    """Whatever stands in the rows around a text."""
    model = quality.Model(3)
    model.center, model.scale, model.shift = np.full(quality.FORMS, 0.1), np.full(quality.FORMS, 0.7), 0.3
    rng = np.random.default_rng(1)
    words = ["The", "the", "ABC", "x1", "é", "#", "--", "word,", "\n", "\n\n"]
    texts = [" ".join(rng.choice(words, int(n))) for n in (0, 1, 5, 99, 100, 101, 250, 1000)] + ["", " \n", "the", "The\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.score for r in quality.scored(df, model).collect()}
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(plain_score(model, text), abs=1e-6)


def test_training_reads_every_passage(spark):
    """A long document whose bad part is one passage of 400 counts as all of it."""
    long = " ".join(["fine words here"] * 20_000) + " BUY $$$ NOW " * 30
    batch = pa.RecordBatch.from_pydict({"label": [1.0, 0.0], "text": [long, None]})
    (out,) = quality._encoded(iter([batch]))
    per = np.frombuffer(out.column("per")[0].as_py(), np.int32)
    assert per.sum() == 60_090 and len(per) == 601 and len(out.column("forms")[0].as_py()) == 601 * quality.FORMS * 4
    steps = quality._steps(np.array([0, 1, 2, 3]), np.array([3_000, 1_000, 9_000, 10]), 128)
    assert [list(s) for s in steps] == [[0, 1], [2], [3]]
