from collections import defaultdict
from fractions import Fraction

import numpy as np
import pandas as pd

from tableweave.llm import mixing


def text(n, mark="w"):
    return " ".join(f"{mark}{i}" for i in range(n))


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: Fraction([3, 1, 2][i % 3]) for i, s in enumerate(names)}
    total = sum(sizes.values())
    free, held = set(names), Fraction(0)
    target = {}
    while free:
        level = (Fraction(3, 2) * total - held) / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not above:
            target |= {s: level * weight[s] for s in free}
            break
        for s in above:
            target[s] = Fraction(2 * sizes[s])
            held += target[s]
        free -= above
    return target


ROWS = (
    [(i, text(n), "hot") for i, n in enumerate([1, 2, 3, 5, 900, 40, 12] * 30)]
    + [(1000 + i, text(7), "b") for i in range(12)]
    + [(2000, text(5000), "é"), (2001, None, "empty"), (None, text(30), None), (2002, "", "b"), (2003, text(9), "a")]
    + [(3000, text(11), "b")] * 3
)


def test_targets_and_taken_words(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    rows = mixing.taken_by_document(df, block_words=16, shard_words=300).collect()
    assert len(rows) == len(ROWS)
    assert sorted((r.doc_id or -1, r.size) for r in rows) == sorted((i or -1, len((t or "").split())) for i, t, _ in ROWS)
    sizes = defaultdict(int)
    for _, t, s in ROWS:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    by_size = {float(want[s]): sizes[s] for s in sizes}
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == min(by_size.items(), key=lambda x: abs(x[0] - r.target))[1] or r.target == 0
        assert 0 <= r.taken <= 2 * r.size
        taken[r.target] += r.taken
    assert np.allclose(sorted(set(map(float, want.values()))), sorted(taken))
    assert all(abs(t - n) <= 0.5 for t, n in taken.items())
    again = mixing.taken_by_document(df.repartition(5), block_words=16, shard_words=300).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_slices_are_disjoint_and_shards_even(spark):
    df = spark.createDataFrame([r for r in ROWS if r[0] != 3000], "doc_id long, text string, source string")
    rows, slices = mixing.mix(df, block_words=16, shard_words=300)
    seen = defaultdict(set)
    words, draws = defaultdict(int), 0
    for s in slices.collect():
        span = set(range(s["first"], s["last"]))
        assert not span & seen[s.id, s.turn] and s["last"] <= s["size"]
        seen[s.id, s.turn] |= span
        words[s.shard] += len(span)
        draws += len(span)
    mean = draws / len(words)
    assert len(words) > 20 and all(abs(w - mean) < 0.25 * mean for w in words.values())
    assert rows.count() == len(ROWS) - 3


def test_splitting_tree_is_exact():
    counts = np.array([1000, 0, 37, 5], np.int64)
    leaves = list(mixing.split_quotas(counts, 0, 13, 3))
    assert [(lo, hi) for lo, hi, _ in leaves] == [(i, i + 1) for i in range(13)]
    assert (sum(c for _, _, c in leaves) == counts).all()
    assert {int(c.sum()) for _, _, c in leaves} <= {80, 79, 81}
    again = list(mixing.split_quotas(counts, 0, 13, 3))
    assert all((a[2] == b[2]).all() for a, b in zip(leaves, again))
    # The spread of a source over shards is that of random dealing.
    many = [c[2] for s in range(300) for _, _, c in mixing.split_quotas(np.array([960, 0, 60, 4]), 0, 8, s)]
    assert abs(np.mean(many) - 7.5) < 0.01 and abs(np.var(many) - 7.5 * (1 - 60 / 1024) * (7 / 8) * 1024 / 1023) < 0.6


def test_documents_of_the_mix(spark):
    df = spark.createDataFrame(
        [(i, t, s, len(t or ""), "x") for i, t, s in ROWS], "doc_id long, text string, source string, n_chars long, h string"
    )
    out = mixing.mixed_documents(df, block_words=16, shard_words=300)
    assert out.columns == df.columns
    taken = {(r.doc_id, r["size"]): r.taken for r in mixing.taken_by_document(df, block_words=16, shard_words=300).collect() if r.doc_id != 3000}
    words, originals = defaultdict(int), {i: t for i, t, _ in ROWS}
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.text in originals[r.doc_id] and r.n_chars == len(r.text) and r.h == "x"
    for (i, _), n in taken.items():
        assert words.get(i, 0) == n


def test_documents_come_in_shuffled_shards(spark, tmp_path):
    df = spark.createDataFrame([r for r in ROWS if r[0] != 3000], "doc_id long, text string, source string")
    options = {"block_words": 16, "shard_words": 300}
    slices = mixing.mix(df, **options)[1].collect()
    dealt = mixing.taken_by_document(df, **options).collect()
    want = defaultdict(int)
    for s in slices:
        want[s.id, s.shard] += s["last"] - s["first"]
    assert {(r.doc_id, p.shard): p.words for r in dealt for p in r.shards} == want
    assert all(sum(p.words for p in r.shards) == r.taken for r in dealt)
    places = defaultdict(list)
    for s in sorted(slices, key=lambda s: s.place):
        places[s.shard, s.id, s["first"]].append(s.place)

    mixing.mixed_documents(df, **options).write.parquet(f"file://{tmp_path}/out")
    got, files = defaultdict(int), sorted(tmp_path.glob("out/*.parquet"))
    assert len(files) == len({s.shard for s in slices}) > 20
    for shard, path in enumerate(files):
        last = -(2**63)
        for r in pd.read_parquet(path).itertuples():
            i = None if pd.isna(r.doc_id) else int(r.doc_id)
            got[i, shard] += len(r.text.split())
            last = next(p for p in places[shard, i, int(r.text.split()[0][1:])] if p >= last)
    assert got == want


def test_no_rows_and_no_words(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r["size"], r.target, r.taken) for r in mixing.taken_by_document(df).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
    assert mixing.taken_by_document(df.limit(0)).count() == 0
    assert mixing.mixed_documents(df).count() == 0


def test_equal_rows_and_rows_that_differ_elsewhere(spark, no_broadcast):
    """A third of the rows are one row; others differ only in a column of their own. Reruns agree."""
    rows = [(1, text(20), "a", 0)] * 2_500 + [(2, text(30, "x"), "a", k) for k in range(40)] + [(i, text(9, "y"), "b", 1) for i in range(10, 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").repartition(5)
    options = {"block_words": 16, "shard_words": 2_000}
    dealt = mixing.taken_by_document(df, **options).collect()
    assert len(dealt) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in dealt)
    out = mixing.mixed_documents(df, **options)
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
    taken = defaultdict(int)
    for r in dealt:
        taken[r.doc_id] += r.taken
    assert words == {i: n for i, n in taken.items() if n}
    again = mixing.mixed_documents(df.repartition(3), **options)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))


def test_texts_are_shuffled_once_before_the_shards(spark, no_broadcast):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    out = mixing.mixed_documents(df, block_words=16, shard_words=300)
    plan = out._jdf.queryExecution().executedPlan().toString()
    texts = [line for line in plan.splitlines() if "Exchange" in line and "hashpartitioning(h#" in line and "row_hash#" in line]
    assert len(texts) == 3  # the texts, and the slices before and after they are grouped
