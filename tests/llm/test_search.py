import math
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest

from tableweave.llm import ann, topk

QUERY = "id % 20 = 0"


def brute(rows, k, whole, zero_too):
    """(query, rank, id, score) over all pairs."""
    ok = [
        (i, v) for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero_too or any(v))
    ]
    if whole:
        ok = [(i, [math.floor(64 * x) for x in v]) for i, v in ok]
    out = []
    for q, v in ok:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return out


def data(seed=0, n=700, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[100:260] = x[0]
    x[300:320] *= 0
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(None, rows[1][1]), (2000, None), (2020, []), (2040, [1.0, None]), (2060, [float("nan")] * dim),
             (2080, [float("inf")] * dim), (3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (3020, [0.5, -0.25]), (4000, [0.0] * dim)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")


def test_exact_top_k(spark):
    rows = data()
    got = topk.top_scores(frame(spark, rows), QUERY, block_rows=128, query_rows=16).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(brute(rows, 20, True, True))


def test_threshold_stops_early_and_large_numbers(spark):
    rng = np.random.default_rng(1)
    x = np.zeros((5000, 8))
    x[np.arange(5000), rng.integers(0, 8, 5000)] = rng.integers(1, 1000, 5000)
    lists = topk.Lists(np.arange(5000), x)
    q = np.array([[3.0, 0, 0, 2, 0, 0, 0, 0], [0, -1.0, 0, 0, 0, 0, 0, 0], [1.0] * 8])
    none, any_ = np.full(3, -np.inf), np.full(3, -1)
    found, depth = lists.top(q, 20, any_, none)
    for weights, (ids, scores) in zip(q, found):
        assert list(zip(-scores, ids)) == sorted(zip(-(x @ weights), range(5000)))[:20]
    assert depth[0] < 1000 and depth[1] == 5000
    # Known scores of other blocks end the reading, and what lies below is left out.
    bound = np.array([3_000.0, 0.0, 2_000.0])
    found, less = lists.top(q, 20, any_, bound)
    assert less[0] <= depth[0] and less[2] < 1000 and len(found[2][0]) == 0 and (found[0][1] >= 2_900).all()
    big = [(0, [1e10, 1.0]), (1, [1e10, -3.0]), (2, [-1e10, 0.0]), (20, [1e18, 1e18])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_scores(df, QUERY).collect()}
    for a, v in big:
        for b, w in big:
            if a % 20 == 0 and a != b:
                s = sum(math.floor(64 * p) * math.floor(64 * r) for p, r in zip(v, w))
                assert got[a, b] == max(-(2**63), min(2**63 - 1, s))


def test_bound_keeps_ties(spark):
    """Many equal scores over many blocks: ties go to the smallest ids."""
    rows = [(i, [1.0, 2.0, float(i % 3)]) for i in range(900)]
    got = topk.top_scores(frame(spark, rows), QUERY, block_rows=50, query_rows=16).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(brute(rows, 20, True, True))


@pytest.mark.parametrize("size", [1e25, 1e150, 1e307])
@pytest.mark.parametrize("which", ["one row", "one query", "all"])
def test_large_finite_vectors(spark, size, which):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 8)) / 4
    of = {"one row": [17], "one query": [40], "all": range(400)}[which]
    for i in of:
        x[i] *= size
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    # Products may be infinite, as doubles are: then the order is that of plain doubles.
    got = {}
    for r in ann.nearest(df, QUERY, block_rows=128, query_rows=8).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score))
    with np.errstate(over="ignore", invalid="ignore"):
        for q in range(0, 400, 20):
            scores = np.delete((x * x[q]).sum(1), q)
            scores = np.sort(scores[~np.isnan(scores)])[::-1][:20]
            mine = np.array([s for _, s in sorted(got[q])])
            assert len(mine) == 20
            mine = mine[~np.isnan(mine)]
            close = [np.isclose(mine, s, rtol=1e-12, atol=0).any() or s in mine for s in scores]
            assert np.mean(close) >= 0.9
    exact = topk.top_scores(df, QUERY, block_rows=128, query_rows=8).collect()
    ints = [[math.floor(Fraction(v) * 64) for v in row] for row in x.tolist()]
    for q in (0, 40):
        want = sorted((-sum(a * b for a, b in zip(ints[q], w)), i) for i, w in enumerate(ints) if i != q)[:20]
        mine = {r["rank"]: (r.vec_id, r.score) for r in exact if r.query_id == q}
        held = [max(-(2**63), min(2**63 - 1, -s)) for s, _ in want]
        assert [mine[k][1] for k in range(1, 21)] == held
        assert all(mine[k + 1][0] == i for k, (_, i) in enumerate(want) if abs(held[k]) < 2**63 - 1)


def test_neighbours_found(spark):
    rows = data(3)
    got = ann.nearest(frame(spark, rows), QUERY, block_rows=128, query_rows=16).collect()
    want = brute([(i, None if v is None else [None if a is None else float(np.float32(a)) for a in v]) for i, v in rows], 20, False, False)
    assert len(got) == len(want)
    truth = {(q, i) for q, _, i, _ in want}
    scores = {(q, n): s for q, n, _, s in want}
    hit = sum((r.query_id, r.vec_id) in truth for r in got)
    assert hit / len(want) > 0.97
    for r in got:
        assert r.score <= scores[r.query_id, r["rank"]] + 1e-9
    by_query = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by_query.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert all(v == sorted(v) for v in by_query.values())


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(3000, 64)), rng.normal(size=(40, 64))
    c, turn = x.mean(0), ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    guess, error = ann.estimates(*ann.encode(x, c, turn), q, c, turn, ann.EPS)
    off = np.abs(guess - x @ q.T)
    assert (off > error).mean() < 0.03 and error.mean() < 1.2 * np.sqrt(64) * 64**0.5 / 4
    assert abs((guess - x @ q.T).mean()) < 0.05


def test_recall_on_the_table(spark):
    path = Path("/root/testdata/sf0.01/embeddings.parquet")
    if not path.exists():
        pytest.skip("no test data")
    df = spark.read.parquet(str(path))
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    want = brute(rows, 20, False, False)
    got = {(r.query_id, r.vec_id) for r in ann.nearest(df, QUERY).collect()}
    assert len(got & {(q, i) for q, _, i, _ in want}) / len(want) > 0.98
    exact = topk.top_scores(df, QUERY).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in exact) == sorted(brute(rows, 20, True, True))


def test_no_rows(spark):
    df = frame(spark, data()[:5])
    assert ann.nearest(df.limit(0), QUERY).count() == 0 and topk.top_scores(df.limit(0), QUERY).count() == 0
    one = ann.nearest(df.where("vec_id < 2"), QUERY).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in one] == [(0, 1, 1)]
