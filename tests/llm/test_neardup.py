import random
from pathlib import Path

import numpy as np
import pytest

from tableweave.llm import neardup
from tableweave.llm.arrays import mixed

from .test_jaccard import brute, shingles


def found(df, **options):
    rows = neardup.near_duplicates(df, **options).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def copies(seed, groups=12, most=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for _ in range(groups):
        original = [rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 40, 150, 400]))]
        for _ in range(rng.choice([1, 4, most])):
            copy = list(original)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy[len(copy) // 2 : len(copy) // 2] = passage
            if rng.random() < 0.1:
                copy = copy[: max(1, int(len(copy) * rng.uniform(0.7, 1)))]
            rows.append((len(rows) * 3, " ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy)))
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_equal_to_all_pairs(spark, percent):
    rows = copies(percent)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, percent=percent) == brute(rows, 5, percent)


def test_one_large_group_of_near_copies(spark, no_broadcast):
    """Copies around the threshold: some link with the original, some with copies only, some with none."""
    rng = random.Random(3)
    original = [f"w{rng.randrange(5_000)}" for _ in range(300)]
    rows = []
    for i in range(300):
        copy = list(original)
        for _ in range(rng.choice([0, 2, 4, 5, 6, 7, 8, 12])):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
        if i % 60 == 7:  # a copy of a copy
            copy[rng.randrange(len(copy))] = "y"
            rows.append((1000 + i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, 5, 85)
    assert 20 < len({c for _, c in want.values()}) < 280
    assert found(df, percent=85) == want


def test_sketches_fill_and_agree_like_sets():
    rng = np.random.default_rng(2)
    size = 240
    agree = []
    for n in (1, 2, 7, 60, 3_000):
        common = rng.integers(0, 2**63, 3 * n, dtype=np.uint64)
        own = [rng.integers(0, 2**63, n, dtype=np.uint64) for _ in range(2)]
        sets = [np.concatenate((common, o)) for o in own]
        table = neardup.sketches(np.concatenate(sets), np.array([0, 4 * n, 8 * n, 8 * n]), size)
        assert (table[:2] != neardup._EMPTY).all() and (table[2] == neardup._EMPTY).all()
        agree.append((table[0] == table[1]).mean())
        # The value is that of one shingle of the set.
        assert (table[0] >> np.uint64(54) < 2 * size).all()
    assert all(abs(a - 0.6) < 0.2 for a in agree[2:]) and abs(np.mean(agree[2:]) - 0.6) < 0.08
    h = mixed(np.arange(1, 1_001, dtype=np.uint64))
    one = neardup.sketches(h, np.array([0, 1000]), size)
    assert (one == neardup.sketches(np.concatenate((h[::-1], h[:5])), np.array([0, 1005]), size)).all()


def test_whole_table(spark):
    data = Path("/root/testdata/sf0.001/documents.parquet")
    if not data.exists():
        pytest.skip("no test data")
    docs = spark.read.parquet(str(data))
    assert found(docs, percent=85) == brute([(r.doc_id, r.text) for r in docs.collect()], 5, 85)


def test_nulls_short_long_and_repeated_rows(spark):
    long = " ".join(f"x{i}" for i in range(200_000))
    rows = [
        (5, "a b c", 1), (3, "A B\tC", 2), (9, "a b", 3), (1, "", 4), (2, None, 5), (None, "a b c", 6), (4, " \n", 7),
        (20, long, 8), (21, long + " more", 9), (30, "p q r s t u", 10), (30, "p q r s t u", 11),
        (31, "p q r s t u", 12), (31, "another text of its own here", 13),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = sorted(map(tuple, neardup.near_duplicates(df).collect()), key=str)
    want = [(5, 1, 3, False), (3, 1, 3, True), (9, 1, 9, True), (1, 0, 1, True), (2, 0, 2, True), (None, 1, None, True),
            (4, 0, 4, True), (20, 199_996, 20, True), (21, 199_997, 20, False), (30, 2, 30, True), (30, 2, 30, True),
            (31, 2, 30, False), (31, 2, 31, True)]
    assert got == sorted(want, key=str)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_copies_of_one_text_are_one_node(spark):
    rows = [(i, "the same words in every one of these") for i in range(3_000)] + [(9_999, "no words of it")]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {c for i, (_, c) in got.items() if i < 3_000} == {0} and got[9_999] == (len(shingles("no words of it", 5)), 9_999)
