import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from tableweave.llm import jaccard
from tableweave.llm.components import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text, n=4):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows, n=4, percent=85):
    """(shingles, component) of each id, from all pairs that share a shingle."""
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    lists = {}
    for i, s in sets.items():
        for token in s:
            lists.setdefault(token, []).append(i)
    for i, s in sets.items():
        for j, k in Counter(j for token in s for j in lists[token] if j < i).items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def found(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(df, **options).collect()}


@pytest.mark.parametrize("words, percent", [(4, 85), (5, 80)])
def test_equal_to_all_pairs(spark, words, percent):
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for base in range(12):
        original = [rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 40, 150, 400]))]
        for _ in range(rng.choice([1, 4, 25])):
            copy = list(original)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy[len(copy) // 2 : len(copy) // 2] = passage
            rows.append((len(rows) * 3, " ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, words=words, percent=percent) == brute(rows, words, percent)


@pytest.mark.parametrize("percent", [30, 50, 70])
def test_low_similarities_of_long_texts(spark, percent):
    """Copies with so many changes that pairs lie around the threshold, of very unlike sizes too."""
    rng = random.Random(percent)
    rows = []
    for base in range(5):
        original = [f"{base}w{rng.randrange(4_000)}" for _ in range(rng.choice([300, 900, 2_000]))]
        for _ in range(14):
            copy = list(original)
            for _ in range(int(len(copy) * rng.uniform(0, 0.9 - percent / 130))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.5:
                copy = copy[: int(len(copy) * rng.uniform(percent / 110, 1))]
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 1, percent)
    assert 6 < len({c for _, c in want.values()}) < 69
    assert found(df, words=1, percent=percent) == want


def test_tables_grow_with_the_input():
    assert [jaccard.counters_for(n) for n in (0, 10, 10**5, 10**6, 10**12)] == [1 << 18, 1 << 18, 1 << 19, 1 << 22, 1 << 24]


def test_whole_table(spark):
    data = Path("/root/testdata/sf0.001/documents.parquet")
    if not data.exists():
        pytest.skip("no test data")
    docs = spark.read.parquet(str(data))
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_nulls_short_long_and_repeated_rows(spark):
    long = " ".join(f"x{i}" for i in range(300_000))
    rows = [
        (5, "a b c", 1), (3, "A B\tC", 2), (9, "a b", 3), (1, "", 4), (2, None, 5), (None, "a b c", 6), (4, " \n", 7),
        (20, long, 8), (21, long + " more", 9), (30, "p q r s t", 10), (30, "p q r s t", 11),
        (40, "é ü é ü é", 12), (41, "É ü é ü é", 13),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sorted(map(tuple, jaccard.similar_documents(df).collect()), key=str)
    want = [(5, 1, 3), (3, 1, 3), (9, 1, 9), (1, 0, 1), (2, 0, 2), (None, 1, None), (4, 0, 4), (20, 299_997, 20),
            (21, 299_998, 20), (30, 2, 30), (30, 2, 30), (40, 2, 40), (41, 2, 41)]
    assert got == sorted(want, key=str)
    assert jaccard.similar_documents(df.limit(0)).count() == 0


def test_prefix_lemma():
    """Two similar sets share ℓ shingles within what both keep, for either one's ℓ."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        x = rng.choice(100_000, n, replace=False).astype(np.uint64)
        swap = int(rng.integers(0, n // 10 + 1))
        y = np.concatenate([x[swap:], rng.choice(np.arange(100_000, 200_000), int(rng.integers(0, n // 10 + 1)), replace=False).astype(np.uint64)])
        common = len(np.intersect1d(x, y))
        if 100 * common < 85 * (len(x) + len(y) - common):
            continue
        seen = {int(t): int(rng.integers(1, 50)) for t in np.union1d(x, y)}
        px, bx, lx = jaccard.prefix_of(np.sort(x), np.array([seen[int(t)] for t in np.sort(x)]), 85)
        py, by, ly = jaccard.prefix_of(np.sort(y), np.array([seen[int(t)] for t in np.sort(y)]), 85)
        ell = max(lx, ly)
        assert len(np.intersect1d(px[: bx + ell - 1], py[: by + ell - 1])) >= ell


def test_partner_classes_lose_no_similar_set():
    """A set's own prefix shingles never rule out a size that a similar set has."""
    rng = np.random.default_rng(9)
    seen = 0
    for _ in range(400):
        n = int(rng.integers(1, 500))
        x = rng.choice(10**6, n, replace=False)
        drop, add = int(rng.integers(0, n // 9 + 1)), int(rng.integers(0, n // 9 + 1))
        y = np.concatenate([x[drop:], 10**6 + rng.choice(10**6, add, replace=False)])
        common = n - drop
        if not len(y) or 100 * common < 85 * (n + len(y) - common):
            continue
        seen += 1
        order = {int(t): (int(rng.integers(1, 4)), int(t)) for t in np.union1d(x, y)}
        px, py = ([int(t) for t in sorted(s, key=lambda t: order[int(t)])][: jaccard.kept_length(len(s), 85)] for s in (x, y))
        for mine, others, size, other in ((px, py, n, len(y)), (py, px, len(y), n)):
            shared = np.array([i for i, t in enumerate(mine) if t in set(others)], np.int64)
            first, last = jaccard.partner_classes(size, shared, 85)
            assert first <= jaccard.size_class(other) <= last
    assert seen > 100
    for k in range(1, 900):
        lo, hi = jaccard._class_sizes(k)
        assert all(lo <= n <= hi for n in range(max(1, lo - 5), hi + 5) if jaccard.size_class(n) == k)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 100), (5, 5), (200, 3), (200, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 0}
    assert connected(df.limit(0)).count() == 0
