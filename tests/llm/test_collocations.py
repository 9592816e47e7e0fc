import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np

from tableweave.llm import collocations

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows, support, first=2000, longest=5):
    """Every column of the result, in plain Python."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.setdefault((lang, k), Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang in n:
        of = {p: c for k in range(1, longest + 1) for p, c in f[lang, k].items()}
        candidates = {p: a for p, a in of.items() if len(p) > 1 and a >= support}
        ranked = []
        for p, a in candidates.items():
            if any(p == q[i : i + len(p)] and b >= a for q, b in candidates.items() if len(q) > len(p) for i in range(len(q) - len(p) + 1)):
                continue
            cuts = [(int(Fraction(1000 * a * n[lang], of[p[:k]] * of[p[k:]])), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        out += [
            (lang, rank, p.decode(), -a, left, right, n[lang], -score)
            for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:first], 1)
        ]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, score int, phrase string")
    got = collocations.collocations(df, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, got.collect()))


def sentences(seed, rows=60):
    rng = random.Random(seed)
    common = ["the", "of", "New", "York", "city", "é", "ß", "and", "and", "b2"]
    fixed = ["new york city", "state of the art", "one two three four five six", "ha ha ha ha"]
    out = []
    for _ in range(rows):
        parts = []
        for _ in range(rng.randrange(1, 30)):
            part = rng.choice(fixed) if rng.random() < 0.4 else " ".join(rng.choice(common) for _ in range(rng.randrange(1, 6)))
            parts.append(part + rng.choice([" ", "\t ", ". ", ",", "\n", "!?", "...;", "\x0b"]))
        out.append(("".join(parts), rng.choice(["en", "de", None, "und", ""])))
    return out


def test_equal_to_plain_counting(spark):
    rows = sentences(1)
    want = brute(rows, 5)
    assert len(want) > 30 and {len(w[2].split()) for w in want} >= {2, 3, 4, 5}
    assert found(spark, rows, support=5) == want
    assert found(spark, rows, support=5, first=3) == brute(rows, 5, 3)


def test_many_runs(spark):
    rows = sentences(2, 40)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(13)
    got = sorted(map(tuple, collocations.collocations(df, support=4).collect()))
    assert got == brute(rows, 4)


def test_word_places():
    text = b"a b.c  d\te,,f\ng"
    starts, ends, row, piece = collocations.word_places(np.frombuffer(text + b"hi j", np.uint8), np.array([0, 0, len(text), len(text), len(text) + 4]))
    assert [bytes((text + b"hi j")[a:b]) for a, b in zip(starts, ends)] == [b"a", b"b", b"c", b"d", b"e", b"f", b"g", b"hi", b"j"]
    assert row.tolist() == [1] * 7 + [3] * 2 and piece.tolist() == [0, 0, 1, 1, 1, 2, 3, 4, 4]
    codes = np.array([0, 3, 70_000, 1], np.uint32)
    assert collocations.unpacked(collocations.packed(codes)).tolist() == codes.tolist()
    assert collocations.unpacked(collocations.packed(codes[:2])).dtype == np.uint16
    assert len(collocations.unpacked(collocations.packed(codes[:0]))) == 0


def test_nulls_empty_long_and_repeated_rows(spark):
    long = "x y " * 200_000
    rows = [(None, "en"), ("", None), (" .,\n", "en"), (long, "en"), ("p q. p q", None)] + [("p q r", None)] * 40 + [("é Ä", "fr")] * 7
    got = found(spark, rows, support=5)
    assert got == brute(rows, 5)
    assert ("und", "p q", 42) in [(g[0], *g[2:4]) for g in got] and ("fr", "é Ä", 7) in [(g[0], *g[2:4]) for g in got]
    assert found(spark, [(None, None), ("a b", "en")], support=5) == []
    df = spark.createDataFrame(rows, "text string, lang string").limit(0)
    assert collocations.collocations(df).count() == 0


def test_ties_go_by_occurrences_then_bytes(spark):
    rows = [("b a", "x")] * 6 + [("a b", "x")] * 6 + [("é z", "x")] * 6 + [("Z z", "x")] * 6
    got = found(spark, rows, support=6)
    assert got == brute(rows, 6) and len(got) == 4


def test_packed_pairs_are_small_and_exact():
    """A run's distinct pairs, most of them rare, take a few bytes each, not a row of numbers."""
    rng = np.random.default_rng(1)
    numbers = np.sort(rng.choice(1 << 30, 30_000, replace=False)) + (5 << 42)
    codes = np.minimum(rng.zipf(1.2, 120_000), 30_000).astype(np.uint32)
    codes[::9] = 0
    at, code, bucket, a, b = collocations._pairs_of(codes, numbers, 7)
    assert sorted(zip(a[code], b[code])) == sorted((numbers[x - 1], numbers[y - 1]) for x, y in zip(codes, codes[1:]) if x and y)
    assert sorted(set(zip(bucket, a, b))) == list(zip(bucket, a, b)) and set(bucket) == set(range(7))
    count, size = np.bincount(code), 0
    for k in range(7):
        columns = a[bucket == k], b[bucket == k], count[bucket == k]
        blob = collocations.packed_pairs(*columns)
        assert np.array_equal(collocations.unpacked_pairs(blob), np.stack(columns))
        size += len(blob)
    assert size < 8 * len(a)
    one = collocations.packed_pairs(a[:1], b[:1], count[:1])
    assert collocations.unpacked_pairs(one).tolist() == [[a[0]], [b[0]], [count[0]]]


def test_pairs_of_many_runs_meet_in_buckets(spark, monkeypatch):
    """A run passes on a row per bucket, not one per distinct pair; counts add up over runs."""
    monkeypatch.setattr(collocations, "RUN_BYTES", 300)
    seen, plain = [], collocations._pairs
    monkeypatch.setattr(collocations, "_pairs", lambda buckets: seen.append(buckets) or plain(buckets))
    rows = sentences(3, 50)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    assert sorted(map(tuple, collocations.collocations(df, support=4).collect())) == brute(rows, 4)
    assert len(seen) == 4 and min(seen) >= 8
