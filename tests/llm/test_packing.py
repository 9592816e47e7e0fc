import random

import pytest

from tableweave.llm import packing


def slow_best_fit(lengths, capacities, quadratic):
    """Every choice by looking at all bins and all remaining pieces."""
    rooms, filled, places, opened = [], [], [], []
    for i, length in enumerate(lengths):
        fit = [(rooms[b], opened[b], b) for b in range(len(rooms)) if rooms[b] >= length]
        if fit:
            b = min(fit)[2]
        else:
            best = None
            for c in capacities:
                if c >= length:
                    free = c - length
                    fitting = sum(x for x in lengths[i + 1:] if x <= free)
                    key = (packing.cost_of(c, quadratic) / (length + min(free, fitting)), c)
                    best = min(best or (key, c), (key, c))
            b = len(rooms)
            rooms.append(best[1])
            filled.append(0)
            opened.append(0)
        places.append((b, filled[b]))
        filled[b] += length
        rooms[b] -= length
        opened[b] = i
    return places


@pytest.mark.parametrize("seed", range(12))
def test_equal_to_slow_best_fit(seed):
    rng = random.Random(seed)
    capacities = tuple(sorted(rng.sample(range(4, 60), 4)))
    lengths = sorted((rng.randint(1, capacities[-1]) for _ in range(rng.randint(0, 120))), reverse=True)
    assert packing.best_fit(lengths, capacities, 1 / 64) == slow_best_fit(lengths, capacities, 1 / 64)


def text(n):
    return " ".join(["w"] * n)


def check(rows, sizes, capacities, quadratic=1 / 65_536):
    """Every word of every document once, bins within their length and no larger than needed."""
    bins, words = {}, {}
    for r in rows:
        if r.length == 0:
            assert r.bin is None and r.capacity is None
            continue
        words.setdefault(r.doc_id, []).append((r.start, r.length))
        bins.setdefault((r.bin, r.capacity, r.bin_tokens), []).append((r.bin_offset, r.length))
    for doc, n in sizes.items():
        at = 0
        for start, length in sorted(words.get(doc, [])):
            assert start == at
            at += length
        assert at == n
    for (_, capacity, filled), parts in bins.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == filled <= capacity
        assert capacity == min((c for c in capacities if c >= filled), key=lambda c: packing.cost_of(c, quadratic))
    return bins


def test_every_word_is_packed_once(spark):
    rng = random.Random(5)
    sizes = {i: rng.choice([0, 1, 7, 63, 64, 65, 300, 129]) for i in range(400)}
    df = spark.createDataFrame([(i, text(n), i) for i, n in sizes.items()], "doc_id long, text string, bin int")
    bins = check(packing.pack(df, capacities=(16, 32, 64), shard_pieces=150).collect(), sizes, (16, 32, 64))
    used = sum(c for _, c, _ in bins)
    assert used < 1.1 * sum(sizes.values())
    again = packing.pack(df, capacities=(64, 32, 16), shard_pieces=150)
    assert sorted(map(str, again.collect())) == sorted(map(str, packing.pack(df, capacities=(16, 32, 64), shard_pieces=150).collect()))


def test_nulls_repeats_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None), (1, "a"), (1, "a"), (2, " \t")], "doc_id long, text string")
    rows = packing.pack(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.length) for r in rows) == [
        (False, 1, 1), (False, 1, 1), (False, 2, 0), (True, 0, 0), (True, 0, 2)]
    assert {r.capacity for r in rows} == {512, None}
    assert packing.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, capacities=())


def test_sequences_hold_the_texts(spark):
    df = spark.createDataFrame([(1, " a b\nc d e"), (2, "x  y"), (3, "")], "doc_id long, text string")
    packed = packing.pack(df, capacities=(2, 4))
    got = {r.text for r in packing.sequences(df, packed).collect()}
    assert sorted(" ".join(got).split()) == list("abcdexy")
    assert any("a b\nc d" in t for t in got)


def test_one_row_in_most_places(spark):
    """Copies of one row spread over the shards; reruns agree."""
    rows = [(1, "a b c d e")] * 3_000 + [(2, " ".join("x" * 700))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = packing.pack(df, shard_pieces=500).collect()
    assert len(out) == 3_001 and sum(r.length for r in out) == 15_700
    shards = {}
    for r in out:
        shards[r.bin.split("-")[0]] = shards.get(r.bin.split("-")[0], 0) + 1
    assert len(shards) == 7 and max(shards.values()) < 700
    assert sorted(map(str, out)) == sorted(map(str, packing.pack(df.repartition(3), shard_pieces=500).collect()))
