"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A sketch has ``bands * rows`` coordinates. In round i each shingle of a set falls into one
coordinate with the value (i, hash): into a hashed one in the first rounds, as many as
there are coordinates, then into coordinate i - bands * rows. A coordinate keeps its least
value, so what an earlier round has filled stays; a set stops at the round that leaves no
coordinate empty. Every coordinate is filled whatever the size of the set, a large set
needs a few rounds, and two sets agree in a coordinate with the probability of their
similarity, agreements being as concentrated as for independent minima.

1. One pass over the texts gives each row its set's signature and its band keys. Rows of
   equal sets form a class, one node; a class is read once from here on.
2. Nodes that share a band key form a bucket. Its most popular member (most companions in
   its buckets), an original rather than a copy, is the pivot; each member's overlap with
   it is counted on the whole sets. Links give first components.
3. What may still link different components of a bucket is found without comparing all
   its members. A node's home is its most popular pivot. Two nodes of one home that share
   no shingle outside of it overlap by no more than either does with the home; the few
   pairs this leaves open are listed from the bucket, those that share other shingles
   from an index of just these shingles, and pairs of different homes from the bucket.
   All are verified on the whole sets.
4. All links give the components.

The only loss is what banding misses: a pair at the threshold of 85 % meets in none of 40
bands of 6 coordinates with a probability of 6e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import mixed, slices, text_bytes
from .components import connected
from .idfilter import id_table, may_hold
from .jaccard import set_signature, shingle_hashes
from .shared import stored

BANDS = 40
ROWS = 6
_EMPTY = np.uint64(np.iinfo(np.uint64).max)


def sketches(h: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """Sketches of the sets h[begin[i]:begin[i + 1]], one row each; empty sets stay empty."""
    rows = len(begin) - 1
    table = np.full((rows, size), _EMPTY, np.uint64)
    owner = np.repeat(np.arange(rows), np.diff(begin))
    for i in range(2 * size):
        if not len(h):
            break
        v = mixed(h ^ mixed(np.array([i + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        at = (v % np.uint64(size)).astype(np.int64) if i < size else np.full(len(h), i - size)
        np.minimum.at(table.reshape(-1), owner * size + at, np.uint64(i) << np.uint64(54) | v >> np.uint64(10))
        open_rows = (table == _EMPTY).any(1)[owner]
        owner, h = owner[open_rows], h[open_rows]
    return table


def band_keys(table: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band and set."""
    parts = table.reshape(len(table), bands, -1)
    keys = np.zeros(parts.shape[:2], np.uint64)
    for k in range(parts.shape[2]):
        keys = mixed(keys * np.uint64(31) + parts[:, :, k] + np.uint64(1))
    return keys


def _hashed(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, end, shingle hashes, where each row's begin) of (id, text) rows."""
    data, offsets = text_bytes(batch.column(1))
    for lo, hi in slices(offsets):
        yield lo, hi, *shingle_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words)


def _lists(arrays: list[np.ndarray], of: pa.DataType) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, of))


def _scan(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, node, check, keys = [], [], [], []
            for lo, hi, h, begin in _hashed(batch, words):
                found = band_keys(sketches(h, begin, bands * rows), bands).view(np.int64)
                for i in range(hi - lo):
                    s = np.unique(h[begin[i] : begin[i + 1]])
                    a, b = set_signature(s)
                    size.append(len(s))
                    node.append(a)
                    check.append(b)
                    keys.append(found[i] if len(s) else found[i][:0])
            signed = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (node, check)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), *signed, _lists(keys, pa.int64())],
                ["id", "n", "node", "mark", "keys"],
            )

    return run


def _whole_sets(words: int, table):
    """(node, id, set) of the rows whose node is in the bit table, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, h, begin in _hashed(batch, words):
                node, at, sets = [], [], []
                for i in range(hi - lo):
                    s = np.unique(h[begin[i] : begin[i + 1]])
                    own = int(np.array([set_signature(s)[0]], np.uint64).view(np.int64)[0])
                    if len(s) and own not in seen and may_hold(table.value, np.array([own]))[0]:
                        seen.add(own)
                        node.append(own)
                        at.append(lo + i)
                        sets.append(s.tobytes())
                ids = batch.column(0).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), ids, pa.array(sets, pa.binary())], ["node", "id", "set"])

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, left, right) to (a, b, common)."""
    for batch in batches:
        common = np.zeros(batch.num_rows, np.int64)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            both = np.concatenate([np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y)])
            both.sort(kind="stable")
            common[i] = np.count_nonzero(both[1:] == both[:-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common)], ["a", "b", "common"])


def _others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, left, right) to (a, others): what a has that b has not."""
    for batch in batches:
        found = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            found.append(np.setdiff1d(x, y, assume_unique=True).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found, pa.int64())], ["a", "others"])


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("right"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right")


def _enough(percent: int, common: Column, x: str, y: str) -> Column:
    """Sets of sizes x and y with so many shingles in common are similar."""
    return (100 + percent) * common >= percent * (F.col(x) + F.col(y))


def _sizes_fit(percent: int, x: str, y: str) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _between_components(members: DataFrame, by: list[str]) -> DataFrame:
    """Members of lists that hold several components, and whether theirs is the list's largest."""
    top = (
        members.groupBy(*by, "component").agg(F.count("*").alias("members"))
        .groupBy(*by).agg(F.count("*").alias("parts"), F.max(F.struct("members", "component")).alias("top"))
        .where("parts > 1").select(*by, F.col("top.component").alias("top"))
    )
    return members.join(top, by).withColumn("inner", F.col("component") == F.col("top")).drop("top")


def _open_pairs(mixed_lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket that home overlaps leave open, and pairs of different homes."""
    bucket = ["band", "key"]
    # Of two homes one is not the bucket's most common one.
    homes = (
        mixed_lists.groupBy(*bucket, "home").agg(F.count("*").alias("members"))
        .groupBy(*bucket).agg(F.count("*").alias("homes"), F.max(F.struct("members", "home")).alias("most"))
        .where("homes > 1").select(*bucket, F.col("most.home").alias("most"))
    )
    several = mixed_lists.join(homes, bucket)
    x, y = several.where("home <> most").alias("x"), several.alias("y")
    far = x.join(
        y,
        [F.col(f"x.{c}") == F.col(f"y.{c}") for c in bucket]
        + [
            (F.col("x.home") != F.col("y.home")) & (F.col("x.component") != F.col("y.component"))
            & ((F.col("y.home") == F.col("y.most")) | (F.col("x.node") < F.col("y.node")))
            & _sizes_fit(percent, "x.n", "y.n")
        ],
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    # The largest set that a node may be similar to without other shingles in common.
    alone = [*bucket, "home"]
    lists = _between_components(mixed_lists.drop("inner"), alone).withColumn(
        "most_n", F.floor((100 + percent) * F.col("with_home") / percent) - F.col("n")
    )
    least = lists.groupBy(*alone).agg(F.min("n").alias("least_n"))
    x = lists.where(~F.col("inner")).join(least, alone).where("most_n >= least_n").drop("least_n")
    reach = x.groupBy(*alone).agg(F.max("most_n").alias("reach_n"), F.min("n").alias("outer_n"))
    y = lists.join(reach, alone).where("n <= reach_n and most_n >= outer_n")
    x, y = x.alias("x"), y.alias("y")
    near = x.join(
        y,
        [F.col(f"x.{c}") == F.col(f"y.{c}") for c in alone]
        + [
            (F.col("x.component") != F.col("y.component")) & (F.col("y.inner") | (F.col("x.node") < F.col("y.node")))
            & _sizes_fit(percent, "x.n", "y.n")
            & _enough(percent, F.least("x.with_home", "y.with_home"), "x.n", "y.n")
        ],
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    return far.unionAll(near)


def _sharing_others(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of one home whose shingles outside of it, counted, may make them similar."""
    pairs = members.where("node <> home").select(F.col("node").alias("a"), F.col("home").alias("b"))
    others = stored(
        _with_sets(pairs, sets).mapInArrow(_others, "a long, others array<long>")
        .select(F.col("a").alias("node"), F.explode("others").alias("shingle"))
    )
    listed = others.join(members.select("node", "home", "n", "with_home", "component"), "node")
    lists = stored(_between_components(listed, ["home", "shingle"]))
    x, y = lists.where(~F.col("inner")).alias("x"), lists.alias("y")
    met = x.join(
        y,
        (F.col("x.home") == F.col("y.home")) & (F.col("x.shingle") == F.col("y.shingle"))
        & (F.col("x.component") != F.col("y.component")) & (F.col("y.inner") | (F.col("x.node") < F.col("y.node")))
        & _sizes_fit(percent, "x.n", "y.n"),
    )
    a, b = F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")
    counted = met.groupBy(a, b, (F.col("x.n") + F.col("y.n")).alias("sizes"), F.least("x.with_home", "y.with_home").alias("home_common"))
    return (
        counted.agg(F.countDistinct("x.shingle").alias("more"))
        .where((100 + percent) * (F.col("home_common") + F.col("more")) >= percent * F.col("sizes")).select("a", "b")
    )


def near_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, percent: int = 80,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Texts link when 100 * |A ∩ B| >= percent * |A ∪ B| for their sets of word n-grams;
    the component is the smallest id reachable by links, the own one included, and the
    rows that bear it are kept.

    Null and blank texts have no shingles and link with nothing. Rows are documents: two
    rows of one id link by their texts only. Rows with a null id take no part in linking,
    have a null component and are kept. Other columns are ignored; no rows give no rows.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scanned = stored(docs.mapInArrow(_scan(words, bands, rows), "id long, n long, node long, mark long, keys array<long>"))
    same = ["node", "mark", "n"]
    classes = scanned.where("n > 0 and id is not null").groupBy(*same).agg(F.min("id").alias("id"))
    heads = scanned.join(classes, [*same, "id"], "left_semi").dropDuplicates(["node"])
    lists = heads.select("node", "n", F.posexplode("keys").alias("band", "key"))
    bucket = ["band", "key"]
    shared = lists.groupBy(*bucket).agg(F.count("*").alias("members")).where("members > 1")
    live = stored(lists.join(shared, bucket))

    popular = live.groupBy("node").agg(F.sum("members").alias("popular"))
    live = stored(live.drop("members").join(popular, "node"))
    rank = F.struct("popular", "node")
    pivots = live.groupBy(*bucket).agg(F.max(F.struct("popular", "node", "n")).alias("p"))
    stars = stored(
        live.join(pivots, bucket).where(F.col("node") != F.col("p.node"))
        .select(F.col("node").alias("a"), F.col("p.node").alias("b"), F.col("n").alias("a_n"), F.col("p.n").alias("b_n"),
                F.col("p.popular").alias("popular")).distinct()
    )
    nodes = stored(live.select("node", "n", "popular").distinct())
    marked = docs.sparkSession.sparkContext.broadcast(id_table(nodes.select("node")))
    with_id = docs.where("id is not null").mapInArrow(_whole_sets(words, marked), "node long, id long, set binary")
    sets = stored(with_id.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"]).select("node", "set"))

    measured = stored(
        _with_sets(stars, sets).mapInArrow(_overlaps, "a long, b long, common long").join(stars, ["a", "b"])
    )
    first = measured.where(_enough(percent, F.col("common"), "a_n", "b_n")).select("a", "b")
    known = stored(connected(first))

    # A node more popular than its pivots is its own home.
    own = nodes.select("node", F.struct("popular", F.col("node").alias("home"), F.col("n").alias("with_home")).alias("h"))
    met = measured.select(F.col("a").alias("node"), F.struct("popular", F.col("b").alias("home"), F.col("common").alias("with_home")).alias("h"))
    homes = own.unionAll(met).groupBy("node").agg(F.max("h").alias("h")).select("node", "h.home", "h.with_home")
    placed = stored(
        nodes.select("node", "n").join(homes, "node").join(known, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    mixed_lists = stored(_between_components(live.select("node", *bucket).join(placed, "node"), bucket))
    members = placed.join(mixed_lists.select("node").distinct(), "node", "left_semi")
    open_pairs = _open_pairs(mixed_lists, percent).unionAll(_sharing_others(members, sets, percent))
    left = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    rest = stored(_with_sets(stored(open_pairs.select(*left).distinct()), sets).mapInArrow(_overlaps, "a long, b long, common long"))
    sizes = nodes.select("node", "n")
    rest = (
        rest.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("a_n")), "a")
        .join(sizes.select(F.col("node").alias("b"), F.col("n").alias("b_n")), "b")
        .where(_enough(percent, F.col("common"), "a_n", "b_n")).select("a", "b")
    )
    reached = connected(first.unionAll(rest))

    found = classes.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = found.groupBy("component").agg(F.min("id").alias("least"))
    by_class = found.join(least, "component").select(*same, "least")
    joined = scanned.select("id", "n", "node", "mark").join(by_class, same, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    return joined.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
