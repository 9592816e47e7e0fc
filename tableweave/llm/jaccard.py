"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Every distinct shingle set is ordered by one global order, rarest shingles first. With
``need`` the least overlap that a set of size n can have with a similar one, two similar
sets share at least ℓ shingles within their first n - need + ℓ ones, for every ℓ. A set
picks the ℓ of least estimated cost (list entries read plus verifications, which the
entries bound by entries / ℓ); a pair uses the larger ℓ of its two sets, and is verified
on the whole sets only if it shares that many prefix shingles.

Steps, each a Spark job over all rows:

1. Sets are hashed (64 bits a shingle). Rows with equal sets form a class; one member
   stands for it. The same pass counts hashed shingles in a table of fixed size.
2. A second pass orders each class's set by those counts and keeps its prefix. Only
   prefix shingles that at least two classes share go on.
3. In each shingle's list up to three members are pivots, the ones with the fewest prefix
   shingles of their own first, and all members are compared with them: linear in the
   list. The links found give first components; most of a large group of near copies
   falls into one, because its original is such a pivot.
4. What may still link different components is found exactly: a list whose members lie
   in one component is dropped, in the others the members outside the list's largest
   component meet all members of other components. Members meet only if, by the number
   of prefix shingles that no other set has, either may be similar to a set of the
   other's size, and only in the prefix that sets of these two sizes need: a copy too
   far from its original does not meet all other copies.
5. All verified links give the components.

No list is gathered in one task, no pair inside a known component is emitted, and the
lists are joined by adaptive joins that split long ones. Python works on one row at a
time, except for the counts table, which has about four counters a row within bounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, mixed, slices, span_hashes, text_bytes, words_of
from .components import connected
from .idfilter import id_table, may_hold
from .shared import stored

#: Counters of hashed shingles: four a row between these bounds (2 to 128 MB). The table
#: only sets the order of shingles and the cost estimate, so collisions cost time, never
#: results.
LEAST_COUNTERS, MOST_COUNTERS = 1 << 18, 1 << 24
_PART = 1 << 13
_TOGETHER = 1 << 22  # bytes of sets that go on together
_VERIFY = 0.25  # cost of what an entry may become, in entries: few become candidates


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of a slice of rows, and where each row's begin.

    A row with 1 to n-1 words has its whole sequence as one; one without words has none.
    """
    data = LOWER[data]
    starts, ends, rows = words_of(data, offsets)
    words = span_hashes(data, starts, ends)
    count = np.diff(rows)
    grams = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(grams)))
    row = np.repeat(np.arange(len(count)), grams)
    first = rows[:-1][row] + np.arange(begin[-1]) - begin[:-1][row]
    h = np.zeros(len(first), np.uint64)
    for k in range(n):
        at = first + k
        there = at < rows[1:][row]
        word = words[np.minimum(at, max(len(words) - 1, 0))] if len(words) else h
        h = mixed(h * np.uint64(31) + np.where(there, word, np.uint64(k)) + np.uint64(1))
    return h, begin


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct shingle hashes) of each row of a batch whose columns are id and text."""
    data, offsets = text_bytes(batch.column(1))
    for lo, hi in slices(offsets):
        h, begin = shingle_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)
        for i in range(hi - lo):
            yield lo + i, np.unique(h[begin[i] : begin[i + 1]])


def set_signature(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = int(np.sum(mixed(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64))
    b = int(np.bitwise_xor.reduce(mixed(s + np.uint64(0x14057B7EF767814F)))) if len(s) else 0
    return a, b


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _scan(n: int, size_of_table: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size_of_table, np.int64)
        for batch in batches:
            size, a, b = [], [], []
            for _, s in _sets(batch, n):
                size.append(len(s))
                one, two = set_signature(s)
                a.append(one)
                b.append(two)
                np.add.at(counts, s & np.uint64(size_of_table - 1), 1)
            rows = len(size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(size, pa.int64()), _signed(a), _signed(b),
                 pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                ["id", "n", "s1", "s2", "part", "counts"],
            )
        parts = [p for p in range(size_of_table // _PART) if counts[p * _PART : (p + 1) * _PART].any()]
        none = pa.nulls(len(parts), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, none, pa.array(parts, pa.int32()),
             pa.array([counts[p * _PART : (p + 1) * _PART].tobytes() for p in parts], pa.binary())],
            ["id", "n", "s1", "s2", "part", "counts"],
        )

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counter parts that come in a stream, added up; at most one table in memory."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts = np.frombuffer(raw, np.int64)
            total[part] = total[part] + counts if part in total else counts
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())],
        ["part", "counts"],
    )


def counters_for(rows: int) -> int:
    return min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << (4 * max(rows, 1) - 1).bit_length()))


def _counters(scanned: DataFrame, size_of_table: int) -> np.ndarray:
    """The whole table of counts."""
    parts = scanned.where("part is not null").select("part", "counts")
    parts = parts.repartition(8, "part").mapInArrow(_summed, "part int, counts binary")
    table = np.zeros(size_of_table, np.int64)
    for row in parts.collect():
        table[row["part"] * _PART : (row["part"] + 1) * _PART] += np.frombuffer(row["counts"], np.int64)
    return table


def _ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def prefix_of(s: np.ndarray, seen: np.ndarray, percent: int) -> tuple[np.ndarray, int, int]:
    """(prefix in global order, its length at ℓ = 1, chosen ℓ) of a set with its counts.

    ℓ is at most a twentieth of the set, and the prefix is kept to three fiftieths more
    than its shortest: a similar set is at most 100/85 times as large, so that its ℓ is
    within what this one keeps. Costs are those of the prefix for sets of the same size.
    """
    n = len(s)
    need = max(1, _ceil_div(percent * n, 100))
    base = n - need + 1
    most = max(1, min(n // 20, need))
    keep = kept_length(n, percent)
    order = np.lexsort((s, seen))[:keep]
    reads = np.cumsum(np.maximum(seen[order], 1))
    equal = n - _ceil_div(2 * percent * n, 100 + percent) + 1
    ell = np.unique(np.clip(np.rint(most * np.array([0.0, 0.1, 0.25, 0.5, 0.75, 1.0])), 1, most).astype(np.int64))
    entries = reads[np.minimum(equal + ell - 1, keep) - 1]
    cost = entries * (1 + _VERIFY / ell)
    return s[order], base, int(ell[np.argmin(cost)])


def kept_length(n: int, percent: int) -> int:
    """How many shingles the prefix of a set of n keeps."""
    base = n - max(1, _ceil_div(percent * n, 100)) + 1
    return min(n, base + _ceil_div(5 * n, percent - percent % 5 or 5) + 1)


def size_class(n: int) -> int:
    """Sets of up to 200 shingles by size, larger ones by half a percent."""
    return n if n <= 200 else 200 + int(math.log(n / 200) / math.log(1.005))


def _class_sizes(k: int) -> tuple[int, int]:
    """Bounds of the sizes of a class."""
    if k < 200:
        return k, k
    return math.floor(200 * 1.005 ** (k - 200)), math.ceil(200 * 1.005 ** (k - 199)) + 1


def partner_classes(n: int, shared: np.ndarray, percent: int) -> tuple[int, int] | None:
    """First and last size class that may hold a set similar to a set of n; None if none may.

    ``shared`` has the positions of its prefix shingles that other prefixes hold too. A
    shingle at another position i of the prefix is in a set y at most behind y's prefix,
    which then has ``kept - i`` shingles that this set lacks. With the overlap c that
    similarity needs, this cannot be for i < c - |y| + kept: so many of the first
    positions are the set's own, and what is left must reach c.
    """
    found = []
    for k in range(size_class(_ceil_div(percent * n, 100)), size_class(100 * n // percent) + 1):
        lo, hi = _class_sizes(k)
        lo, hi = max(lo, _ceil_div(percent * n, 100)), min(hi, 100 * n // percent)
        if lo > hi:
            continue
        overlap = _ceil_div(percent * (n + lo), 100 + percent)
        sure = min(
            _ceil_div(percent * (n + y), 100 + percent) - y + kept_length(y, percent) - 2 for y in (lo, hi)
        )
        sure = max(0, min(sure, kept_length(n, percent)))
        if n - (sure - int(np.searchsorted(shared, sure))) >= overlap:
            found.append(k)
    return (found[0], found[-1]) if found else None


def _partners(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_pylist()
            first, last = [], []
            for n, shared in zip(sizes, batch.column(2)):
                bounds = partner_classes(n, np.sort(shared.values.to_numpy()), percent)
                first.append(bounds and bounds[0])
                last.append(bounds and bounds[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([size_class(n) for n in sizes], pa.int32()), pa.array(first, pa.int32()), pa.array(last, pa.int32())],
                ["id", "k", "k_first", "k_last"],
            )

    return run


def _prefixes(n: int, percent: int, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        noise = int(counts.sum() // len(counts))
        for batch in batches:
            size, a, b, base, ell, tokens = [], [], [], [], [], []
            for _, s in _sets(batch, n):
                one, two = set_signature(s)
                seen = np.maximum(counts[(s & np.uint64(len(counts) - 1)).astype(np.int64)] - noise, 1)
                found = prefix_of(s, seen, percent) if len(s) else (s, 0, 0)
                for column, value in zip((size, a, b, base, ell, tokens), (len(s), one, two, found[1], found[2], found[0])):
                    column.append(value)
            ends = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int32)
            flat = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(size, pa.int64()), _signed(a), _signed(b),
                 pa.array(base, pa.int32()), pa.array(ell, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                ["id", "n", "s1", "s2", "base", "ell", "tokens"],
            )

    return run


def _named(ids: pa.Array, rows: list[int], packed: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(packed, pa.binary())], ["id", "set"])


def _packed(n: int, marked):
    """Whole sets of the documents that the filter names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(marked.value, batch.column(0).cast(pa.int64()).to_numpy())))
            ids, rows, packed, size = batch.column(0).cast(pa.int64()), [], [], 0
            for row, found in _sets(batch, n):
                rows.append(row)
                packed.append(found.tobytes())
                size += len(packed[-1])
                if size >= _TOGETHER:
                    yield _named(ids, rows, packed)
                    rows, packed, size = [], [], 0
            if rows:
                yield _named(ids, rows, packed)

    return run


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            hit = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                hit[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(hit))

    return run


def _verified(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar, written to the shared folder."""
    marked = docs.sparkSession.sparkContext.broadcast(id_table(pairs.select("a").unionAll(pairs.select("b")).distinct()))
    sets = stored(docs.where("id is not null").mapInArrow(_packed(n, marked), "id long, set binary"))
    full = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("left")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("set").alias("right")), "b")
        .select("a", "b", "left", "right")
    )
    return stored(full.mapInArrow(_similar(percent), "a long, b long"))


def _sizes_fit(percent: int, x: str, y: str):
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _classes_fit(x: str, y: str):
    """Each of two members may have partners in the other's size class."""
    return F.col(f"{y}.k").between(F.col(f"{x}.k_first"), F.col(f"{x}.k_last")) & F.col(f"{x}.k").between(
        F.col(f"{y}.k_first"), F.col(f"{y}.k_last")
    )


def similar_documents(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 4, percent: int = 85
) -> DataFrame:
    """(id, n_shingles, component_id) of every row.

    Texts link when 100 * |A ∩ B| >= percent * |A ∪ B| for their shingle sets; the
    component is the smallest id reachable by links, the own one included.

    Null and blank texts have no shingles and link with nothing. Rows with a null id take
    no part in linking and get a null component. Rows with one id count as one document
    that has the links of each. Other columns are ignored; no rows give no rows.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counters = counters_for(docs.count())
    scanned = stored(
        docs.mapInArrow(_scan(words, counters), "id long, n long, s1 long, s2 long, part int, counts binary")
    )
    rows = scanned.where("part is null").select("id", "n", "s1", "s2")
    classes = rows.where("n > 0 and id is not null").groupBy("s1", "s2", "n").agg(F.min("id").alias("id"))

    table = spark.sparkContext.broadcast(_counters(scanned, counters))
    ordered = docs.where("id is not null").mapInArrow(
        _prefixes(words, percent, table),
        "id long, n long, s1 long, s2 long, base int, ell int, tokens array<long>",
    )
    prefixes = stored(
        ordered.join(classes, ["s1", "s2", "n", "id"], "left_semi").dropDuplicates(["s1", "s2", "n", "id"])
        .select("id", "n", "base", "ell", "tokens")
    )
    lists = prefixes.select("id", "n", "ell", F.posexplode("tokens").alias("pos", "token"))
    shared = lists.groupBy("token").agg(F.count("*").alias("members")).where("members > 1").select("token")
    live = stored(lists.join(shared, "token"))

    # Sets whose own shingles leave too little to share have no partners.
    partners = (
        live.groupBy("id", "n").agg(F.collect_list("pos").alias("shared")).select("id", "n", "shared")
        .mapInArrow(_partners(percent), "id long, k int, k_first int, k_last int").where("k_first is not null")
    )
    # Pivots: the members with the least share of shingles of their own (an original has
    # none that its copies lack), ties in two random orders, and the least in a third.
    own = prefixes.select("id", F.size("tokens").alias("kept")).join(
        live.groupBy("id").agg(F.count("*").alias("shared")), "id"
    ).select("id", (F.col("kept") - F.col("shared")).alias("own"))
    live = stored(live.join(own.join(partners, "id"), "id"))
    me = F.struct("id", "n", "ell", "k", "k_first", "k_last").alias("m")
    orders = [F.min(F.struct("own", F.xxhash64("id", F.lit(k)).alias("h"), me)).getField("m") for k in range(2)]
    orders.append(F.min(F.struct(F.xxhash64("id", F.lit(2)).alias("h"), me)).getField("m"))
    pivots = live.groupBy("token").agg(F.array_distinct(F.array(*orders)).alias("pivots"))
    pivots = pivots.select("token", F.explode("pivots").alias("p"))
    members = live.select("token", "id", "n", "ell", "k", "k_first", "k_last").alias("m")
    stars = (
        members.join(pivots.alias("v"), "token")
        .where((F.col("id") != F.col("p.id")) & _sizes_fit(percent, "n", "p.n") & _classes_fit("m", "p"))
        .groupBy(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"), F.greatest("ell", "p.ell").alias("ell"))
        .agg(F.countDistinct("token").alias("common"))
        .where("common >= ell")
        .select("a", "b")
    )
    first = _verified(docs, stored(stars), words, percent)
    known = stored(connected(first))

    live = live.join(known.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    mixed_lists = (
        live.groupBy("token", "component").agg(F.count("*").alias("members"))
        .groupBy("token").agg(F.count("*").alias("parts"), F.max(F.struct("members", "component")).alias("top"))
        .where("parts > 1").select("token", F.col("top.component").alias("top"))
    )
    live = stored(live.join(mixed_lists, "token"))
    # A member meets the size classes of its list that may hold partners of it: both
    # sides are filtered before they meet.
    present = live.groupBy("token", "k").agg(F.count("*").alias("there")).select("token", F.col("k").alias("other"))
    facing = live.join(present, "token").where("other between k_first and k_last")
    # For one size class the prefix is shorter: what similarity needs at its least size.
    least = F.when(F.col("other") < 200, F.col("other")).otherwise(F.floor(200 * F.pow(F.lit(1.005), F.col("other") - 200)))
    room = F.col("n") - F.ceil(percent * (F.col("n") + least) / (100 + percent))
    facing = facing.withColumn("room", room.cast("long")).where(
        # A pair's ℓ is at most a twentieth of the larger set, as in ``kept_length``.
        F.col("pos") <= F.col("room") + F.ceil(5 * F.col("n") / (percent - percent % 5 or 5))
    )
    x = facing.where("component <> top").alias("x")
    y = facing.alias("y")
    ell = F.greatest("x.ell", "y.ell")
    crossing = (
        x.join(
            y,
            (F.col("x.token") == F.col("y.token"))
            & (F.col("x.other") == F.col("y.k"))
            & (F.col("y.other") == F.col("x.k"))
            & (F.col("x.component") != F.col("y.component"))
            & ((F.col("y.component") == F.col("y.top")) | (F.col("x.id") < F.col("y.id")))
            & _sizes_fit(percent, "x.n", "y.n")
            & (F.col("x.pos") < F.col("x.room") + ell)
            & (F.col("y.pos") < F.col("y.room") + ell),
        )
        .groupBy(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), ell.alias("ell"))
        .agg(F.count("*").alias("common"))
        .where("common >= ell")
        .select("a", "b")
    )
    rest = _verified(docs, stored(crossing), words, percent)
    reached = stored(connected(first.unionAll(rest)))

    by_class = classes.join(reached.withColumnRenamed("node", "id"), "id", "left").select(
        "s1", "s2", "n", F.coalesce("component", "id").alias("class_component")
    )
    joined = rows.join(by_class, ["s1", "s2", "n"], "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("class_component", "id")).alias("component_id"),
    )
