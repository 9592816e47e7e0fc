"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets: sources share the budget by weight; none gets more than ``most`` times its
   size, and what is above goes to the others by weight.
2. Each source's words, its documents laid end to end in a random order fixed by hashes,
   are cut into blocks of equal length. A pass over a source takes its blocks in the
   order of a pseudo-random permutation; as many passes and blocks are drawn as its target
   needs, and the last block drawn is cut, so that the words taken are the target rounded.
3. Tree: the quotas of drawn blocks by source are split between two halves of the output
   shards by a multivariate hypergeometric draw, and so on down to single shards. The
   draws of a source go to the shards in order, so shards never share one.
4. Inside a shard, draws are ordered by a hash. A shard of the documents is one partition,
   and one file where the result is written.

Offsets of documents come from sums over hash buckets of bounded size, so the order of a
source that holds a third of all rows is found without a window over it; equal rows are
counted, not numbered in a window. Permutations and
trims are arithmetic on (source, block). Only narrow rows are shuffled. A node of the tree
is one vector with an entry per source; its upper levels run on the driver, the subtrees
as Spark tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .copies import numbered_copies, row_hash
from .shared import stored

WEIGHTS = (3.0, 1.0, 2.0)
BLOCK_WORDS = 1_000
SHARD_WORDS = 1_000_000
#: numpy draws hypergeometrics from fewer items than 10**9; longer blocks keep below it.
_MOST_BLOCKS = 500_000_000
_TOP_NODES = 64
_BUCKET_DOCS = 2_000
_LOT = 16  # copies whose slices go together
WORD = r"[^\x20\x09-\x0D]+"


def _ranked(sources: DataFrame) -> DataFrame:
    """The sources with their place in code-point order, null last, from 0.

    Ranges of sources are counted apart, so no task sorts all of them.
    """
    ranges = 32
    placed = stored(
        sources.repartitionByRange(ranges, F.col("source").isNull(), "source").withColumn("range", F.spark_partition_id())
    )
    counts = {r["range"]: r["count"] for r in placed.groupBy("range").count().collect()}
    before, total = {}, 0
    for k in sorted(counts):
        before[k] = total
        total += counts[k]
    at = F.create_map(*[F.lit(x) for k in before for x in (k, before[k])]) if before else F.create_map()
    inside = Window.partitionBy("range").orderBy(F.col("source").isNull(), "source")
    offset = at[F.col("range")] if before else F.lit(0)
    return placed.withColumn("rank", offset + F.row_number().over(inside) - 1).drop("range")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Targets share ``share`` times all sizes by weight, weights repeating over the sources
    in code-point order with null last. A target above ``most`` times its size stops there
    and the rest is shared again by weight, until none is above.
    """
    ranked = stored(
        _ranked(sizes).withColumn(
            "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
        ).drop("rank").withColumn("cap", most * F.col("source_size"))
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while total:
        # Sources at their cap leave the sharing; the level per weight only rises.
        capped = F.col("cap") <= level * F.col("weight")
        row = ranked.agg(
            F.sum(F.when(capped, F.col("cap")).otherwise(0.0)).alias("held"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if not row["weight"]:
            break
        rise = (share * total - row["held"]) / row["weight"]
        if rise <= level:
            break
        level = rise
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def split_quotas(counts: np.ndarray, lo: int, hi: int, seed: int, stop: int = 1) -> Iterator[tuple[int, int, np.ndarray]]:
    """Leaves (lo, hi, counts) of at most ``stop`` shards below the node of shards [lo, hi).

    A node's blocks are dealt to its halves in proportion to their shards; which sources
    they come from is a multivariate hypergeometric draw. Seeds depend on the node alone.
    """
    if hi - lo <= stop:
        yield lo, hi, counts
        return
    mid = (lo + hi) // 2
    rng = np.random.default_rng([seed, lo, hi])
    take = int(counts.sum()) * (mid - lo) // (hi - lo)
    left = rng.multivariate_hypergeometric(counts, take, method="marginals")
    yield from split_quotas(left, lo, mid, seed, stop)
    yield from split_quotas(counts - left, mid, hi, seed, stop)


def _shard_quotas(draws: DataFrame, shards: int, seed: int) -> DataFrame:
    """(sid, shard, first, last): the draw numbers [first, last) of a source that a shard gets.

    ``draws`` holds (sid, draws), one row per source; sids count from 0.
    """
    spark = draws.sparkSession
    rows = draws.collect()  # one number per source
    counts = np.zeros(len(rows), np.int64)
    for r in rows:
        counts[r["sid"]] = r["draws"]
    tops = [
        (lo, hi, part.tolist())
        for lo, hi, part in split_quotas(counts, 0, shards, seed, max(1, math.ceil(shards / _TOP_NODES)))
    ]

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo, hi, part in zip(batch["lo"], batch["hi"], batch["counts"]):
                for shard, _, leaf in split_quotas(np.asarray(part, np.int64), lo, hi, seed):
                    sid = np.flatnonzero(leaf)
                    yield pd.DataFrame({"sid": sid, "shard": shard, "n": leaf[sid]})

    nodes = spark.createDataFrame(tops, "lo long, hi long, counts array<long>").repartition(len(tops) or 1)
    leaves = stored(nodes.mapInPandas(finish, "sid long, shard long, n long"))
    # Sums over ranges of shards first: a window sees the shards of one range.
    span = max(1, math.isqrt(shards))
    ranged = leaves.withColumn("range", F.expr(f"shard div {span}"))
    by_range = ranged.groupBy("sid", "range").agg(F.sum("n").alias("total"))
    outer = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    by_range = by_range.select("sid", "range", (F.sum("total").over(outer) - F.col("total")).alias("before"))
    inner = Window.partitionBy("sid", "range").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn("upto", F.sum("n").over(inner)).join(by_range, ["sid", "range"])
        .select("sid", "shard", (F.col("before") + F.col("upto") - F.col("n")).alias("first"), (F.col("before") + F.col("upto")).alias("last"))
    )


def _offsets(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows with the offset of their first word in their source's order.

    Buckets of about ``_BUCKET_DOCS`` rows by hash; groups of buckets are summed first.
    """
    span = 1_000
    h = F.xxhash64("id", "h", "row_hash", "copy", F.lit("order"))
    placed = sized.join(targets.select("sid", "rows", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    buckets = F.ceil(F.col("rows") / _BUCKET_DOCS)
    placed = placed.withColumn("order", h).withColumn("bucket", F.pmod(F.xxhash64("order"), buckets)).drop("rows")
    placed = placed.withColumn("group", F.expr(f"bucket div {span}"))
    sums = stored(placed.groupBy("sid", "group", "bucket").agg(F.sum("size").alias("total")))
    groups = sums.groupBy("sid", "group").agg(F.sum("total").alias("all"))
    upto = Window.partitionBy("sid").orderBy("group").rowsBetween(Window.unboundedPreceding, 0)
    groups = groups.select("sid", "group", (F.sum("all").over(upto) - F.col("all")).alias("before"))
    within = Window.partitionBy("sid", "group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    starts = sums.withColumn("upto", F.sum("total").over(within)).join(groups, ["sid", "group"]).select(
        "sid", "group", "bucket", (F.col("before") + F.col("upto") - F.col("total")).alias("base")
    )
    inside = Window.partitionBy("sid", "group", "bucket").orderBy("order", "id", "h", "row_hash", "copy").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("upto", F.sum("size").over(inside)).join(starts, ["sid", "group", "bucket"])
        .withColumn("offset", F.col("base") + F.col("upto") - F.col("size"))
        .drop("base", "upto", "order", "group", "bucket")
    )


def _coprime(n: int, seed: int) -> int:
    """A multiplier that permutes 0 … n-1."""
    a = max(1, int(n * 0.6180339887) ^ (seed & 0xFFFF)) % n or 1
    while math.gcd(a, n) > 1:
        a = a % n + 1
    return a


def _permutation(sid: int, blocks: int) -> tuple[int, int]:
    """Multiplier and shift for a source: one small call per source."""
    rng = np.random.default_rng([sid, blocks])
    if blocks < 2:
        return 1, 0
    return _coprime(blocks, int(rng.integers(1 << 16))), int(rng.integers(blocks))


def _place(block: Column) -> Column:
    """A block's place in its source's permuted order; ``_MOST_BLOCKS`` keeps the product in a long."""
    return (F.col("perm.a") * block + F.col("perm.b")) % F.col("blocks")


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> tuple[DataFrame, DataFrame]:
    """(rows, slices) of the mix.

    ``rows``: (id, source, h, row_hash, copy, size, source_size, target), a row per document;
    size in words, h the hash of its text, row_hash that of all its columns, copy numbering
    equal rows. ``slices``: (id, source, h, row_hash, copy, size, turn, first, last, shard,
    place): words [first, last) of a document that the mix takes in pass ``turn``, the output
    shard and the place in its shuffled order.

    Null texts have size 0 and, like all empty ones, no slices. A null source is a source
    like any other and comes last. Null and repeated ids are kept. Every source gives its
    target rounded to whole words, no document more than ``most`` rounded up times its
    size. Reruns give the same mix. Without words there are no slices.
    """
    return _mix(documents, id_col, text_col, source_col, **options)[:2]


def _mix(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    weights=WEIGHTS, share: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS, seed: int = 17,
) -> tuple[DataFrame, DataFrame, int]:
    """Rows and slices as ``mix`` returns them, and the number of shards."""
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = documents.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words.alias("size"), F.xxhash64(text_col).alias("h"),
        row_hash(documents).alias("row_hash"),
    )
    units = stored(sized.groupBy("id", "source", "size", "h", "row_hash").agg(F.count("*").alias("copies")))
    sized = numbered_copies(units, ["h", "row_hash"])
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("rows"))
    sources = stored(sources)
    targets = source_targets(sources.select("source", "source_size"), weights, share, most)
    targets = targets.alias("t").join(sources.select(F.col("source").alias("s"), "rows"), F.col("t.source").eqNullSafe(F.col("s"))).drop("s")
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    block = max(block_words, math.ceil(budget / _MOST_BLOCKS))

    plan = targets.withColumn("words", F.round("target").cast("long"))
    plan = plan.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0).cast("long")))
    plan = plan.withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
    plan = stored(_ranked(plan).withColumnRenamed("rank", "sid"))
    plan = plan.withColumn("sid", F.col("sid").cast("long")).withColumn(
        "perm", F.udf(_permutation, "struct<a: long, b: long>")("sid", "blocks")
    )
    # The rest: whole blocks in permuted order until it is reached. ``short`` words are
    # missing in the last block of the source, whose place in that order is ``odd``.
    plan = plan.withColumn("short", F.col("blocks") * block - F.col("source_size"))
    plan = plan.withColumn("odd", F.when(F.col("blocks") > 0, _place(F.col("blocks") - 1)))
    plain = F.expr(f"(rest + {block - 1}) div {block}")
    late = F.expr(f"(rest + short + {block - 1}) div {block}")
    plan = plan.withColumn("drawn", F.when(plain <= F.col("odd"), plain).otherwise(F.greatest(late, F.col("odd") + 1)))
    plan = plan.withColumn("drawn", F.when(F.col("rest") > 0, F.col("drawn")).otherwise(F.lit(0).cast("long")))
    over = F.col("drawn") * block - F.when(F.col("drawn") > F.col("odd"), F.col("short")).otherwise(0) - F.col("rest")
    plan = plan.withColumn("over", F.when(F.col("drawn") > 0, over).otherwise(F.lit(0).cast("long")))
    plan = stored(plan.withColumn("draws", F.col("passes") * F.col("blocks") + F.col("drawn")))

    rows = _offsets(sized, plan)
    rows = rows.join(
        plan.select("sid", "source_size", "target", "blocks", "passes", "drawn", "over", "draws", "perm"), "sid"
    )
    rows = stored(rows)
    shards = max(1, math.ceil(budget / shard_words))
    quotas = _shard_quotas(plan.select("sid", "draws"), shards, seed)

    cut = rows.where("size > 0 and draws > 0").select(
        "*", F.explode(F.expr(f"sequence(offset div {block}, (offset + size - 1) div {block})")).alias("block")
    )
    cut = cut.withColumn("at", _place(F.col("block")))
    turns = F.col("passes") + (F.col("at") < F.col("drawn")).cast("long")
    cut = cut.withColumn("turns", turns).where("turns > 0").select("*", F.explode(F.expr("sequence(0L, turns - 1)")).alias("turn"))
    # The part of the block inside the document; the last draw of a source loses its end.
    end = F.least((F.col("block") + 1) * block, F.col("source_size"))
    trimmed = F.when((F.col("turn") == F.col("passes")) & (F.col("at") == F.col("drawn") - 1), end - F.col("over")).otherwise(end)
    cut = cut.withColumn("first", F.greatest(F.col("block") * block, F.col("offset")) - F.col("offset"))
    cut = cut.withColumn("last", F.least(trimmed, F.col("offset") + F.col("size")) - F.col("offset")).where("last > first")
    cut = cut.withColumn("draw", F.col("turn") * F.col("blocks") + F.col("at"))

    # Draw → shard: an equi join on runs of draws, then the interval.
    run = 256
    quotas = quotas.select(
        F.col("sid").alias("q_sid"), "shard", F.col("first").alias("q_first"), F.col("last").alias("q_last"),
        F.explode(F.expr(f"sequence(first div {run}, (last - 1) div {run})")).alias("q_run"),
    )
    slices = cut.withColumn("run", F.expr(f"draw div {run}")).join(
        quotas,
        (F.col("sid") == F.col("q_sid")) & (F.col("run") == F.col("q_run"))
        & (F.col("draw") >= F.col("q_first")) & (F.col("draw") < F.col("q_last")),
    )
    slices = slices.select(
        "id", "source", "h", "row_hash", "copy", "size", "turn", "first", "last", "shard",
        F.xxhash64("sid", "draw", "offset", F.lit(seed)).alias("place"),
    )
    return rows.select("id", "source", "h", "row_hash", "copy", "size", "source_size", "target"), slices, shards


def taken_by_document(documents: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, size, source_size, target, taken, shards): the words of each row that the mix takes.

    ``shards`` lists (shard, words), the words of the row that each output shard gets.
    """
    rows, slices = mix(documents, id_col, **options)
    key = ["h", "row_hash", "copy"]
    taken = slices.groupBy(*key, "shard").agg(F.sum(F.col("last") - F.col("first")).alias("words"))
    taken = taken.groupBy(*key).agg(
        F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("shard", "words"))).alias("shards")
    )
    return rows.join(taken, key, "left").select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"),
        F.coalesce("shards", F.array().cast("array<struct<shard: bigint, words: bigint>>")).alias("shards"),
    )


def mixed_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows the mix takes, with their columns; a row for every run of words taken at once.

    Partition k is output shard k, its rows in their shuffled order. A document taken twice
    comes twice. Texts run from the first to the last word of a run of adjoining slices of
    one shard; a whole document keeps its text as it is. An ``n_chars`` column is counted
    anew. Empty texts give no row.
    """
    _, slices, shards = _mix(documents, id_col, text_col, source_col, **options)
    part = F.struct("copy", "turn", "first", "last", "shard", "place")
    # Equal rows stand for each other: one of them meets the slices of all copies, some
    # copies a row, so that texts are shuffled once and no task gets all copies of one.
    key = ["h", "row_hash"]
    parts = slices.groupBy(*key, F.expr(f"copy div {_LOT}").alias("lot")).agg(
        F.max("size").alias("size"), F.array_sort(F.collect_list(part)).alias("parts")
    )
    packed = documents.select(F.struct("*").alias("row"), F.xxhash64(text_col).alias("h"), row_hash(documents).alias("row_hash"))
    joined = packed.dropDuplicates(key).join(parts.drop("lot"), key).select(
        "row", F.col(f"row.{text_col}").cast("string").alias("text"), "size", "parts"
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        word = re.compile(WORD)
        for batch in batches:
            cuts = []
            for text, size, parts in zip(batch["text"], batch["size"], batch["parts"]):
                runs: list[dict] = []
                for p in parts:
                    if runs and all(runs[-1][c] == p[c] for c in ("copy", "turn", "shard")) and runs[-1]["last"] == p["first"]:
                        runs[-1]["last"] = p["last"]
                    else:
                        runs.append({c: p[c] for c in ("copy", "turn", "first", "last", "shard", "place")})
                whole = all(r["last"] - r["first"] == size for r in runs)
                bounds = [] if whole else [m.span() for m in word.finditer(text)]
                for r in runs:
                    a, b = r["first"], r["last"]
                    r["text"] = text if b - a == size else text[bounds[a][0] : bounds[b - 1][1]]
                cuts.append([{c: r[c] for c in ("text", "shard", "place")} for r in runs])
            yield pd.DataFrame({"row": batch["row"], "cuts": cuts})

    row_type = joined.schema["row"].dataType.simpleString()
    rows = joined.mapInPandas(cut, f"row {row_type}, cuts array<struct<text: string, shard: bigint, place: bigint>>")
    rows = rows.select("row", F.explode("cuts").alias("cut")).select("row", "cut.*")
    row = F.col("row").withField(text_col, F.col("text"))
    if "n_chars" in documents.columns:
        row = row.withField("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    # Shards hold equal numbers of draws, so the partitions are even.
    dealt = rows.select(row.alias("row"), "shard", "place").repartitionById(shards, F.col("shard").cast("int"))
    return dealt.sortWithinPartitions("place").select("row.*")
