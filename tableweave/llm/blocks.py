"""Searches of a query set against all vectors, block against block.

Vectors go to blocks of about ``block_rows`` rows and queries to blocks of about
``query_rows`` by a hash of their ids, so that equal vectors spread. Every pair of blocks
is one bounded task that returns the best k of its rows for each of its queries; a ranking
per query merges them, cut to k before its shuffle. The work grows with queries times
vectors, as an answer over all rows without a pruning index must; the pairs are never
emitted.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

BLOCK_ROWS = 16_384
QUERY_ROWS = 1_024


def usable(vectors: DataFrame, id_col: str, vec_col: str, zero_too: bool) -> DataFrame:
    """(id, dim, vec) of the rows that take part: an id, and finite components only."""
    x = F.col(vec_col).cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c))
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(x) > 0) & finite)
    if not zero_too:
        rows = rows.where(F.exists(x, lambda c: c != 0))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.size(x).alias("dim"), x.alias("vec"))


def query_rows_of(rows: DataFrame, is_query: Column | str) -> DataFrame:
    """The queries, one per id; of rows with one id the least vector."""
    return rows.where(is_query).groupBy("id").agg(F.min(F.struct("dim", "vec")).alias("q")).select("id", "q.dim", "q.vec")


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if len(column) else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def best_of_blocks(
    rows: DataFrame, queries: DataFrame, search: Callable[[pa.Table, pa.Table], pa.Table], score: str, k: int, *,
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of each query, ties to the smaller id.

    ``search(rows, queries)`` gets one block of each, of one dimension, and returns
    (query_id, vec_id, score), at most k rows per query.
    """
    queries = stored(queries)
    row_blocks = max(1, math.ceil(rows.count() / block_rows))
    query_blocks = max(1, math.ceil(queries.count() / query_rows))
    left = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(row_blocks))).withColumn(
        "q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long")))
    )
    right = queries.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(query_blocks))).withColumn(
        "b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long")))
    )
    none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                     "score": pa.array([], pa.float64() if score == "double" else pa.int64())})

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return search(a, b) if a.num_rows and b.num_rows else none

    key = ["dim", "b", "q"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, f"query_id long, vec_id long, score {score}")
    # Sums of infinite products may be no number; those come last.
    order = Window.partitionBy("query_id").orderBy(F.isnan(F.col("score").cast("double")), F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
