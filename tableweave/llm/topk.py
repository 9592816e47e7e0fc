"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are small integers, floor(``scale`` · x). Rows go to blocks by a hash of their
ids; each block is stored once with a list per dimension of its rows sorted by their
component. A query reads its lists from the end its weight favours, all to the same
depth, and scores the rows that come up. No row that has not come up can score more than
the threshold, the weighted sum of the components at that depth; a query leaves a block
when the k-th best score it knows is above the threshold, so that not even a tie can be
missed. Depths double. From the depth at which the lists name most rows on, what
is left of the block is read whole, for all remaining queries in one matrix product.

Each query reads one block first; the k-th best score found there is its bound in all
others: it reads them at once to the depth at which the threshold is below it, or whole.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK_ROWS, QUERY_ROWS, matrix, query_rows_of, usable
from .shared import stored

_FIRST_DEPTH, _GROWTH = 16, 2
_TOGETHER = 64  # queries of one matrix product
_LONG = 2**63 - 1


def small_limit(dim: int) -> int:
    """Integers below it may be multiplied and summed over ``dim`` components as doubles."""
    return 1 << int((53 - math.ceil(math.log2(max(dim, 2)))) // 2)


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale · x) as Python integers, however large."""
    by = Fraction(scale)
    return np.array([[math.floor(Fraction(v) * by) for v in row] for row in x.tolist()], object).reshape(x.shape)


def split_whole(x: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(floor(scale · x) as doubles, which rows are small enough, the other rows as integers)."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    small = (np.abs(y) < small_limit(x.shape[1])).all(1)
    return y, small, whole(x[~small], scale)


class Lists:
    """The rows of a block with their sorted lists; rows of large integers stand apart."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.x = ids, x
        self.order = np.argsort(-x, axis=0, kind="stable").astype(np.int32) if order is None else order
        self.sorted = np.take_along_axis(x, self.order.astype(np.int64), axis=0)

    def top(self, queries: np.ndarray, k: int, without: np.ndarray, bound: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """(ids, scores) of each query's k best rows, best first, ties to the smaller id; and depths read.

        ``bound`` has scores that k rows of other blocks reach: rows below are left out.
        """
        n, m = len(self.ids), len(queries)
        seen = np.zeros((m, n), bool)
        found = [(np.zeros(0, np.int64), np.zeros(0)) for _ in range(m)]
        depth_of, live = np.zeros(m, np.int64), np.arange(m)
        up, down, width = np.maximum(queries, 0), np.minimum(queries, 0), (queries != 0).sum(1)
        known, late, read, depth = bound > -np.inf, [], 0, _FIRST_DEPTH
        while len(live):
            deep = (depth * width[live] >= n) | (depth >= n)
            late.append(live[deep])
            live = live[~deep]
            if not len(live):
                break
            threshold = up[live] @ self.sorted[depth - 1] + down[live] @ self.sorted[n - depth]
            # A query with a bound need not read before the depth at which it ends.
            reading = ~known[live] | (threshold < bound[live])
            for j in live[reading]:
                since = 0 if known[j] else read
                came = np.concatenate(
                    (self.order[since:depth, queries[j] > 0].ravel(), self.order[n - depth : n - since, queries[j] < 0].ravel())
                )
                came = np.unique(came[~seen[j, came]])
                seen[j, came] = True
                found[j] = self._best(*found[j], came, self.x[came] @ queries[j], k, without[j], bound[j])
            depth_of[live] = depth
            kth = np.array([found[j][1][-1] if len(found[j][1]) == k else -np.inf for j in live])
            live = live[np.maximum(kth, bound[live]) <= threshold]
            read, depth = depth, depth * _GROWTH
        late = np.concatenate(late) if late else live
        for lo in range(0, len(late), _TOGETHER):
            some = late[lo : lo + _TOGETHER]
            scores = queries[some] @ self.x.T
            for j, s in zip(some, scores):
                rest = np.flatnonzero(~seen[j])
                found[j] = self._best(*found[j], rest, s[rest], k, without[j], bound[j])
        depth_of[late] = n
        return found, depth_of

    def _best(self, ids, best, rows, scores, k, without, bound):
        least = max(bound, best[-1] if len(best) == k else -np.inf)
        if len(scores) > k:
            least = max(least, np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1])
        keep = (scores >= least) & (self.ids[rows] != without)
        ids, best = np.concatenate((ids, self.ids[rows[keep]])), np.concatenate((best, scores[keep]))
        order = np.lexsort((ids, -best))[:k]
        return ids[order], best[order]


_BLOCK = "dim int, b long, ids binary, x binary, lists binary, big_ids binary, big binary"


def _listed(scale: float):
    """The rows of a block to one row: its small rows with their lists, and the large ones."""

    def run(rows: pa.Table) -> pa.Table:
        dim, b = rows.column("dim")[0].as_py(), rows.column("b")[0].as_py()
        ids, x = rows.column("id").to_numpy(), matrix(rows.column("vec"), dim)
        y, small, _ = split_whole(x, scale)
        lists = Lists(ids[small], y[small])
        parts = [lists.ids, lists.x, lists.order, ids[~small], x[~small]]
        return pa.table({"dim": pa.array([dim], pa.int32()), "b": [b]} | {
            n: pa.array([p.tobytes()], pa.binary()) for n, p in zip(("ids", "x", "lists", "big_ids", "big"), parts)
        })

    return run


def _exact(rows: np.ndarray, ids: np.ndarray, q: np.ndarray, without: int, k: int) -> list[tuple[int, int]]:
    scores = [(-sum(a * b for a, b in zip(row, q)), int(i)) for row, i in zip(rows.tolist(), ids) if i != without]
    return sorted(scores)[:k]


def _searcher(scale: float, k: int):
    none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})

    def search(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        if not blocks.num_rows or not queries.num_rows:
            return none
        dim = blocks.column("dim")[0].as_py()
        raw = lambda name, kind: np.frombuffer(blocks.column(name)[0].as_buffer(), kind)
        lists = Lists(raw("ids", np.int64), raw("x", np.float64).reshape(-1, dim), raw("lists", np.int32).reshape(-1, dim))
        big_ids, big = raw("big_ids", np.int64), whole(raw("big", np.float64).reshape(-1, dim), scale)
        query_ids, q = queries.column("id").to_numpy(), matrix(queries.column("vec"), dim)
        bound = queries.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)
        bound[np.isnan(bound)] = -np.inf
        y, small, large = split_whole(q, scale)
        rows: list[tuple[int, int, int]] = []
        best, _ = lists.top(y[small], k, query_ids[small], bound[small])
        whole_y = y[small].astype(np.int64).astype(object) if len(big) else None
        for at, (one, (ids, scores)) in enumerate(zip(query_ids[small], best)):
            pairs = list(zip((-scores).astype(np.int64).tolist(), ids.tolist()))
            if len(big):
                pairs = sorted(pairs + _exact(big, big_ids, whole_y[at], one, k))[:k]
            rows += [(int(one), i, -s) for s, i in pairs]
        if len(large):
            every = np.concatenate((lists.x.astype(np.int64).astype(object), big))
            every_ids = np.concatenate((lists.ids, big_ids))
            for one, weights in zip(query_ids[~small], large):
                rows += [(int(one), i, -s) for s, i in _exact(every, every_ids, weights, one, k)]
        if not rows:
            return none
        ids, found, scores = zip(*rows)
        held = [max(-_LONG - 1, min(_LONG, s)) for s in scores]
        return pa.table({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(held, pa.int64())})

    return search


def top_scores(
    vectors: DataFrame, is_query: Column | str, id_col: str = "vec_id", vec_col: str = "embedding", *,
    scale: float = 64.0, k: int = 20, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products.

    ``is_query`` is a condition on a column ``id``. Ties go to the smaller id; with fewer
    candidates all are returned. A row is no candidate for a query of its own id. Null ids
    and vectors that are null, empty or hold null or non-finite components take no part;
    zero vectors do. Only vectors of the query's dimension are candidates. Components may
    be as large as doubles are; scores beyond a long are the nearest long. Repeated rows
    are candidates each; queries that repeat an id are one. No rows give no rows.
    """
    rows = usable(vectors, id_col, vec_col, zero_too=True)
    queries = stored(query_rows_of(rows, is_query))
    row_blocks = max(1, math.ceil(rows.count() / block_rows))
    query_blocks = max(1, math.ceil(queries.count() / query_rows))
    place = F.pmod(F.xxhash64("id"), F.lit(row_blocks))
    # Rows that repeat an id are told apart, so that they spread.
    spread = F.pmod(F.xxhash64("id", "vec"), F.lit(row_blocks))
    blocks = stored(rows.withColumn("b", spread).groupBy("dim", "b").applyInArrow(_listed(scale), _BLOCK))
    search = _searcher(scale, k)
    result = "query_id long, vec_id long, score long"

    first = queries.withColumn("b", place).withColumn("bound", F.lit(None).cast("double"))
    near = stored(blocks.groupBy("dim", "b").cogroup(first.groupBy("dim", "b")).applyInArrow(search, result))
    bounds = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("bound"))

    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    right = queries.withColumn("own", place).join(bounds.withColumnRenamed("query_id", "id"), "id", "left")
    right = right.withColumn("b", every(row_blocks)).where("b <> own").withColumn("q", F.pmod(F.xxhash64("id"), F.lit(query_blocks)))
    left = blocks.withColumn("q", every(query_blocks))
    key = ["dim", "b", "q"]
    far = left.groupBy(*key).cogroup(right.drop("own").groupBy(*key)).applyInArrow(search, result)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = near.unionAll(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
