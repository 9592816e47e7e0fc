"""Pages of a table in a given order.

A page near the start is a top-k, bounded by the request. For one far behind, ``page``
counts its way to it each time; ``page_directory`` sorts the table once over the cluster
and keeps the row counts of its parts, so that any page reads the parts that hold it.
Parts lie in a folder per sorting task, and tasks follow the rows, not the parts: what a
task reports to the driver weighs the same however small the parts are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import PlanError
from ..functions.columns import col, require_columns
from ..session import shared_folder, stored

DEFAULT_PAGE_SIZE = 200
MAX_PAGE_SIZE = 1000
# Narrowing ends once so few rows of a part lie before the end of the page.
KEEP_ROWS = 20 * MAX_PAGE_SIZE
SAMPLE_ROWS = 2_000
CUTS = 64
PART_ROWS = 50_000  # rows of a part of a page directory
FOLDER_ROWS = 500_000  # rows of a folder of parts, where the session's shuffle partitions are too few
FOLDER = "__folder"
PLACE = "__place_in_folder"  # from 0, in order


def page_size(value: object) -> int:
    try:
        return max(1, min(int(value), MAX_PAGE_SIZE))
    except (TypeError, ValueError):
        return DEFAULT_PAGE_SIZE


def page_number(value: object) -> int:
    try:
        return max(int(value), 0)
    except (TypeError, ValueError):
        return 0


def page(
    df: DataFrame,
    order_by: Sequence[str],
    number: object = 0,
    size: object = DEFAULT_PAGE_SIZE,
    after: Sequence[object] | None = None,
) -> DataFrame:
    """Page ``number`` (from 0) in the order of ``order_by``, which must be total.

    A page whose end lies within ``KEEP_ROWS`` rows is one top-k. The start of a page
    behind that is found by counting, in jobs run when the page is planned. To walk on from a page at hand, pass the order values of its last
    row as ``after``: the next page then needs no counting.
    """
    if not order_by:
        raise PlanError("paging needs an order")
    require_columns(df, order_by, "order columns")
    rows = page_size(size)
    order = [col(n).asc_nulls_first() for n in order_by]
    if after is not None:
        if len(after) != len(order_by):
            raise PlanError("after needs one value per order column")
        return df.where(_behind(order_by, after)).orderBy(*order).limit(rows)
    skip = page_number(number) * rows
    if skip + rows <= KEEP_ROWS:
        return df.orderBy(*order).offset(skip).limit(rows)
    pieces = [
        part.orderBy(*order).offset(skip).limit(take)
        for part, skip, take in _locate(df, list(order_by), skip, rows)
    ]
    return reduce(lambda a, b: a.unionAll(b), pieces)


@dataclass(frozen=True)
class PageDirectory:
    """A table sorted into parts, whole parts to a folder below ``path``, and ``starts``:
    (folder, part, rows, start, place), the rows of each part, of all parts before it and
    of those before it in its folder."""

    path: str
    starts: DataFrame
    order_by: tuple[str, ...]
    schema: T.StructType
    rows: int

    def page(self, number: object = 0, size: object = DEFAULT_PAGE_SIZE) -> DataFrame:
        """Page ``number`` (from 0), in order; empty behind the last one.

        One job over ``starts`` finds the parts; only their places in their folders are read.
        """
        take = page_size(size)
        skip = page_number(number) * take
        holds = (F.col("start") < skip + take) & (F.col("start") + F.col("rows") > skip)
        parts = self.starts.where(holds).orderBy("start").collect()  # at most ``take`` parts, mostly one
        spark = self.starts.sparkSession
        if not parts:
            return spark.createDataFrame([], self.schema)
        schema = T.StructType([*self.schema, T.StructField(PLACE, T.LongType())])
        pieces = []
        for folder, held in groupby(parts, lambda p: p.folder):
            held = list(held)
            before = held[0].start - held[0].place
            low, high = max(skip - before, held[0].place), min(skip + take - before, held[-1].place + held[-1].rows)
            rows = spark.read.schema(schema).parquet(f"{self.path}/{FOLDER}={folder}")
            inside = (F.col(PLACE) >= low) & (F.col(PLACE) < high)
            pieces.append(rows.where(inside).withColumn(FOLDER, F.lit(folder)))
        return reduce(lambda a, b: a.unionAll(b), pieces).orderBy(FOLDER, PLACE).drop(FOLDER, PLACE)

    def pages(self, size: object = DEFAULT_PAGE_SIZE) -> int:
        return math.ceil(self.rows / page_size(size))


def page_directory(df: DataFrame, order_by: Sequence[str], part_rows: int = PART_ROWS) -> PageDirectory:
    """Sort ``df`` by ``order_by``, which must be total, into parts of ``part_rows`` rows,
    less at the end of a folder.

    Rows are counted, sorted over the cluster and written below ``spark.checkpoint.dir``
    once. Row counts of parts are summed by folder first, so that no task orders all of
    them.
    """
    if not order_by:
        raise PlanError("paging needs an order")
    require_columns(df, order_by, "order columns")
    spark = df.sparkSession
    total = df.count()
    parts = max(1, math.ceil(total / part_rows))
    folders = min(parts, max(math.ceil(total / FOLDER_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    order = [col(n).asc_nulls_first() for n in order_by]
    path = shared_folder(spark)
    placed = df.repartitionByRange(folders, *order).withColumn(FOLDER, F.spark_partition_id())
    # The lower 33 bits count the rows of a task.
    placed = placed.sortWithinPartitions(FOLDER, *order).withColumn(
        PLACE, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    # A reader skips file pages by their least and greatest place.
    placed.write.option("parquet.page.row.count.limit", part_rows).partitionBy(FOLDER).parquet(path)
    written = spark.read.schema(placed.schema).parquet(path)
    counts = written.groupBy(F.col(FOLDER).alias("folder"), F.expr(f"{PLACE} div {part_rows}").alias("part")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    before = lambda by, *within: F.sum("rows").over(
        Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    ) - F.col("rows")
    inner = counts.withColumn("place", before("part", "folder"))
    groups = counts.groupBy("folder").agg(F.sum("rows").alias("rows"))
    outer = groups.select("folder", before("folder").alias("outer"))
    starts = inner.join(outer, "folder").select("folder", "part", "rows", (F.col("place") + F.col("outer")).alias("start"), "place")
    return PageDirectory(path, stored(starts), tuple(order_by), df.schema, total)


def _locate(
    df: DataFrame, names: list[str], skip: int, take: int
) -> list[tuple[DataFrame, int, int]]:
    """Parts of ``df`` that hold the page, each with the rows to skip and take in it.

    A sort that skips many rows keeps them all in one task. So the table is narrowed
    first: exact counts at a few values of the leading order column say which of them
    lie before and behind the page. A value that fills the part alone hands over to
    the next order column; a page that crosses such a value falls into two pieces.
    """
    narrowed = False
    while names and skip and not (narrowed and skip + take <= KEEP_ROWS):
        narrowed = True
        name, dtype = names[0], df.schema[names[0]].dataType
        bounds, total = _bounds(df, name, dtype)
        below = [b for b in bounds if b.rows <= skip]
        above = [b for b in bounds if b.rows >= skip + take]
        low, high = below[-1], above[0] if above else None
        if high and low.value == high.value and not low.through and high.through:
            value = F.lit(low.value).cast(dtype)
            df, skip, names = df.where(col(name).eqNullSafe(value)), skip - low.rows, names[1:]
            continue
        inside = [b for b in bounds if skip < b.rows < skip + take]
        if inside:
            cut = inside[0].rows - skip
            if skip + take <= KEEP_ROWS:
                break
            return _locate(df.where(inside[0].before(name, dtype)), names, skip, cut) + _locate(
                df.where(~inside[0].before(name, dtype)), names, 0, take - cut
            )
        if low.rows == 0 and (high is None or high.rows == total):
            break  # no value seen divides what is left
        df = df.where(~low.before(name, dtype))
        if high:
            df = df.where(high.before(name, dtype))
        skip -= low.rows
    return [(df, skip, take)]


class _Bound(NamedTuple):
    """A place in the order: before a value, or through it. Nulls come first."""

    value: object
    through: bool
    rows: int  # rows of the part before this place

    def before(self, name: str, dtype) -> Column:
        if self.value is None:
            return col(name).isNull() if self.through else F.lit(False)
        value = F.lit(self.value).cast(dtype)
        within = col(name) <= value if self.through else col(name) < value
        return col(name).isNull() | within


def _bounds(df: DataFrame, name: str, dtype) -> tuple[list[_Bound], int]:
    """Places at some values of a column, in order, with exact counts, and the number
    of all rows. Which values are chosen is left to chance; it has no bearing on the
    rows of the page."""
    some = df.select(col(name).alias("v")).where(F.col("v").isNotNull())
    sample = [r.v for r in some.orderBy(F.rand()).limit(SAMPLE_ROWS).collect()]
    values = sorted({v for v in sample if v == v})
    chosen = [None, *values[:: max(1, len(values) // CUTS)], *values[-1:]]
    places = [_Bound(v, t, 0) for v in dict.fromkeys(chosen) for t in (False, True)]
    counts = df.agg(
        *(F.count_if(p.before(name, dtype)).alias(f"n{i}") for i, p in enumerate(places)),
        F.count(F.lit(1)).alias("total"),
    ).first()
    return [p._replace(rows=n) for p, n in zip(places, counts)], counts.total


def _behind(names: Sequence[str], values: Sequence[object]):
    """Rows whose order values come after ``values``, column by column."""
    tests = []
    for i, (name, value) in enumerate(zip(names, values)):
        same = [col(n).eqNullSafe(F.lit(v)) for n, v in zip(names[:i], values[:i])]
        later = col(name).isNotNull() if value is None else col(name) > F.lit(value)
        tests.append(reduce(and_, [*same, later]))
    return reduce(or_, tests)


def page_count(df: DataFrame, size: object = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One row: the number of rows and of pages."""
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("rows"), F.ceil(rows / F.lit(page_size(size))).cast("long").alias("pages")
    )
