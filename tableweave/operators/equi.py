"""Null-safe equi joins and the rows they leave unmatched.

A key may hold a large part of a table. AQE splits such a key at run time, on both
sides of an inner join and on the kept side of an outer or anti join, provided both
sides come straight from a shuffle made for the join. Hence three rules here:

* An outer join is one join. The side that it does not keep, which AQE cannot split,
  is counted by key first, combined on the map side; keys with more than ``HOT_ROWS``
  rows are named, and only their rows are joined apart, as an inner join plus the
  rows without a partner. Without such keys there is no second join.
* Up to ``MOST_NAMED`` of them, which is counted, are sent to every task; more are
  joined like any table.
* Counts per key are one table, the ``KeyDirectory``. Where a step makes one, it is stored
  and hot keys, the report and both extracts are read from it.
* Joins compare by ``<=>``. Spark shuffles for it by (value or default, is null), so
  a side aggregated by the same key is shuffled once more. It is small by then, and
  sharing the aggregation's shuffle would leave a hot key of the other side whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions.columns import col, family, require_columns, type_of
from ..session import stored
from .layout import JoinLayout, join_layout

JOIN_TYPES = ("inner", "left", "right", "outer")
HOT_ROWS = 1_000_000
MOST_NAMED = 100_000


def check_keys(
    left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str]
) -> None:
    if not left_keys or not right_keys:
        raise PlanError("at least one key column per side is needed")
    if len(left_keys) != len(right_keys):
        raise PlanError("both sides need the same number of key columns")
    require_columns(left, left_keys, "left key columns")
    require_columns(right, right_keys, "right key columns")
    for a, b in zip(left_keys, right_keys):
        kinds = {family(type_of(left, a)), family(type_of(right, b))} - {"null"}
        if len(kinds) > 1:
            raise PlanError(f"key types do not fit: {a} ({type_of(left, a).simpleString()}) "
                            f"and {b} ({type_of(right, b).simpleString()})")


def null_safe(left_names: Sequence[str], right_names: Sequence[str]):
    return reduce(
        and_, (col(a).eqNullSafe(col(b)) for a, b in zip(left_names, right_names))
    )


def anti(left: DataFrame, right: DataFrame, left_names, right_names) -> DataFrame:
    """Left rows without a partner. Distinct first, so a hot right key is one row."""
    right_keys = right.select(*(col(n) for n in right_names)).distinct()
    return left.join(right_keys, null_safe(left_names, right_names), "left_anti")


@dataclass(frozen=True)
class KeyDirectory:
    """(k0, k1, …, left_count, right_count) of every key of two tables, null a key like any other."""

    rows: DataFrame
    keys: tuple[str, ...]

    def hot(self, side: str) -> DataFrame:
        """Keys of more than ``HOT_ROWS`` rows of a side."""
        return self.rows.where(F.col(f"{side}_count") > HOT_ROWS).select(*self.keys)

    def alone(self, side: str) -> DataFrame:
        """Keys of a side that the other one lacks."""
        other = "right" if side == "left" else "left"
        return self.rows.where((F.col(f"{side}_count") > 0) & (F.col(f"{other}_count") == 0)).select(*self.keys)


def key_directory(
    left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str]
) -> KeyDirectory:
    """Count both tables by key, in one aggregation with a map-side stage."""
    check_keys(left, right, left_keys, right_keys)
    keys = tuple(f"k{i}" for i in range(len(left_keys)))

    def side(df: DataFrame, names: Sequence[str], lc: int, rc: int) -> DataFrame:
        return df.select(
            *(col(n).alias(k) for n, k in zip(names, keys)),
            F.lit(lc).cast("long").alias("left_count"),
            F.lit(rc).cast("long").alias("right_count"),
        )

    counts = side(left, left_keys, 1, 0).unionAll(side(right, right_keys, 0, 1)).groupBy(*keys).agg(
        F.sum("left_count").alias("left_count"), F.sum("right_count").alias("right_count")
    )
    return KeyDirectory(counts, keys)


def stored_directory(directory: KeyDirectory) -> KeyDirectory:
    return KeyDirectory(stored(directory.rows), directory.keys)


def unmatched(
    left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str],
    directory: KeyDirectory | None = None, side: str = "left",
) -> DataFrame:
    """Left rows whose key is not in right; swap the sides for the right extract.

    With a stored ``directory`` of the step, whose ``side`` the rows are, the other table
    is not read again.
    """
    check_keys(left, right, left_keys, right_keys)
    if directory is not None:
        missing = directory.alone(side).toDF(*(f"__key{i}" for i in range(len(left_keys))))
        return left.join(missing, null_safe(left_keys, missing.columns), "left_semi")
    keyed = right.select(*(col(k).alias(f"__key{i}") for i, k in enumerate(right_keys)))
    return anti(left, keyed, left_keys, [f"__key{i}" for i in range(len(right_keys))])


def equi_join(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str],
    how: str = "left",
    conflict: str = "keep_both",
    suffixes: Sequence[str] = ("_l", "_r"),
    left_unique: bool = False,
    right_unique: bool = False,
    directory: KeyDirectory | None = None,
) -> DataFrame:
    """Join on equal keys, null matching null.

    ``left_unique`` and ``right_unique`` promise that a key occurs at most once on
    that side; keys of a side without the promise are counted, one job over its key
    columns, if the join type does not let AQE split them and no ``directory`` has them.
    """
    if how not in JOIN_TYPES:
        raise PlanError(f"unknown join type: {how}")
    check_keys(left, right, left_keys, right_keys)
    plan = join_layout(left, right, list(zip(left_keys, right_keys)), suffixes, conflict)
    lk = [plan.l(k) for k in left_keys]
    rk = [plan.r(k) for k in right_keys]
    on = null_safe(lk, rk)

    if how == "inner":
        return plan.left.join(plan.right, on, "inner").select(*plan.select("left"))
    keys_from = {"left": "left", "right": "right", "outer": "both"}[how]
    hot = []
    if how in ("left", "outer") and not right_unique:
        hot.append(directory.hot("right") if directory else _hot_keys(plan.right, rk))
    if how in ("right", "outer") and not left_unique:
        hot.append(directory.hot("left") if directory else _hot_keys(plan.left, lk))
    names = [f"h{i}" for i in range(len(lk))]
    types = [type_of(plan.left, n) for n in lk]
    named = [keys.select(*(F.col(c).cast(t).alias(n) for c, t, n in zip(keys.columns, types, names))) for keys in hot]
    number = 0
    if named:
        named = reduce(DataFrame.unionAll, named).distinct()
        named = named if directory else stored(named)
        number = named.count()
    if not number:
        return plan.left.join(plan.right, on, how).select(*plan.select(keys_from))
    if number <= MOST_NAMED:
        named = F.broadcast(named)

    def parts(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        same = null_safe(keys, names)
        return df.join(named, same, "left_anti"), df.join(named, same, "left_semi")

    (cold_l, hot_l), (cold_r, hot_r) = parts(plan.left, lk), parts(plan.right, rk)
    pieces = [
        cold_l.join(cold_r, on, how).select(*plan.select(keys_from)),
        hot_l.join(hot_r, on, "inner").select(*plan.select(keys_from)),
    ]
    if how in ("left", "outer"):
        pieces.append(_only(plan, anti(hot_l, hot_r, lk, rk), plan.right, "left"))
    if how in ("right", "outer"):
        pieces.append(_only(plan, anti(hot_r, hot_l, rk, lk), plan.left, "right"))
    return reduce(DataFrame.unionByName, pieces)


def _hot_keys(side: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than ``HOT_ROWS`` rows."""
    counts = side.groupBy(*(F.col(k) for k in keys)).count().where(F.col("count") > HOT_ROWS)
    return counts.select(*(F.col(k) for k in keys))


def _only(plan: JoinLayout, rows: DataFrame, other: DataFrame, keys: str) -> DataFrame:
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in other.schema.fields]
    return rows.select("*", *empty).select(*plan.select(keys))
