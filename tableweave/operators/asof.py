"""As-of join: each left row takes the nearest right row in key order.

A by-group, or a single key within it, may hold a large part of a table, so no window
ever sees a whole group:

1. both tables shrink to their distinct (by, key) pairs, by aggregation with a map-side
   stage; no other column goes on from here;
2. the pairs of a large table are sorted over the cluster into ranges of bounded size and
   written with their range number (``stored``), so that every later stage sees the same
   ranges; ranges are a column of that table, nothing of them comes to the driver;
3. the last right key before each (by, range), or the first one behind it, comes from a
   prefix scan in two levels: over the ranges of a block of ranges, and over the blocks;
4. a window runs per (by, range), with these keys as one more row each;
5. the matched pairs meet the right table, reduced to one row per (by, key), and then the
   left rows: right rows travel with their columns only here.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import PlanError
from ..functions.columns import (
    MICROS_PER_SECOND,
    col,
    common_type,
    family,
    micros,
    nan_to_null,
    orderable,
    require_columns,
    to_datetime,
    to_number,
    type_of,
)
from ..session import stored
from .layout import JoinLayout, join_layout

DIRECTIONS = ("backward", "forward", "nearest")
RANGE_ROWS = 200_000  # keys and right rows in one range of keys
COERCE_SHARE = 0.8

# Unit names accepted in a time span, in microseconds.
SPAN_UNITS = {
    "us": 1, "micro": 1, "micros": 1, "microsecond": 1, "microseconds": 1,
    "ms": 1_000, "milli": 1_000, "millis": 1_000, "millisecond": 1_000, "milliseconds": 1_000,
    "s": 1_000_000, "sec": 1_000_000, "second": 1_000_000, "seconds": 1_000_000,
    "m": 60_000_000, "min": 60_000_000, "minute": 60_000_000, "minutes": 60_000_000,
    "h": 3_600_000_000, "hr": 3_600_000_000, "hour": 3_600_000_000, "hours": 3_600_000_000,
    "d": 86_400_000_000, "day": 86_400_000_000, "days": 86_400_000_000,
    "w": 604_800_000_000,
}


def span_micros(text: str) -> int:
    """Length of a time span such as '10min', '1h 30m' or '01:30:00' in microseconds."""
    body = str(text).strip().lower()
    sign = -1 if body.startswith("-") else 1
    body = body.lstrip("+-").strip()
    clock = re.fullmatch(r"(?:(\d+)\s*days?,?\s*)?(\d+):(\d+)(?::(\d+(?:\.\d+)?))?", body)
    if clock:
        days, hours, minutes, seconds = clock.groups()
        total = (int(days or 0) * 24 + int(hours)) * 3600 + int(minutes) * 60
        return sign * (total * MICROS_PER_SECOND + round(float(seconds or 0) * MICROS_PER_SECOND))
    parts = re.findall(r"(\d+(?:\.\d+)?|\.\d+)\s*([a-z]+)", body)
    rest = re.sub(r"(\d+(?:\.\d+)?|\.\d+)\s*([a-z]+)", "", body).strip(" ,")
    if not parts or rest or any(unit not in SPAN_UNITS for _, unit in parts):
        raise PlanError(f"cannot read a time span from {text!r}")
    return sign * sum(round(float(n) * SPAN_UNITS[unit]) for n, unit in parts)


@dataclass(frozen=True)
class AsofMatches:
    """Left rows (l0, l1, …), by-keys (b0, b1, …) and ``hit``: the matched right key
    ``k``, right row ``v`` and ``which`` of the rows at that key it is (0: the only one,
    1: the first, 2: the last) as one struct, null where there is no match."""

    rows: DataFrame
    layout: JoinLayout
    by_names: tuple[str, ...]
    right: DataFrame  # all right rows as (b0, b1, …, k, v)

    def right_row(self, v: str = "hit.v") -> list[Column]:
        """Columns r0, r1, … of a right row, by default the matched one."""
        parts = self.right.schema["v"].dataType.fields
        where = {f.name: part.name for part in parts for f in part.dataType.fields}
        return [F.col(f"{v}.{where[n]}.{n}").alias(n) for n in self.layout.right.columns]


@dataclass(frozen=True)
class _Rule:
    """What counts as a match."""

    direction: str
    allow_exact: bool
    limit: float | None
    whole: bool  # integer keys: a difference may leave the long range

    @property
    def sides(self) -> tuple[str, ...]:
        return {"backward": ("bwd",), "forward": ("fwd",)}.get(self.direction, ("bwd", "fwd"))

    def gap(self, other: Column) -> Column:
        cast = (lambda c: c.cast("decimal(20,0)")) if self.whole else (lambda c: c)
        return F.abs(cast(F.col("k")) - cast(other))

    def side(self) -> Column:
        """The direction in which the match of a left key lies."""
        if self.direction != "nearest":
            return F.lit(self.sides[0])
        bwd, fwd = F.col("bwd"), F.col("fwd")
        ahead = fwd.isNotNull() & (bwd.isNull() | (self.gap(fwd) < self.gap(bwd)))
        return F.when(ahead, "fwd").otherwise("bwd")

    def fits(self, other: Column) -> Column:
        near = other.isNotNull()
        return near if self.limit is None else near & (self.gap(other) <= F.lit(self.limit))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    left_by: Sequence[str] = (),
    right_by: Sequence[str] = (),
    direction: str = "backward",
    tolerance: str | float | None = None,
    allow_exact: bool = True,
    order_by: Sequence[str] = (),
    on_null: str = "error",
    conflict: str = "keep_both",
    suffixes: Sequence[str] = ("_l", "_r"),
) -> DataFrame:
    """Left as-of join.

    Right rows with equal keys are ranked by ``order_by`` and then by their other
    columns: backward takes the last, forward the first. ``on_null`` says what a
    null key does: "error", or "unmatched" to keep a left row without a match.
    """
    return asof_output(asof_matches(
        left, right, left_on, right_on, left_by, right_by, direction, tolerance,
        allow_exact, order_by, on_null, conflict, suffixes,
    ))


def asof_output(found: AsofMatches) -> DataFrame:
    wide = found.rows.select(
        *(F.col(n) for n in found.layout.left.columns), *found.right_row()
    )
    return wide.select(*found.layout.select("left"))


def asof_matches(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    left_by: Sequence[str] = (),
    right_by: Sequence[str] = (),
    direction: str = "backward",
    tolerance: str | float | None = None,
    allow_exact: bool = True,
    order_by: Sequence[str] = (),
    on_null: str = "error",
    conflict: str = "keep_both",
    suffixes: Sequence[str] = ("_l", "_r"),
) -> AsofMatches:
    if direction not in DIRECTIONS:
        raise PlanError(f"unknown as-of direction: {direction}")
    if on_null not in ("error", "unmatched"):
        raise PlanError(f"unknown rule for null keys: {on_null}")
    if len(left_by) != len(right_by):
        raise PlanError("both sides need the same number of by-keys")
    require_columns(left, [left_on, *left_by], "left columns")
    require_columns(right, [right_on, *right_by, *order_by], "right columns")
    for a, b in zip(left_by, right_by):
        if len({family(type_of(left, a)), family(type_of(right, b))} - {"null"}) > 1:
            raise PlanError(f"by-key types do not fit: {a} and {b}")

    left, right = _coerce_keys(left, right, left_on, right_on)
    key_type = common_type(type_of(left, left_on), type_of(right, right_on))
    timed = family(key_type) == "datetime"
    if timed or isinstance(key_type, T.IntegralType):
        key_name = "bigint"
    else:
        key_name = key_type.simpleString()
    limit = _tolerance(tolerance, timed)
    rule = _Rule(direction, allow_exact, limit, key_name == "bigint" and not timed)

    pairs = [*zip(left_by, right_by), (left_on, right_on)]
    layout = join_layout(left, right, pairs, suffixes, conflict)

    def key(name: str, side: str) -> Column:
        value = F.col(name)
        if timed:
            value = micros(value.cast(key_type), key_type)
        else:
            value = nan_to_null(value.cast(key_name), key_type)
        if on_null == "error":
            stop = F.raise_error(F.lit(f"null as-of key in the {side} table"))
            value = F.coalesce(value, stop.cast(key_name))
        return value.alias("k")

    bys = [f"b{i}" for i in range(len(left_by))]
    by_types = [
        common_type(type_of(left, a), type_of(right, b)) for a, b in zip(left_by, right_by)
    ]

    def by_columns(names: list[str]) -> list[Column]:
        return [F.col(n).cast(t).alias(b) for n, t, b in zip(names, by_types, bys)]

    fields = {f.name: f.dataType for f in layout.right.schema.fields}
    ranks = list(dict.fromkeys(layout.r(n) for n in order_by))
    ranks += [n for n, t in fields.items() if orderable(t) and n not in ranks]
    rest = [n for n in fields if n not in ranks]
    parts = [F.struct(*(F.col(n) for n in ranks)).alias("o")]
    if rest:
        parts.append(F.struct(*(F.col(n) for n in rest)).alias("x"))

    L = layout.left.select(
        "*", *by_columns([layout.l(n) for n in left_by]), key(layout.l(left_on), "left")
    )
    R = layout.right.select(
        *by_columns([layout.r(n) for n in right_by]),
        key(layout.r(right_on), "right"),
        F.struct(*parts).alias("v"),
    )
    rows = _matched(L, R.where(F.col("k").isNotNull()), layout.left.columns, bys, rule)
    return AsofMatches(rows, layout, tuple(bys), R)


# ---------------------------------------------------------------------- the plan


def _matched(L: DataFrame, R: DataFrame, lefts, bys, rule: _Rule) -> DataFrame:
    left_keys = L.where(F.col("k").isNotNull()).select(*bys, "k").distinct()
    right_keys = R.select(*bys, "k").distinct()
    keys = right_keys.select(*bys, "k", F.lit(0).alias("s")).unionAll(left_keys.select(*bys, "k", F.lit(1).alias("s")))
    matches = _key_matches(keys, bys, rule).select(
        *(F.col(b).alias(f"m_{b}") for b in bys), F.col("k").alias("m_k"), "to_k", "side"
    )
    # Of right rows with equal keys backward takes the last, forward the first.
    best = {"bwd": F.max_by("v", F.col("v.o")), "fwd": F.min_by("v", F.col("v.o"))}
    rows = R.groupBy(*(F.col(b).alias(f"r_{b}") for b in bys), F.col("k").alias("r_k")).agg(
        F.count(F.lit(1)).alias("copies"), *(best[n].alias(n) for n in rule.sides)
    )
    ahead = F.col("side") == "fwd"
    taken = F.when(ahead, _or_null(rows, "fwd")).otherwise(_or_null(rows, "bwd"))
    # Which of the right rows at a key: the only one, the first or the last.
    which = F.when(F.col("copies") == 1, 0).when(ahead, 1).otherwise(2)
    # Null-safe, so that the join has a shuffle of its own: AQE can then split a right row
    # that many left keys match.
    on = [F.col("to_k").eqNullSafe(F.col("r_k"))] + [F.col(f"m_{b}").eqNullSafe(F.col(f"r_{b}")) for b in bys]
    hits = matches.join(rows, reduce(and_, on)).select(
        *(f"m_{b}" for b in bys), "m_k", F.struct(F.col("to_k").alias("k"), taken.alias("v"), which.alias("which")).alias("hit")
    )
    on = [F.col("k") == F.col("m_k")] + [F.col(b).eqNullSafe(F.col(f"m_{b}")) for b in bys]
    return L.join(hits, reduce(and_, on), "left").select(*lefts, *bys, "hit")


def _key_matches(keys: DataFrame, bys: Sequence[str], rule: _Rule) -> DataFrame:
    """(by…, k, to_k, side) of the left keys (s = 1) that a right key (s = 0) matches."""
    # Counted, not estimated: an estimate is no bound.
    ranges = math.ceil(keys.count() / RANGE_ROWS)
    if not bys:
        ranges = max(ranges, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows, part = keys, list(bys)
    if ranges > 1:
        # A range is a stretch of the order by (by…, key): most by-groups lie in one.
        rows = stored(keys.repartitionByRange(ranges, *bys, "k").withColumn("g", F.spark_partition_id()))
        rows, part = rows.unionByName(_carried(rows, bys, rule, ranges)), [*bys, "g"]
    # At equal keys right rows (s = 0) come before left rows (s = 1), or after them.
    side = F.col("s").asc() if rule.allow_exact else F.col("s").desc()
    for name in rule.sides:
        # The frame always runs over preceding rows, which Spark extends row by row, so
        # forward sorts the keys downwards.
        window = (
            Window.partitionBy(*part)
            .orderBy(F.col("k").asc() if name == "bwd" else F.col("k").desc(), side)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        rows = rows.withColumn(name, F.last(F.when(F.col("s") == 0, F.col("k")), ignorenulls=True).over(window))
    found = rows.where(F.col("s") == 1).withColumn("side", rule.side())
    to_k = F.when(F.col("side") == "fwd", _or_null(found, "fwd")).otherwise(_or_null(found, "bwd"))
    return found.withColumn("to_k", to_k).where(rule.fits(F.col("to_k"))).select(*bys, "k", "to_k", "side")


def _or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


def _carried(ranged: DataFrame, bys: Sequence[str], rule: _Rule, ranges: int) -> DataFrame:
    """The right keys that enter each (by, range) with left keys, one per direction.

    Keys grow with the range, so the last key before a range is the greatest of all
    earlier ranges. Blocks hold about as many ranges as there are blocks.
    """
    span = max(1, math.isqrt(ranges))
    right_k = F.when(F.col("s") == 0, F.col("k"))
    ends = {"bwd": F.max, "fwd": F.min}
    spans = ranged.groupBy(*bys, "g").agg(
        F.max("s").alias("has_left"), *(ends[n](right_k).alias(n) for n in rule.sides)
    ).withColumn("block", F.expr(f"g div {span}"))
    blocks = spans.groupBy(*bys, "block").agg(*(ends[n](n).alias(n) for n in rule.sides))

    def ahead(part: Sequence[str], by: str, name: str) -> Column:
        order = F.col(by).asc() if name == "bwd" else F.col(by).desc()
        window = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return ends[name](name).over(window)

    if bys:
        outer = blocks.select(*bys, "block", *(ahead(bys, "block", n).alias(f"{n}_outer") for n in rule.sides))
    else:
        # Each block's end goes to all blocks on its far side: as many rows as ranges.
        last = (ranges - 1) // span
        reach = {
            "bwd": F.expr(f"if(block < {last}, sequence(block + 1, {last}L), array())"),
            "fwd": F.expr("if(block > 0, sequence(0L, block - 1), array())"),
        }
        sent = [
            blocks.select(F.explode(reach[n]).alias("block"), *(
                (F.col(m) if m == n else F.lit(None).cast(blocks.schema[m].dataType)).alias(m) for m in rule.sides
            ))
            for n in rule.sides
        ]
        outer = reduce(DataFrame.unionAll, sent).groupBy("block").agg(*(ends[n](n).alias(f"{n}_outer") for n in rule.sides))
    outer = outer.select(*(F.col(c).alias(f"o_{c}") for c in [*bys, "block"]), *(f"{n}_outer" for n in rule.sides))
    inner = spans.withColumns({f"{n}_inner": ahead([*bys, "block"], "g", n) for n in rule.sides})
    on = [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in [*bys, "block"]]
    joined = inner.where(F.col("has_left") == 1).join(outer, reduce(and_, on), "left")
    meet = {"bwd": F.greatest, "fwd": F.least}  # both pass over nulls
    entering = F.array(*(meet[n](f"{n}_inner", f"{n}_outer") for n in rule.sides))
    rows = joined.select(*bys, F.explode(entering).alias("k"), F.lit(0).alias("s"), "g")
    return rows.where(F.col("k").isNotNull())


# -------------------------------------------------------------------- parameters


def _tolerance(tolerance, timed: bool) -> float | None:
    if tolerance is None or str(tolerance).strip() == "":
        return None
    if timed:
        return span_micros(str(tolerance))
    try:
        return float(tolerance)
    except ValueError as exc:
        raise PlanError(f"cannot read a number from tolerance {tolerance!r}") from exc


def _coerce_keys(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str
) -> tuple[DataFrame, DataFrame]:
    """Give both keys one family. Text keys become numbers if 80 % of both sides
    parse, else datetimes; the shares come from one aggregate per side."""
    kinds = [family(type_of(left, left_on)), family(type_of(right, right_on))]
    if kinds[0] == kinds[1] and kinds[0] in ("number", "datetime"):
        return left, right
    tables = ((left, left_on), (right, right_on))
    counts = []
    for df, name in tables:
        dtype = type_of(df, name)
        counts.append(
            df.agg(
                F.count(col(name)).alias("filled"),
                F.count(to_number(col(name), dtype)).alias("numbers"),
                F.count(to_datetime(col(name), dtype)).alias("datetimes"),
            ).first()
        )
    if all(c.numbers >= max(1, int(c.filled * COERCE_SHARE)) for c in counts):
        parse = to_number
    elif any(c.filled and not c.datetimes for c in counts):
        raise PlanError(f"as-of keys are neither numbers nor datetimes: {left_on}, {right_on}")
    else:
        parse = to_datetime
    done = [
        df.withColumn(name, parse(col(name), type_of(df, name))) for df, name in tables
    ]
    return done[0], done[1]
