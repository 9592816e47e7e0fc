"""Operators on long time series: one row per tag and timestamp."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import PlanError
from ..functions.columns import (
    MICROS_PER_SECOND,
    col,
    family,
    micros,
    micros_interval,
    orderable,
    require_columns,
    to_number,
    type_of,
)
from ..functions.names import match_key, match_key_column, match_keys_column, matches_any_name
from .asof import span_micros

SUMMARY_FUNCTIONS = ("average", "min", "max", "sum", "count", "std")
DEFAULT_SUMMARY = ("average", "min", "max")
# Hours, seconds, microseconds: each step looks into one slot of the step before.
EDGE_WIDTHS = (3_600 * MICROS_PER_SECOND, MICROS_PER_SECOND, 1)
RANGE_CELLS = 4_096  # grid cells in one window of an interpolation

_TIME_FORMS = tuple(
    day + clock for day in ("%Y/%m/%d", "%m/%d/%Y") for clock in (" %H:%M:%S", " %H:%M", "")
) + ("%Y%m%d%H%M%S",)
_RELATIVE = re.compile(r"\*\s*(?:([+-])\s*(\d+(?:\.\d+)?)\s*([a-z]+))?", re.IGNORECASE)


# -------------------------------------------------------------------- parameters


def rows_per_tag(value: object) -> int | None:
    """A cap as given, 1 at least; None, no cap, where none is given or it is no number."""
    try:
        return max(1, int(value))
    except (TypeError, ValueError):
        return None


def summary_functions(names: Iterable[str] | None) -> tuple[str, ...]:
    """Known functions in their fixed order; none means average, min and max."""
    wanted = {str(n or "").strip().lower() for n in names or ()}
    return tuple(f for f in SUMMARY_FUNCTIONS if f in wanted) or DEFAULT_SUMMARY


def resolve_time(text: object, now: datetime | None = None) -> datetime | None:
    """A time bound: a datetime, a text, ``*`` (now) or ``*-1d``; None if unreadable.

    Now has an offset. Texts may be ISO, with or without one, or ``2024/01/05`` and
    ``1/5/2024`` with a clock time or without.
    """
    if text is None or isinstance(text, datetime):
        return text
    body = str(text).strip()
    relative = _RELATIVE.fullmatch(body)
    if relative:
        sign, amount, unit = relative.groups()
        moment = now or datetime.now(timezone.utc)
        if sign is None:
            return moment
        return moment + timedelta(microseconds=span_micros(f"{sign}{amount}{unit}"))
    try:
        return datetime.fromisoformat(body)
    except ValueError:
        pass
    for form in _TIME_FORMS:
        try:
            return datetime.strptime(body, form)
        except ValueError:
            continue
    return None


def wall_clock(df: DataFrame, moment: datetime) -> datetime:
    """The moment without its offset, as clocks show it in the session's time zone."""
    if moment.tzinfo is None:
        return moment
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    try:
        place = ZoneInfo(zone)
    except (KeyError, ValueError):  # an offset such as +09:00 or GMT+9
        found = re.fullmatch(r"(?:UTC|GMT|UT)?([+-])(\d{1,2})(?::?(\d{2}))?(?::\d{2})?", zone)
        if not found:
            raise PlanError(f"cannot read the session time zone {zone!r}") from None
        sign, hours, minutes = found.groups()
        away = timedelta(hours=int(hours), minutes=int(minutes or 0))
        place = timezone(-away if sign == "-" else away)
    return moment.astimezone(place).replace(tzinfo=None)


def _bound(moment: datetime, dtype: T.DataType) -> Column:
    """A bound as a literal of the column's own type, so that it is pushed to the scan."""
    return F.lit(moment.isoformat(sep=" ")).cast(dtype)


def _bound_micros(df: DataFrame, moment: datetime, dtype: T.DataType) -> Column:
    return micros(_bound(moment, dtype), dtype)


def _in_range(df: DataFrame, ts: str, start, end, now) -> DataFrame:
    dtype = type_of(df, ts)
    for text, test in ((start, lambda c, b: c >= b), (end, lambda c, b: c <= b)):
        moment = resolve_time(text, now)
        if text is not None and moment is None:
            raise PlanError(f"cannot read the time {text!r}")
        if moment is not None:
            df = df.where(test(col(ts), _bound(wall_clock(df, moment), dtype)))
    return df


def _only_tags(df: DataFrame, tag: str, tags: Sequence[str] | None) -> DataFrame:
    return df if not tags else df.where(col(tag).isin(list(tags)))


def _ranking(df: DataFrame, order_by: Sequence[str], skip: Sequence[str]) -> Column:
    """Tie-break among equal timestamps: ``order_by``, then every other column."""
    require_columns(df, order_by, "order columns")
    names = list(order_by)
    names += [
        f.name
        for f in df.schema.fields
        if f.name not in skip and f.name not in names and orderable(f.dataType)
    ]
    return F.struct(*(col(n) for n in names)) if names else F.struct(F.lit(0).alias("none"))


def _check(df: DataFrame, tag: str, ts: str, value: str | None = None) -> None:
    require_columns(df, [n for n in (tag, ts, value) if n], "series columns")
    if family(type_of(df, ts)) != "datetime":
        raise PlanError(f"{ts} is not a datetime column")


# --------------------------------------------------------------------- operators


def recorded(
    df: DataFrame,
    start=None,
    end=None,
    max_rows: int | None = None,
    tags: Sequence[str] | None = None,
    tag: str = "tag",
    ts: str = "timestamp",
    order_by: Sequence[str] = (),
    now: datetime | None = None,
) -> DataFrame:
    """Rows inside [start, end]; with ``max_rows``, the first ones of each tag only.

    A tag may hold most rows, so none is sorted to apply the cap. Counts per tag and
    hour, combined on the map side, say in which hour a tag reaches it; counts of the
    seconds of that hour and of the microseconds of that second say at which timestamp.
    Earlier rows are kept, later ones dropped; only rows of that timestamp are ranked.
    """
    _check(df, tag, ts)
    rows = _in_range(_only_tags(df, tag, tags), ts, start, end, now).where(col(ts).isNotNull())
    if max_rows is None:
        return rows
    names = rows.columns
    at = micros(col(ts), type_of(rows, ts))
    edges = _cap_edges(rows.select(col(tag).alias("__tag"), at.alias("__t")), rows_per_tag(max_rows))
    placed = rows.withColumns({"__t": at, "__rank": _ranking(rows, order_by, (tag, ts))}).join(
        edges, col(tag).eqNullSafe(F.col("__tag")), "left"
    )
    edge = F.col("__edge")
    inside = placed.where(edge.isNull() | (F.col("__t") < edge))
    window = Window.partitionBy(col(tag)).orderBy("__rank")
    tied = placed.where(F.col("__t") == edge).withColumn("__n", F.row_number().over(window))
    tied = tied.where(F.col("__n") <= F.col("__quota"))
    return inside.select(*(col(n) for n in names)).unionAll(tied.select(*(col(n) for n in names)))


def _cap_edges(times: DataFrame, cap: int) -> DataFrame:
    """(__tag, __edge, __quota) of tags with at least ``cap`` rows: the timestamp at which
    the cap is reached, and how many rows of that timestamp are still inside it."""
    still = times.withColumn("__quota", F.lit(cap).cast("long"))
    for width in EDGE_WIDTHS:
        slot = F.floor(F.col("__t") / width) if width > 1 else F.col("__t")
        slots = still.groupBy("__tag", slot.alias("__slot")).agg(
            F.count("*").alias("__n"), F.max("__quota").alias("__quota")
        )
        upto = Window.partitionBy("__tag").orderBy("__slot").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        before = F.sum("__n").over(upto) - F.col("__n")
        reached = (
            slots.withColumn("__before", before)
            .where((F.col("__before") < F.col("__quota")) & (F.col("__before") + F.col("__n") >= F.col("__quota")))
            .select(
                F.col("__tag").alias("__in"), F.col("__slot").alias("__at"),
                (F.col("__quota") - F.col("__before")).alias("__rest"),
            )
        )
        if width == 1:
            break
        within = F.col("__tag").eqNullSafe(F.col("__in")) & (slot == F.col("__at"))
        still = still.join(reached, within).select("__tag", "__t", F.col("__rest").alias("__quota"))
    return reached.select(F.col("__in").alias("__tag"), F.col("__at").alias("__edge"), F.col("__rest").alias("__quota"))


def snapshot(
    df: DataFrame,
    tags: Sequence[str] | None = None,
    tag: str = "tag",
    ts: str = "timestamp",
    order_by: Sequence[str] = (),
) -> DataFrame:
    """The newest row per tag."""
    _check(df, tag, ts)
    rows = _only_tags(df, tag, tags)
    others = [n for n in rows.columns if n != tag]
    row = F.struct(*(col(n) for n in others))
    order = F.struct(col(ts), _ranking(rows, order_by, (tag, ts)))
    newest = rows.groupBy(col(tag)).agg(F.max_by(row, order).alias("__row"))
    return newest.select(
        *(col(n) if n == tag else F.col("__row").getField(n).alias(n) for n in rows.columns)
    )


def interpolate(
    df: DataFrame,
    start,
    end,
    interval: str,
    max_points: int | None = None,
    tags: Sequence[str] | None = None,
    tag: str = "tag",
    ts: str = "timestamp",
    value: str = "value",
    order_by: Sequence[str] = (),
    now: datetime | None = None,
) -> DataFrame:
    """Values at start, start + interval, … ≤ end, linear between the samples around.

    A grid cell only needs its first and last sample, so samples are reduced per
    (tag, cell) on the map side first. Windows see ``RANGE_CELLS`` cells of a tag;
    the samples before and after them come from one row per (tag, range).
    ``max_points`` keeps the first points of the grid only.
    """
    _check(df, tag, ts, value)
    first, last = resolve_time(start, now), resolve_time(end, now)
    if first is None or last is None:
        raise PlanError("interpolation needs a start and an end")
    first, last = wall_clock(df, first), wall_clock(df, last)
    step = span_micros(interval)
    if step <= 0:
        raise PlanError("the interval must be positive")
    span = (last - first) // timedelta(microseconds=1)
    points = span // step + 1 if span >= 0 else 0
    if max_points is not None:
        points = min(points, rows_per_tag(max_points) or points)

    rows = _only_tags(df, tag, tags).where(col(tag).isNotNull())
    dtype = type_of(rows, ts)
    origin = _bound_micros(rows, first, dtype)
    samples = rows.select(
        col(tag).alias("tag"),
        micros(col(ts), dtype).alias("t"),
        to_number(col(value), type_of(rows, value)).cast("double").alias("v"),
        _ranking(rows, order_by, (tag, ts)).alias("o"),
    ).where(F.col("t").isNotNull() & F.col("v").isNotNull())
    away = F.col("t") - origin
    cell = (
        F.when(away < 0, F.lit(-1).cast("long"))
        .when(away >= points * step, F.lit(points).cast("long"))
        .otherwise(((away - F.pmod(away, F.lit(step))) / step).cast("long"))
    )
    order = F.struct("t", "o")
    cells = (
        samples.withColumn("cell", cell)
        .withColumn("sample", F.struct("t", "v"))
        .groupBy("tag", "cell")
        .agg(
            F.min_by("sample", order).alias("head"),
            F.max_by("sample", order).alias("tail"),
            # the value at the grid point itself; among several the last one
            F.max_by("v", F.when(away == F.col("cell") * step, F.col("o"))).alias("hit"),
        )
        .withColumn("s", F.lit(1))
    )
    # Ranges first, then the points of each: no array holds more than one of the two.
    ranges = -(-points // RANGE_CELLS)
    grid = (
        rows.groupBy(col(tag).alias("tag"))
        .agg(F.max(F.lit(ranges)).alias("ranges"))
        .where(F.col("ranges") > 0)
        .select("tag", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)).alias("r"))
        .select("tag", F.explode(F.sequence(F.lit(0), F.lit(RANGE_CELLS - 1))).alias("i"), "r")
        .select("tag", (F.col("r").cast("long") * RANGE_CELLS + F.col("i")).alias("cell"), F.lit(0).alias("s"))
        .where(F.col("cell") < points)
    )
    both = cells.unionByName(grid, allowMissingColumns=True)
    both = both.withColumn("r", F.floor(F.col("cell") / RANGE_CELLS))
    # Upwards the grid point comes before the samples of its own cell, downwards
    # after them, so ``prev`` ends at the cell before and ``next`` includes its own.
    up = Window.partitionBy("tag", "r").orderBy("cell", "s")
    down = Window.partitionBy("tag", "r").orderBy(F.col("cell").desc(), F.col("s").desc())
    frame = (Window.unboundedPreceding, Window.currentRow)
    following = F.when(F.col("s") == 1, F.struct("head", "hit"))
    # What enters a range from the ranges around it.
    sampled = F.when(F.col("s") == 1, F.col("cell"))
    ends = both.groupBy("tag", "r").agg(
        F.max_by("tail", sampled).alias("end"), F.min_by(F.struct("head", "hit"), sampled).alias("begin"),
        F.max("s").alias("any"),
    ).withColumn("begin", F.when(F.col("any") == 1, F.col("begin")))
    earlier = Window.partitionBy("tag").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("tag").orderBy(F.col("r").desc()).rowsBetween(Window.unboundedPreceding, -1)
    entering = ends.select(
        F.col("tag").alias("e_tag"), F.col("r").alias("e_r"),
        F.last("end", ignorenulls=True).over(earlier).alias("before"),
        F.last("begin", ignorenulls=True).over(later).alias("after"),
    )
    at = origin + F.col("cell") * step
    placed = (
        both.withColumn("prev", F.last("tail", ignorenulls=True).over(up.rowsBetween(*frame)))
        .withColumn("next", F.last(following, ignorenulls=True).over(down.rowsBetween(*frame)))
        .where(F.col("s") == 0)
        .join(entering, (F.col("tag") == F.col("e_tag")) & (F.col("r") == F.col("e_r")))
        .withColumn("prev", F.coalesce("prev", "before"))
        .withColumn("next", F.coalesce("next", "after"))
        .withColumn("at", at)
    )
    p, q = F.col("prev"), F.col("next.head")
    between = p.v + (q.v - p.v) * (F.col("at") - p.t) / (q.t - p.t)
    exact = q.t == F.col("at")
    return placed.select(
        F.col("tag").alias(tag),
        (_bound(first, dtype) + micros_interval(F.col("cell") * step)).alias(ts),
        F.when(exact, F.col("next.hit")).when(p.isNotNull() & q.isNotNull(), between).alias(value),
        F.lit("interpolated").alias("source_type"),
    )


def summarize(
    df: DataFrame,
    interval: str,
    functions: Iterable[str] | None = None,
    start=None,
    tag: str = "tag",
    ts: str = "timestamp",
    value: str = "value",
    now: datetime | None = None,
) -> DataFrame:
    """Tumbling windows: one row per tag, window and summary function.

    Windows start at ``start``, else at the first timestamp of the tag. Rows before
    the start fall into windows before it.
    """
    _check(df, tag, ts, value)
    step = span_micros(interval)
    if step <= 0:
        raise PlanError("the interval must be positive")
    dtype = type_of(df, ts)
    rows = df.where(col(ts).isNotNull() & col(tag).isNotNull()).select(
        col(tag).alias("tag"),
        col(ts).alias("ts"),
        to_number(col(value), type_of(df, value)).alias("v"),
    )
    anchor = resolve_time(start, now)
    if anchor is not None:
        origin = _bound_micros(rows, wall_clock(df, anchor), dtype)
    else:
        firsts = rows.groupBy(F.col("tag").alias("first_tag")).agg(F.min("ts").alias("first_ts"))
        # <=> has its own shuffle, without which a hot tag could not be split
        rows = rows.join(firsts, F.col("tag").eqNullSafe(F.col("first_tag")), "inner")
        origin = micros(F.col("first_ts"), dtype)
    into = F.pmod(micros(F.col("ts"), dtype) - origin, F.lit(step))
    width = micros_interval(F.lit(step))
    v = F.col("v")
    one = {
        "average": F.avg(v),
        "min": F.min(v).cast("double"),
        "max": F.max(v).cast("double"),
        "sum": F.coalesce(F.sum(v).cast("double"), F.lit(0.0)),
        "count": F.count(v).cast("double"),
        "std": F.stddev_samp(v.cast("double")),
    }
    chosen = summary_functions(functions)
    windows = (
        rows.withColumn("window_start", F.col("ts") - micros_interval(into))
        .groupBy("tag", "window_start")
        .agg(*(one[f].cast("double").alias(f) for f in chosen))
    )
    entries = [F.struct(F.lit(f).alias("summary"), F.col(f).alias("value")) for f in chosen]
    return windows.select(
        F.col("tag").alias(tag),
        "window_start",
        (F.col("window_start") + width).alias("window_end"),
        F.explode(F.array(*entries)).alias("e"),
    ).select(tag, "window_start", "window_end", "e.*", F.lit("summary").alias("source_type"))


def to_wide(
    df: DataFrame,
    tags: Sequence[str] | None = None,
    index: Sequence[str] | None = None,
    tag: str = "tag",
    value: str = "value",
    order_by: Sequence[str] = (),
) -> DataFrame:
    """One column per tag. Rows and tags without any value do not appear.

    Given ``tags`` make columns as listed; else the tags that have values are looked
    up first, which runs one small aggregation.
    """
    if index is None:
        index = (
            ["timestamp"]
            if "timestamp" in df.columns
            else [n for n in ("window_start", "window_end", "summary") if n in df.columns]
        )
    if not index:
        raise PlanError("no index column: timestamp, or window_start")
    require_columns(df, [*index, tag, value], "series columns")
    order = _ranking(df, order_by, (tag, *index))
    rows = df.where(col(value).isNotNull())
    for name in (*index, tag):
        rows = rows.where(col(name).isNotNull())
    rows = rows.select(
        *(col(n) for n in index),
        col(tag).cast("string").alias("__tag"),
        col(value).alias("__value"),
        order.alias("__order"),
    )
    if tags is None:
        # One name per column of the result.
        tags = sorted(r[0] for r in rows.select("__tag").distinct().collect())
    else:
        rows = rows.where(F.col("__tag").isin(list(tags)))
    if not tags:
        return df.select(*(col(n) for n in index)).limit(0)
    return (
        rows.groupBy(*(col(n) for n in index))
        .pivot("__tag", list(tags))
        .agg(F.min_by("__value", F.col("__order")))
    )


def _of_distinct(rows: DataFrame, name: str, test: Column) -> DataFrame:
    """Rows whose value passes a test that runs once per distinct value, not per row."""
    passing = rows.select(name).distinct().where(test).select(col(name).alias("__passing"))
    return rows.join(passing, col(name).eqNullSafe(F.col("__passing")), "left_semi")


def event_frames(
    df: DataFrame,
    template: str = "",
    start=None,
    end=None,
    analyses: Sequence[str] = (),
    now: datetime | None = None,
) -> DataFrame:
    """Event frames of a template and time range made by one of the analyses.

    Input: event_frame, template, analysis (array of names), element, start_time,
    end_time. A frame without an end passes the upper bound, as does one without a
    template the template test.
    """
    require_columns(
        df,
        ["event_frame", "template", "analysis", "element", "start_time", "end_time"],
        "event frame columns",
    )
    dtype = type_of(df, "start_time")
    begin, finish = F.col("start_time"), F.col("end_time")
    lower, upper = (
        None if moment is None else wall_clock(df, moment)
        for moment in (resolve_time(start, now), resolve_time(end, now))
    )
    rows = df
    if lower is not None:
        rows = rows.where(begin.isNull() | (begin >= _bound(lower, dtype)))
    if upper is not None:
        # an unknown start is not after the bound
        rows = rows.where(
            finish.isNull() | begin.isNull() | (begin <= _bound(upper, dtype))
        )
    wanted = match_key(template)
    if wanted:
        key = F.coalesce(match_key_column("template"), F.lit(""))
        rows = _of_distinct(rows, "template", (key == "") | (key == wanted))
    if any(match_key(a) for a in analyses):
        rows = _of_distinct(rows, "analysis", matches_any_name(match_keys_column("analysis"), analyses))
    end_type = type_of(df, "end_time")
    length = micros(finish, end_type) - micros(begin, dtype)
    return rows.select(
        F.coalesce("event_frame", F.lit("")).alias("event_frame"),
        F.coalesce("template", F.lit("")).alias("template"),
        F.coalesce(F.array_join("analysis", "; "), F.lit("")).alias("analysis"),
        F.coalesce(F.size("analysis"), F.lit(0)).alias("analysis_count"),
        F.coalesce("element", F.lit("")).alias("element"),
        begin.alias("start_time"),
        finish.alias("end_time"),
        (length / MICROS_PER_SECOND).alias("duration_sec"),
        F.lit("event_frame").alias("source_type"),
    )
