"""Quality reports: one row of counts, rates and warnings per step."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import col
from .asof import AsofMatches
from .equi import KeyDirectory, check_keys, key_directory
from .union import UnionLayout

DEFAULT_GROWTH_LIMIT = 10.0

# Warning codes.
MANY_TO_MANY = "many_to_many"
ROW_GROWTH = "row_growth"
UNION_ALWAYS_MATCHES = "union_always_matches"

# Names and types of the report's fields.
REPORT_SCHEMA = T.StructType([
    T.StructField("step_id", T.StringType()),
    T.StructField("join_type", T.StringType()),
    T.StructField("left_rows", T.LongType()),
    T.StructField("right_rows", T.LongType()),
    T.StructField("output_rows", T.LongType()),
    T.StructField("matched_left_rows", T.LongType()),
    T.StructField("unmatched_left_rows", T.LongType()),
    T.StructField("matched_right_rows", T.LongType()),
    T.StructField("unmatched_right_rows", T.LongType()),
    T.StructField("left_match_rate", T.DoubleType()),
    T.StructField("right_match_rate", T.DoubleType()),
    T.StructField("left_duplicate_key_rows", T.LongType()),
    T.StructField("right_duplicate_key_rows", T.LongType()),
    T.StructField("many_to_many_suspected", T.BooleanType()),
    T.StructField("row_growth_ratio_vs_left", T.DoubleType()),
    T.StructField("operation", T.StringType()),
    T.StructField("algorithm", T.StringType()),
    T.StructField("warnings", T.ArrayType(T.StringType())),
    T.StructField("details", T.StringType()),
])


def equi_report(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str],
    how: str = "left",
    growth_limit: float = DEFAULT_GROWTH_LIMIT,
    step_id: str = "",
    details: Mapping[str, object] | None = None,
    directory: KeyDirectory | None = None,
) -> DataFrame:
    """Report of an equi join, without running the join.

    Both tables are counted per key in one aggregation (grouping treats null as a
    value, as the join does), unless the step's ``directory`` has the counts; every figure
    is a sum over them. A hot key is combined on the map side.
    """
    check_keys(left, right, left_keys, right_keys)
    counts = (directory or key_directory(left, right, left_keys, right_keys)).rows
    lc, rc = F.col("left_count"), F.col("right_count")
    pairs = F.coalesce(F.sum(lc.cast("decimal(19,0)") * rc.cast("decimal(19,0)")), F.lit(0))

    def total(value: Column, where: Column | None = None) -> Column:
        return F.coalesce(F.sum(value if where is None else F.when(where, value)), F.lit(0))

    figures = counts.agg(
        total(lc).alias("left_rows"),
        total(rc).alias("right_rows"),
        pairs.alias("pairs"),
        total(lc, rc > 0).alias("matched_left_rows"),
        total(rc, lc > 0).alias("matched_right_rows"),
        total(lc, lc > 1).alias("left_duplicate_key_rows"),
        total(rc, rc > 1).alias("right_duplicate_key_rows"),
    )
    output = F.col("pairs")
    if how in ("left", "outer"):
        output = output + F.col("left_rows") - F.col("matched_left_rows")
    if how in ("right", "outer"):
        output = output + F.col("right_rows") - F.col("matched_right_rows")
    return _finish(
        figures.withColumn("output_rows", output.cast("long")),
        step_id, how, "join", "equi", growth_limit, details,
    )


def with_row_counts(report: DataFrame, before: DataFrame) -> DataFrame:
    """The report of a step on a pre-aggregated right table, with the rows before and after
    in its details: ``before`` is counted in the report's own job."""
    counted = _one_row(report, before.agg(F.count(F.lit(1)).alias("__before")))
    # Details end with the braces of the aggregation and of themselves.
    rows = F.format_string(', "input_rows": %d, "output_rows": %d}}', F.col("__before"), F.col("right_rows"))
    details = F.concat(F.regexp_replace("details", r"\}\}$", ""), rows)
    return counted.withColumn("details", details).select(*(f.name for f in REPORT_SCHEMA.fields))


def asof_report(
    left: DataFrame,
    right: DataFrame,
    found: AsofMatches,
    direction: str,
    tolerance: str | float | None = None,
    growth_limit: float = DEFAULT_GROWTH_LIMIT,
    step_id: str = "",
) -> DataFrame:
    """Report of an as-of join from its matches."""
    used = F.struct(*found.by_names, F.col("hit.k"), F.col("hit.which"))
    matched = found.rows.agg(
        F.count(F.lit(1)).alias("left_rows"),
        F.count("hit").alias("matched_left_rows"),
        F.countDistinct(F.when(F.col("hit").isNotNull(), used)).alias("matched_right_rows"),
    )
    figures = _one_row(matched, right.agg(F.count(F.lit(1)).alias("right_rows")))
    figures = figures.withColumns({
        "output_rows": F.col("left_rows"),
        "left_duplicate_key_rows": F.lit(0).cast("long"),
        "right_duplicate_key_rows": F.lit(0).cast("long"),
    })
    details = {"direction": direction, "tolerance": "" if tolerance is None else str(tolerance)}
    return _finish(figures, step_id, "left", "join", "asof", growth_limit, details)


def asof_unmatched_left(found: AsofMatches) -> DataFrame:
    rows = found.rows.where(F.col("hit").isNull()).select(*found.layout.left.columns)
    return rows.toDF(*found.layout.left_names)


def asof_unmatched_right(found: AsofMatches) -> DataFrame:
    """Right rows never used. Equal rows count one by one, as in EXCEPT ALL.

    A key names its row where it has only one. Of several, those that equal the used first
    or last one are told apart by the columns that have an order (maps travel along) and
    numbered, and one of them goes; no other rows pass through a window.
    """
    bys, hit = found.by_names, found.rows.where(F.col("hit").isNotNull())
    which, ordered = F.col("hit.which"), F.col("hit.v.o")
    used = hit.groupBy(*(F.col(b).alias(f"u_{b}") for b in bys), F.col("hit.k").alias("u_k")).agg(
        F.max(which == 0).alias("only"),
        F.max(F.when(which == 1, ordered)).alias("first"), F.max(F.when(which == 2, ordered)).alias("last"),
    )
    same = reduce(and_, (F.col(b).eqNullSafe(F.col(f"u_{b}")) for b in bys), F.col("k").eqNullSafe(F.col("u_k")))
    rows = found.right.join(used, same, "left").where(F.col("u_k").isNull() | ~F.col("only"))
    # How many rows equal to this one are used.
    uses = sum((F.col("v.o").eqNullSafe(F.col(c)) & F.col(c).isNotNull()).cast("int") for c in ("first", "last"))
    rows = rows.withColumn("uses", F.when(F.col("u_k").isNull(), 0).otherwise(uses))
    kept = rows.where(F.col("uses") == 0)
    equal = Window.partitionBy(*bys, "k", "v.o").orderBy("uses")
    some = rows.where(F.col("uses") > 0).withColumn("n", F.row_number().over(equal)).where(F.col("n") > F.col("uses"))
    unused = kept.unionAll(some.drop("n")).select(*found.right_row("v"))
    return unused.toDF(*found.layout.right_names)


def union_report(
    left: DataFrame,
    right: DataFrame,
    layout: UnionLayout,
    growth_limit: float = DEFAULT_GROWTH_LIMIT,
    step_id: str = "",
) -> DataFrame:
    """Report of a union: every row counts as matched."""
    count = F.count(F.lit(1))
    figures = _one_row(left.agg(count.alias("left_rows")), right.agg(count.alias("right_rows")))
    figures = figures.withColumns({
        "output_rows": F.col("left_rows") + F.col("right_rows"),
        "matched_left_rows": F.col("left_rows"),
        "matched_right_rows": F.col("right_rows"),
        "left_duplicate_key_rows": F.lit(0).cast("long"),
        "right_duplicate_key_rows": F.lit(0).cast("long"),
    })
    details = {
        "mapped_columns": layout.mapped,
        "kept_new_columns": layout.kept_new,
        "dropped_columns": layout.dropped,
    }
    return _finish(figures, step_id, "union", "union", "union", growth_limit, details)


def empty_extract(df: DataFrame) -> DataFrame:
    """No rows, same schema: a union leaves nothing unmatched."""
    return df.limit(0)


def _one_row(*singles: DataFrame) -> DataFrame:
    """Columns of several one-row tables side by side."""
    names = [n for df in singles for n in df.columns]
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), singles
    )
    return stacked.agg(*(F.max(n).alias(n) for n in names))


def _finish(
    figures: DataFrame, step_id: str, join_type: str, operation: str, algorithm: str,
    growth_limit: float, details: Mapping[str, object] | None,
) -> DataFrame:
    c = F.col
    suspected = (
        (c("left_duplicate_key_rows") > 0)
        & (c("right_duplicate_key_rows") > 0)
        & (c("output_rows") > F.greatest("left_rows", "right_rows"))
    )
    growth = F.try_divide(c("output_rows").cast("double"), c("left_rows").cast("double"))
    warnings = F.array_compact(F.array(
        F.when(F.lit(operation == "union"), F.lit(UNION_ALWAYS_MATCHES)),
        F.when(suspected, F.lit(MANY_TO_MANY)),
        F.when(growth > growth_limit, F.lit(ROW_GROWTH)),
    ))
    values = {
        "step_id": F.lit(step_id),
        "join_type": F.lit(join_type),
        "unmatched_left_rows": c("left_rows") - c("matched_left_rows"),
        "unmatched_right_rows": c("right_rows") - c("matched_right_rows"),
        "left_match_rate": F.try_divide(c("matched_left_rows").cast("double"), c("left_rows")),
        "right_match_rate": F.try_divide(c("matched_right_rows").cast("double"), c("right_rows")),
        "many_to_many_suspected": suspected,
        "row_growth_ratio_vs_left": growth,
        "operation": F.lit(operation),
        "algorithm": F.lit(algorithm),
        "warnings": warnings,
        "details": F.lit(json.dumps(details or {}, ensure_ascii=False, sort_keys=True)),
    }
    return figures.select(*(
        values.get(f.name, c(f.name)).cast(f.dataType).alias(f.name) for f in REPORT_SCHEMA.fields
    ))
