"""Equal rows, counted once and dealt out again to many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COPIES = 1_000  # copies of equal rows that one task numbers


def row_hash(rows: DataFrame) -> Column:
    """64 bits that tell rows apart that differ in any column; equal rows stand for each other."""
    columns = []
    for field in rows.schema.fields:
        column, kind = F.col("`" + field.name.replace("`", "``") + "`"), field.dataType.simpleString()
        columns.append(column.cast("string") if "map<" in kind or "variant" in kind else column)
    return F.xxhash64(F.lit("row"), *columns)


def numbered_copies(units: DataFrame, key: Sequence[str]) -> DataFrame:
    """A row per copy of each unit (``copies`` of them), numbered from 0 in ``copy``.

    No window numbers equal rows: many copies are dealt to many tasks by ``key`` and lot.
    """
    few, many = F.col("copies") <= COPIES, F.col("copies") > COPIES
    lots = units.where(many).select("*", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")).alias("lot"))
    lots = lots.repartition(*key, "lot").select(
        "*", F.explode(F.expr(f"sequence(lot * {COPIES}, least((lot + 1) * {COPIES}, copies) - 1)")).alias("copy")
    )
    single = units.where(few).select("*", F.explode(F.expr("sequence(0L, copies - 1)")).alias("copy"))
    return single.unionAll(lots.drop("lot")).drop("copies")
