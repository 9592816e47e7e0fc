"""Table preparation: names, projection and type overrides, in that order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..errors import PlanError
from ..functions.columns import col, require_columns, to_datetime, to_number
from ..functions.names import normalize_columns

SIMPLE_TYPES = ("auto", "string", "number", "datetime")


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the listed columns in the listed order; no list keeps all."""
    if not columns:
        return df
    require_columns(df, columns, "selected columns")
    return df.select(*(col(n) for n in columns))


def override_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast columns; a value that does not parse becomes null. Columns the table
    does not have are left alone."""
    wanted = {n: t for n, t in types.items() if n in df.columns and t not in ("", "auto")}
    for name, kind in wanted.items():
        if kind not in SIMPLE_TYPES:
            raise PlanError(f"unknown type {kind} for column {name}")

    def value(field):
        kind = wanted.get(field.name)
        if kind == "string":
            return col(field.name).cast("string").alias(field.name)
        if kind == "number":
            return to_number(col(field.name), field.dataType).alias(field.name)
        if kind == "datetime":
            return to_datetime(col(field.name), field.dataType).alias(field.name)
        return col(field.name)

    return df.select(*(value(f) for f in df.schema.fields)) if wanted else df


def prepare(
    df: DataFrame,
    normalize: bool = True,
    columns: Sequence[str] = (),
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """Normalize names, then project, then cast."""
    if normalize:
        df = normalize_columns(df)
    return override_types(project(df, columns), types or {})
