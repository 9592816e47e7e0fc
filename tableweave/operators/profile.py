"""Column profiles and coarse type inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, family, is_number_text, micros, nan_to_null, to_datetime

INFER_SHARE = 0.9
# Longer values are compared by their SHA-256, which keeps shuffled rows short.
LONG_VALUE = 64
# A value in one of three typed columns, which spares numbers the way through text,
# and whether a long text is a number (it cannot be a datetime).
ITEM_TYPES = {
    "whole": "bigint", "real": "double", "text": "string", "long_number": "boolean",
}


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: inferred type, nulls, share of nulls and distinct non-null values.

    Exact mode counts (column, value) pairs with a map-side stage, so frequent
    values travel once per task. ``approx`` counts distinct values with a sketch
    in a single pass without that shuffle.
    """
    if approx:
        return _approx_profile(df)
    fields = df.schema.fields
    pairs = _unpivot(df, [F.struct(F.lit(i).alias("pos"), *_item(f)) for i, f in enumerate(fields)])
    # Every column appears, also when the table has no rows.
    zero = df.sparkSession.range(len(fields)).select(
        F.col("id").cast("int").alias("pos"),
        *(F.lit(None).cast(t).alias(n) for n, t in ITEM_TYPES.items()),
        F.lit(0).cast("long").alias("n"),
    )
    items = pairs.groupBy("pos", *ITEM_TYPES).agg(F.count(F.lit(1)).alias("n")).unionAll(zero)

    # A text is parsed once per distinct value.
    texts = [i for i, f in enumerate(fields) if family(f.dataType) == "string"]
    is_text = F.col("pos").isin(texts) if texts else F.lit(False)
    parsed = _parse_flags(T.StructField("text", T.StringType()))
    number = F.coalesce("long_number", is_text & parsed["is_number"])
    datetime = F.col("long_number").isNull() & is_text & parsed["is_datetime"]
    filled = F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull()
    rows = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    per_column = items.groupBy("pos").agg(
        F.sum("n").alias("rows"),
        rows(filled).alias("filled"),
        F.count_if(filled).alias("nunique_preview"),
        rows(filled & number).alias("numbers"),
        rows(filled & datetime).alias("datetimes"),
    )
    return _finish(df, per_column)


def _approx_profile(df: DataFrame) -> DataFrame:
    figures = []
    for i, field in enumerate(df.schema.fields):
        value = nan_to_null(col(field.name), field.dataType)
        flags = _parse_flags(field)
        figures.append(F.struct(
            F.lit(i).alias("pos"),
            F.count(F.lit(1)).alias("rows"),
            F.count(value).alias("filled"),
            F.coalesce(*(F.nullif(F.approx_count_distinct(c), F.lit(0)) for c in _item(field)[:3]),
                       F.lit(0).cast("long")).alias("nunique_preview"),
            F.count_if(flags["is_number"] & value.isNotNull()).alias("numbers"),
            F.count_if(flags["is_datetime"] & value.isNotNull()).alias("datetimes"),
        ))
    one = df.agg(F.array(*figures).alias("all"))
    return _finish(df, one.select(F.explode("all").alias("c")).select("c.*"))


def infer_types(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Inferred type per column, from all rows, or from the first ``rows`` for a look."""
    source = df if rows is None else df.limit(rows)
    flags = []
    for i, field in enumerate(source.schema.fields):
        parse = _parse_flags(field)
        flags.append(F.struct(
            F.lit(i).alias("pos"),
            F.count(F.lit(1)).alias("rows"),
            F.count(col(field.name)).alias("filled"),
            F.lit(0).cast("long").alias("nunique_preview"),
            F.count_if(parse["is_number"] & col(field.name).isNotNull()).alias("numbers"),
            F.count_if(parse["is_datetime"] & col(field.name).isNotNull()).alias("datetimes"),
        ))
    one = source.agg(F.array(*flags).alias("all"))
    figures = one.select(F.explode("all").alias("c")).select("c.*")
    return _finish(df, figures).select("column", "inferred_type")


def _unpivot(df: DataFrame, entries: list[Column]) -> DataFrame:
    return df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def _item(field: T.StructField) -> list[Column]:
    """The value of a column as an item: equal items are equal values."""
    value = nan_to_null(col(field.name), field.dataType)
    kind = family(field.dataType)
    found: dict[str, Column] = {}
    if isinstance(field.dataType, (T.IntegralType, T.BooleanType)):
        found["whole"] = value
    elif kind == "datetime":
        found["whole"] = micros(value, field.dataType)
    elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        found["real"] = value
    else:
        found["text"] = _short_text(value, field.dataType)
        if kind == "string":
            found["long_number"] = F.when(_is_long(value), is_number_text(value))
    return [found.get(n, F.lit(None)).cast(t).alias(n) for n, t in ITEM_TYPES.items()]


def _short_text(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BinaryType):
        return F.sha2(value, 256)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        value = F.to_json(value)
    text = value.cast("string")
    return F.when(_is_long(text), F.sha2(text, 256)).otherwise(text)


def _is_long(text: Column) -> Column:
    return F.length(F.trim(text)) > LONG_VALUE


def _parse_flags(field: T.StructField) -> dict[str, Column]:
    """Whether a text value parses as a number or a datetime; typed columns need no test."""
    if family(field.dataType) != "string":
        return {"is_number": F.lit(False), "is_datetime": F.lit(False)}
    text = col(field.name)
    return {
        "is_number": is_number_text(text),
        "is_datetime": to_datetime(F.when(~_is_long(text), text), field.dataType).isNotNull(),
    }


def _finish(df: DataFrame, figures: DataFrame) -> DataFrame:
    known = {"number": "number", "boolean": "number", "datetime": "datetime"}
    names = F.array(*(F.lit(n) for n in df.columns))
    types = F.array(*(
        F.lit(known.get(family(f.dataType), None)).cast("string") for f in df.schema.fields
    ))
    pos = F.col("pos") + 1
    inferred = (
        F.when(F.element_at(types, pos).isNotNull(), F.element_at(types, pos))
        .when((F.col("filled") > 0) & (F.col("numbers") >= INFER_SHARE * F.col("filled")), "number")
        .when((F.col("filled") > 0) & (F.col("datetimes") >= INFER_SHARE * F.col("filled")), "datetime")
        .otherwise("string")
    )
    nulls = F.col("rows") - F.col("filled")
    return figures.select(
        F.element_at(names, pos).alias("column"),
        inferred.alias("inferred_type"),
        nulls.alias("null_count"),
        F.coalesce(F.try_divide(nulls.cast("double"), F.col("rows")), F.lit(0.0)).alias("null_ratio"),
        F.col("nunique_preview"),
    )
