"""Column helpers shared by the operators: quoting, type families, parsing, sizes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError

# A decimal or scientific number with optional blanks around it. The guard is
# needed because a Spark cast also takes '1d' and '1f'.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY_PATTERN = r"(?i)^\s*[+-]?inf(inity)?\s*$"

# Datetime forms beside ISO, tried in this order: the shape of a text and its
# pattern. The shape test keeps texts that are no datetimes away from the parser,
# which is slow to refuse them.
DATETIME_FORMS = (
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "y/M/d H:m:s"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}$", "y/M/d H:m"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "M/d/y H:m:s"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$", "M/d/y H:m"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
    (r"^\d{14}$", "yyyyMMddHHmmss"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM y"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, y"),
)
ISO_SHAPE = r"^\d{4}(-\d|$)"

MICROS_PER_SECOND = 1_000_000
_EPOCH_NTZ = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by exact name; names may hold dots and backticks."""
    return F.col(quote(name))


def require_columns(df: DataFrame, names: Iterable[str], what: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise PlanError(f"{what} not found: {', '.join(missing)}")


def check_names(df: DataFrame, names: Sequence[str], what: str) -> None:
    """Reject names Spark could not tell apart."""
    exact = list(names)
    if len(set(exact)) != len(exact):
        double = sorted({n for n in exact if exact.count(n) > 1})
        raise PlanError(f"{what}: duplicate column names: {', '.join(double)}")
    if df.sparkSession.conf.get("spark.sql.caseSensitive", "false").lower() == "true":
        return
    folded = [n.lower() for n in exact]
    double = sorted({n for n in exact if folded.count(n.lower()) > 1})
    if double:
        raise PlanError(
            f"{what}: column names differ only in case: {', '.join(double)}; "
            "rename them or set spark.sql.caseSensitive"
        )


# ---------------------------------------------------------------- type families


def family(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NullType):
        return "null"
    return dtype.typeName()


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return orderable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(orderable(f.dataType) for f in dtype.fields)
    return not isinstance(dtype, (T.MapType, T.VariantType))


_INTEGER_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 20}


def common_type(left: T.DataType, right: T.DataType) -> T.DataType:
    """One type both columns fit: equal, the wider number or datetime, else text."""
    if left == right or isinstance(right, T.NullType):
        return left
    if isinstance(left, T.NullType):
        return right
    families = {family(left), family(right)}
    if families == {"number"}:
        return _wider_number(left, right)
    if families == {"datetime"}:
        if T.TimestampType() in (left, right):
            return T.TimestampType()
        return T.TimestampNTZType()
    return T.StringType()


def _wider_number(left: T.DataType, right: T.DataType) -> T.DataType:
    if isinstance(left, T.DecimalType) or isinstance(right, T.DecimalType):
        if isinstance(left, T.FractionalType) != isinstance(right, T.FractionalType) or (
            isinstance(left, T.DecimalType) and isinstance(right, T.DecimalType)
        ):
            whole, scale = 0, 0
            for dtype in (left, right):
                if isinstance(dtype, T.DecimalType):
                    whole = max(whole, dtype.precision - dtype.scale)
                    scale = max(scale, dtype.scale)
                else:
                    whole = max(whole, _INTEGER_DIGITS[dtype.simpleString()])
            if whole + scale <= 38:
                return T.DecimalType(whole + scale, scale)
        return T.DoubleType()
    if isinstance(left, T.FractionalType) or isinstance(right, T.FractionalType):
        return T.DoubleType()
    return max((left, right), key=lambda t: _INTEGER_DIGITS[t.simpleString()])


# -------------------------------------------------------------------- conversion


def nan_to_null(value: Column, dtype: T.DataType) -> Column:
    """NaN counts as missing everywhere in this package."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value)
    return value


def to_number(value: Column, dtype: T.DataType) -> Column:
    """Numeric value of a column; what does not parse becomes null."""
    kind = family(dtype)
    if kind == "number":
        return nan_to_null(value, dtype)
    if kind == "boolean":
        return value.cast("double")
    if kind == "string":
        text = F.trim(F.regexp_replace(value, r"[\t\r\n]", " "))
        return (
            F.when(value.rlike(NUMBER_PATTERN), text.try_cast("double"))
            .when(
                value.rlike(INFINITY_PATTERN),
                F.when(text.startswith("-"), float("-inf")).otherwise(float("inf")),
            )
        )
    return F.lit(None).cast("double")


def is_number_text(value: Column) -> Column:
    """Whether to_number gives a number for a text."""
    return value.rlike(NUMBER_PATTERN) | value.rlike(INFINITY_PATTERN)


def to_datetime(value: Column, dtype: T.DataType) -> Column:
    """Timestamp of a column; what does not parse becomes null."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return value
    if isinstance(dtype, T.DateType):
        return value.cast("timestamp")
    if family(dtype) != "string":
        return F.lit(None).cast("timestamp")
    text = F.trim(value)
    parsed = F.when(text.rlike(ISO_SHAPE), text.try_cast("timestamp"))
    for shape, pattern in DATETIME_FORMS:
        parsed = parsed.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)))
    any_shape = "|".join(f"(?:{shape})" for shape in (ISO_SHAPE, *(s for s, _ in DATETIME_FORMS)))
    return F.when(text.rlike(any_shape), parsed)


def micros(value: Column, dtype: T.DataType) -> Column:
    """Microseconds since the epoch as a long, free of session time zone rules."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(dtype, T.DateType):
        return F.unix_date(value).cast("long") * F.lit(86_400 * MICROS_PER_SECOND)
    if isinstance(dtype, T.TimestampNTZType):
        gap = value - F.expr(_EPOCH_NTZ)
        part = lambda name: F.extract(F.lit(name), gap).cast("long")
        seconds = F.extract(F.lit("SECOND"), gap) * F.lit(MICROS_PER_SECOND)
        return (
            (part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")
        ) * F.lit(60 * MICROS_PER_SECOND) + seconds.cast("long")
    raise PlanError(f"not a datetime column: {dtype.simpleString()}")


def micros_interval(value: Column) -> Column:
    """Day-time interval of a long number of microseconds."""
    seconds = (value.cast("decimal(20,0)") / F.lit(MICROS_PER_SECOND)).cast("decimal(18,6)")
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


# -------------------------------------------------------------------------- size


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of a DataFrame, None where it cannot be read."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # a Spark Connect session has no local plan
        return None
