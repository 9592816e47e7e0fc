"""Name rules: normalization, comparison keys and name lists typed by users."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError
from .columns import check_names

# Characters that separate names in a typed list, and the yen sign
# that stands for a backslash on Japanese keyboards.
LIST_SEPARATORS = "\n\r\t,;、，；"
YEN_SIGNS = "¥￥"


def clean_column_name(name: object) -> str:
    return unicodedata.normalize("NFKC", "" if name is None else str(name)).strip()


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename every column to its NFKC form without outer blanks."""
    names = [clean_column_name(n) for n in df.columns]
    check_names(df, names, "after normalization")
    return df.toDF(*names)


def header_names(cells: Iterable[str | None]) -> list[str]:
    """Unique column names of a header row: a, a.1, a.2, …; blank cells get a name."""
    names: list[str] = []
    for i, cell in enumerate(cells):
        base = cell or f"Unnamed: {i}"
        tries = (base if n == 0 else f"{base}.{n}" for n in count())
        names.append(next(t for t in tries if t not in names))
    return names


def clean_text(value: object) -> str:
    text = unicodedata.normalize("NFKC", "" if value is None else str(value))
    for sign in YEN_SIGNS:
        text = text.replace(sign, "\\")
    return text.strip()


def match_key(value: object) -> str:
    return clean_text(value).casefold()


def parse_name_list(text: str | None) -> tuple[str, ...]:
    """Names of a typed list, without repeats; the first spelling of a name stays."""
    found: dict[str, str] = {}
    for part in re.split(f"[{LIST_SEPARATORS}]", clean_text(text)):
        name = clean_text(part)
        if name:
            found.setdefault(name.casefold(), name)
    return tuple(found.values())


@F.pandas_udf(T.StringType())
def match_key_column(names: pd.Series) -> pd.Series:
    """match_key for a string column (Spark has no NFKC function)."""
    return names.map(match_key, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def match_keys_column(lists: pd.Series) -> pd.Series:
    """match_key for every element of an array column, blank ones left out."""
    return lists.map(
        lambda names: [k for k in map(match_key, names) if k], na_action="ignore"
    )


def matches_any_name(available_keys: Column, required: Iterable[str]) -> Column:
    """Any wanted name inside any available one, or the other way round."""
    wanted = [k for k in map(match_key, required) if k]
    if not wanted:
        return F.lit(True)

    def hit(name: Column) -> Column:
        tests = [name.contains(w) | F.lit(w).contains(name) for w in wanted]
        return F.greatest(*tests) if len(tests) > 1 else tests[0]

    return F.coalesce(F.exists(available_keys, hit), F.lit(False))


def require_names(names: tuple[str, ...], what: str) -> tuple[str, ...]:
    if not names:
        raise PlanError(f"at least one {what} is needed")
    return names
