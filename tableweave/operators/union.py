"""UNION ALL with a column mapping from the right table to the left one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions.columns import check_names, col, common_type, require_columns

# Fixed values of the mapping format.
KEEP_AS_NEW = "__KEEP_AS_NEW__"
DROP = "__DROP__"
LEFT_SOURCE_VALUE = "current_result"
DEFAULT_SOURCE_COLUMN = "_source_table"
SOURCE_SUFFIX = "_src"


@dataclass(frozen=True)
class UnionLayout:
    """Where each kept right column goes: ``renames`` is {right name: result name}."""

    renames: dict[str, str]
    mapped: int
    kept_new: int
    dropped: int


def free_name(name: str, taken: set[str], suffix: str) -> str:
    """``name`` if free, else with the suffix, then with the suffix and 2, 3, …"""
    if name not in taken:
        return name
    numbered = (name + suffix + (str(n) if n > 1 else "") for n in count(1))
    return next(candidate for candidate in numbered if candidate not in taken)


def union_layout(
    left_columns: Sequence[str],
    right_columns: Sequence[str],
    mapping: Mapping[str, str],
    suffix: str = "_u",
) -> UnionLayout:
    lefts = set(left_columns)
    targets = {
        name: mapping.get(name) or (name if name in lefts else KEEP_AS_NEW)
        for name in right_columns
    }
    mapped: dict[str, str] = {}
    for name, target in targets.items():
        if target in (DROP, KEEP_AS_NEW):
            continue
        if target not in lefts:
            raise PlanError(f"union target is not a left column: {name} -> {target}")
        if target in mapped:
            raise PlanError(f"two right columns map to {target}: {mapped[target]}, {name}")
        mapped[target] = name
    renames, taken = {}, set(lefts)
    for name, target in targets.items():
        if target == DROP:
            continue
        if target == KEEP_AS_NEW:
            target = free_name(name, taken, suffix or "_u")
            taken.add(target)
        renames[name] = target
    dropped = sum(t == DROP for t in targets.values())
    return UnionLayout(renames, len(mapped), len(renames) - len(mapped), dropped)


def union_mapped(
    left: DataFrame,
    right: DataFrame,
    mapping: Mapping[str, str] | None = None,
    suffix: str = "_u",
    source_column: str | None = None,
    source_value: str = "right",
) -> DataFrame:
    """All rows of both tables. Two types meet in the wider one, or in text."""
    mapping = dict(mapping or {})
    require_columns(right, mapping, "mapped columns in the right table")
    layout = union_layout(left.columns, right.columns, mapping, suffix)

    names = list(left.columns)
    names += [n for n in layout.renames.values() if n not in left.columns]
    label = None
    if source_column:
        label = free_name(source_column, set(names), SOURCE_SUFFIX)
        names.insert(len(left.columns), label)
    check_names(left, names, "union result")

    origin = {target: name for name, target in layout.renames.items()}
    left_out, right_out = [], []
    for name in names:
        if name == label:
            left_out.append(F.lit(LEFT_SOURCE_VALUE).alias(name))
            right_out.append(F.lit(source_value).alias(name))
            continue
        left_type = left.schema[name].dataType if name in left.columns else None
        right_type = right.schema[origin[name]].dataType if name in origin else None
        target = common_type(left_type or right_type, right_type or left_type)
        empty = F.lit(None).cast(target)
        left_value = col(name).cast(target) if left_type is not None else empty
        right_value = col(origin[name]).cast(target) if right_type is not None else empty
        left_out.append(left_value.alias(name))
        right_out.append(right_value.alias(name))
    return left.select(*left_out).unionAll(right.select(*right_out))
