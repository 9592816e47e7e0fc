"""Column layout of a join result: shared keys, suffixes and conflict rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions.columns import check_names, common_type

CONFLICT_POLICIES = ("keep_both", "left_prefer", "right_prefer")


@dataclass(frozen=True)
class OutputColumn:
    """One result column; an index is None where that side gives no value."""

    name: str
    left: int | None
    right: int | None
    kind: str  # "key", "side", "left_prefer" or "right_prefer"


@dataclass(frozen=True)
class JoinLayout:
    """Both inputs under positional names (l0, l1, …, r0, r1, …) and the result columns."""

    left: DataFrame
    right: DataFrame
    columns: tuple[OutputColumn, ...]
    left_names: tuple[str, ...]
    right_names: tuple[str, ...]

    def l(self, name: str) -> str:
        return f"l{self.left_names.index(name)}"

    def r(self, name: str) -> str:
        return f"r{self.right_names.index(name)}"

    def select(self, keys: str) -> list[Column]:
        """Result columns; ``keys`` says where a shared key comes from: left, right or both."""
        out = []
        for item in self.columns:
            left = None if item.left is None else F.col(f"l{item.left}")
            right = None if item.right is None else F.col(f"r{item.right}")
            if item.kind == "key":
                value = {"left": left, "right": right, "both": F.coalesce(left, right)}[keys]
            elif item.kind in ("left_prefer", "right_prefer"):
                target = common_type(
                    self.left.schema[item.left].dataType, self.right.schema[item.right].dataType
                )
                pair = (left.cast(target), right.cast(target))
                value = F.coalesce(*(pair if item.kind == "left_prefer" else pair[::-1]))
            else:
                value = left if right is None else right
            out.append(value.alias(item.name))
        return out


def join_layout(
    left: DataFrame,
    right: DataFrame,
    pairs: Sequence[tuple[str, str]],
    suffixes: Sequence[str],
    conflict: str,
) -> JoinLayout:
    """Lay out the result of joining on ``pairs`` of (left, right) key names."""
    if conflict not in CONFLICT_POLICIES:
        raise PlanError(f"unknown conflict policy: {conflict}")
    if len(suffixes) != 2:
        raise PlanError("suffixes must be a pair")
    lefts, rights = list(left.columns), list(right.columns)
    check_names(left, lefts, "left table")
    check_names(right, rights, "right table")

    shared = {a for a, b in pairs if a == b}
    keys = {name for pair in pairs for name in pair}
    overlap = (set(lefts) & set(rights)) - shared
    if overlap and not (suffixes[0] or suffixes[1]):
        raise PlanError(f"columns overlap but no suffix is given: {', '.join(sorted(overlap))}")
    merged = set() if conflict == "keep_both" else {n for n in overlap if n not in keys}

    columns = []
    for i, name in enumerate(lefts):
        if name in shared:
            columns.append(OutputColumn(name, i, rights.index(name), "key"))
        elif name in merged:
            columns.append(OutputColumn(name, i, rights.index(name), conflict))
        else:
            shown = name + suffixes[0] if name in overlap else name
            columns.append(OutputColumn(shown, i, None, "side"))
    for j, name in enumerate(rights):
        if name not in shared and name not in merged:
            shown = name + suffixes[1] if name in overlap else name
            columns.append(OutputColumn(shown, None, j, "side"))
    check_names(left, [c.name for c in columns], "join result")
    return JoinLayout(
        left=left.toDF(*(f"l{i}" for i in range(len(lefts)))),
        right=right.toDF(*(f"r{j}" for j in range(len(rights)))),
        columns=tuple(columns),
        left_names=tuple(lefts),
        right_names=tuple(rights),
    )
