"""Arithmetic formulas over aggregate values, turned into one Column."""

from __future__ import annotations

import ast
import operator
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PlanError

_PLAIN = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul}


def formula_column(text: str, names: Mapping[str, Column], label: str) -> Column:
    """Build the Column of ``text``; every name in it must be a key of ``names``."""
    if not text.strip():
        raise PlanError(f"{label}: the formula is empty")
    try:
        root = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as exc:
        raise PlanError(f"{label}: cannot read the formula {text!r}") from exc
    return _column(root, names, label)


def _column(node: ast.expr, names: Mapping[str, Column], label: str) -> Column:
    match node:
        case ast.Constant(value=bool()):
            pass
        case ast.Constant(value=int() | float() as number):
            return F.lit(float(number))
        case ast.Name(id=name):
            if name in names:
                return names[name]
            raise PlanError(f"{label}: unknown name {name!r} in the formula")
        case ast.UnaryOp(op=ast.UAdd(), operand=inner):
            return _column(inner, names, label)
        case ast.UnaryOp(op=ast.USub(), operand=inner):
            return -_column(inner, names, label)
        case ast.BinOp(left=left, op=ast.Div(), right=right):
            over, under = _column(left, names, label), _column(right, names, label)
            stop = F.raise_error(F.lit(f"{label}: division by zero in the formula"))
            return F.when(under == 0, stop.cast("double")).otherwise(over / under)
        case ast.BinOp(left=left, op=op, right=right) if type(op) in _PLAIN:
            return _PLAIN[type(op)](_column(left, names, label), _column(right, names, label))
    raise PlanError(f"{label}: the formula may only use numbers, names, + - * / and ()")
