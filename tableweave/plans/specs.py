"""Tables, steps, plans and recipes as data, with their JSON form."""

from __future__ import annotations

import dataclasses
import json
import types
import typing
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from ..errors import PlanError
from ..operators.asof import DIRECTIONS
from ..operators.equi import JOIN_TYPES
from ..operators.layout import CONFLICT_POLICIES
from ..operators.preagg import METHODS, NEEDS_WEIGHT, normalize_rules
from ..operators.prepare import SIMPLE_TYPES
from ..operators.quality import DEFAULT_GROWTH_LIMIT
from ..sources.csvfiles import CsvOptions

RECIPE_VERSION = "1.0"

# Fixed values of the recipe format.
FILE_KINDS = ("csv", "excel")
SQL_KIND = "sql"
SERIES_KINDS = ("pi_da_tag", "af_attribute", "af_event_frame")
SOURCE_KINDS = (*FILE_KINDS, SQL_KIND, *SERIES_KINDS)
OPERATIONS = ("join", "union")
ALGORITHMS = ("equi", "asof")


@dataclass(frozen=True)
class WorkbookOptions:
    sheet_name: str | None = None
    header_row: int = 1


# Field names and defaults of the next four classes are those of the
# JSON recipe format.


@dataclass(frozen=True)
class TableSpec:
    table_id: str
    table_name: str = ""
    source_file_name: str = ""
    source_kind: str = "csv"
    file_hash: str | None = None
    csv_options: CsvOptions = CsvOptions()
    excel_options: WorkbookOptions = WorkbookOptions()
    source_options: dict[str, Any] = field(default_factory=dict)
    normalize_columns: bool = True
    selected_columns: tuple[str, ...] = ()
    dtype_overrides: dict[str, str] = field(default_factory=dict)

    def check(self) -> None:
        if self.source_kind not in SOURCE_KINDS:
            raise PlanError(f"{self.table_id}: unknown source kind {self.source_kind}")
        for name, kind in self.dtype_overrides.items():
            if kind and kind not in SIMPLE_TYPES:
                raise PlanError(f"{self.table_id}: unknown type {kind} for column {name}")


@dataclass(frozen=True)
class StepSpec:
    """One step: the result so far joined or united with a right table.

    ``right_pre_agg_order_by`` and ``asof_order_by`` say what "first", "last" and
    the order of equal as-of keys mean; recipes without them stay readable.
    """

    step_id: str
    right_table_id: str = ""
    operation: str = "join"
    join_algorithm: str = "equi"
    join_type: str = "left"
    left_keys: tuple[str, ...] = ()
    right_keys: tuple[str, ...] = ()
    left_by_keys: tuple[str, ...] = ()
    right_by_keys: tuple[str, ...] = ()
    asof_direction: str = "backward"
    asof_tolerance: str | None = None
    asof_allow_exact_matches: bool = True
    asof_order_by: tuple[str, ...] = ()
    conflict_policy: str = "keep_both"
    suffixes: tuple[str, ...] = ("_l", "_r")
    right_pre_agg_enabled: bool = False
    right_pre_agg_group_keys: tuple[str, ...] = ()
    right_pre_agg_weight_col: str = ""
    right_pre_agg_rules: dict[str, Any] = field(default_factory=dict)
    right_pre_agg_order_by: tuple[str, ...] = ()
    union_column_mapping: dict[str, str] = field(default_factory=dict)
    union_right_column_suffix: str = "_u"
    union_add_source_column: bool = False
    union_source_column_name: str = "_source_table"
    union_source_value: str = ""

    def check(self) -> None:
        """Everything that can be said without looking at a table."""
        if not self.right_table_id:
            raise PlanError(f"{self.step_id}: no right table")
        if self.operation not in OPERATIONS:
            raise PlanError(f"{self.step_id}: unknown operation {self.operation}")
        if self.operation == "union":
            return
        if self.join_algorithm not in ALGORITHMS:
            raise PlanError(f"{self.step_id}: unknown join algorithm {self.join_algorithm}")
        if self.conflict_policy not in CONFLICT_POLICIES:
            raise PlanError(f"{self.step_id}: unknown conflict policy {self.conflict_policy}")
        if self.join_algorithm == "asof":
            if self.join_type != "left":
                raise PlanError(f"{self.step_id}: an as-of join is always a left join")
            if len(self.left_keys) != 1 or len(self.right_keys) != 1:
                raise PlanError(f"{self.step_id}: an as-of join takes one key per side")
            if len(self.left_by_keys) != len(self.right_by_keys):
                raise PlanError(f"{self.step_id}: by-keys differ in number")
            if self.asof_direction not in DIRECTIONS:
                raise PlanError(f"{self.step_id}: unknown direction {self.asof_direction}")
            return
        if self.join_type not in JOIN_TYPES:
            raise PlanError(f"{self.step_id}: unknown join type {self.join_type}")
        if not self.left_keys or len(self.left_keys) != len(self.right_keys):
            raise PlanError(f"{self.step_id}: keys are missing or differ in number")
        if self.right_pre_agg_enabled:
            for name, rule in normalize_rules(self.right_pre_agg_rules).items():
                if rule["method"] not in METHODS:
                    raise PlanError(f"{self.step_id}: unknown method {rule['method']} ({name})")
                if rule["method"] in NEEDS_WEIGHT and not self.right_pre_agg_weight_col:
                    raise PlanError(f"{self.step_id}: {rule['method']} needs a weight column ({name})")


@dataclass(frozen=True)
class PlanSpec:
    base_table_id: str = ""
    row_explosion_warn_ratio: float = DEFAULT_GROWTH_LIMIT
    steps: tuple[StepSpec, ...] = ()

    def check(self) -> None:
        if not self.base_table_id:
            raise PlanError("no base table")
        for step in self.steps:
            step.check()

    def table_ids(self) -> list[str]:
        return [self.base_table_id, *(s.right_table_id for s in self.steps)]


@dataclass(frozen=True)
class OutputSpec:
    default_format: str = "csv"
    csv_encoding: str = "utf-8-sig"
    excel_sheet_name: str = "result"


@dataclass(frozen=True)
class Recipe:
    version: str = RECIPE_VERSION
    created_at: str = field(
        default_factory=lambda: datetime.now(timezone.utc).isoformat()
    )
    tables: tuple[TableSpec, ...] = ()
    join_plan: PlanSpec = PlanSpec()
    output_settings: OutputSpec = OutputSpec()
    ui_settings: dict[str, Any] = field(default_factory=dict)

    def check(self) -> None:
        if self.version != RECIPE_VERSION:
            raise PlanError(f"recipe version {self.version} is not {RECIPE_VERSION}")
        if not self.tables:
            raise PlanError("the recipe has no tables")
        ids = [t.table_id for t in self.tables]
        if len(set(ids)) != len(ids):
            raise PlanError("a table id occurs twice in the recipe")
        wanted = [i for i in [self.join_plan.base_table_id] if i]
        wanted += [s.right_table_id for s in self.join_plan.steps]
        unknown = sorted(set(wanted) - set(ids))
        if unknown:
            raise PlanError(f"the plan uses unknown tables: {', '.join(unknown)}")
        for table in self.tables:
            table.check()
        for step in self.join_plan.steps:
            step.check()

    def table(self, table_id: str) -> TableSpec:
        return next(t for t in self.tables if t.table_id == table_id)


# -------------------------------------------------------------------------- JSON


def from_data(kind: type, data: Mapping[str, Any] | None):
    """Build a spec from plain data. Missing fields take their default; unknown
    fields are ignored."""
    hints = typing.get_type_hints(kind)
    values = {}
    for f in dataclasses.fields(kind):
        if data is None or f.name not in data:
            continue
        value = _convert(hints[f.name], data[f.name])
        if value is not dataclasses.MISSING:
            values[f.name] = value
    missing = [
        f.name
        for f in dataclasses.fields(kind)
        if f.default is dataclasses.MISSING
        and f.default_factory is dataclasses.MISSING
        and f.name not in values
    ]
    if missing:
        raise PlanError(f"{kind.__name__} lacks {', '.join(missing)}")
    return kind(**values)


def _convert(hint: Any, value: Any):
    """The value in the type of its field, or MISSING to keep the default."""
    if dataclasses.is_dataclass(hint):
        return from_data(hint, value) if isinstance(value, Mapping) else dataclasses.MISSING
    origin, inner = typing.get_origin(hint), typing.get_args(hint)
    if origin is tuple:
        if not isinstance(value, (list, tuple)):
            return dataclasses.MISSING
        return tuple(_convert(inner[0], v) for v in value)
    if origin is dict:
        if not isinstance(value, Mapping):
            return dataclasses.MISSING
        return {str(k): v if inner[1] is Any else _convert(inner[1], v) for k, v in value.items()}
    if origin in (types.UnionType, typing.Union):
        return None if value in (None, "") else _convert(inner[0], value)
    if value is None:
        return dataclasses.MISSING
    try:
        return hint(value)
    except (TypeError, ValueError) as exc:
        raise PlanError(f"cannot read {value!r} as {hint.__name__}") from exc


def recipe_to_json(recipe: Recipe, indent: int = 2) -> str:
    return json.dumps(dataclasses.asdict(recipe), ensure_ascii=False, indent=indent)


def recipe_from_json(text: str) -> Recipe:
    """Read and check a recipe."""
    try:
        data = json.loads(text)
    except json.JSONDecodeError as exc:
        raise PlanError(f"the recipe is not JSON: {exc}") from exc
    for table in data.get("tables") or [] if isinstance(data, Mapping) else []:
        if isinstance(table, dict) and "table_name" not in table:
            # A table without a name has that of its file, or its id.
            table["table_name"] = table.get("source_file_name", table.get("table_id"))
    recipe = from_data(Recipe, data)
    recipe.check()
    return recipe
