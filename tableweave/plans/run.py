"""Running plans and recipes: a fold of steps over lazy DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions.columns import require_columns
from ..operators.asof import AsofMatches, asof_matches, asof_output
from ..operators.equi import KeyDirectory, equi_join, key_directory, stored_directory, unmatched
from ..operators.preagg import normalize_rules, pre_aggregate
from ..operators.prepare import prepare
from ..operators.quality import (
    DEFAULT_GROWTH_LIMIT,
    asof_report,
    asof_unmatched_left,
    asof_unmatched_right,
    empty_extract,
    equi_report,
    union_report,
    with_row_counts,
)
from ..operators.union import DEFAULT_SOURCE_COLUMN, union_layout, union_mapped
from ..session import checkpointed
from ..sources.csvfiles import read_csv, write_csv
from ..sources.jdbc import Database, read_sql
from ..sources.workbooks import read_workbooks
from .cache import KeptStep, StepCache, step_key, table_key
from .series_query import SeriesQuery, series_table
from .specs import PlanSpec, Recipe, StepSpec, TableSpec, recipe_from_json

PREVIEW_ROWS = 200


@dataclass
class StepResult:
    """Result of one step. Every part is a lazy DataFrame, made when asked for.

    Parts of an equi join share one stored count of both sides' keys, made with the first
    part that needs it.
    """

    step: StepSpec
    left: DataFrame
    right: DataFrame  # after pre-aggregation
    growth_limit: float
    details: dict = field(default_factory=dict)
    matches: AsofMatches | None = None
    before: DataFrame | None = None  # the right table before pre-aggregation

    @cached_property
    def directory(self) -> KeyDirectory:
        return stored_directory(key_directory(self.left, self.right, self.step.left_keys, self.step.right_keys))

    @cached_property
    def output(self) -> DataFrame:
        step = self.step
        if step.operation == "union":
            return union_mapped(
                self.left, self.right, step.union_column_mapping, step.union_right_column_suffix,
                (step.union_source_column_name or DEFAULT_SOURCE_COLUMN)
                if step.union_add_source_column else None,
                step.union_source_value or step.right_table_id,
            )
        if self.matches is not None:
            return asof_output(self.matches)
        groups = set(step.right_pre_agg_group_keys or step.right_keys)
        unique = step.right_pre_agg_enabled and groups <= set(step.right_keys)
        counted = step.join_type in ("right", "outer") or step.join_type == "left" and not unique
        return equi_join(
            self.left, self.right, step.left_keys, step.right_keys, step.join_type,
            step.conflict_policy, step.suffixes, right_unique=unique,
            directory=self.directory if counted else None,
        )

    @cached_property
    def report(self) -> DataFrame:
        step = self.step
        if step.operation == "union":
            layout = union_layout(
                self.left.columns, self.right.columns, step.union_column_mapping,
                step.union_right_column_suffix,
            )
            return union_report(self.left, self.right, layout, self.growth_limit, step.step_id)
        if self.matches is not None:
            return asof_report(
                self.left, self.right, self.matches, step.asof_direction, step.asof_tolerance,
                self.growth_limit, step.step_id,
            )
        report = equi_report(
            self.left, self.right, step.left_keys, step.right_keys, step.join_type,
            self.growth_limit, step.step_id, self.details, self.directory,
        )
        return report if self.before is None else with_row_counts(report, self.before)

    @cached_property
    def unmatched_left(self) -> DataFrame:
        if self.step.operation == "union":
            return empty_extract(self.left)
        if self.matches is not None:
            return asof_unmatched_left(self.matches)
        return unmatched(
            self.left, self.right, self.step.left_keys, self.step.right_keys, self.directory, "left"
        )

    @cached_property
    def unmatched_right(self) -> DataFrame:
        if self.step.operation == "union":
            return empty_extract(self.right)
        if self.matches is not None:
            return asof_unmatched_right(self.matches)
        return unmatched(
            self.right, self.left, self.step.right_keys, self.step.left_keys, self.directory, "right"
        )


@dataclass
class PlanResult:
    output: DataFrame
    steps: list[StepResult]

    def reports(self) -> DataFrame | None:
        """One row per step, None for a plan without steps."""
        if not self.steps:
            return None
        return reduce(lambda a, b: a.unionAll(b), [s.report for s in self.steps])


def run_step(
    left: DataFrame, right: DataFrame, step: StepSpec, growth_limit: float = DEFAULT_GROWTH_LIMIT
) -> StepResult:
    """Check and plan one step."""
    step.check()
    result = StepResult(step, left, right, growth_limit)
    if step.operation == "join" and step.join_algorithm == "asof":
        result.matches = asof_matches(
            left, right, step.left_keys[0], step.right_keys[0], step.left_by_keys,
            step.right_by_keys, step.asof_direction, step.asof_tolerance,
            step.asof_allow_exact_matches, step.asof_order_by,
            conflict=step.conflict_policy, suffixes=step.suffixes,
        )
    elif step.operation == "join" and step.right_pre_agg_enabled:
        groups = list(step.right_pre_agg_group_keys or step.right_keys)
        result.before = right
        result.right = pre_aggregate(
            right, groups, step.right_pre_agg_rules, step.right_pre_agg_weight_col or None,
            step.right_pre_agg_order_by,
        )
        require_columns(result.right, step.right_keys, "right keys after pre-aggregation")
        result.details["right_pre_aggregation"] = {
            "enabled": True,
            "group_keys": groups,
            "weight_column": step.right_pre_agg_weight_col,
            "rules": normalize_rules(step.right_pre_agg_rules),
        }
    result.output  # a wrong step fails here, not when the result is first used
    return result


def run_plan(
    tables: Mapping[str, DataFrame] | Callable[[str], DataFrame],
    plan: PlanSpec,
    checkpoint: bool = False,
) -> PlanResult:
    """Apply the steps in order, lazily.

    ``checkpoint`` writes a table used more than once, and the result of each step that
    the next one reads, to the shared checkpoint folder, at once: for long plans, whose
    steps and reports would otherwise start from the sources again each time.
    """
    plan.check()
    load = tables if callable(tables) else tables.__getitem__
    ids = plan.table_ids()
    loaded: dict[str, DataFrame] = {}
    for table_id in ids:
        if table_id not in loaded:
            try:
                df = load(table_id)
            except KeyError as exc:
                raise PlanError(f"no table {table_id}") from exc
            again = checkpoint and ids.count(table_id) > 1
            loaded[table_id] = checkpointed(df) if again else df
    current, steps = loaded[plan.base_table_id], []
    for number, step in enumerate(plan.steps, start=1):
        result = run_step(
            current, loaded[step.right_table_id], step, plan.row_explosion_warn_ratio
        )
        current = result.output
        if checkpoint and number < len(plan.steps):
            current = result.output = checkpointed(current)
        steps.append(result)
    return PlanResult(current, steps)


def preview_plan(
    tables: Mapping[str, DataFrame], plan: PlanSpec, rows: int = PREVIEW_ROWS
) -> PlanResult:
    """The plan on ``rows`` rows of each table, and on as many of each step's result.

    The rows are fetched once, so that results, reports and extracts agree.
    """
    plan.check()
    wanted = dict.fromkeys(plan.table_ids())
    missing = [k for k in wanted if k not in tables]
    if missing:
        raise PlanError(f"no table {missing[0]}")
    some = {k: _fetched(tables[k], rows) for k in wanted}
    current, steps = some[plan.base_table_id], []
    for step in plan.steps:
        result = run_step(current, some[step.right_table_id], step, plan.row_explosion_warn_ratio)
        current = _fetched(result.output, rows)
        steps.append(result)
    return PlanResult(current, steps)


def _fetched(df: DataFrame, rows: int) -> DataFrame:
    return df.sparkSession.createDataFrame(df.limit(rows).collect(), df.schema)


def load_table(
    spark: SparkSession,
    spec: TableSpec,
    location: str | DataFrame | None = None,
    rows: int | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """Read and prepare one table.

    ``location`` is the file or folder of a file source. For a historian source it
    is a DataFrame or Parquet folder of long rows. An SQL source needs none. A
    DataFrame given for any other source stands for its raw rows.
    """
    spec.check()
    if spec.source_kind == "sql" and location is None:
        query = str(spec.source_options.get("query") or "")
        raw = read_sql(spark, Database.from_options(spec.source_options), query, rows)
    elif location is None:
        raise PlanError(f"table {spec.table_id} needs a location")
    elif spec.source_kind in ("pi_da_tag", "af_attribute", "af_event_frame"):
        query = SeriesQuery.from_options(spec.source_kind, spec.source_options, rows)
        source = spark.read.parquet(location) if isinstance(location, str) else location
        raw = series_table(source, query, now)
        raw = raw if rows is None else raw.limit(rows)
    elif isinstance(location, DataFrame):
        raw = location if rows is None else location.limit(rows)
    elif spec.source_kind == "csv":
        raw = read_csv(spark, location, spec.csv_options, rows=rows)
    else:
        options = spec.excel_options
        raw = read_workbooks(spark, location, options.sheet_name, options.header_row, rows=rows)
    return prepare(raw, spec.normalize_columns, spec.selected_columns, spec.dtype_overrides)


def run_recipe(
    spark: SparkSession,
    recipe: str | Recipe,
    locations: Mapping[str, str | DataFrame],
    rows: int | None = None,
    now: datetime | None = None,
    checkpoint: bool = False,
    cache: str | None = None,
) -> PlanResult:
    """Run a recipe; ``locations`` says where each table id is found, ``rows`` reads
    only the first rows of each table for a preview.

    With a folder ``cache``, shared by all executors, results of steps are written there
    and read by later runs for as long as their files, tables and steps, and those before
    them, stay the same; see ``plans.cache``. Steps that read a DataFrame or a database,
    and those behind them, are not kept.
    """
    if isinstance(recipe, str):
        recipe = recipe_from_json(recipe)
    else:
        recipe.check()

    def load(table_id: str) -> DataFrame:
        return load_table(spark, recipe.table(table_id), locations.get(table_id), rows, now)

    if cache is None:
        return run_plan(load, recipe.join_plan, checkpoint)
    # A relative time range means other rows at another time.
    relative = lambda t: any("*" in str(v) for v in t.source_options.values())
    keys = {
        t.table_id: None if relative(t) else table_key(spark, t, locations.get(t.table_id), rows)
        for t in recipe.tables if t.table_id in recipe.join_plan.table_ids()
    }
    return _run_kept(load, recipe.join_plan, keys, StepCache(spark, cache))


def _run_kept(load: Callable[[str], DataFrame], plan: PlanSpec, tables: Mapping[str, str | None], cache: StepCache) -> PlanResult:
    """The plan, from the last step on whose result the cache has."""
    plan.check()
    before, keys = tables[plan.base_table_id], []
    for step in plan.steps:
        before = step_key(before, tables[step.right_table_id], step, plan.row_explosion_warn_ratio)
        keys.append(before)
    loaded: dict[str, DataFrame] = {}

    def table(table_id: str) -> DataFrame:
        if table_id not in loaded:
            loaded[table_id] = load(table_id)
        return loaded[table_id]

    steps: list[StepResult | KeptStep] = []

    def left_of(i: int) -> DataFrame:
        return steps[i - 1].output if i else table(plan.base_table_id)

    def made(i: int) -> StepResult:
        step = plan.steps[i]
        return run_step(left_of(i), table(step.right_table_id), step, plan.row_explosion_warn_ratio)

    for i, (step, key) in enumerate(zip(plan.steps, keys)):
        if not cache.has(key):
            result = made(i)
            if key is None:
                steps.append(result)
                continue
            cache.write(key, result)
        steps.append(cache.read(key, step, lambda i=i: made(i)))
    return PlanResult(left_of(len(plan.steps)), steps)


def write_result(result: DataFrame, recipe: Recipe, path: str, mode: str = "errorifexists") -> None:
    """Write a result as the recipe's output settings say."""
    settings = recipe.output_settings
    if settings.default_format != "csv":
        raise PlanError(f"no sink for the format {settings.default_format}")
    write_csv(result, path, settings.csv_encoding, mode)


def log_entry(
    spark: SparkSession,
    recipe: Recipe,
    result: PlanResult | None,
    inputs: Mapping[str, DataFrame] | None = None,
    status: str = "success",
    error: str | None = None,
) -> DataFrame:
    """One log row of a run: inputs, step reports, final shape and status.

    All reports are one action. Row counts come from them: a step's report counts its left
    and right table (before pre-aggregation, if any); only inputs that no step has read
    are counted by themselves.
    """
    found = [] if result is None or not result.steps else [r.asDict(recursive=True) for r in result.reports().collect()]
    place = {s.step.step_id: i for i, s in enumerate(result.steps)} if found else {}
    if found and len(place) == len(found):
        found.sort(key=lambda r: place[r["step_id"]])
    counted = {}
    for step, report in zip(result.steps if found else [], found):
        before = json.loads(report["details"] or "{}").get("right_pre_aggregation", {}).get("input_rows")
        counted[step.step.right_table_id] = report["right_rows"] if before is None else before
    if found:
        counted[recipe.join_plan.base_table_id] = found[0]["left_rows"]
    files = []
    for table in recipe.tables:
        df = (inputs or {}).get(table.table_id)
        rows = counted.get(table.table_id)
        if rows is None and df is not None:
            rows = df.count()
        files.append(F.struct(
            F.lit(table.table_id).alias("table_id"),
            F.lit(table.table_name).alias("table_name"),
            F.lit(table.source_file_name).alias("file_name"),
            F.lit(table.source_kind).alias("source_kind"),
            F.lit(table.file_hash).cast("string").alias("sha256"),
            F.lit(None if df is None else rows).cast("long").alias("rows"),
            F.lit(None if df is None else len(df.columns)).cast("long").alias("cols"),
        ))
    reports = [json.dumps(r, ensure_ascii=False) for r in found]
    if result is None:
        shape = [0, 0]
    else:
        shape = [found[-1]["output_rows"] if found else result.output.count(), len(result.output.columns)]
    return spark.range(1).select(
        F.lit(datetime.now(timezone.utc).isoformat()).alias("executed_at"),
        F.lit(recipe.version).alias("recipe_version"),
        F.array(*files).alias("input_files"),
        F.lit(recipe.join_plan.base_table_id).alias("base_table_id"),
        F.array(*map(F.lit, reports)).cast("array<string>").alias("step_reports"),
        F.array(*map(F.lit, shape)).cast("array<bigint>").alias("final_shape"),
        F.lit(status).alias("status"),
        F.lit(error).cast("string").alias("error"),
    )

