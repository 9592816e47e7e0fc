import json

import pytest

import tableweave as tw
from tableweave.errors import PlanError
from tableweave.plans.run import log_entry, write_result
from tableweave.plans.specs import from_data
from tableweave.sources.csvfiles import CsvOptions
from tableweave.sources.manifest import append_log

from .conftest import only, rows


def folder(tmp_path):
    (tmp_path / "orders.csv").write_text("order_id,customer_id,amount\nO1,C1,10\nO2,C2,20\nO3,C9,30\n")
    (tmp_path / "customers.csv").write_text("customer_id;name\nC1;Ann\nC2;Bob\nC3;Cid\n")
    (tmp_path / "more.csv").write_text("order_no,cust,amt,memo\nO4,C1,5,x\n")
    return {k: str(tmp_path / f"{k}.csv") for k in ("orders", "customers", "more")}


def recipe(**changes):
    data = {
        "version": "1.0", "created_at": "2024-01-01T00:00:00",
        "tables": [
            {"table_id": "orders", "source_file_name": "orders.csv", "dtype_overrides": {"amount": "number"}},
            {"table_id": "customers", "csv_options": {"delimiter": ";", "encoding": "utf-8"}},
            {"table_id": "more", "selected_columns": ["order_no", "cust", "amt"]},
        ],
        "join_plan": {
            "base_table_id": "orders",
            "steps": [
                {"step_id": "s1", "right_table_id": "customers", "left_keys": ["customer_id"],
                 "right_keys": ["customer_id"]},
                {"step_id": "s2", "right_table_id": "more", "operation": "union",
                 "union_column_mapping": {"order_no": "order_id", "cust": "customer_id", "amt": "amount"}},
            ],
        },
        "ui_settings": {"page_size": 50},
    }
    return {**data, **changes}


def test_recipe_over_files(spark, tmp_path):
    result = tw.run_recipe(spark, json.dumps(recipe()), folder(tmp_path))
    assert result.output.columns == ["order_id", "customer_id", "amount", "name"]
    assert rows(result.output) == [
        ("O1", "C1", 10, "Ann"), ("O2", "C2", 20, "Bob"), ("O3", "C9", 30, None), ("O4", "C1", 5, None),
    ]
    first, second = result.steps
    assert rows(first.unmatched_left) == [("O3", "C9", 30)]
    assert rows(first.unmatched_right) == [("C3", "Cid")]
    assert second.unmatched_left.count() == 0 and second.unmatched_right.columns == ["order_no", "cust", "amt"]
    reports = result.reports().orderBy("step_id").collect()
    assert [(r.operation, r.output_rows) for r in reports] == [("join", 3), ("union", 4)]


def test_preview(spark, tmp_path):
    locations = folder(tmp_path)
    assert tw.run_recipe(spark, json.dumps(recipe()), locations, rows=1).output.count() == 2
    tables = {"orders": spark.range(500).toDF("k"), "r": spark.range(500).toDF("k")}
    plan = tw.PlanSpec("orders", steps=(tw.StepSpec("s", "r", left_keys=("k",), right_keys=("k",)),))
    assert tw.preview_plan(tables, plan).output.count() == 200
    many = {"orders": spark.range(500).selectExpr("1 AS k", "id"), "r": spark.range(500).selectExpr("1 AS k", "id AS j")}
    shown = tw.preview_plan(many, plan, 20)
    assert shown.output.count() == 20 and shown.reports().first().output_rows == 400


def test_checkpoint_between_steps(spark, tmp_path):
    locations = folder(tmp_path)
    if not spark.sparkContext.getCheckpointDir():
        with pytest.raises(PlanError, match="spark.checkpoint.dir"):
            tw.run_recipe(spark, json.dumps(recipe()), locations, checkpoint=True)
        spark.sparkContext.setCheckpointDir(str(tmp_path / "cut"))
    result = tw.run_recipe(spark, json.dumps(recipe()), locations, checkpoint=True)
    assert result.output.count() == 4
    assert "ExistingRDD" in result.steps[0].output._jdf.queryExecution().executedPlan().toString()


def test_round_trip():
    one = tw.recipe_from_json(json.dumps(recipe()))
    again = tw.recipe_from_json(tw.recipe_to_json(one))
    assert again == one
    assert one.tables[1].csv_options == CsvOptions("utf-8", ";", "auto", 1)
    assert one.tables[0].source_kind == "csv" and one.tables[0].normalize_columns is True
    step = one.join_plan.steps[0]
    assert (step.join_type, step.suffixes, step.asof_tolerance) == ("left", ("_l", "_r"), None)
    assert one.output_settings.csv_encoding == "utf-8-sig"
    assert json.loads(tw.recipe_to_json(one))["join_plan"]["steps"][0]["suffixes"] == ["_l", "_r"]


def test_defaults_of_odd_values():
    step = from_data(tw.StepSpec, {
        "step_id": 1, "suffixes": None, "asof_tolerance": "", "left_keys": ["a", 2],
        "union_column_mapping": "x", "unknown": 1,
    })
    assert (step.step_id, step.suffixes, step.asof_tolerance) == ("1", ("_l", "_r"), None)
    assert (step.left_keys, step.union_column_mapping) == (("a", "2"), {})


@pytest.mark.parametrize("change", [
    {"version": "2.0"},
    {"tables": []},
    {"tables": [{"table_id": "orders"}, {"table_id": "orders"}]},
    {"tables": [{"table_id": "orders"}]},
    {"tables": [{"name": "no id"}]},
    {"join_plan": {"base_table_id": "nope"}},
    {"join_plan": {"base_table_id": "orders", "steps": [
        {"step_id": "s", "right_table_id": "more", "left_keys": ["a"], "right_keys": []}]}},
    {"join_plan": {"base_table_id": "orders", "steps": [
        {"step_id": "s", "right_table_id": "more", "join_algorithm": "asof", "left_keys": ["a"]}]}},
    {"join_plan": {"base_table_id": "orders", "steps": [
        {"step_id": "s", "right_table_id": "more", "join_algorithm": "asof", "join_type": "inner",
         "left_keys": ["a"], "right_keys": ["b"]}]}},
    {"join_plan": {"base_table_id": "orders", "steps": [
        {"step_id": "s", "right_table_id": "more", "join_algorithm": "asof", "left_keys": ["a"],
         "right_keys": ["b"], "left_by_keys": ["c"]}]}},
])
def test_recipes_that_are_refused(change):
    with pytest.raises(PlanError):
        tw.recipe_from_json(json.dumps(recipe(**change)))


def test_not_json():
    with pytest.raises(PlanError):
        tw.recipe_from_json("{")


def test_plan_errors(spark):
    df = spark.range(3).toDF("k")
    step = tw.StepSpec("s", "r", left_keys=("k",), right_keys=("k",))
    for plan in (tw.PlanSpec(), tw.PlanSpec("b", steps=(step,)), tw.PlanSpec("b", steps=(tw.StepSpec("s"),))):
        with pytest.raises(PlanError):
            tw.run_plan({"b": df}, plan)
    with pytest.raises(PlanError):
        tw.load_table(spark, tw.TableSpec("t", source_kind="parquet"), "x")
    with pytest.raises(PlanError):
        tw.load_table(spark, tw.TableSpec("t"))
    with pytest.raises(PlanError):
        tw.load_table(spark, tw.TableSpec("t", source_kind="sql"))


def test_pre_aggregation_in_a_step(spark):
    left = spark.createDataFrame([("L1",), ("L2",)], "lot string")
    right = spark.createDataFrame(
        [("L1", 10, 0.0), ("L1", 30, 40.0), ("L2", 5, 90.0)], "lot_ref string, kg long, q double"
    )
    step = tw.StepSpec(
        "s", "r", left_keys=("lot",), right_keys=("lot_ref",), right_pre_agg_enabled=True,
        right_pre_agg_weight_col="kg", right_pre_agg_rules={"q": {"method": "weighted_mean"}},
    )
    result = tw.run_step(left, right, step)
    assert rows(result.output) == [("L1", "L1", 30.0), ("L2", "L2", 90.0)]
    report = only(result.report)
    assert report["right_rows"] == 2  # counted after the aggregation
    details = json.loads(report["details"])["right_pre_aggregation"]
    assert details["group_keys"] == ["lot_ref"] and details["rules"] == {"q": {"method": "weighted_mean", "formula": ""}}
    assert (details["input_rows"], details["output_rows"]) == (3, 2)
    with pytest.raises(PlanError, match="weight"):
        tw.run_step(left, right, tw.StepSpec(
            "s", "r", left_keys=("lot",), right_keys=("lot_ref",), right_pre_agg_enabled=True,
            right_pre_agg_rules={"q": {"method": "weighted_mean"}},
        ))


def test_historian_table_in_a_plan(spark):
    long = spark.createDataFrame([("a", "2024-01-01", 1.0), ("b", "2024-01-01", 2.0)], "tag string, t string, value double")
    long = long.selectExpr("tag", "cast(t as timestamp) AS timestamp", "value")
    spec = tw.TableSpec("h", source_kind="pi_da_tag", source_options={
        "tags_text": "a,b", "start_time": "2023-01-01", "end_time": "2025-01-01"}, selected_columns=("b", "a"))
    assert rows(tw.load_table(spark, spec, long)) == [(2.0, 1.0)]


def test_result_and_log(spark, tmp_path, monkeypatch):
    one = tw.recipe_from_json(json.dumps(recipe()))
    locations = folder(tmp_path)
    result = tw.run_recipe(spark, one, locations)
    write_result(result.output, one, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 4
    orders = tw.load_table(spark, one.tables[0], locations["orders"])
    frame = type(orders)
    monkeypatch.setattr(frame, "count", lambda self: pytest.fail("rows are known from the reports"))
    entry = log_entry(spark, one, result, {"orders": orders})
    monkeypatch.undo()
    append_log(entry, str(tmp_path / "log"))
    append_log(log_entry(spark, one, None, status="error", error="broken"), str(tmp_path / "log"))
    good, bad = spark.read.json(str(tmp_path / "log")).orderBy("status", ascending=False).collect()
    assert (good.status, good.final_shape, good.input_files[0].rows) == ("success", [4, 4], 3)
    assert json.loads(good.step_reports[0])["matched_left_rows"] == 2
    assert (bad.status, bad.error, bad.step_reports) == ("error", "broken", [])


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_one_count_of_the_keys_per_step(spark, tmp_path, how):
    """Output, report and extracts share a stored count: each side is aggregated once."""
    for name, keys in (("left", [1, 1, 2, None, 7]), ("right", [1, 3, None, 3])):
        spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"{name}_k long, {name}_v long").write.parquet(f"file://{tmp_path}/{name}")
    left, right = (spark.read.parquet(f"file://{tmp_path}/{n}") for n in ("left", "right"))
    result = tw.run_step(left, right, tw.StepSpec("s", "r", join_type=how, left_keys=("left_k",), right_keys=("right_k",)))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    report = only(result.report)
    assert (report["matched_left_rows"], report["matched_right_rows"], report["unmatched_right_rows"]) == (3, 2, 2)
    assert "/left]" not in plan(result.report) and "/right]" not in plan(result.report)
    assert "/right]" not in plan(result.unmatched_left) and "/left]" not in plan(result.unmatched_right)
    assert plan(result.output).count("/left]") == plan(result.output).count("/right]") == 1
    assert "Aggregate" not in plan(result.output) + plan(result.unmatched_left) + plan(result.unmatched_right)
    assert rows(result.unmatched_left) == [(2, 2), (7, 4)] and rows(result.unmatched_right) == [(3, 1), (3, 3)]
    assert result.output.count() == report["output_rows"]


def test_table_names_of_a_recipe():
    text = json.dumps({"tables": [
        {"table_id": "a", "source_file_name": "a.csv"}, {"table_id": "b"}, {"table_id": "c", "table_name": "own", "source_file_name": "c.csv"},
    ], "join_plan": {"base_table_id": "a", "steps": []}})
    assert [t.table_name for t in tw.recipe_from_json(text).tables] == ["a.csv", "b", "own"]


def test_kept_steps_are_not_run_again(spark, tmp_path, monkeypatch):
    """A second run reads no source; a change runs what depends on it, and nothing else."""
    from tableweave.plans import run as run_module

    places, kept = folder(tmp_path), f"file://{tmp_path}/kept"
    one = tw.recipe_from_json(json.dumps(recipe()))
    read, opened = run_module.read_csv, []

    def seen(spark, location, *args, **options):
        opened.append(location.rsplit("/")[-1])
        return read(spark, location, *args, **options)

    monkeypatch.setattr(run_module, "read_csv", seen)
    plain = tw.run_recipe(spark, one, places)
    want, reports = rows(plain.output), rows(plain.reports())
    opened.clear()
    for expected in (["orders.csv", "customers.csv", "more.csv"], []):
        result = tw.run_recipe(spark, one, places, cache=kept)
        assert rows(result.output) == want and rows(result.reports()) == reports
        assert opened == expected
        opened.clear()
    assert rows(result.steps[0].unmatched_left) == rows(plain.steps[0].unmatched_left)
    assert opened[:2] == ["orders.csv", "customers.csv"] or set(opened) >= {"orders.csv", "customers.csv"}
    opened.clear()
    (tmp_path / "more.csv").write_text("order_no,cust,amt,memo\nO4,C1,5,x\nO5,C1,6,y\n")
    result = tw.run_recipe(spark, one, places, cache=kept)
    assert result.output.count() == len(want) + 1 and opened == ["more.csv"]
    opened.clear()
    orders = tw.load_table(spark, one.tables[0], places["orders"])
    opened.clear()
    result = tw.run_recipe(spark, one, places | {"orders": orders}, cache=kept)
    assert result.output.count() == len(want) + 1 and sorted(opened) == ["customers.csv", "more.csv"]
