import random

import pandas as pd
import pytest

import tableweave as tw
from tableweave.errors import PlanError
from tableweave.operators import asof as asof_module
from tableweave.operators.asof import span_micros

from .conftest import at, only, rows


@pytest.fixture
def many_ranges(monkeypatch):
    """Cut even tiny inputs into several ranges."""
    monkeypatch.setattr(asof_module, "RANGE_ROWS", 10)


def rates(spark):
    left = spark.createDataFrame(
        [("A", at("2024-01-01 10:00"), 1), ("A", at("2024-01-01 10:06"), 2),
         ("B", at("2024-01-01 10:03"), 1)],
        "customer_id string, ts timestamp, qty long",
    )
    right = spark.createDataFrame(
        [("A", at("2024-01-01 09:59"), 100), ("A", at("2024-01-01 10:05"), 120),
         ("B", at("2024-01-01 10:10"), 999)],
        "customer_code string, rate_ts timestamp, price long",
    )
    return left, right


def test_backward_with_by_key_and_tolerance(spark, many_ranges):
    left, right = rates(spark)
    found = tw.asof_matches(
        left, right, "ts", "rate_ts", ["customer_id"], ["customer_code"], tolerance="10min",
    )
    out = tw.asof_output(found)
    assert out.columns == ["customer_id", "ts", "qty", "customer_code", "rate_ts", "price"]
    assert [r[5] for r in rows(out)] == [100, 120, None]
    report = only(tw.asof_report(left, right, found, "backward", "10min"))
    assert report["algorithm"] == "asof" and report["join_type"] == "left"
    assert (report["matched_left_rows"], report["unmatched_left_rows"]) == (2, 1)
    assert (report["matched_right_rows"], report["unmatched_right_rows"]) == (2, 1)
    assert report["details"] == '{"direction": "backward", "tolerance": "10min"}'
    assert [r[0] for r in rows(tw.asof_unmatched_left(found))] == ["B"]
    assert [r[2] for r in rows(tw.asof_unmatched_right(found))] == [999]


def random_tables(seed: int):
    """Few keys, so many ties; one by-key, and one key in it, holds most rows."""
    rng = random.Random(seed)
    by = lambda: None if rng.random() < 0.1 else "h" if rng.random() < 0.5 else rng.choice("abc")
    key = lambda: 20 if rng.random() < 0.3 else rng.randrange(0, 60)
    left = [(i, by(), key()) for i in range(200)]
    right = [(i, by(), key()) for i in range(90)]
    return left, right


@pytest.mark.parametrize("direction, exact, tolerance", [
    ("backward", True, None), ("backward", False, 2), ("forward", True, 2),
    ("forward", False, None), ("nearest", True, None), ("nearest", True, 2),
    ("nearest", False, 1),
])
def test_against_pandas(spark, many_ranges, direction, exact, tolerance):
    lefts, rights = random_tables(3)
    left = spark.createDataFrame(lefts, "id long, b string, k long")
    right = spark.createDataFrame(rights, "rid long, rb string, rk long")
    for by in (True, False):
        expected = pd.merge_asof(
            pd.DataFrame(lefts, columns=["id", "b", "k"]).sort_values(["k", "id"], kind="stable"),
            pd.DataFrame(rights, columns=["rid", "rb", "rk"]).sort_values(["rk", "rid"], kind="stable"),
            left_on="k", right_on="rk", left_by="b" if by else None, right_by="rb" if by else None,
            direction=direction, allow_exact_matches=exact, tolerance=tolerance,
        )
        want = {int(r.id): None if pd.isna(r.rid) else int(r.rid) for r in expected.itertuples()}
        out = tw.asof_join(
            left, right, "k", "rk", ["b"] if by else [], ["rb"] if by else [], direction,
            tolerance, exact, ["rid"],
        )
        assert {r.id: r.rid for r in out.collect()} == want, by


def test_match_several_ranges_back(spark, many_ranges):
    left = spark.createDataFrame([(i,) for i in range(100, 400)], "k long")
    right = spark.createDataFrame([(5,), (390,)], "r long")
    out = tw.asof_join(left, right, "k", "r")
    assert rows(out.groupBy("r").count()) == [(5, 290), (390, 10)]
    ahead = tw.asof_join(left, right, "k", "r", direction="forward")
    assert rows(ahead.groupBy("r").count()) == [(None, 9), (390, 291)]


def test_split_plan_has_no_window_over_a_whole_side(spark, many_ranges):
    left = spark.createDataFrame([(i,) for i in range(300)], "k long")
    right = spark.createDataFrame([(i,) for i in range(0, 300, 7)], "r long")
    out = tw.asof_join(left, right, "k", "r")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert any("[g#" in line for line in windows) and "SinglePartition" not in plan


def test_right_columns_meet_only_the_last_joins(spark, many_ranges, no_broadcast):
    """Ranges, windows and the carried keys see (by, key) alone; each side's rows are read for their keys and once whole."""
    left = spark.createDataFrame([(i % 3, i, f"left {i}") for i in range(300)], "b long, k long, wide_left string")
    right = spark.createDataFrame([(i % 3, i, f"right {i}") for i in range(0, 300, 7)], "c long, r long, wide_right string")
    found = tw.asof_matches(left, right, "k", "r", ["b"], ["c"], "nearest")
    plan = found.rows._jdf.queryExecution().executedPlan().toString()
    payload = [f"{n.name}#" for n in found.layout.right.schema.fields][2:]
    for line in plan.splitlines():
        if "Window" in line or "Sort [" in line and " g#" in line:
            assert "v#" not in line and not any(p in line for p in payload)
    assert "SinglePartition" not in plan
    assert found.rows.where("hit is not null").count() == 300


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("by", [True, False])
def test_carried_over_many_empty_ranges(spark, many_ranges, direction, by):
    """Right rows only at both ends and in one by-group; null by-keys match."""
    left = [(None if i % 4 == 0 else i % 2, i) for i in range(400)]
    right = [(None, 3, "a"), (None, 3, "z"), (1, -5, "c"), (1, 390, "d"), (0, 1000, "e")]
    df = tw.asof_join(
        spark.createDataFrame(left, "b long, k long"), spark.createDataFrame(right, "c long, r long, name string"),
        "k", "r", ["b"] if by else [], ["c"] if by else [], direction,
    )

    def best(b, k):
        rows_ = [(r, n) for c, r, n in right if not by or c == b]
        back = max((x for x in rows_ if x[0] <= k), default=None)
        ahead = min((x for x in rows_ if x[0] >= k), default=None)
        if direction != "nearest":
            return back if direction == "backward" else ahead
        if back is None or ahead is None:
            return back or ahead
        return ahead if ahead[0] - k < k - back[0] else back

    got = {(r.b, r.k): (None if r.name is None else (r.r, r.name)) for r in df.collect()}
    assert got == {(b, k): best(b, k) for b, k in left}


def test_equal_right_rows_count_one_by_one(spark):
    """Of two equal right rows nearest uses both: one looking back, one looking ahead."""
    left = spark.createDataFrame([(9,), (11,)], "k long")
    right = spark.createDataFrame([(10, "x"), (10, "x"), (50, "y")], "r long, v string")
    found = tw.asof_matches(left, right, "k", "r", direction="nearest")
    report = only(tw.asof_report(left, right, found, "nearest"))
    assert (report["matched_right_rows"], report["unmatched_right_rows"]) == (2, 1)


def test_an_exploded_hot_group_is_split(spark, monkeypatch):
    """Rows are counted where an estimate would be far too low."""
    monkeypatch.setattr(asof_module, "RANGE_ROWS", 2_000)
    left = spark.range(10).selectExpr("'one' AS b", "id * 1000 AS at", "explode(sequence(1, 1000)) AS i").selectExpr("b", "at + i AS k")
    right = spark.range(3).selectExpr("'one' AS c", "id * 4000 AS r")
    found = tw.asof_matches(left, right, "k", "r", ["b"], ["c"])
    plan = found.rows._jdf.queryExecution().executedPlan().toString()
    assert any("g#" in line for line in plan.splitlines() if "Window" in line) and "bwd_outer" in plan
    assert rows(tw.asof_output(found).groupBy("r").count()) == [(0, 3999), (4000, 4000), (8000, 2001)]


def test_tolerance_is_inclusive_and_ties_go_backward(spark):
    left = spark.createDataFrame([(10, "a")], "k long, b string")
    right = spark.createDataFrame([(7, "a"), (13, "a")], "r long, c string")
    for limit, want in ((3, 7), (2, None), ("2.9", None)):
        out = tw.asof_join(left, right, "k", "r", ["b"], ["c"], "nearest", limit)
        assert out.first().r == want


def test_number_keys_of_different_types(spark):
    left = spark.createDataFrame([(10, "a")], "k int, b string")
    right = spark.createDataFrame([(9.5, "a"), (float("inf"), "a")], "r double, c string")
    out = tw.asof_join(left, right, "k", "r", ["b"], ["c"], tolerance="1")
    assert out.first().r == 9.5


def test_null_keys(spark, many_ranges):
    left = spark.createDataFrame([(1, None, "a"), (2, 5, "a")], "id long, k long, b string")
    right = spark.createDataFrame([(None, "a"), (3, "a")], "r long, c string")
    with pytest.raises(Exception, match="null as-of key"):
        tw.asof_join(left, right, "k", "r", ["b"], ["c"]).collect()
    out = tw.asof_join(
        left, right, "k", "r", ["b"], ["c"], on_null="unmatched"
    )
    assert {r.id: r.r for r in out.collect()} == {1: None, 2: 3}


def test_rows_with_arrays_and_maps_travel_along(spark):
    left = spark.createDataFrame([(5, "a", {"x": 1})], "k long, b string, m map<string,int>")
    right = spark.createDataFrame([(4, "a", [1, 2], {"y": 2})], "r long, c string, l array<int>, n map<string,int>")
    row = tw.asof_join(left, right, "k", "r", ["b"], ["c"]).first()
    assert (row.m, row.l, row.n) == ({"x": 1}, [1, 2], {"y": 2})


def test_same_key_name_is_one_column_and_conflicts_resolve(spark):
    left = spark.createDataFrame([(5, "a", None)], "k long, b string, v string")
    right = spark.createDataFrame([(4, "a", "w")], "k long, b string, v string")
    out = tw.asof_join(left, right, "k", "k", ["b"], ["b"], conflict="left_prefer")
    assert out.columns == ["k", "b", "v"]
    assert rows(out) == [(5, "a", "w")]
    assert tw.asof_join(left, right, "k", "k", ["b"], ["b"]).columns == ["k", "b", "v_l", "v_r"]


def test_text_keys_become_numbers_or_datetimes(spark):
    left = spark.createDataFrame([("10", "a"), ("x", "a"), ("12", "a"), ("3", "a"), ("4", "a")], "k string, b string")
    right = spark.createDataFrame([("9", "a")], "r string, c string")
    out = tw.asof_join(left, right, "k", "r", ["b"], ["c"], on_null="unmatched")
    assert dict(out.dtypes)["k"] == "double"
    assert {r.k: r.r for r in out.collect()} == {10.0: 9.0, 12.0: 9.0, 3.0: None, 4.0: None, None: None}
    days = spark.createDataFrame([("2024-01-02", "a")], "k string, b string")
    rates = spark.createDataFrame([("2024/1/1 23:59:00", "a")], "r string, c string")
    found = tw.asof_join(days, rates, "k", "r", ["b"], ["c"], tolerance="1min").first()
    assert found.r == at("2024-01-01 23:59")
    with pytest.raises(PlanError):
        tw.asof_join(spark.createDataFrame([("p", "a")], "k string, b string"), rates, "k", "r", ["b"], ["c"])


def test_equal_right_rows_count_one_by_one(spark):
    left = spark.createDataFrame([(5, "a")], "k long, b string")
    right = spark.createDataFrame([(4, "a")] * 3 + [(1, "a")], "r long, c string")
    found = tw.asof_matches(left, right, "k", "r", ["b"], ["c"])
    assert rows(tw.asof_unmatched_right(found)) == [(1, "a"), (4, "a"), (4, "a")]
    assert only(tw.asof_report(left, right, found, "backward"))["matched_right_rows"] == 1


def test_spans():
    assert span_micros("10min") == 600_000_000
    assert span_micros("1h 30m") == span_micros("01:30:00") == 5_400_000_000
    assert span_micros("1 day, 2 hours") == span_micros("1 days 02:00:00") == 93_600_000_000
    assert span_micros("-0.5s") == -500_000
    for wrong in ("", "10", "min", "3 parsecs", "5min x"):
        with pytest.raises(PlanError):
            span_micros(wrong)


def test_wrong_steps(spark):
    left, right = rates(spark)
    for arguments in (
        dict(left_by=["customer_id"]),
        dict(direction="sideways"),
        dict(tolerance="soon"),
        dict(left_by=["qty"], right_by=["customer_code"]),
        dict(order_by=["nope"]),
        dict(on_null="drop"),
    ):
        with pytest.raises(PlanError):
            tw.asof_join(left, right, "ts", "rate_ts", **arguments)


def test_unmatched_right_rows_with_maps_and_copies(spark):
    left = spark.createDataFrame([(5, "a"), (6, "a")], "k long, b string")
    right = spark.createDataFrame(
        [(4, "a", {"y": 2}), (4, "a", {"y": 2}), (9, "a", None), (1, None, {})], "r long, c string, n map<string,int>"
    )
    found = tw.asof_matches(left, right, "k", "r", ["b"], ["c"])
    out = tw.asof_unmatched_right(found).collect()
    assert sorted((r.r, r.c or "", r.n and dict(r.n)) for r in out) == [(1, "", {}), (4, "a", {"y": 2}), (9, "a", None)]
