import random

import pandas as pd
import pytest

import tableweave as tw
from tableweave.errors import PlanError

from .conftest import only, rows

L = "k long, v string"
R = "k long, w string"


def test_composite_left_join_with_left_prefer(spark):
    left = spark.createDataFrame(
        [("A", 1, "x", 100), ("A", 2, None, 200), ("B", 1, "z", 300)],
        "id string, sub_id long, name string, amount long",
    )
    right = spark.createDataFrame(
        [("A", 1, "x2", "c1"), ("A", 2, "y2", "c2"), ("C", 9, "c", "c3")],
        "id string, sub_id long, name string, category string",
    )
    keys = ["id", "sub_id"]
    out = tw.equi_join(left, right, keys, keys, "left", conflict="left_prefer")
    assert out.columns == ["id", "sub_id", "name", "amount", "category"]
    assert rows(out) == [
        ("A", 1, "x", 100, "c1"), ("A", 2, "y2", 200, "c2"), ("B", 1, "z", 300, None),
    ]
    report = only(tw.equi_report(left, right, keys, keys, "left"))
    assert (report["left_rows"], report["right_rows"], report["output_rows"]) == (3, 3, 3)
    assert (report["unmatched_left_rows"], report["unmatched_right_rows"]) == (1, 1)


def test_outer_join_keeps_both_and_extracts(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "key long, v string")
    right = spark.createDataFrame([(2, "bb"), (3, "cc")], "key long, v string")
    out = tw.equi_join(left, right, ["key"], ["key"], "outer", suffixes=("_L", "_R"))
    assert out.columns == ["key", "v_L", "v_R"]
    assert rows(out) == [(1, "a", None), (2, "b", "bb"), (3, None, "cc")]
    assert rows(tw.unmatched(left, right, ["key"], ["key"])) == [(1, "a")]
    assert rows(tw.unmatched(right, left, ["key"], ["key"])) == [(3, "cc")]


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("names", [("k", "k"), ("k", "j")])
def test_all_join_types_against_pandas(spark, no_broadcast, how, names):
    """Null keys, repeated keys and a hot key; planned without broadcast."""
    rng = random.Random(7)
    key = lambda: None if rng.random() < 0.05 else 0 if rng.random() < 0.3 else rng.randrange(1, 40)
    lefts = [(key(), i) for i in range(120)]
    rights = [(key(), -i) for i in range(90)]
    lk, rk = names
    left = spark.createDataFrame(lefts, f"{lk} long, x long")
    right = spark.createDataFrame(rights, f"{rk} long, y long")
    expected = pd.merge(
        pd.DataFrame(lefts, columns=[lk, "x"], dtype="Int64"),
        pd.DataFrame(rights, columns=[rk, "y"], dtype="Int64"),
        how=how, left_on=lk, right_on=rk,
    )
    found = tw.equi_join(left, right, [lk], [rk], how)
    assert found.columns == list(expected.columns)
    plain = [tuple(None if pd.isna(v) else int(v) for v in r) for r in expected.itertuples(index=False)]
    order = lambda r: [(v is not None, v or 0) for v in r]
    assert rows(found) == sorted(plain, key=order)

    report = only(tw.equi_report(left, right, [lk], [rk], how))
    assert report["output_rows"] == len(plain)
    lonely = tw.unmatched(left, right, [lk], [rk])
    assert report["unmatched_left_rows"] == lonely.count()
    assert report["unmatched_right_rows"] == tw.unmatched(right, left, [rk], [lk]).count()
    assert report["left_duplicate_key_rows"] == sum(
        [k for k, _ in lefts].count(k) > 1 for k, _ in lefts
    )


def test_outer_join_is_one_join_that_never_loops(spark, no_broadcast):
    left, right = spark.range(50).toDF("k"), spark.range(20, 90).toDF("k")
    plan = tw.equi_join(left, right, ["k"], ["k"], "outer")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FullOuter") == 1 and "NestedLoop" not in text and "Cartesian" not in text
    assert plan.count() == 90


def test_key_that_equals_a_column_of_the_other_side_gets_the_suffix(spark):
    left = spark.createDataFrame([(1, 2)], "a long, v long")
    right = spark.createDataFrame([(9, 1, 3)], "a long, b long, v long")
    out = tw.equi_join(left, right, ["a"], ["b"], "inner")
    assert out.columns == ["a_l", "v_l", "a_r", "b", "v_r"]
    merged = tw.equi_join(left, right, ["a"], ["b"], "inner", conflict="right_prefer")
    assert merged.columns == ["a_l", "v", "a_r", "b"]
    assert rows(merged) == [(1, 3, 9, 1)]


def test_names_with_dots_and_blanks(spark):
    left = spark.createDataFrame([(1, 2)], "`a.b` long, `v ``x` long")
    right = spark.createDataFrame([(1, 3)], "`a.b` long, `w.w` long")
    out = tw.equi_join(left, right, ["a.b"], ["a.b"])
    assert out.columns == ["a.b", "v `x", "w.w"]
    assert rows(out) == [(1, 2, 3)]
    assert rows(tw.unmatched(left, right, ["a.b"], ["a.b"])) == []


def test_wrong_steps_fail_before_any_job(spark):
    left = spark.createDataFrame([(1, "a", "b")], "k long, v string, v_l string")
    right = spark.createDataFrame([(1, "c")], "k long, v string")
    text = spark.createDataFrame([("1", "c")], "k string, v string")
    for arguments in (
        (left, right, ["k"], ["k"]),  # v becomes v_l, which exists
        (left, right, ["k"], ["k"], "left", "keep_both", ("", "")),
        (left, text, ["k"], ["k"], "left", "keep_both", ("_a", "_b")),
        (left, right, ["k"], ["nope"]),
        (left, right, [], []),
        (left, right, ["k", "v"], ["k"]),
        (left, right, ["k"], ["k"], "cross"),
        (left, right, ["k"], ["k"], "left", "other", ("_a", "_b")),
    ):
        with pytest.raises(PlanError):
            tw.equi_join(*arguments)


def test_names_that_differ_in_case_only(spark):
    left = spark.createDataFrame([(1, 2)], "k long, V long")
    right = spark.createDataFrame([(1, 3)], "k long, v long")
    with pytest.raises(PlanError, match="case"):
        tw.equi_join(left, right, ["k"], ["k"])


def test_many_to_many_and_growth_warnings(spark):
    left = spark.createDataFrame([(1, "a")] * 2 + [(2, "b")], L)
    right = spark.createDataFrame([(1, "c")] * 3, R)
    report = only(tw.equi_report(left, right, ["k"], ["k"], "left", growth_limit=2.0))
    assert report["output_rows"] == 7
    assert report["many_to_many_suspected"] is True
    assert report["warnings"] == ["many_to_many", "row_growth"]
    exact = only(tw.equi_report(left, right, ["k"], ["k"], "inner", growth_limit=2.0))
    assert exact["row_growth_ratio_vs_left"] == 2.0
    assert exact["warnings"] == ["many_to_many"]  # the limit itself is allowed


def test_report_of_empty_sides(spark):
    empty, right = spark.createDataFrame([], L), spark.createDataFrame([(1, "c")], R)
    report = only(tw.equi_report(empty, right, ["k"], ["k"], "outer"))
    assert report["left_match_rate"] is None and report["row_growth_ratio_vs_left"] is None
    assert (report["left_rows"], report["output_rows"], report["right_match_rate"]) == (0, 1, 0.0)
