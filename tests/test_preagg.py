import pytest

import tableweave as tw
from tableweave.errors import PlanError

from .conftest import only, rows


def lots(spark):
    return spark.createDataFrame(
        [("L1", "a", 10, 0.0), ("L1", "b", 30, 40.0), ("L2", "c", 5, 90.0)],
        "lot string, raw string, kg long, quality double",
    )


def test_weighted_mean_then_join(spark):
    left = spark.createDataFrame([("L1", 1.0), ("L2", 2.0)], "product string, q double")
    right = tw.pre_aggregate(lots(spark), ["lot"], {"quality": "weighted_mean"}, "kg")
    assert right.columns == ["lot", "quality"]
    out = tw.equi_join(left, right, ["product"], ["lot"], right_unique=True)
    assert rows(out) == [("L1", 1.0, "L1", 30.0), ("L2", 2.0, "L2", 90.0)]


def test_every_method_with_nulls_and_text(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [("g", 1, "5", 2.0), ("g", 2, None, 3.0), ("g", 3, "x", 1.0), ("g", 4, " 7 ", None),
         (None, 1, None, None), (None, 2, None, 4.0), ("z", 1, "3", 0.0), ("n", 1, "1", nan)],
        "k string, pos int, v string, w double",
    )

    def run(method, formula=""):
        rule = {"method": method, "formula": formula}
        out = tw.pre_aggregate(df, ["k"], {"v": rule}, "w", ["pos"])
        return {r.k: r.v for r in out.collect()}

    assert run("first") == {"g": "5", None: None, "z": "3", "n": "1"}
    assert run("last") == {"g": " 7 ", None: None, "z": "3", "n": "1"}
    assert run("count") == {"g": 3, None: 0, "z": 1, "n": 1}
    assert run("sum") == {"g": 12.0, None: None, "z": 3.0, "n": 1.0}
    assert run("mean") == {"g": 6.0, None: None, "z": 3.0, "n": 1.0}
    assert run("min") == {"g": 5.0, None: None, "z": 3.0, "n": 1.0}
    assert run("max") == {"g": 7.0, None: None, "z": 3.0, "n": 1.0}
    assert run("weighted_sum") == {"g": 10.0, None: 0.0, "z": 0.0, "n": 0.0}
    assert run("weighted_mean") == {"g": 5.0, None: None, "z": None, "n": None}
    assert run("formula", "sum_v + 10*count_v - -(min_v + +max_v)/2 + sum_w + mean_w + sum_vw + mean_v") == {
        "g": 12 + 20 + 6 + 2 + 2 + 10 + 6.0, None: 0.0, "z": 3 + 10 + 3 + 0 + 0 + 0 + 3.0, "n": 13.0,
    }


def test_first_without_order_does_not_depend_on_arrival(spark):
    data = [("g", i % 7, i) for i in range(50)]
    out = []
    for part in (data, data[::-1]):
        df = spark.createDataFrame(part, "k string, a long, b long").repartition(5)
        out.append(rows(tw.pre_aggregate(df, ["k"], {"a": "first", "b": "last"})))
    assert out[0] == out[1]


def test_one_aggregation_for_all_rules(spark):
    rules = {"raw": "count", "quality": {"method": "weighted_mean"}}
    out = tw.pre_aggregate(lots(spark), ["lot"], rules, "kg")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange") == 1


def test_formula_division_by_zero_stops_the_query(spark):
    rule = {"quality": {"method": "formula", "formula": "1 / (sum_w - 5)"}}
    with pytest.raises(Exception, match="division by zero"):
        tw.pre_aggregate(lots(spark), ["lot"], rule, "kg").collect()


@pytest.mark.parametrize("formula", [
    "", "sum_v +", "other + 1", "sum_v ** 2", "abs(sum_v)", "sum_v > 1", "True", "'a'", "sum_v % 2",
    "~sum_v", "(sum_v).x", "[sum_v]",
])
def test_formulas_that_are_refused(spark, formula):
    with pytest.raises(PlanError):
        tw.pre_aggregate(lots(spark), ["lot"], {"quality": {"method": "formula", "formula": formula}}, "kg")


def test_wrong_rules(spark):
    df = lots(spark)
    for keys, rules, weight in (
        ([], {"kg": "sum"}, None),
        (["nope"], {"kg": "sum"}, None),
        (["lot"], {}, None),
        (["lot"], {"nope": "sum"}, None),
        (["lot"], {"lot": "count"}, None),
        (["lot"], {"kg": "median"}, None),
        (["lot"], {"quality": "weighted_mean"}, None),
        (["lot"], {"quality": "weighted_mean"}, "nope"),
    ):
        with pytest.raises(PlanError):
            tw.pre_aggregate(df, keys, rules, weight)


def test_key_outside_the_groups_is_a_clear_error(spark):
    step = tw.StepSpec(
        "s", "r", left_keys=("raw",), right_keys=("raw",), right_pre_agg_enabled=True,
        right_pre_agg_group_keys=("lot",), right_pre_agg_rules={"kg": "sum"},
    )
    with pytest.raises(PlanError, match="after pre-aggregation"):
        tw.run_step(lots(spark), lots(spark), step)


def test_a_third_of_all_rows_in_one_group(spark):
    df = spark.range(30_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "id AS v", "1.0D AS w"
    )
    out = tw.pre_aggregate(df, ["k"], {"v": "weighted_sum"}, "w")
    assert only(out.where("k = 0"))["v"] == sum(range(0, 30_000, 3))
