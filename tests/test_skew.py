"""Hot keys are split: the final plans of small jobs with small thresholds."""

import pytest

import tableweave as tw
from tableweave.operators import asof as asof_module
from tableweave.operators import equi as equi_module

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def small_thresholds(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def hot(spark, rows: int, name: str):
    """A third of all rows share one key."""
    return spark.range(0, rows, 1, 8).selectExpr(
        "CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS k", f"id AS {name}", f"sha2(string(id), 256) AS {name}_text"
    )


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_hot_left_key_of_a_left_join(spark, small_thresholds):
    right = spark.range(-1, 3000).selectExpr("id AS k", "id AS y")
    plan = final_plan(tw.equi_join(hot(spark, 60_000, "x"), right, ["k"], ["k"], "left"))
    assert "skew=true" in plan


def test_hot_left_key_against_an_aggregated_side(spark, small_thresholds):
    right = tw.pre_aggregate(hot(spark, 60_000, "y"), ["k"], {"y": "sum"})
    out = tw.equi_join(hot(spark, 60_000, "x"), right, ["k"], ["k"], "left", right_unique=True)
    assert "skew=true" in final_plan(out)


def test_hot_right_key_of_an_outer_join(spark, small_thresholds, monkeypatch):
    monkeypatch.setattr(equi_module, "HOT_ROWS", 5_000)
    left = spark.range(-1, 3000).selectExpr("id AS k", "id AS y")
    out = tw.equi_join(left, hot(spark, 60_000, "x"), ["k"], ["k"], "outer")
    assert "skew=true" in final_plan(out)
    # 20,000 rows match -1, the others only themselves, 1,000 left keys have none
    assert out.count() == 60_000 + 1_000


def test_a_left_join_without_hot_keys_reads_each_side_once(spark, small_thresholds, tmp_path):
    for name in ("l", "r"):
        hot(spark, 3_000, "x").write.parquet(str(tmp_path / name))
    left, right = (spark.read.parquet(str(tmp_path / n)) for n in ("l", "r"))
    for how in ("left", "right", "outer"):
        out = tw.equi_join(left, right, ["k"], ["k"], how)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 2 and plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("how", ["left", "right", "outer"])
def test_hot_keys_give_the_same_rows(spark, monkeypatch, how):
    left = spark.createDataFrame([(k % 7 if k % 9 else None, k) for k in range(200)], "k long, x long")
    right = spark.createDataFrame([(k % 11 if k % 4 else None, -k) for k in range(150)], "k long, y long")
    want = sorted(map(str, tw.equi_join(left, right, ["k"], ["k"], how).collect()))
    monkeypatch.setattr(equi_module, "HOT_ROWS", 12)
    assert sorted(map(str, tw.equi_join(left, right, ["k"], ["k"], how).collect())) == want


@pytest.mark.parametrize("how", ["left", "right", "outer"])
def test_more_hot_keys_than_are_named(spark, monkeypatch, how):
    """Too many hot keys to send to every task are joined like a table, with and without a directory."""
    left = spark.range(0, 600).selectExpr("if(id % 10 = 0, null, id % 7) AS k", "id AS x")
    right = spark.range(0, 400).selectExpr("if(id % 9 = 0, null, id % 5) AS k", "id AS y")
    want = sorted(map(str, tw.equi_join(left, right, ["k"], ["k"], how).collect()))
    monkeypatch.setattr(equi_module, "HOT_ROWS", 12)
    monkeypatch.setattr(equi_module, "MOST_NAMED", 2)
    assert sorted(map(str, tw.equi_join(left, right, ["k"], ["k"], how).collect())) == want
    counted = equi_module.stored_directory(equi_module.key_directory(left, right, ["k"], ["k"]))
    assert sorted(map(str, tw.equi_join(left, right, ["k"], ["k"], how, directory=counted).collect())) == want


def test_hot_key_of_an_anti_join(spark, small_thresholds):
    out = tw.unmatched(hot(spark, 60_000, "x"), spark.range(3000).toDF("k"), ["k"], ["k"])
    assert "skew=true" in final_plan(out)


def test_hot_key_of_an_asof_join(spark, small_thresholds, monkeypatch):
    monkeypatch.setattr(asof_module, "RANGE_ROWS", 5_000)
    left = hot(spark, 60_000, "x").selectExpr("'one' AS b", "k", "x", "x_text")
    right = spark.range(0, 60_000, 50).selectExpr("'one' AS c", "id - 2 AS r")
    out = tw.asof_join(left, right, "k", "r", ["b"], ["c"])
    assert "skew=true" in final_plan(out)
    assert out.where("k = -1 AND r = -2").count() == 20_000


def test_hot_tag_of_a_summary_anchored_at_its_first_row(spark, small_thresholds):
    df = spark.range(0, 90_000, 1, 8).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE string(id) END AS tag",
        "timestamp_seconds(id) AS timestamp", "double(id) AS value",
    )
    assert "skew=true" in final_plan(tw.summarize(df, "1d"))
