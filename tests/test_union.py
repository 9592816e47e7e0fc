import decimal

import pytest

import tableweave as tw
from tableweave.errors import PlanError
from tableweave.operators.union import DROP, KEEP_AS_NEW

from .conftest import only, rows


def sales(spark):
    left = spark.createDataFrame(
        [("C1", "2024-01-01", 10), ("C2", "2024-01-02", 20)],
        "customer_id string, order_date string, amount long",
    )
    right = spark.createDataFrame(
        [("C3", "2024-02-01", 30, "n")], "cust_id string, date string, amt long, note string"
    )
    return left, right


MAPPING = {"cust_id": "customer_id", "date": "order_date", "amt": "amount", "note": KEEP_AS_NEW}


def test_mapping_and_new_column(spark):
    left, right = sales(spark)
    out = tw.union_mapped(left, right, MAPPING)
    assert out.columns == ["customer_id", "order_date", "amount", "note"]
    assert rows(out)[-1] == ("C3", "2024-02-01", 30, "n") and rows(out)[0][3] is None
    report = only(tw.union_report(left, right, tw.union_layout(left.columns, right.columns, MAPPING)))
    assert (report["output_rows"], report["left_match_rate"], report["right_match_rate"]) == (3, 1.0, 1.0)
    assert report["details"] == '{"dropped_columns": 0, "kept_new_columns": 1, "mapped_columns": 3}'
    assert report["warnings"] == ["union_always_matches"]


def test_defaults_drop_and_clashing_names(spark):
    left = spark.createDataFrame([(1, 2, 3)], "a long, b long, b_u long")
    right = spark.createDataFrame([(4, 5, 6, 7)], "a long, b long, c long, d long")
    out = tw.union_mapped(left, right, {"b": KEEP_AS_NEW, "c": DROP, "d": ""})
    assert out.columns == ["a", "b", "b_u", "b_u2", "d"]
    assert rows(out) == [(1, 2, 3, None, None), (4, None, None, 5, 7)]


def test_source_column_and_its_clash(spark):
    left, right = sales(spark)
    out = tw.union_mapped(left, right, MAPPING, source_column="note", source_value="feb")
    assert out.columns == ["customer_id", "order_date", "amount", "note_src", "note"]
    assert [r[3] for r in rows(out)] == ["current_result", "current_result", "feb"]


@pytest.mark.parametrize("types, values, want", [
    (("bigint", "double"), (1, 2.5), ["1.0", "2.5"]),
    (("int", "bigint"), (1, 2), ["1", "2"]),
    (("bigint", "string"), (1, "x"), ["1", "x"]),
    (("decimal(5,2)", "int"), (decimal.Decimal("1.25"), 3), ["1.25", "3.00"]),
    (("boolean", "bigint"), (True, 3), ["3", "true"]),
])
def test_types_meet(spark, types, values, want):
    left = spark.createDataFrame([(values[0],)], f"a {types[0]}")
    right = spark.createDataFrame([(values[1],)], f"a {types[1]}")
    out = tw.union_mapped(left, right)
    assert sorted(r[0] for r in out.selectExpr("cast(a as string)").collect()) == want


def test_union_does_not_shuffle(spark):
    left, right = sales(spark)
    plan = tw.union_mapped(left, right, MAPPING)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_wrong_mappings(spark):
    left, right = sales(spark)
    for mapping in ({"amt": "nope"}, {"amt": "amount", "note": "amount"}, {"nope": "amount"}):
        with pytest.raises(PlanError):
            tw.union_mapped(left, right, mapping)
