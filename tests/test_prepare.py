import random

import pytest
from pyspark.sql import functions as F

import tableweave as tw
from tableweave.errors import PlanError
from tableweave.operators import paging
from tableweave.functions.names import matches_any_name, match_keys_column, parse_name_list

from .conftest import at, only, rows


def test_names_then_projection_then_types(spark):
    df = spark.createDataFrame([(" 12 ", "2024-01-02", 3, "x")], "` ａ ` string, b string, c long, d string")
    out = tw.prepare(df, True, ["b", "a", "c"], {"a": "number", "b": "datetime", "c": "string", "z": "number"})
    assert out.columns == ["b", "a", "c"]
    assert rows(out) == [(at("2024-01-02"), 12.0, "3")]
    assert tw.prepare(df, False).columns == df.columns


def test_errors(spark):
    df = spark.createDataFrame([(1, 2)], "`a` long, `ａ` long")
    with pytest.raises(PlanError, match="duplicate"):
        tw.prepare(df)
    with pytest.raises(PlanError, match="not found"):
        tw.prepare(df, False, ["b"])
    with pytest.raises(PlanError, match="unknown type"):
        tw.prepare(df, False, types={"a": "date"})


def test_number_texts(spark):
    texts = [" 12 ", "1e3", "", "1,000", "1d", "1f", "NA", "nan", ".5", "5.", "-inf", "Infinity", "0x10", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    out = [r.v for r in tw.override_types(df, {"v": "number"}).orderBy("i").collect()]
    inf = float("inf")
    assert out == [12.0, 1000.0, None, None, None, None, None, None, 0.5, 5.0, -inf, inf, None, None]
    typed = spark.createDataFrame([(True, 1.5, float("nan"))], "a boolean, b double, c double")
    assert rows(tw.override_types(typed, {c: "number" for c in "abc"})) == [(1.0, 1.5, None)]


def test_datetime_texts(spark):
    forms = {
        "2024-01-02": at("2024-01-02"), "2024-01-02T03:04:05.5": at("2024-01-02 03:04:05.5"),
        "2024/1/2 3:04": at("2024-01-02 03:04"), "1/2/2024": at("2024-01-02"),
        "20240102": at("2024-01-02"), "2 Jan 2024": at("2024-01-02"), "Jan 2, 2024": at("2024-01-02"),
        "2024-13-01": None, "13/13/2024": None, "1-URGENT": None, "": None, "12:00": None,
    }
    df = spark.createDataFrame(list(enumerate(forms)), "i int, v string")
    out = [r.v for r in tw.override_types(df, {"v": "datetime"}).orderBy("i").collect()]
    assert out == list(forms.values())


def test_profile(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(1, "1", "2024-01-01", "a", 0.0, None, b"x"), (1, "2", "2024-01-02", "b" * 80, -0.0, None, b"x"),
         (2, None, "x" * 100, "b" * 80, nan, None, None)],
        "n long, num string, day string, text string, d double, none string, bin binary",
    )
    for approx in (False, True):
        found = {r.column: tuple(r)[1:] for r in tw.profile(df, approx).collect()}
        assert found["n"] == ("number", 0, 0.0, 2)
        assert found["num"] == ("number", 1, pytest.approx(1 / 3), 2)
        assert found["day"] == ("string", 0, 0.0, 3)
        assert found["text"] == ("string", 0, 0.0, 2)
        assert found["d"] == ("number", 1, pytest.approx(1 / 3), 1)
        assert found["none"] == ("string", 3, 1.0, 0)
        assert found["bin"] == ("string", 1, pytest.approx(1 / 3), 1)
    for approx in (False, True):
        empty = {r.column: tuple(r)[1:] for r in tw.profile(df.limit(0), approx).collect()}
        assert empty["n"] == ("number", 0, 0.0, 0) and empty["text"] == ("string", 0, 0.0, 0)


def test_type_inference_needs_nine_of_ten(spark):
    df = spark.createDataFrame(
        [("1" if i < 9 else "x", "1" if i < 8 else "x", "2024-01-01" if i else "?", None, True) for i in range(10)],
        "a string, b string, c string, d string, e boolean",
    )
    assert {r.column: r.inferred_type for r in tw.infer_types(df).collect()} == {
        "a": "number", "b": "string", "c": "datetime", "d": "string", "e": "number",
    }


def test_pages(spark):
    df = spark.range(1, 11).toDF("id")
    assert [r.id for r in tw.page(df, ["id"], 1, 4).collect()] == [5, 6, 7, 8]
    assert only(tw.page_count(df, 4)) == {"rows": 10, "pages": 3}
    assert [r.id for r in tw.page(df, ["id"], "x", "y").collect()] == list(range(1, 11))
    assert [r.id for r in tw.page(df, ["id"], size=3, after=[8]).collect()] == [9, 10]
    assert only(tw.page_count(df.limit(0))) == {"rows": 0, "pages": 0}
    with pytest.raises(PlanError):
        tw.page(df, [])


def test_pages_behind_a_row_with_nulls(spark):
    data = [(None, 1), (None, 2), (1, 1), (1, None), (2, 0)]
    df = spark.createDataFrame(data, "a int, b int")
    whole = [tuple(r) for r in tw.page(df, ["a", "b"], size=10).collect()]
    for i, row in enumerate(whole):
        rest = [tuple(r) for r in tw.page(df, ["a", "b"], size=10, after=row).collect()]
        assert rest == whole[i + 1:]


def test_pages_far_from_the_first(spark, monkeypatch):
    """Hot values, nulls and pages across their edges; tiny limits force the counting."""
    monkeypatch.setattr(paging, "KEEP_ROWS", 30)
    monkeypatch.setattr(paging, "CUTS", 4)
    rng = random.Random(2)
    day = lambda: rng.choice([None, "2024-01-05", "2024-01-05", f"2024-02-{rng.randrange(10, 28)}"])
    data = [(day(), rng.choice([None, 7.0, 7.0, rng.random()]), i) for i in range(400)]
    df = spark.createDataFrame(data, "d string, x double, id long")
    whole = sorted(data, key=lambda r: [(r[0] is not None, r[0] or ""), (r[1] is not None, r[1] or 0), r[2]])
    for number in (0, 5, 13, 17, 22, 39, 40):
        found = [tuple(r) for r in tw.page(df, ["d", "x", "id"], number, 10).collect()]
        assert sorted(found, key=lambda r: r[2]) == sorted(
            whole[number * 10:number * 10 + 10], key=lambda r: r[2]
        ), number


def test_name_lists():
    assert parse_name_list("温度、圧力， 流量；ﾚﾍﾞﾙ\n温度") == ("温度", "圧力", "流量", "レベル")
    assert parse_name_list("a\tA;b,,") == ("a", "b")
    assert parse_name_list(None) == () and parse_name_list("￥x") == ("\\x",)


def test_any_name_matches_in_both_directions(spark):
    df = spark.createDataFrame(
        [(1, ["Pump Trip"]), (2, ["ＰＵＭＰ"]), (3, ["valve"]), (4, []), (5, None), (6, [" "])],
        "id int, names array<string>",
    )
    hit = lambda required: [
        r.id for r in df.where(matches_any_name(match_keys_column("names"), required)).collect()
    ]
    assert hit(["pump"]) == [1, 2]
    assert hit(["Pump Trip High", "x"]) == [1, 2]
    assert hit([]) == hit([" "]) == [1, 2, 3, 4, 5, 6]


def test_page_directory(spark):
    """Every page equals the plain sort's; a page reads the parts that hold it, wherever it lies."""
    rows_ = [(None if i % 7 == 0 else i % 5, i, f"text {i}") for i in range(1_000)]
    df = spark.createDataFrame(rows_, "a int, b long, __x string").repartition(3)
    directory = tw.page_directory(df, ["a", "b"], part_rows=90)
    whole = [tuple(r) for r in df.orderBy(F.col("a").asc_nulls_first(), "b").collect()]
    assert (directory.rows, directory.pages(30)) == (1_000, 34)
    for number in (0, 3, 5, 17, 32, 33):
        found = directory.page(number, 30)
        assert [tuple(r) for r in found.collect()] == whole[number * 30 : number * 30 + 30]
        assert len({f.rsplit("/", 2)[1] for f in found.inputFiles()}) <= 2
    assert directory.page(34, 30).collect() == [] and directory.page(34, 30).columns == df.columns
    assert [tuple(r) for r in directory.page(0, 1_000).collect()] == whole
    empty = tw.page_directory(df.limit(0), ["a", "b"])
    assert (empty.rows, empty.pages(), empty.page(0).collect()) == (0, 0, [])
    with pytest.raises(PlanError):
        tw.page_directory(df, [])


def test_page_directory_small_parts_share_folders(spark, monkeypatch):
    """Tasks and folders follow the rows, not the parts: 500 parts lie in the folders of 8 tasks."""
    df = spark.range(0, 1_000).select((F.col("id") * 7 % 1_000).alias("a"), F.col("id").cast("string").alias("b"))
    directory = tw.page_directory(df, ["a"], part_rows=2)
    assert directory.starts.count() >= 500 and directory.starts.agg(F.max("rows")).first()[0] == 2
    assert directory.starts.select("folder").distinct().count() <= 8
    whole = [tuple(r) for r in df.orderBy("a").collect()]
    for number in (0, 4, 17, 33):
        assert [tuple(r) for r in directory.page(number, 30).collect()] == whole[number * 30 : number * 30 + 30]
    monkeypatch.setattr(paging, "FOLDER_ROWS", 50)
    assert 8 < tw.page_directory(df, ["a"], part_rows=2).starts.select("folder").distinct().count() <= 20


def test_page_directory_pages_of_equal_keys(spark):
    """Where the order does not tell rows apart, pages still hold each row once."""
    df = spark.range(0, 300).select((F.col("id") % 2).alias("a"), "id")
    directory = tw.page_directory(df, ["a"], part_rows=7)
    found = [r for number in range(directory.pages(60)) for r in directory.page(number, 60).collect()]
    assert sorted(r.id for r in found) == list(range(300)) and [r.a for r in found] == [0] * 150 + [1] * 150
