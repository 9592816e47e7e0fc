import csv
import hashlib
import random
import re
import zipfile

import numpy as np
import pytest

from tableweave.errors import PlanError
from tableweave.sources.csvfiles import CsvOptions, detect_csv, read_csv, write_csv
from tableweave.sources.csvrecords import line_effects, states_after
from tableweave.sources.jdbc import (
    Database, limited_query, read_options, sample_query, tables_query,
)
from tableweave.sources import manifest as manifest_module
from tableweave.sources.manifest import append_log, distinct_inputs, file_manifest
from tableweave.sources.workbooks import read_workbooks, sheet_names

from .conftest import rows

PLAIN = CsvOptions("utf-8", ",", '"')


@pytest.fixture
def java_charsets(spark):
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    yield
    spark.conf.unset("spark.sql.legacy.javaCharsets")


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_types_null_texts_and_quotes(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,x,flag,note\n1,1.5,True,"a, ""b"""\n2,NA,False,n/a\n3,1e3,,007\n')
    df = read_csv(spark, path, PLAIN)
    assert df.dtypes == [("id", "bigint"), ("x", "double"), ("flag", "boolean"), ("note", "string")]
    assert rows(df) == [(1, 1.5, True, 'a, "b"'), (2, None, False, None), (3, 1000.0, None, "007")]
    raw = read_csv(spark, path, PLAIN, null_tokens=False, infer=False)
    assert rows(raw)[1] == ("2", "NA", "False", "n/a")
    assert read_csv(spark, path, PLAIN, rows=2).count() == 2


def test_file_names_with_blanks(spark, tmp_path):
    folder = tmp_path / "my files"
    folder.mkdir()
    write(folder / "a 1%.csv", "id,v\n1,x\n")
    assert rows(read_csv(spark, str(folder), PLAIN)) == [(1, "x")]
    write(folder / "b é.csv", "id;v\n2;y\n3;z\n")
    assert rows(read_csv(spark, str(folder))) == [(1, "x"), (2, "y"), (3, "z")]


def test_header_names(spark, tmp_path):
    path = write(tmp_path / "a.csv", "﻿a,a,,b.c,a\n1,2,3,4,5\n")
    df = read_csv(spark, path, PLAIN)
    assert df.columns == ["a", "a.1", "Unnamed: 2", "b.c", "a.2"]
    assert rows(df) == [(1, 2, 3, 4, 5)]


def test_header_on_a_later_row_of_every_file(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        write(folder / f"{i}.csv", f"title\n\nmore,text\nid;v\n{i};x{i}\n{i};id;v\n".replace("\nmore", "\n\nmore"))
    df = read_csv(spark, str(folder), CsvOptions("utf-8", ";", '"', 3))
    assert df.columns == ["id", "v"]
    assert rows(df) == [(0, "id"), (0, "x0"), (1, "id"), (1, "x1"), (2, "id"), (2, "x2")]
    with pytest.raises(PlanError):
        read_csv(spark, str(folder), CsvOptions("utf-8", ";", '"', 30))


def test_header_on_a_later_row_of_a_split_file(spark, tmp_path):
    body = "".join(f"{i},row {i}\n" for i in range(5000))
    path = write(tmp_path / "big.csv", "title\nid,name\n" + body)
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "8k")
    try:
        df = read_csv(spark, path, CsvOptions("utf-8", ",", '"', 2))
        assert df.rdd.getNumPartitions() > 1
        assert (df.count(), df.selectExpr("sum(id)").first()[0]) == (5000, sum(range(5000)))
        found = detect_csv(spark, path).collect()
        assert [(r.encoding, r.delimiter) for r in found] == [("utf-8", ",")]
    finally:
        spark.conf.set(key, before)


def test_detection_and_mixed_folder(spark, tmp_path, java_charsets):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.csv", "id,name\n1,ascii\n")
    write(folder / "b.csv", "﻿id\tname\n2\t日,本\n3\ty\n")
    # the only characters outside ASCII come after many plain lines
    write(folder / "c.csv", "id;name\n" + "4;z\n" * 2000 + "5;日本\n", "cp932")
    write(folder / "d.csv", "id|name\n6|'é'\n7|'a'\n", "latin1")
    found = {r.path.rsplit("/")[-1]: (r.encoding, r.delimiter) for r in detect_csv(spark, str(folder)).collect()}
    assert found == {
        "a.csv": ("utf-8", ","), "b.csv": ("utf-8", "\t"), "c.csv": ("cp932", ";"),
        "d.csv": ("latin1", "|"),
    }
    df = read_csv(spark, str(folder), CsvOptions())
    assert df.columns == ["id", "name"] and df.count() == 2006
    names = {r.id: r.name for r in df.collect()}
    assert (names[1], names[5], names[6]) == ("ascii", "日本", "é")


def test_encodings_that_need_a_setting(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id\n1\n", "cp932")
    with pytest.raises(PlanError, match="javaCharsets"):
        read_csv(spark, path, CsvOptions("cp932", ",", '"'))
    with pytest.raises(PlanError, match="unknown encoding"):
        read_csv(spark, path, CsvOptions("klingon", ",", '"'))


def test_no_quoting(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,v\n1,"x\n2,y"\n')
    assert rows(read_csv(spark, path, CsvOptions("utf-8", ",", "none"))) == [(1, '"x'), (2, 'y"')]


def test_sink_reads_back(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 'a "b", c', None, True), (2, "", 1.5, False)], "id long, v string, x double, f boolean"
    ).selectExpr("*", "timestamp_ntz'2024-01-02 03:04:05' AS t")
    path = str(tmp_path / "out")
    write_csv(df.coalesce(1), path)
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert text == (
        'id,v,x,f,t\n1,"a ""b"", c",,True,2024-01-02 03:04:05\n2,,1.5,False,2024-01-02 03:04:05\n'
    )
    assert rows(read_csv(spark, path, PLAIN))[0] == (1, 'a "b", c', None, True, "2024-01-02 03:04:05")


def test_sink_replaces_what_the_encoding_lacks(spark, tmp_path, java_charsets):
    write_csv(spark.createDataFrame([("日本🙂",)], "v string").coalesce(1), str(tmp_path / "out"), "cp932")
    data = next((tmp_path / "out").glob("*.csv")).read_bytes()
    assert data.decode("cp932").startswith("v\n日本?")


# ------------------------------------------------------------------- workbooks

BOOK = {
    "xl/workbook.xml": (
        '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
        'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
        '<sheet name="First" sheetId="1" r:id="rId1"/><sheet name="Other" sheetId="2" r:id="rId2"/>'
        "</sheets></workbook>"
    ),
    "xl/_rels/workbook.xml.rels": (
        '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
        '<Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>'
    ),
    "xl/sharedStrings.xml": (
        '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
        "<si><t>id</t></si><si><r><t>na</t></r><r><t>me</t></r><rPh><t>x</t></rPh></si><si><t>day</t></si></sst>"
    ),
    "xl/styles.xml": (
        '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
        '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>'
    ),
}


def sheet(*lines):
    return (
        '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
        + "".join(lines) + "</sheetData></worksheet>"
    )


def make_book(path, number):
    first = sheet(
        '<row r="1"><c r="A1" t="inlineStr"><is><t>title</t></is></c></row>',
        '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="C2" t="s"><v>2</v></c></row>',
        f'<row r="3"><c r="A3"><v>{number}</v></c><c r="C3" s="1"><v>45293.5</v></c></row>',
        f'<row r="5"><c r="A5"><v>{number}.5</v></c><c r="B5" t="inlineStr"><is><t>n{number}</t></is></c></row>',
    )
    other = sheet('<row r="1"><c r="A1" t="b"><v>1</v></c></row>')
    with zipfile.ZipFile(path, "w") as book:
        for name, text in BOOK.items():
            book.writestr(name, text)
        book.writestr("xl/worksheets/sheet1.xml", first)
        book.writestr("xl/worksheets/sheet2.xml", other)


def test_workbooks(spark, tmp_path):
    for i in (1, 2):
        make_book(tmp_path / f"{i}.xlsx", i)
    df = read_workbooks(spark, str(tmp_path), header_row=2)
    assert df.dtypes == [("id", "double"), ("name", "string"), ("day", "string")]
    assert rows(df) == [
        (1.0, None, "2024-01-02 12:00:00"), (1.5, "n1", None),
        (2.0, None, "2024-01-02 12:00:00"), (2.5, "n2", None),
    ]
    assert sorted({(r.sheet, r.position) for r in sheet_names(spark, str(tmp_path)).collect()}) == [
        ("First", 0), ("Other", 1)]
    assert read_workbooks(spark, str(tmp_path), "Other").columns == ["True"]
    with pytest.raises(Exception, match="no sheet"):
        read_workbooks(spark, str(tmp_path), "Nope")


# --------------------------------------------------------------------- databases


def test_addresses():
    base = {"host": "h", "database": "d", "username": "u", "password": "p"}
    urls = {k: Database.from_options({"dbms": k, **base}).options()["url"]
            for k in ("sqlserver", "mysql", "oracle", "postgresql")}
    assert urls == {
        "sqlserver": "jdbc:sqlserver://h:1433;databaseName=d;trustServerCertificate=true",
        "mysql": "jdbc:mysql://h:3306/d", "oracle": "jdbc:oracle:thin:@//h:1521/d",
        "postgresql": "jdbc:postgresql://h:5432/d",
    }
    assert Database.from_options({"dbms": "sqlite", "sqlite_path": "/x.db"}).options() == {"url": "jdbc:sqlite:/x.db"}
    own = Database.from_options({"dbms": "mysql", "port": "99", **base})
    assert own.options() == {"url": "jdbc:mysql://h:99/d", "user": "u", "password": "p"}
    assert "p'" not in repr(own)
    for options in ({"dbms": "mysql"}, {"dbms": "sqlite"}, {"dbms": "oracle", "host": "h"}):
        with pytest.raises(PlanError):
            Database.from_options(options).check()


def test_queries_per_database():
    assert limited_query("sqlserver", "SELECT 1; ", 5) == "SELECT TOP (5) * FROM (SELECT 1) AS src"
    assert limited_query("oracle", "SELECT 1", 5) == "SELECT * FROM (SELECT 1) src WHERE ROWNUM <= 5"
    assert limited_query("mysql", "SELECT 1", 0) == "SELECT * FROM (SELECT 1) AS src LIMIT 1"
    assert limited_query("mysql", "SELECT 1", None) == "SELECT 1"
    assert sample_query("sqlserver", "dbo.[a]", 3) == "SELECT TOP (3) * FROM [dbo].[a]"
    assert sample_query("mysql", "a") == "SELECT * FROM `a` LIMIT 1000"
    assert sample_query("oracle", "s.t.u", 0) == 'SELECT * FROM "s"."t.u" FETCH FIRST 1 ROWS ONLY'
    assert "table_schema = 'public'" in tables_query(Database("postgresql"))
    assert "owner = 'BOB'" in tables_query(Database("oracle", username="bob"))
    for wrong in ("", " ; "):
        with pytest.raises(PlanError):
            limited_query("mysql", wrong, 1)
    with pytest.raises(PlanError):
        sample_query("mysql", "[]")


def test_read_options():
    db = Database("postgresql", url="jdbc:x")
    assert read_options(db, "SELECT 1") == {"url": "jdbc:x", "query": "SELECT 1"}
    assert read_options(db, "SELECT 1", partition_column="id", bounds=(0, 9), partitions=3) == {
        "url": "jdbc:x", "dbtable": "(SELECT 1) t", "partitionColumn": "id", "lowerBound": "0",
        "upperBound": "9", "numPartitions": "3",
    }
    with pytest.raises(PlanError):
        read_options(db, "SELECT 1", partition_column="id")


# ---------------------------------------------------------------------- manifest


def test_manifest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest_module, "CHUNK_BYTES", 1000)
    data = {"a.csv": b"small", "b.csv": b"small", "big one.csv": b"x" * 5000}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    files = file_manifest(spark, str(tmp_path))
    found = {r.length: (r.sha256, r.table_id) for r in files.collect()}
    for content in data.values():
        digest = hashlib.sha256(content).hexdigest()
        assert found[len(content)] == (digest, "tbl_" + digest[:10])
    copies = {r.length: (r.copies, r.path.rsplit("/")[-1]) for r in distinct_inputs(files).collect()}
    assert copies[5] == (2, "a.csv") and copies[5000][0] == 1


def test_log(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(2):
        append_log(spark.range(1).selectExpr(f"{i} AS run"), path)
    assert sorted(r.run for r in spark.read.json(path).collect()) == [0, 1]


def test_csv_headers_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,c\n3,4\n")
    plain = CsvOptions("utf-8", ",", '"')
    with pytest.raises(PlanError, match="different headers"):
        read_csv(spark, str(tmp_path), plain)
    (tmp_path / "b.csv").write_bytes(b'\xef\xbb\xbf"a",b\n3,4\n')
    assert sorted(tuple(r) for r in read_csv(spark, str(tmp_path), plain).collect()) == [(1, 2), (3, 4)]
    with pytest.raises(PlanError, match="row 3"):
        read_csv(spark, str(tmp_path), CsvOptions("utf-8", ",", '"', 3))


def test_columns_in_another_order(spark, tmp_path):
    """Many spellings and orders of one header; values go by name."""
    for i in range(70):
        (tmp_path / f"{i}.csv").write_text(f'"a",b{" " * 0},"c"\n{i},"x\n{i}",c{i}\n' if i % 2 else f"c,{'a' if i % 4 else chr(34) + 'a' + chr(34)},b\nc{i},{i},y{i}\n")
    got = rows(read_csv(spark, str(tmp_path), PLAIN))
    assert got == [(i, f"x\n{i}" if i % 2 else f"y{i}", f"c{i}") for i in range(70)]


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "2k")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("header_row", [1, 3])
def test_line_breaks_in_quotes_over_many_splits(spark, tmp_path, small_splits, header_row):
    """Against Python's reader: records longer than a split, quotes in text, empty fields, blank lines."""
    rng = random.Random(header_row)
    words = ["a", "b,c", 'say ""hi""', "line\nbreak", "\n\n", "", "é", '""', "x" * 40]
    lines = ["title, of the file", "", "more"][: header_row + (header_row > 1) - 1]
    lines.append("id,text,note")
    for i in range(600):
        long = 'word ""q"",\n' * rng.randrange(400) if i in (100, 101, 350) else ""
        quoted = "".join(rng.choice(words) for _ in range(rng.randrange(5)))
        plain = rng.choice(["n", "5\" wide", "it''s", "", "a \"b\" c"])
        lines.append(f'{i},"{long}{quoted}",{plain}')
        if rng.random() < 0.1:
            lines.append("")
    for i in range(600, 700):
        lines.append(f"{i},no quotes here,n")
    for end, name in (("\n", "a.csv"), ("\r\n", "b.csv")):
        (tmp_path / name).write_bytes((end.join(lines) + end).encode())
    want = []
    for name in ("a.csv", "b.csv"):
        with open(tmp_path / name, newline="") as f:
            got = [tuple(r) for r in csv.reader(f) if r]
        want += got[header_row:]
    df = read_csv(spark, str(tmp_path), CsvOptions("utf-8", ",", '"', header_row), null_tokens=False, infer=False)
    assert df.columns == ["id", "text", "note"] and df.rdd.getNumPartitions() > 20
    read = sorted(tuple(v or "" for v in r) for r in df.collect())
    assert read == sorted(want) and len(read) == 1400


def test_effects_of_lines():
    """Line by line against a plain walk over the characters."""
    rng = random.Random(1)

    def walk(line, inside):
        i, start = 0, True
        while i < len(line):
            c = line[i]
            if inside and c == '"':
                if line[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    inside = False
            elif not inside and c == '"' and start:
                inside = True
            start = not inside and c == ","
            i += 1
        return inside

    lines = ["".join(rng.choice('ab,"""') for _ in range(rng.randrange(9))) for _ in range(3000)]
    data = np.frombuffer("".join(lines).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lines])))
    sets, odd = line_effects(data, offsets, ",", '"')
    for line, s, o in zip(lines, sets, odd):
        for inside in (0, 1):
            # What follows a closed quote is text; plain walk and parity agree where fields are well formed.
            if not re.search(r'"[^",]+"|"{2,}[^",]|[^",]"{2}', line):
                assert walk(line, bool(inside)) == bool(o if s else inside ^ o), (line, inside)
    state = 1
    for s, o, after in zip(sets, odd, states_after(sets, odd, 1)):
        state = int(o) if s else state ^ int(o)
        assert state == after


def test_quote_never_closed(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,b\n1,"x\n2,y\n')
    with pytest.raises(PlanError, match="not closed"):
        read_csv(spark, path, PLAIN)
    assert read_csv(spark, path, PLAIN, multiline=False).count() == 2


def test_charsets_told_apart(spark, tmp_path):
    japanese = "名前,値\n" + "".join(f"{i},これは日本語の文章です。カタカナと漢字を含みます\n" for i in range(30))
    texts = {
        "euc_jp": japanese, "cp932": japanese, "utf-16le": japanese, "utf-16be": japanese,
        "gb18030": "名称,值\n" + "1,这是一个中文的文本我们在这里写一些常用的汉字\n" * 5,
        "big5": "名稱,值\n" + "1,這是一個中文的文本我們在這裡寫一些常用的漢字\n" * 5,
        "euc_kr": "이름,값\n" + "1,이것은 한국어로 쓴 문장입니다\n" * 5,
        "windows-1252": "name,value\n1,“élève” – œuvre à 5 €\n2,naïve\n", "latin1": "name,value\n1,élève à Genève\n2,naïve ±\n",
        "utf-8": japanese,
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode(name))
    found = {r.path.rsplit("/")[-1]: r.encoding for r in detect_csv(spark, str(tmp_path)).collect()}
    assert found == {f"{n}.csv": n for n in texts}
    for name, text in texts.items():
        if name != "cp932":  # needs a setting
            df = read_csv(spark, str(tmp_path / f"{name}.csv"), infer=False)
            want = list(csv.reader(text.splitlines()))
            assert df.columns == want[0] and sorted(map(list, df.collect())) == sorted(want[1:])


def test_no_charset_fits(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"id,v\n1,\x80\x81\xff\xfe\x8d\n")
    with pytest.raises(PlanError, match="no known encoding"):
        read_csv(spark, str(tmp_path))
