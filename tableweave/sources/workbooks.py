"""Excel workbooks (.xlsx): a folder of them, one task per workbook."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions.names import header_names
from .csvfiles import NULL_TOKENS, infer_columns

# Fixed values of the file format: number formats that show a date, and day zero.
DATE_FORMATS = {*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)}
DAY_ZERO, DAY_ZERO_1904 = datetime(1899, 12, 30), datetime(1904, 1, 1)
BATCH_ROWS = 10_000
CELLS_SCHEMA = "path string, sheet string, row_number int, cells array<string>"


def sheet_names(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, position) of every workbook."""

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (path, name, i)
                for path, content in zip(batch["path"], batch["content"])
                for i, (name, _) in enumerate(_sheets(zipfile.ZipFile(io.BytesIO(content))))
            ]
            yield pd.DataFrame(rows, columns=["path", "sheet", "position"])

    return _files(spark, path).mapInPandas(names, "path string, sheet string, position int")


def read_cells(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Cell texts per row, blank rows left out."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows: list[tuple] = []
                for row in _rows(name, content, sheet):
                    rows.append(row)
                    if len(rows) == BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=["path", "sheet", "row_number", "cells"])
                        rows = []
                yield pd.DataFrame(rows, columns=["path", "sheet", "row_number", "cells"])

    return _files(spark, path).mapInPandas(cells, CELLS_SCHEMA)


def read_workbooks(
    spark: SparkSession,
    path: str,
    sheet: str | None = None,
    header_row: int = 1,
    infer: bool = True,
    rows: int | None = None,
) -> DataFrame:
    """One table from the same sheet of all workbooks, which share one header."""
    cells = read_cells(spark, path, sheet)
    found = cells.where(F.col("row_number") == header_row).orderBy("path").limit(1).collect()
    if not found:
        raise PlanError(f"no header row {header_row} in the workbooks under {path}")
    names = header_names(found[0].cells)
    body = cells.where(F.col("row_number") > header_row)
    values = [F.get("cells", F.lit(i)) for i in range(len(names))]
    df = body.select(*(
        F.when(~v.isin(*NULL_TOKENS), v).alias(f"c{i}") for i, v in enumerate(values)
    )).toDF(*names)
    if rows is not None:
        df = df.limit(rows)
    return infer_columns(df) if infer else df


def _files(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx")
    return reader.load(path).select("path", "content")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of every sheet, in workbook order."""
    links = {
        r.get("Id"): r.get("Target")
        for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    }
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    out = []
    for node in root.iter():
        if _local(node.tag) == "sheet":
            link = next(v for k, v in node.attrib.items() if _local(k) == "id")
            target = links[link]
            part = target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)
            out.append((node.get("name"), posixpath.normpath(part)))
    return out


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    texts = []
    with book.open("xl/sharedStrings.xml") as part:
        for _, node in ElementTree.iterparse(part):
            if _local(node.tag) == "si":
                texts.append(_text(node))
                node.clear()
    return texts


def _text(node) -> str:
    """Text of a string item; phonetic guides are not part of it."""
    if _local(node.tag) == "t":
        return node.text or ""
    return "".join(_text(child) for child in node if _local(child.tag) != "rPh")


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    dated = set(DATE_FORMATS)
    styles: set[int] = set()
    for node in root.iter():
        if _local(node.tag) == "numFmt":
            code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", node.get("formatCode", ""))
            if re.search(r"[ymdhs]", code, re.IGNORECASE) and "General" not in code:
                dated.add(int(node.get("numFmtId")))
    for node in root:
        if _local(node.tag) == "cellXfs":
            styles = {i for i, x in enumerate(node) if int(x.get("numFmtId", 0)) in dated}
    return styles


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _rows(path: str, content: bytes, sheet: str | None) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        sheets = dict(_sheets(book))
        name = sheet or next(iter(sheets))
        if name not in sheets:
            raise PlanError(f"{path} has no sheet {name!r}")
        texts, dated = _shared_texts(book), _date_styles(book)
        zero = DAY_ZERO_1904 if b'date1904="1"' in book.read("xl/workbook.xml") else DAY_ZERO
        position = 0
        with book.open(sheets[name]) as part:
            for _, node in ElementTree.iterparse(part):
                if _local(node.tag) != "row":
                    continue
                position = int(node.get("r", position + 1))
                cells: list[str | None] = []
                for cell in node:
                    place = cell.get("r")
                    at = _column_number(place) if place else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = _value(cell, texts, dated, zero)
                node.clear()
                if any(c not in (None, "") for c in cells):
                    yield path, name, position, cells


def _value(cell, texts: list[str], dated: set[int], zero: datetime) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(_text(c) for c in cell if _local(c.tag) == "is")
    raw = next((c.text for c in cell if _local(c.tag) == "v"), None)
    if raw is None:
        return None
    if kind == "s":
        return texts[int(raw)]
    if kind == "b":
        return "True" if raw == "1" else "False"
    if kind == "n" and int(cell.get("s", -1)) in dated:
        moment = zero + timedelta(microseconds=round(float(raw) * 86_400_000_000))
        return str(moment)
    if kind == "e":
        return None
    return raw
