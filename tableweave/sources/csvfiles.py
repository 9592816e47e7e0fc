"""CSV files: option detection, scan and sink."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import PlanError
from ..functions.columns import col, is_number_text
from ..functions.names import header_names
from . import charsets
from .csvrecords import RECORD, blocks_inside_quotes, cut_records, joined_fragments, raw_lines

# Delimiters looked for, and the texts a field may hold for "no value".
DELIMITERS = (",", "\t", ";", "|")
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
SNIFF_LINES = 10

# Java names of encodings; the last two need spark.sql.legacy.javaCharsets.
JAVA_CHARSETS = {
    "utf-8": "UTF-8", "utf8": "UTF-8", "utf_8": "UTF-8", "utf-8-sig": "UTF-8",
    "utf_8_sig": "UTF-8", "ascii": "US-ASCII", "latin1": "ISO-8859-1",
    "iso-8859-1": "ISO-8859-1", "cp932": "windows-31j", "shift_jis": "Shift_JIS",
}
LEGACY_CHARSETS = ("windows-31j", "Shift_JIS")


@dataclass(frozen=True)
class CsvOptions:
    """How to read CSV files; "auto" is detected, quotechar "none" turns quoting off."""

    encoding: str = "auto"
    delimiter: str = "auto"
    quotechar: str = "auto"
    header_row: int = 1


def java_charset(spark: SparkSession, encoding: str) -> str:
    name = JAVA_CHARSETS.get(encoding.strip().lower())
    if name is None:
        raise PlanError(f"unknown encoding: {encoding}")
    if name in LEGACY_CHARSETS and (
        spark.conf.get("spark.sql.legacy.javaCharsets", "false").lower() != "true"
    ):
        raise PlanError(f"encoding {encoding} needs spark.sql.legacy.javaCharsets=true")
    return name


# --------------------------------------------------------------------- detection


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines as raw bytes without their LF, with their file and block."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("line"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def _head(lines: DataFrame, count: int) -> DataFrame:
    """The first lines of every file. They lie in its first block, within which the
    generated id grows line by line."""
    order = Window.partitionBy("path").orderBy("id")
    return (
        lines.where(F.col("block") == 0)
        .withColumn("id", F.monotonically_increasing_id())
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= count)
    )


def detect_csv(spark: SparkSession, path: str) -> DataFrame:
    """Per file: encoding, delimiter and quote character.

    Encodings are judged on every line, so a file of any size is split over tasks; only
    lines that are not valid UTF-8 pass through Python. A byte-order mark needs no name of
    its own: the readers drop it. Delimiter and quote come from the first ten lines that are
    not blank, of twice as many. An
    encoding that none of ``charsets.CANDIDATES`` explains is null.
    """
    lines = _lines(spark, path)
    odd = lines.where(~F.is_valid_utf8(F.col("line").cast("string")))
    filled = F.length(F.trim(F.col("line").cast("string"))) > 0
    files = lines.where(filled).groupBy("path").agg(F.count(F.lit(1)).alias("lines"))
    judged = charsets.judged(odd.select("path", "line"))
    heads = (
        _head(lines, 2 * SNIFF_LINES)
        .groupBy("path")
        .agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("head"))
        .select("path", F.col("head.line").alias("head"))
    )

    def sniff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            starts = [b"\n".join(map(bytes, h)) for h in batch["head"]]
            encodings = [charsets.wide_form(s) or e for s, e in zip(starts, batch["encoding"])]
            found = [_sniff(s, e) for s, e in zip(starts, encodings)]
            out = batch[["path"]].copy()
            out["encoding"] = encodings
            out["delimiter"] = [d for d, _ in found]
            out["quotechar"] = [q for _, q in found]
            yield out

    known = files.join(heads, "path").join(judged, "path", "left")
    encoding = F.when(F.col("judged").isNull(), "utf-8").otherwise(F.col("judged.encoding"))
    return known.select("path", "head", encoding.alias("encoding")).mapInPandas(
        sniff, "path string, encoding string, delimiter string, quotechar string"
    )


def _sniff(start: bytes, encoding: str | None) -> tuple[str, str]:
    """Delimiter and quote of the first lines that are not blank."""
    text = start.decode(encoding or "latin1", "replace").removeprefix("\ufeff")
    text = "\n".join([line for line in text.splitlines() if line.strip()][:SNIFF_LINES])
    try:
        dialect = csv.Sniffer().sniff(text, "".join(DELIMITERS))
    except csv.Error:
        return ",", '"'
    return dialect.delimiter or ",", dialect.quotechar or '"'


# -------------------------------------------------------------------------- scan


def read_csv(
    spark: SparkSession,
    path: str,
    options: CsvOptions = CsvOptions(),
    null_tokens: bool = True,
    infer: bool = True,
    rows: int | None = None,
    multiline: bool = True,
) -> DataFrame:
    """Scan a CSV file or folder whose files have the same columns, in any order.

    Quoted fields may hold line breaks. Planning scans the files for such fields and for
    their headers; a form without line breaks, other orders of columns or rows above the
    header is then left to Spark's reader, all others are cut by ``csvrecords``. Files
    are split in both cases. ``multiline=False`` says that no field holds a line break,
    and saves the first of these scans. ``infer`` types whole columns from all rows in one
    aggregation; turn it off to get text and cast with ``prepare``.
    """
    if options.header_row < 1:
        raise PlanError("the header row counts from 1")
    if "auto" not in (options.encoding, options.delimiter, options.quotechar):
        df = _scan(spark, [path], options, multiline)
    else:
        df = _scan_detected(spark, path, options, multiline)
    if null_tokens:
        df = df.select(*(
            F.when(~col(n).isin(*NULL_TOKENS), col(n)).alias(n) for n in df.columns
        ))
    if rows is not None:
        df = df.limit(rows)
    return infer_columns(df) if infer else df


def _scan_detected(
    spark: SparkSession, path: str, options: CsvOptions, multiline: bool
) -> DataFrame:
    """One scan per set of detected options; a folder mostly has a single one."""
    pick = lambda name: (
        F.col(name) if getattr(options, name) == "auto" else F.lit(getattr(options, name)).alias(name)
    )
    found = detect_csv(spark, path).select(
        "path", pick("encoding"), pick("delimiter"), pick("quotechar")
    )
    forms = found.groupBy("encoding", "delimiter", "quotechar").agg(F.min("path").alias("path")).collect()
    if not forms:
        raise PlanError(f"no CSV lines under {path}")
    for form in forms:
        if form.encoding is None:
            raise PlanError(f"no known encoding fits {unquote(form.path)}; give one in the options")
    scans = []
    for form in forms:
        paths = [path]
        if len(forms) > 1:
            # The reader needs the names of its files, as any file listing does.
            same = [F.col(n).eqNullSafe(F.lit(form[n])) for n in ("encoding", "delimiter", "quotechar")]
            rows = found.where(reduce(and_, same)).select("path").collect()
            paths = [unquote(r.path) for r in rows]
        chosen = CsvOptions(form.encoding, form.delimiter, form.quotechar, options.header_row)
        scans.append(_scan(spark, paths, chosen, multiline))
    return reduce(lambda a, b: a.unionByName(b), scans)


def _scan(
    spark: SparkSession, paths: list[str], options: CsvOptions, multiline: bool
) -> DataFrame:
    encoding = options.encoding.strip().lower()
    if encoding not in JAVA_CHARSETS and encoding not in charsets.CODECS:
        raise PlanError(f"unknown encoding: {options.encoding}")
    native = encoding in JAVA_CHARSETS
    charset = java_charset(spark, encoding) if native else None
    quote = None if options.quotechar == "none" else options.quotechar
    codec = "utf-8" if encoding in charsets.WIDE else encoding
    lines = raw_lines(spark, paths, encoding if encoding in charsets.WIDE else None)
    broken, marks = False, np.zeros((4, 0), np.int64)
    if quote and multiline:
        broken, marks = blocks_inside_quotes(lines, options.delimiter, quote)
    heads = _headers(lines, marks, options, quote, codec)
    names, same_order = _one_header(heads, paths, options)
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    reading = {"sep": options.delimiter, "quote": quote or ""}
    if quote:
        reading["escape"] = quote
    if native and same_order and not broken and options.header_row == 1:
        reader = spark.read.schema(schema).options(**reading, header="true", encoding=charset)
        return reader.csv(paths).toDF(*names)

    cut = cut_records(lines, marks, options.delimiter, quote, codec, options.header_row)
    records = cut.where(F.col("kind") == RECORD).select("file", "record")
    if marks.shape[1]:
        records = records.unionAll(joined_fragments(cut))
    parsed = F.from_csv("record", schema, reading | {"multiLine": "true"}).alias("c")
    if same_order:
        return records.select(parsed).select("c.*").toDF(*names)
    fields = records.select("file", parsed).select("file", F.array("c.*").alias("values"))
    placed = fields.join(heads.select("file", "names"), "file")
    return placed.select(*(F.get("values", F.array_position("names", n) - 1).alias(n) for n in names))


def _headers(lines: DataFrame, marks: np.ndarray, options: CsvOptions, quote: str | None, codec: str) -> DataFrame:
    """(file, names): the names on the header row of every file with rows, unique as a.1, a.2, …

    Names are null where a file's first block has no such row.
    """
    form = {"quotechar": quote} if quote else {"quoting": csv.QUOTE_NONE}

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [None if r is None else next(csv.reader([r.rstrip("\r\n")], delimiter=options.delimiter, **form)) for r in batch["record"]]
            yield pd.DataFrame({"file": batch["file"], "names": [None if r is None else header_names(r) for r in rows]})

    first = cut_records(lines.where(F.col("block") == 0), marks, options.delimiter, quote, codec, options.header_row, header_only=True)
    return first.select("file", "record").mapInPandas(named, "file long, names array<string>")


def _one_header(heads: DataFrame, paths: list[str], options: CsvOptions) -> tuple[list[str], bool]:
    """The columns, which all files must have, and whether they have them in one order."""
    in_order = F.sort_array("names")
    found = heads.agg(
        F.count(F.lit(1)).alias("files"), F.count("names").alias("headers"), F.min("names").alias("names"),
        F.max("names").alias("other"), F.min(in_order).alias("low"), F.max(in_order).alias("high"),
    ).first()
    if not found.files:
        raise PlanError(f"no lines in {', '.join(paths)}")
    if found.headers < found.files:
        raise PlanError(f"{found.files - found.headers} of {found.files} files have no row {options.header_row}")
    if found.low != found.high:
        raise PlanError(f"files have different headers: {','.join(found.low)} / {','.join(found.high)}")
    return list(found.names), found.names == found.other


def infer_columns(df: DataFrame) -> DataFrame:
    """Type text columns whose filled values are all integers, numbers or booleans."""
    tests = {
        "bigint": lambda c: c.rlike(r"^\s*[+-]?\d{1,18}\s*$"),
        "double": is_number_text,
        "boolean": lambda c: c.isin("True", "TRUE", "true", "False", "FALSE", "false"),
    }
    counts = []
    for i, name in enumerate(df.columns):
        counts.append(F.count(col(name)).alias(f"{i}"))
        counts += [F.count_if(test(col(name))).alias(f"{i}_{t}") for t, test in tests.items()]
    found = df.agg(*counts).first().asDict()
    out = []
    for i, name in enumerate(df.columns):
        filled = found[f"{i}"]
        fits = [t for t in tests if filled and found[f"{i}_{t}"] == filled]
        value = F.trim(col(name)).cast(fits[0]) if fits else col(name)
        out.append(value.alias(name))
    return df.select(*out)


# -------------------------------------------------------------------------- sink


def write_csv(df: DataFrame, path: str, encoding: str = "utf-8-sig", mode: str = "errorifexists") -> None:
    """Write part files with a header. Characters the encoding lacks become '?'."""
    out = []
    for field in df.schema.fields:
        value = col(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            value = value.cast("string")
        elif isinstance(field.dataType, T.BooleanType):
            value = F.initcap(value.cast("string"))
        out.append(value.alias(field.name))
    df.select(*out).write.mode(mode).options(
        header="true", escape='"', emptyValue="",
        encoding=java_charset(df.sparkSession, encoding),
    ).csv(path)
