"""Audit of document filters in every order they may be applied in.

Five filters give each document a mask of the ones it fails. Every mask maps to one big
integer whose fields hold the document's outcomes at all 600 steps (120 orders of five
filters): kept, removed here, failing but removed earlier, and removed here while labelled
good or toxic. Adding the integers of all documents of a part adds every field at once;
fields are as wide as the count of all rows, so that no sum runs into its neighbour.

1. One pass over the texts, in built-in functions, tells what each document fails on its
   own and writes one narrow row per document.
2. A text's first document is the least id of its hash; joining it back on (hash, id)
   meets one row per text, however many copies a text has.
3. Each task adds its documents' integers per part and passes one integer per part on;
   these are added in two levels, so that a part's share of any task is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

FILTERS = "ABCDE"
ORDERS = ["".join(order) for order in permutations(FILTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(1, len(FILTERS) + 1)]
OUTCOMES = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
_FIELDS = len(STEPS) * len(OUTCOMES) + len(FILTERS)
#: Parts that a task keeps at once; beyond that it passes its sums on and starts anew.
OPEN_PARTS = 64

_WORD_GAPS = r"[\x20\x09-\x0D]+"
SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def own_failures(text: Column) -> Column:
    """Bits 0 to 3: the text fails filter A, B, C, D."""
    words = F.filter(F.split(text, _WORD_GAPS, -1), lambda w: w != "")
    few = F.size(words) < 200
    dull = 100 * F.size(F.array_distinct(words)) < 50 * F.size(words)
    letters = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    loud = 100 * letters > 3 * F.length(text)
    marks = text.rlike("[#$%&*|]")
    bits = [F.when(failing, 1 << i).otherwise(0) for i, failing in enumerate((few, dull, loud, marks))]
    return (bits[0] + bits[1] + bits[2] + bits[3]).cast("int")


def packed_outcomes(mask: int, good: bool, toxic: bool, width: int) -> int:
    """The integer of one document: fields of ``width`` bits, in the order of STEPS and OUTCOMES."""
    number, at = 0, 0
    for order, step in STEPS:
        failed = [bool(mask >> FILTERS.index(letter) & 1) for letter in order[:step]]
        gone, fails = any(failed[:-1]), failed[-1]
        removed = fails and not gone
        for outcome in (not any(failed), removed, fails and gone, removed and good, removed and toxic):
            number |= int(outcome) << at
            at += width
    for i in range(len(FILTERS)):
        number |= int(mask == 1 << i) << at
        at += width
    return number


def unpacked(number: int, width: int) -> list[int]:
    field = (1 << width) - 1
    return [number >> (i * width) & field for i in range(_FIELDS)]


def _added(width: int):
    """Rows (part, mask, good, toxic) to one integer per part and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, int] = {}
        sums: dict[str, int] = {}
        for batch in batches:
            for part, *kind in zip(*(c.to_pylist() for c in batch.columns)):
                if part not in sums and len(sums) >= OPEN_PARTS:
                    yield _numbers(sums)
                    sums = {}
                kind = tuple(kind)
                if kind not in known:
                    known[kind] = packed_outcomes(*kind, width)
                sums[part] = sums.get(part, 0) + known[kind]
        yield _numbers(sums)

    return run


def _numbers(sums: dict[str, int]) -> pa.RecordBatch:
    raw = [n.to_bytes((n.bit_length() + 7) // 8, "little") for n in sums.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(raw, pa.binary())], ["part", "number"])


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One integer of the integers (part, number) of a group, read batch by batch."""
    part, total = None, 0
    for batch in batches:
        part = batch.column("part")[0].as_py()
        total += sum(int.from_bytes(raw, "little") for raw in batch.column("number").to_pylist())
    yield _numbers({part: total})


def _rows_of(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fields = unpacked(int.from_bytes(raw, "little"), width)
                only = dict(zip(FILTERS, fields[len(STEPS) * len(OUTCOMES):]))
                shapley = dict.fromkeys(FILTERS, 0)
                rows = []
                for i, (order, step) in enumerate(STEPS):
                    row = dict(zip(OUTCOMES, fields[i * len(OUTCOMES) :]))
                    letter = order[step - 1]
                    shapley[letter] += row["removed"]
                    rows.append({"part": part, "filter_order": order, "step": step, **row, "unique_fails": only[letter]})
                for row in rows:
                    row["shapley"] = shapley[row["filter_order"][row["step"] - 1]]
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return run


_ARROW = pa.schema(
    [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())]
    + [(n, pa.int64()) for n in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
)


def failing_masks(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """(part, mask, good, toxic) of every row: bits 0 to 4 are the filters A to E it fails.

    E: a row with a smaller id has the same text. Rows with a null id fail E never, rows of
    one id and text alike. A document is good (toxic) if any label of its id says so.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    facts = stored(
        documents.select(
            F.col(id_col).cast("long").alias("id"),
            F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(text, 256)).alias("h"),
            own_failures(text).alias("own"),
        )
    )
    first = facts.where("id is not null").groupBy("h").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = (
        labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
        .withColumn("spread", F.lit(0))
    )
    # Null ids match nothing; spread over their texts they do not meet in one task.
    spread = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("h"), F.lit(1 << 20)).cast("int")).otherwise(0)
    rows = facts.join(first, ["h", "id"], "left").withColumn("spread", spread).join(marks, ["id", "spread"], "left")
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return rows.select(
        "part",
        (F.col("own") + F.when(copy, 16).otherwise(0)).cast("int").alias("mask"),
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )


def audit(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """One row per part, order of the five filters and step; columns as in ``SCHEMA``.

    ``labels`` has the id column, quality and toxic. Null texts are empty, null parts join
    the part of the empty string. Other columns are ignored; no documents give no rows.
    ``shapley`` is what the step's filter removes, summed over all orders.
    """
    masks = stored(failing_masks(documents, labels, id_col, text_col, part_col))
    rows = masks.count()
    width = max(1, rows.bit_length())
    numbers = stored(masks.mapInArrow(_added(width), "part string, number binary"))
    groups = max(1, math.isqrt(numbers.count()))
    dealt = numbers.withColumn("g", F.pmod(F.xxhash64("number", F.monotonically_increasing_id()), F.lit(groups)))
    some = dealt.groupBy("part", "g").applyInArrow(_total, "part string, number binary")
    whole = some.groupBy("part").applyInArrow(_total, "part string, number binary")
    return whole.mapInArrow(_rows_of(width), SCHEMA)
