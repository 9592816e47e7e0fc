"""Records of CSV files with line breaks inside quoted fields; files stay split.

Whether a line begins inside quotes depends on all quotes before it in its file. Within a
line, quotes come in runs, and a run acts on that state in one of three ways: an even run
leaves it (doubled quotes, or an empty field); an odd run at the start of a field turns it
(it opens the field, or closes one after a break or delimiter); an odd run elsewhere ends
outside of quotes (it closes a field, or is text of an unquoted one). So the effect of a
line, a block or a file is known without the state before it: it either turns the state or
not, or sets it. Three passes follow from that:

1. ``quote_effects``: every block's effect, from the lines that hold a quote;
2. ``blocks_inside_quotes``: a running composition per file gives the state at the start
   of each block, a row per block;
3. ``cut_records``: each task cuts its blocks at the line ends outside of quotes. What a
   block has before its first such end, and after its last, are fragments of records that
   cross blocks; these, two a block at most, are joined in block order.

Lines end with LF or CR LF here. Blank lines between records are no records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import PlanError

RECORD, HEAD, MIDDLE, TAIL = range(4)


def raw_lines(spark: SparkSession, paths: str | list[str], wide: str | None = None) -> DataFrame:
    """(file, block, line): every line with its end, as bytes; a hash of its file's path, its block's start.

    ``wide`` names the form of files of two-byte characters, whose lines come as UTF-8.
    """
    reader = spark.read.option("lineSep", "\n")
    line = F.col("value").cast("binary")
    if wide:
        reader = reader.option("encoding", wide.upper())
        line = F.encode(F.decode(line, wide.upper()), "UTF-8")
    return reader.text(paths).select(
        F.xxhash64(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.concat(line, F.lit(b"\n")).alias("line"),
    )


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where each row's begin."""
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def line_effects(data: np.ndarray, offsets: np.ndarray, delimiter: str, quote: str) -> tuple[np.ndarray, np.ndarray]:
    """Per line: whether it sets the state, and the state set, or else whether it turns it."""
    lines = len(offsets) - 1
    at = np.flatnonzero(data == ord(quote))
    sets, odd = np.zeros(lines, bool), np.zeros(lines, np.int64)
    if not len(at):
        return sets, odd
    line = np.searchsorted(offsets, at, "right") - 1
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1] + 1) | (line[1:] != line[:-1])
    start, length = at[first], np.diff(np.append(np.flatnonzero(first), len(at)))
    line = line[first]
    opens = (start == offsets[line]) | (data[start - 1] == ord(delimiter))
    odd_run = length % 2 == 1
    turns = np.cumsum(odd_run & opens)
    before = np.concatenate(([0], turns))
    begin, end = np.searchsorted(line, np.arange(lines)), np.searchsorted(line, np.arange(lines), "right")
    odd[:] = before[end] - before[begin]
    setting = np.flatnonzero(odd_run & ~opens)
    sets[line[setting]] = True
    # Of several, the last one stands; turns count from it on.
    last = np.zeros(lines, np.int64)
    last[line[setting]] = setting
    odd[sets] = before[end[sets]] - turns[last[sets]]
    return sets, odd % 2


def states_after(sets: np.ndarray, odd: np.ndarray, state: int) -> np.ndarray:
    """1 for each line whose end is inside quotes, from the state before the first."""
    turned = np.cumsum(odd)
    last = np.maximum.accumulate(np.where(sets, np.arange(len(sets)), -1))
    base = np.where(last >= 0, odd[last] - turned[last], state)
    return (turned + base) % 2


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
    """(file, block, first row, end) of the rows of one block that stand together."""
    file, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    if not len(file):
        return
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    for lo, hi in zip(np.concatenate(([0], cuts)), np.append(cuts, len(file))):
        yield int(file[lo]), int(block[lo]), int(lo), int(hi)


def quote_effects(lines: DataFrame, delimiter: str, quote: str) -> DataFrame:
    """(file, block, sets, odd, inside0, inside1) of every block with quotes: its effect,
    and how many line ends of it are inside quotes if it begins outside or inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, effect = None, None
        for batch in batches:
            data, offsets = _bytes_of(batch.column(2))
            sets, odd = line_effects(data, offsets, delimiter, quote)
            for file, block, lo, hi in _runs(batch):
                if now != (file, block):
                    if now:
                        yield row(now, effect)
                    now, effect = (file, block), (False, 0, 0, 0)
                known, parity, *inside = effect
                ends = [states_after(sets[lo:hi], odd[lo:hi], (parity if known else parity ^ s)) for s in (0, 1)]
                known_now = known or bool(sets[lo:hi].any())
                effect = (known_now, int(ends[0][-1]), *(n + int(e.sum()) for n, e in zip(inside, ends)))
        if now:
            yield row(now, effect)

    def row(key: tuple[int, int], effect: tuple) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
        names = ["file", "block", "sets", "odd", "inside0", "inside1"]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*key, *effect), kinds)], names)

    quoted = lines.where(F.contains("line", F.lit(quote.encode())))
    return quoted.mapInArrow(run, "file long, block long, sets boolean, odd long, inside0 long, inside1 long")


def block_states(effects: DataFrame) -> DataFrame:
    """The blocks' effects with ``before``: 1 if a block begins inside quotes, and ``inside``.

    A running sum per file over one row per block.
    """
    so_far = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summed = effects.withColumn("turned", F.sum("odd").over(so_far))
    base = F.last(F.when(F.col("sets"), F.col("odd") - F.col("turned")), ignorenulls=True)
    before = F.pmod(F.col("turned") - F.col("odd") + F.coalesce(base.over(earlier), F.lit(0)), F.lit(2))
    after = F.pmod(F.col("turned") + F.coalesce(base.over(so_far), F.lit(0)), F.lit(2))
    return summed.withColumns({"before": before, "after": after}).withColumn(
        "inside", F.when(F.col("before") == 1, F.col("inside1")).otherwise(F.col("inside0"))
    )


def blocks_inside_quotes(lines: DataFrame, delimiter: str, quote: str) -> tuple[bool, np.ndarray]:
    """Whether any record goes over several lines, and marks of the blocks that begin inside quotes.

    A block without quotes begins as the one before it ended, see ``_begins_inside``.
    """
    states = block_states(quote_effects(lines, delimiter, quote))
    last = Window.partitionBy("file").orderBy(F.desc("block"))
    ends = states.withColumn("from_last", F.row_number().over(last))
    found = ends.agg(F.sum("inside"), F.max(F.when(F.col("from_last") == 1, F.col("after")))).first()
    if not found[0]:
        return False, np.zeros((4, 0), np.int64)
    if found[1]:
        raise PlanError("a quoted field is not closed at the end of its file")
    # One row per block (100 MB of input or so) around which the state is 1.
    rows = states.where("before = 1 or after = 1").select("file", "block", "before", "after").collect()
    marks = np.array(sorted((r.file, r.block, r.before, r.after) for r in rows), np.int64).reshape(-1, 4)
    return True, marks.T


def _begins_inside(marks: np.ndarray, file: int, block: int) -> int:
    """The state at a block's start."""
    of_file = np.flatnonzero(marks[0] == file)
    i = int(np.searchsorted(marks[1][of_file], block))
    if i < len(of_file) and marks[1][of_file[i]] == block:
        return int(marks[2][of_file[i]])
    # Had it quotes and begun inside, it would be marked; so what stands between it and the
    # last marked block has none, or that one ended outside.
    return int(marks[3][of_file[i - 1]]) if i else 0


def cut_records(
    lines: DataFrame, marks: np.ndarray, delimiter: str, quote: str | None, encoding: str, skip: int, header_only: bool = False
) -> DataFrame:
    """(file, block, kind, record) of all records below the first ``skip`` ones of each file.

    With ``header_only`` the record ``skip`` of every file instead, null if the first block
    has fewer. Records across blocks
    come as fragments: kinds ``HEAD``, ``MIDDLE`` and ``TAIL``. A batch is cut by its bytes;
    only records up to the header, and those across batches, are handled one by one.
    """
    shared = lines.sparkSession.sparkContext.broadcast(marks)
    plain = encoding.lower().replace("_", "-") in ("utf-8", "utf8", "ascii", "us-ascii")

    def text(records: pa.Array) -> pa.Array:
        if plain:
            try:
                return records.cast(pa.string())
            except pa.ArrowInvalid:
                pass
        return pa.array([r if r is None else r.decode(encoding, "replace") for r in records.to_pylist()], pa.string())

    def rows_of(key: tuple[int, int], kind: int, records: pa.Array) -> pa.RecordBatch:
        n = len(records)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, key[0])), pa.array(np.full(n, key[1])), pa.array(np.full(n, kind, np.int32)), text(records)],
            ["file", "block", "kind", "record"],
        )

    def one(record: bytes) -> pa.Array:
        return pa.array([record], pa.binary())

    def none_of(key: tuple[int, int]) -> pa.RecordBatch:
        return rows_of(key, RECORD, pa.array([None], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, seen, pending, inside_head = None, 0, 0, [], False
        for batch in batches:
            data, offsets = _bytes_of(batch.column(2))
            if quote:
                sets, odd = line_effects(data, offsets, delimiter, quote)
            else:
                sets, odd = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, np.int64)
            for file, block, lo, hi in _runs(batch):
                if key != (file, block):
                    if pending and not header_only:
                        yield rows_of(key, MIDDLE if inside_head else TAIL, one(b"".join(pending)))
                    if header_only and key and 0 < seen < skip:
                        yield none_of(key)
                    key, pending, seen = (file, block), [], 0 if block == 0 else skip
                    state = _begins_inside(shared.value, file, block) if block else 0
                    inside_head = state == 1
                if header_only and seen >= skip:
                    continue
                after = states_after(sets[lo:hi], odd[lo:hi], state)
                state = int(after[-1])
                ends = offsets[lo + 1 + np.flatnonzero(after == 0)]  # of records
                at, k = int(offsets[lo]), 0
                while k < len(ends) and (pending or inside_head or seen < skip):
                    record = b"".join((*pending, data[at : ends[k]].tobytes()))
                    pending, at, k = [], int(ends[k]), k + 1
                    if inside_head:
                        inside_head = False
                        if not header_only:
                            yield rows_of(key, HEAD, one(record))
                    elif seen >= skip:
                        yield rows_of(key, RECORD, one(record))
                    elif record.strip():
                        seen += 1
                        if header_only and seen == skip:
                            yield rows_of(key, RECORD, one(record.removeprefix(b"\xef\xbb\xbf") if skip == 1 else record))
                            break
                if header_only and seen >= skip:
                    continue
                if k < len(ends):
                    cuts = np.concatenate(([at], ends[k:]))
                    body = pa.py_buffer(data[at : cuts[-1]])
                    where = pa.py_buffer((cuts - at).astype(np.int32))
                    yield rows_of(key, RECORD, pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, where, body]))
                    at = int(cuts[-1])
                if at < offsets[hi]:
                    pending.append(data[at : offsets[hi]].tobytes())
        if pending and not header_only:
            yield rows_of(key, MIDDLE if inside_head else TAIL, one(b"".join(pending)))
        if header_only and key and 0 < seen < skip:
            yield none_of(key)

    cut = lines.mapInArrow(run, "file long, block long, kind int, record string")
    # What ends a record stands outside of quotes.
    end = F.when(F.col("kind").isin(RECORD, HEAD), F.regexp_replace("record", r"[\r\n]+\z", "")).otherwise(F.col("record"))
    cut = cut.withColumn("record", end)
    return cut if header_only else cut.where((F.col("kind") != RECORD) | (F.length(F.trim("record")) > 0))


def joined_fragments(cut: DataFrame) -> DataFrame:
    """(file, record) of the records that cross blocks."""
    order = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    parts = cut.where(F.col("kind") != RECORD).withColumn("chain", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    whole = F.array_sort(F.collect_list(F.struct("block", "kind", "record")))
    return parts.groupBy("file", "chain").agg(
        F.array_join(F.transform(whole, lambda p: p["record"]), "").alias("record")
    ).select("file", "record")
