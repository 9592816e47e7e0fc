"""A bit table of ids that Python tasks carry, to leave out rows no later join can meet.

False hits cost time only: what passes is joined exactly. The table has 16 bits per id,
``MOST_BITS`` at most (16 MB), so that its size is bounded whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import mixed

LEAST_BITS = 1 << 16
MOST_BITS = 1 << 27
_PART = 1 << 13  # bytes


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def _marks(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits, bool)
        for batch in batches:
            table[_places(batch.column(0).to_numpy(), bits)] = True
        marked = np.packbits(table).reshape(-1, _PART)
        parts = np.flatnonzero(marked.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(parts, pa.int32()), pa.array([marked[p].tobytes() for p in parts], pa.binary())], ["part", "bytes"]
        )

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = np.frombuffer(raw, np.uint8)
            total[part] = total[part] | found if part in total else found
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["part", "bytes"]
    )


def id_table(ids: DataFrame) -> np.ndarray:
    """The bit table of a column of longs without nulls."""
    wanted = 16 * max(1, ids.count())
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (wanted - 1).bit_length()))
    parts = ids.mapInArrow(_marks(bits), "part int, bytes binary").repartition(8, "part")
    marked = np.zeros((bits // 8 // _PART, _PART), np.uint8)
    for row in parts.mapInArrow(_joined, "part int, bytes binary").collect():
        marked[row["part"]] |= np.frombuffer(row["bytes"], np.uint8)
    return marked.reshape(-1)


def may_hold(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """False where an id is surely not in the table."""
    bit = _places(ids, 8 * len(table))
    return ((table[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1).astype(bool)
