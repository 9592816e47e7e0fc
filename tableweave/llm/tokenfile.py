"""Token ids of documents in binary shards with a minimal perfect hash index.

A shard holds the ids of its documents one after the other, little-endian, two bytes each
if the vocabulary allows it, else four, and beside it a file of record ends (8 bytes
each). Documents are in ascending id order over all shards, null ids first.

The index maps an id to (shard, first record, records): ids are dealt to buckets by hash.
In a bucket of m ids a hash-and-displace function sends each to a slot of its own out of
m: ids fall into groups of about four, and each group, largest first, gets the least
displacement that sends its ids to free slots; groups of one are given a free slot
directly. A slot holds a fingerprint, which tells unknown ids apart, and the place. A
lookup reads one displacement and one slot, whatever the number of documents.

Writing is one range shuffle of the texts, then one task per shard and per index bucket.
A shard or bucket that is lost is written again under another name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SLICE_BYTES, mixed, slices, text_bytes
from .bpe import encoder
from .files import Ranges, Writer
from .shared import shared_folder, stored

BUCKET_KEYS = 50_000
SHARD_BYTES = 64 << 20
SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("record", "<u8"), ("records", "<u8")])
_HEAD = np.dtype([("keys", "<u8"), ("groups", "<u8")])


# ------------------------------------------------------------ minimal perfect hash


def key_hashes(ids: pd.Series) -> np.ndarray:
    """64-bit hashes of ids; a null has one of its own."""
    null = ids.isna().to_numpy()
    values = ids.where(~ids.isna(), 0).astype("int64").to_numpy().view(np.uint64)
    return np.where(null, np.uint64(0x6A09E667F3BCC909), mixed(values ^ np.uint64(0xBB67AE8584CAA73B)))


def _parts(h: np.ndarray, groups: int):
    """Group and fingerprint of each key."""
    a = mixed(h + np.uint64(0x3C6EF372FE94F82B))
    return (a % np.uint64(groups)).astype(np.int64), (a >> np.uint64(32)).astype(np.uint32)


def _slots(h: np.ndarray, shift: np.ndarray, keys: int) -> np.ndarray:
    """Slots of keys under a displacement: a hash function for each."""
    return (mixed(h + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(keys)).astype(np.int64)


def build(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacements, slot of each key) of distinct key hashes.

    A displacement of -1 - s sends a group's only key to slot s.
    """
    keys = len(h)
    groups = max(1, math.ceil(keys / 4))
    group, _ = _parts(h, groups)
    shifts = np.zeros(groups, np.int64)
    slot = np.full(keys, -1, np.int64)
    taken = np.zeros(keys, bool)
    order = np.argsort(group, kind="stable")
    size = np.bincount(group, minlength=groups)
    begin = np.cumsum(size) - size
    for g in np.argsort(-size, kind="stable"):
        if size[g] < 2:
            break
        members = order[begin[g] : begin[g] + size[g]]
        lo = 0
        while slot[members[0]] < 0:
            # A block of displacements at once.
            shift = np.arange(lo, lo + 32)
            where = _slots(h[members][None, :], shift[:, None], keys)
            ordered = np.sort(where, axis=1)
            good = ~taken[where].any(1) & (ordered[:, 1:] != ordered[:, :-1]).all(1)
            if good.any():
                k = int(np.argmax(good))
                shifts[g], slot[members] = shift[k], where[k]
                taken[where[k]] = True
            lo += 32
            if lo > 1 << 24:
                raise ValueError("keys are not distinct")
    free = iter(np.flatnonzero(~taken))
    for g in np.flatnonzero(size == 1):
        s = int(next(free))
        shifts[g], slot[order[begin[g]]] = -1 - s, s
    return shifts, slot


def find(h: np.ndarray, shifts: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Slot number of each key hash, -1 where the fingerprint is another's."""
    keys = len(slots)
    group, mark = _parts(h, len(shifts))
    shift = shifts[group]
    at = np.where(shift < 0, -1 - shift, _slots(h, np.maximum(shift, 0), keys))
    return np.where(slots["print"][at] == mark, at, -1)


# ------------------------------------------------------------------------- writing


@dataclass
class TokenFiles:
    """Where a set of shards and its index are; small enough to travel with a task."""

    folder: str
    width: int
    shards: list[tuple[str, str, int]]  # ids file, ends file, ids before it
    buckets: list[str | None]


def _writer(path: str, folder: str, width: int, end_id: int):
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids_file = ends_file = None
        total = record = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if ids_file is None:
                ids_file, ends_file = Writer(folder, f"shard-{part:06d}", "ids"), Writer(folder, f"shard-{part:06d}", "ends")
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in slices(offsets, SLICE_BYTES // 2):
                ids, counts = encoder(path).encoded(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ends = np.cumsum(counts)
                ids_file.write(np.insert(ids, ends, end_id).astype(kind).tobytes())
                upto = total + ends + np.arange(1, hi - lo + 1)
                ends_file.write(upto.astype("<u8").tobytes())
                total = int(upto[-1])
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.arange(record, record + rows)), pa.array([part] * rows, pa.int64()),
                 pa.nulls(rows, pa.string()), pa.nulls(rows, pa.string()), pa.nulls(rows, pa.int64())],
                ["id", "record", "part", "ids_file", "ends_file", "total"],
            )
            record += rows
        if ids_file is not None:
            ids_file.close()
            ends_file.close()
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([part], pa.int64()),
                 pa.array([ids_file.name]), pa.array([ends_file.name]), pa.array([total], pa.int64())],
                ["id", "record", "part", "ids_file", "ends_file", "total"],
            )

    return run


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(h ^ np.uint64(0x510E527FADE682D1)) % np.uint64(buckets)).astype(np.int64)


def _with_bucket(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["id"].astype("string").astype("Int64")
            batch["bucket"] = _bucket_of(key_hashes(ids), buckets)
            yield batch

    return run


def _indexer(folder: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        h = key_hashes(rows["id"].astype("string").astype("Int64"))
        shifts, slot = build(h)
        slots = np.zeros(len(h), SLOT)
        slots["print"][slot] = _parts(h, len(shifts))[1]
        for name in ("shard", "record", "records"):
            slots[name][slot] = rows[name].to_numpy()
        head = np.array([(len(h), len(shifts))], _HEAD)
        bucket = int(rows["bucket"].iloc[0])
        out = Writer(folder, f"index-{bucket:06d}", "mph")
        out.write(head.tobytes() + shifts.astype("<i8").tobytes() + slots.tobytes())
        out.close()
        return pd.DataFrame({"bucket": [bucket], "name": [out.name]})

    return run


def write(
    documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *,
    folder: str | None = None, end_id: int = 0, bucket_keys: int = BUCKET_KEYS, shards: int | None = None,
) -> TokenFiles:
    """Encode every text, append ``end_id`` and write shards and index.

    Null texts are empty: their record is the end id alone. Rows with one id are adjacent
    records of one key; their order is that of their texts' hashes. No rows give no files.
    """
    spark = documents.sparkSession
    folder = folder or shared_folder(spark)
    width = 2 if encoder(path).library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.repartitionByRange(shards, F.col("id").asc_nulls_first()).sortWithinPartitions(
        F.col("id").asc_nulls_first(), F.xxhash64("text")
    )
    manifest = stored(
        ranged.mapInArrow(
            _writer(path, folder, width, end_id), "id long, record long, part long, ids_file string, ends_file string, total long"
        )
    )
    # One row per shard comes to the driver.
    files = sorted((r.part, r.ids_file, r.ends_file, r.total) for r in manifest.where("ids_file is not null").collect())
    listed, before = [], 0
    for _, ids_file, ends_file, total in files:
        listed.append((ids_file, ends_file, before))
        before += total
    numbers = spark.createDataFrame(
        [(part, n) for n, (part, *_) in enumerate(files)], "part long, shard long"
    )
    keys = (
        manifest.where("ids_file is null").groupBy("id", "part")
        .agg(F.min("record").alias("record"), F.count("*").alias("records"))
        .join(F.broadcast(numbers), "part").drop("part")  # one row per shard
    )
    keys = stored(keys)
    buckets = max(1, math.ceil(keys.count() / bucket_keys))
    named = keys.select(F.col("id").cast("string").alias("id"), "shard", "record", "records").mapInPandas(
        _with_bucket(buckets), "id string, shard long, record long, records long, bucket long"
    ).groupBy("bucket").applyInPandas(_indexer(folder), "bucket long, name string")
    names: list[str | None] = [None] * buckets
    for r in stored(named).collect():  # one row per bucket
        names[r.bucket] = r.name
    return TokenFiles(folder, width, listed, names)


# ------------------------------------------------------------------------- reading


class Index:
    """Buckets of the index, read once each; the last few stay in memory."""

    def __init__(self, files: TokenFiles):
        self.files, self.ranges, self.kept = files, Ranges(files.folder), {}

    def bucket(self, number: int):
        if number not in self.kept:
            if len(self.kept) >= 4:
                self.kept.clear()
            name = self.files.buckets[number]
            if name is None:
                return None
            keys, groups = (int(x) for x in np.frombuffer(self.ranges.read(name, 0, _HEAD.itemsize), _HEAD)[0])
            shifts = np.frombuffer(self.ranges.read(name, _HEAD.itemsize, 8 * groups), "<i8")
            slots = np.frombuffer(self.ranges.read(name, _HEAD.itemsize + 8 * groups, SLOT.itemsize * keys), SLOT)
            self.kept[number] = shifts, slots
        return self.kept[number]

    def places(self, ids: pd.Series) -> np.ndarray:
        """A slot per id; ``records`` is 0 for ids that are not there."""
        h = key_hashes(ids)
        out = np.zeros(len(h), SLOT)
        if not self.files.buckets:
            return out
        bucket = _bucket_of(h, len(self.files.buckets))
        for b in np.unique(bucket):
            found = self.bucket(int(b))
            if found is not None:
                rows = np.flatnonzero(bucket == b)
                at = find(h[rows], *found)
                out[rows[at >= 0]] = found[1][at[at >= 0]]
        return out


def get(files: TokenFiles, doc_id: int | None) -> list[np.ndarray]:
    """The ids of a document's records: four range reads, whatever the size of the files."""
    place = Index(files).places(pd.Series([doc_id], dtype="Int64"))[0]
    if not place["records"]:
        return []
    ids_file, ends_file, _ = files.shards[int(place["shard"])]
    ranges, first = Ranges(files.folder), int(place["record"])
    ends = _ends(ranges, ends_file, first, int(place["records"]))
    raw = np.frombuffer(ranges.read(ids_file, int(ends[0]) * files.width, int(ends[-1] - ends[0]) * files.width), f"<u{files.width}")
    return [raw[a - ends[0] : b - ends[0]].astype(np.int64) for a, b in zip(ends[:-1], ends[1:])]


def _ends(ranges: Ranges, name: str, first: int, records: int) -> np.ndarray:
    """Begin of a run of records and the end of each."""
    skip = 1 if first else 0
    ends = np.frombuffer(ranges.read(name, 8 * (first - skip), 8 * (records + skip)), "<u8").astype(np.int64)
    return ends if skip else np.concatenate(([0], ends))


def _locate(files: TokenFiles):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(files)
        for batch in batches:
            place = index.places(batch["id"].astype("string").astype("Int64"))
            there = place["records"] > 0
            yield pd.DataFrame(
                {"id": batch["id"][there], **{k: place[k][there].astype(np.int64) for k in ("shard", "record", "records")}}
            )

    return run


def _reader(files: TokenFiles):
    import zlib

    kind = f"<u{files.width}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_ranges, ends_ranges = Ranges(files.folder), Ranges(files.folder)
        for batch in batches:
            rows = []
            for doc_id, shard, record, records in zip(*(batch[c] for c in ("id", "shard", "record", "records"))):
                ids_file, ends_file, before = files.shards[shard]
                ends = _ends(ends_ranges, ends_file, record, records)
                for a, b in zip(ends[:-1], ends[1:]):
                    raw = ids_ranges.read(ids_file, int(a) * files.width, int(b - a) * files.width)
                    ids = np.frombuffer(raw, kind).astype("<u4")
                    rows.append((doc_id, before + int(a), len(ids), zlib.crc32(ids.tobytes())))
            yield pd.DataFrame(rows, columns=["id", "start", "n_tokens", "ids_crc32"])

    return run


def read(keys: DataFrame, files: TokenFiles, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every record of the given ids, by the index.

    Ids are looked up by bucket, then read by shard in file order. Ids that are not there
    give no row; an id asked for twice is answered once.
    """
    spark = keys.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = keys.select(F.col(id_col).cast("string").alias("id")).distinct()
    asked = asked.mapInPandas(_with_bucket(max(1, len(files.buckets))), "id string, bucket long")
    located = asked.repartition(tasks, "bucket").sortWithinPartitions("bucket").select("id").mapInPandas(
        _locate(files), "id string, shard long, record long, records long"
    )
    rows = located.repartitionByRange(tasks, "shard", "record").sortWithinPartitions("shard", "record").mapInPandas(
        _reader(files), "id string, start long, n_tokens long, ids_crc32 long"
    )
    return rows.select(F.col("id").cast("long").alias(id_col), "start", "n_tokens", "ids_crc32")


def token_records(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write the documents' ids, then read each back through the index."""
    return read(documents.select(id_col), write(documents, path, id_col, text_col, **options), id_col)
