"""Token counts, huge documents by overlapping chunks that are spliced where they agree.

A text of up to ``chunk_bytes`` is encoded whole. A longer one is cut into chunks that
overlap; the chunks are rows of their own and spread over the cluster. A chunk may begin
and end anywhere, so its first and last tokens may be wrong. Its segment boundaries (see
``bpe``) are proven ones, because each depends on a few bytes around it only: where two
neighbours share one in their overlap, the left chunk counts up to it and the right one
from it. A document with a pair of chunks that share none goes round again with overlaps
four times as wide, up to a single chunk that is the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import text_bytes
from .bpe import encoder
from .shared import stored

CHUNK_BYTES = 1 << 16
OVERLAP = 256
_EDGE = 4  # bytes that decide whether a place is a boundary


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(encoder(path).counts(data, offsets))],
                ["id", "n_bytes", "n_tokens"],
            )

    return run


def _chunks(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = memoryview(batch.column(2)[i].as_buffer())
                for k, at in enumerate(range(0, len(raw), chunk)):
                    stop = min(len(raw), at + chunk + overlap)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[i : i + 1], batch.column(1)[i : i + 1], pa.array([k], pa.int64()), pa.array([at], pa.int64()),
                         pa.array([at + chunk >= len(raw)]), pa.array([bytes(raw[at:stop])], pa.binary())],
                        ["h", "size", "chunk", "at", "last", "raw"],
                    )

    return run


def _edges(path: str, chunk: int, overlap: int):
    """Per chunk: its tokens, and (place, tokens before it) of the boundaries in both overlaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails, totals = [], [], []
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column(5)[i].as_buffer(), np.uint8)
                starts, index = encoder(path).segments(data, np.array([0, len(data)]))
                count = encoder(path).count[index]
                upto = np.concatenate(([0], np.cumsum(count)))
                at, k = batch.column(3)[i].as_py(), batch.column(2)[i].as_py()
                proven = (starts >= _EDGE) & (starts < len(data) - _EDGE)
                head = np.flatnonzero(proven & (starts < overlap)) if k else []
                tail = [] if batch.column(4)[i].as_py() else np.flatnonzero(proven & (starts >= chunk))
                heads.append([{"place": int(starts[j] + at), "tokens": int(upto[j])} for j in head])
                tails.append([{"place": int(starts[j] + at), "tokens": int(upto[j])} for j in tail])
                totals.append(int(upto[-1]))
            kind = pa.list_(pa.struct([("place", pa.int64()), ("tokens", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array(totals, pa.int64()),
                 pa.array(heads, kind), pa.array(tails, kind)],
                ["h", "size", "chunk", "last", "total", "head", "tail"],
            )

    return run


def _spliced(huge: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(h, size, n_tokens) of huge texts; n_tokens is null where neighbours do not align."""
    spread = huge.mapInArrow(_chunks(chunk, overlap), "h long, size long, chunk long, at long, last boolean, raw binary")
    places = "array<struct<place: long, tokens: long>>"
    edges = spread.repartition("h", "chunk").mapInArrow(
        _edges(path, chunk, overlap), f"h long, size long, chunk long, last boolean, total long, head {places}, tail {places}"
    )
    # Repeated texts give equal chunks.
    edges = stored(edges.dropDuplicates(["h", "size", "chunk"]))
    left = edges.where("not last").select("h", "size", "chunk", "tail")
    right = edges.where("chunk > 0").select("h", "size", (F.col("chunk") - 1).alias("chunk"), "head")
    common = F.expr(
        "filter(transform(tail, t -> named_struct('place', t.place, 'left', t.tokens, 'right',"
        " get(filter(head, x -> x.place = t.place), 0).tokens)), x -> x.right is not null)"
    )
    pairs = left.join(right, ["h", "size", "chunk"]).select("h", "size", "chunk", F.try_element_at(common, F.lit(1)).alias("splice"))
    ends = pairs.select("h", "size", "chunk", F.col("splice.left").alias("n"), F.col("splice").isNull().alias("failed"))
    begins = pairs.select("h", "size", (F.col("chunk") + 1).alias("chunk"), (-F.col("splice.right")).alias("n"), F.col("splice").isNull().alias("failed"))
    lasts = edges.where("last").select("h", "size", "chunk", F.col("total").alias("n"), F.lit(False).alias("failed"))
    return ends.unionAll(begins).unionAll(lasts).groupBy("h", "size").agg(
        F.when(~F.max("failed"), F.sum("n")).alias("n_tokens")
    )


def token_counts(
    documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *,
    limit: int = 512, chunk_bytes: int = CHUNK_BYTES, overlap: int = OVERLAP,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, as the tokenizers library counts.

    No begin or end tokens; special strings in a text are special tokens, the library's
    default. Null texts are empty and have 0 tokens. Ids may be null or repeat; no rows
    give no rows. ``path`` is a tokenizer file that every executor has.
    """
    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = F.octet_length("text")
    kind = docs.schema["id"].dataType.simpleString()
    small = docs.where(size <= chunk_bytes).mapInArrow(_whole(path), f"id {kind}, n_bytes long, n_tokens long")
    big = docs.where(size > chunk_bytes).select("id", F.xxhash64("text").alias("h"), size.cast("long").alias("size"), F.col("text").cast("binary").alias("raw"))

    todo, done, width = big.select("h", "size", "raw"), None, overlap
    while True:
        found = stored(_spliced(todo, path, max(chunk_bytes, width), width))
        good = found.where("n_tokens is not null")
        done = good if done is None else done.unionAll(good)
        failed = found.where("n_tokens is null").select("h", "size")
        if failed.isEmpty():
            break
        todo, width = big.select("h", "size", "raw").join(failed, ["h", "size"], "left_semi"), width * 4
    long_ones = big.select("id", "h", "size").join(done, ["h", "size"]).select("id", F.col("size").alias("n_bytes"), "n_tokens")
    return small.unionAll(long_ones).select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
