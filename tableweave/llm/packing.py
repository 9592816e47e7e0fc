"""Variable-capacity best-fit packing of documents into sequences.

Several sequence lengths are permitted. A document longer than the largest is cut into
pieces of that length and a rest. Pieces go to shards by a hash of their document; inside
a shard they are placed longest first into the open bin with the least sufficient room
(best fit). Where none fits, a bin is opened at the permitted length whose cost per token
that the rest of the shard can put into it is least. At the end each bin shrinks to the
cheapest permitted length that holds its contents.

A shard holds about ``SHARD_PIECES`` pieces whatever the input, so that its packing is one
bounded task; the room lost at shard borders is at most a few bins per shard. Nothing is
dropped: every piece of every document is in one bin.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .copies import numbered_copies
from .shared import stored

CAPACITIES = (512, 1024, 2048, 4096, 8192)
SHARD_PIECES = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def cost_of(capacity: int, quadratic: float) -> float:
    """Cost of one sequence: its tokens, and attention that grows with their square."""
    return capacity * (1.0 + quadratic * capacity)


def best_fit(lengths: Sequence[int], capacities: Sequence[int], quadratic: float) -> list[tuple[int, int]]:
    """(bin, offset) of each length; lengths come longest first, none above the largest capacity."""
    rooms: list[int] = []  # distinct rooms of open bins, sorted
    bins: dict[int, deque[int]] = {}  # room → open bins with that room, the oldest first
    filled: list[int] = []
    rest = [0] * (len(lengths) + 1)  # tokens of the pieces from i on
    for i in range(len(lengths) - 1, -1, -1):
        rest[i] = rest[i + 1] + lengths[i]
    places = []
    negated = [-x for x in lengths]
    for i, length in enumerate(lengths):
        at = bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            held = bins[room]
            chosen = held.popleft()
            if not held:
                del bins[room]
                rooms.pop(at)
        else:
            def per_token(capacity: int) -> tuple[float, int]:
                free = capacity - length
                # Pieces come longest first: those that fit are a tail of the list.
                fitting = rest[max(i + 1, bisect_left(negated, -free))] if free else 0
                return cost_of(capacity, quadratic) / (length + min(free, fitting)), capacity

            room = min((c for c in capacities if c >= length), key=per_token)
            chosen = len(filled)
            filled.append(0)
        places.append((chosen, filled[chosen]))
        filled[chosen] += length
        left = room - length
        if left:
            if left not in bins:
                bins[left] = deque()
                insort(rooms, left)
            bins[left].append(chosen)
    return places


def _packer(capacities: tuple[int, ...], quadratic: float):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "id", "h", "piece", "copy"], ascending=[False, True, True, True, True], na_position="last")
        places = best_fit(pieces["length"].tolist(), capacities, quadratic)
        pieces["bin"] = [b for b, _ in places]
        pieces["bin_offset"] = [o for _, o in places]
        filled = pieces.groupby("bin")["length"].transform("sum")
        cheapest = sorted(capacities, key=lambda c: (cost_of(c, quadratic), c))
        by_fill = {f: next(c for c in cheapest if c >= f) for f in filled.unique()}
        pieces["capacity"] = filled.map(by_fill)
        pieces["bin_tokens"] = filled
        return pieces[["id", "piece", "start", "length", "shard", "bin", "bin_offset", "capacity", "bin_tokens"]]

    return run


def pack(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    capacities: Sequence[int] = CAPACITIES, quadratic: float = 1 / 65_536, shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """(id, piece, start, length, bin, bin_offset, capacity, bin_tokens), a row per piece.

    Sizes are words, runs of anything but ASCII white space. ``piece`` counts from 0;
    ``start`` is its first word in the document and ``bin_offset`` its first place in the
    bin; ``bin`` names the bin in the whole result. Null and blank texts take no room:
    they have one row of length 0 whose bin columns are null. Ids may be null or repeat,
    each row is packed on its own. Reruns give the same bins.
    """
    capacities = tuple(sorted(set(capacities)))
    if not capacities or capacities[0] < 1 or shard_pieces < 1:
        raise ValueError("capacities and shard_pieces must be positive")
    most = capacities[-1]
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = stored(documents.select(F.col(id_col).alias("id"), size.alias("size"), F.xxhash64(text_col).alias("h")))
    units = sized.where("size > 0").groupBy("id", "h", "size").agg(F.count("*").alias("copies"))
    pieces = numbered_copies(units, ["h"]).select(
        "id", "h", "copy", "size", F.explode(F.sequence(F.lit(0), F.expr(f"int((size - 1) div {most})"))).alias("piece")
    )
    kind = dict(sized.dtypes)["id"]  # as text in Python, where a null would make long ids doubles
    pieces = pieces.select(
        F.col("id").cast("string").alias("id"), "h", "copy", "piece", (F.col("piece").cast("long") * most).alias("start"),
        F.least(F.lit(most), F.col("size") - F.col("piece").cast("long") * most).cast("long").alias("length"),
    )
    shards = max(1, math.ceil(pieces.count() / shard_pieces))
    placed = (
        pieces.withColumn("shard", F.pmod(F.xxhash64("id", "h", "piece", "copy"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(
            _packer(capacities, quadratic),
            "id string, piece int, start long, length long, shard long, bin long, bin_offset long, "
            "capacity long, bin_tokens long",
        )
    )
    named = placed.select(
        F.col("id").cast(kind).alias(id_col), "piece", "start", "length",
        F.concat_ws("-", "shard", "bin").alias("bin"), "bin_offset", "capacity", "bin_tokens",
    )
    none = F.lit(None)
    empty = sized.where("size = 0").select(
        F.col("id").alias(id_col), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
        F.lit(0).cast("long").alias("length"), none.cast("string").alias("bin"), none.cast("long").alias("bin_offset"),
        none.cast("long").alias("capacity"), none.cast("long").alias("bin_tokens"),
    )
    return named.unionByName(empty)


def sequences(documents: DataFrame, packed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bin, capacity, bin_tokens, text): the packed sequences, pieces joined by blanks.

    For documents whose ids are unique. A bin holds at most its capacity in words, which
    bounds what one group gathers.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        word = re.compile(WORD)
        for batch in batches:
            texts = []
            for text, parts in zip(batch["text"], batch["parts"]):
                bounds = [m.span() for m in word.finditer(text or "")]
                texts.append([text[bounds[p["start"]][0] : bounds[p["start"] + p["length"] - 1][1]] for p in parts])
            yield pd.DataFrame({"parts": batch["parts"], "texts": texts})

    part = F.struct("start", "length", "bin", "bin_offset", "capacity", "bin_tokens")
    parts = packed.where("length > 0").groupBy(id_col).agg(F.collect_list(part).alias("parts"))
    docs = documents.select(id_col, F.col(text_col).alias("text")).join(parts, id_col)
    schema = docs.select("parts").schema.simpleString()[len("struct<parts:"):-1]
    cuts = docs.select("text", "parts").mapInPandas(cut, f"parts {schema}, texts array<string>")
    rows = cuts.select(F.explode(F.arrays_zip("parts", "texts")).alias("z")).select("z.parts.*", F.col("z.texts").alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("bin_offset", "text")))
    return rows.groupBy("bin", "capacity", "bin_tokens").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text")
    )
