"""Phrase collocations by relational mining of occurrences (SETM).

The relation of length k has a row (piece, position, phrase) for every place where a
frequent phrase of k words begins. It is persisted in the order of pieces and positions,
so that extending it is a merge join of adjacent positions: a phrase of k + 1 words stands
where one of k words begins and another begins one word on. Joined phrases are counted by
group, and only the places of frequent groups, the semi-join, enter the next relation.

Layout: a row of the persisted relation is a run of whole texts of about ``RUN_BYTES``
(one longer text is a run of its own). Positions are implied: codes in text order, 0 where
no frequent phrase begins, one such code between pieces. Codes are local to the run, with
a list of what they stand for; codes are as narrow as that list allows.

Per length:

1. Each run joins adjacent positions and passes on its distinct pairs of phrases with
   counts, keyed by the two phrases' numbers. Most pairs are rare, so these are by far the
   most rows; a run's pairs travel in order and compressed, a row per bucket of pairs.
2. Counts are summed per pair of numbers over all runs, bucket by bucket; buckets follow
   the number of runs. A group's number is the least (run, code) that names it, so that
   numbers are exact and need no second pass. Per run the places of its frequent groups
   are kept, so a phrase weighs no more than its runs.
3. These rows meet their run again, which keeps the places of the frequent groups.

Phrases of every length, with counts, are then scored at all cuts in exact decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import PlanError
from .arrays import LOWER, slices, span_hashes, text_bytes
from .shared import stored

RUN_BYTES = 1 << 22
#: Runs to a bucket of pairs. A run of usual text has 0.3 million distinct pairs.
_BUCKET_RUNS = 2
#: A place in a run, a run in its task, a task: 30, 12 and 21 bits of one number.
_CODE_BITS, _RUN_BITS = 30, 12
_LANG = "coalesce(cast({} as string), 'und')"

#: Bytes that end a piece, and those that end a word inside one.
_PIECE_END = np.zeros(256, bool)
_PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD_END = _PIECE_END.copy()
_WORD_END[[0x20, 0x09]] = True


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row, piece) of the words of a slice of lower-cased texts.

    Pieces with words are numbered from 0 over the whole slice; a row begins a new one.
    """
    inside = ~_WORD_END[data]
    cuts = offsets[1:-1][offsets[1:-1] < len(data)]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[cuts] = inside[cuts]
    last[:-1] &= ~inside[1:]
    stops = cuts[cuts > 0] - 1
    last[stops] = inside[stops]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    if not len(starts):
        return starts, ends, row, starts
    marks = np.cumsum(_PIECE_END[data])[starts] + row
    return starts, ends, row, np.concatenate(([0], np.cumsum(marks[1:] != marks[:-1])))


def packed(codes: np.ndarray) -> bytes:
    """Codes in two bytes where they fit, else in four, like bytes side by side, compressed;
    the first byte tells."""
    narrow = not len(codes) or codes.max() < 1 << 16
    raw = codes.astype("<u2" if narrow else "<u4").view(np.uint8).reshape(len(codes), -1 if len(codes) else 2).T.tobytes()
    return (b"\2" if narrow else b"\4") + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    raw = pa.decompress(blob[9:], int.from_bytes(blob[1:9], "little"), codec="zstd", asbytes=True)
    width = blob[0]
    return np.frombuffer(raw, np.uint8).reshape(width, len(raw) // width).T.copy().view(f"<u{width}").ravel()


_RUNS = "run long, codes binary, code int, lang string, word string, c long"
_RUN_SCHEMA = pa.schema([
    ("run", pa.int64()), ("codes", pa.binary()), ("code", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("c", pa.int64()),
])


def _words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The lower-cased bytes of a run, and (starts, ends, row, piece, hash) of its words.

    Found slice by slice, as the arrays on the way are many times a slice's bytes.
    """
    text, parts, pieces = LOWER[data], [], 0
    for lo, hi in slices(offsets):
        part = text[offsets[lo] : offsets[hi]]
        starts, ends, row, piece = word_places(part, offsets[lo : hi + 1] - offsets[lo])
        if len(starts):
            at = int(offsets[lo])
            parts.append(((starts + at).astype(np.int32), (ends + at).astype(np.int32), (row + lo).astype(np.int32), piece + pieces, span_hashes(part, starts, ends)))
            pieces += int(piece[-1]) + 1
    if not parts:
        return text, [np.zeros(0, np.int64)] * 5
    return text, [np.concatenate(column) for column in zip(*parts)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) to runs (run, codes) and their words (run, code, lang, word, c)."""
    run = TaskContext.get().partitionId() << _RUN_BITS
    last_run = run + (1 << _RUN_BITS) - 1
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        langs = batch.column(1).dictionary_encode()
        of_row = langs.indices.to_numpy()
        for lo, hi in slices(offsets, RUN_BYTES):
            text, (starts, ends, row, piece, names) = _words_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            if not len(starts):
                continue
            if run > last_run:
                raise PlanError("a partition holds more text than runs can be numbered; split it")
            lang = of_row[lo:hi][row]
            names += lang.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            coded = pa.array(names).dictionary_encode()
            code = coded.indices.to_numpy()
            first = np.full(len(coded.dictionary), len(code), np.int64)
            np.minimum.at(first, code, np.arange(len(code)))
            codes = np.zeros(len(code) + piece[-1], np.uint32)
            codes[np.arange(len(code)) + piece] = code + 1
            words = [text[a:b].tobytes() for a, b in zip(starts[first], ends[first])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([run], pa.int64()), pa.array([packed(codes)], pa.binary())] + [pa.nulls(1, f.type) for f in list(_RUN_SCHEMA)[2:]],
                schema=_RUN_SCHEMA,
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(words), run)), pa.nulls(len(words), pa.binary()), pa.array(np.arange(len(words), dtype=np.int32)),
                 langs.dictionary.take(pa.array(lang[first])), pa.array(words, pa.binary()).cast(pa.string()),
                 pa.array(np.bincount(code, minlength=len(words)).astype(np.int64))],
                schema=_RUN_SCHEMA,
            )
            run += 1


def packed_pairs(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> bytes:
    """Pairs (a, b), ascending, and their counts: steps of a, then like bytes side by side, compressed."""
    columns = np.stack([np.diff(a, prepend=0), b, c]).astype("<i8")
    return len(a).to_bytes(8, "little") + pa.compress(columns.view(np.uint8).reshape(3, -1, 8).transpose(0, 2, 1).tobytes(), codec="zstd", asbytes=True)


def unpacked_pairs(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], 24 * n, codec="zstd", asbytes=True), np.uint8)
    columns = raw.reshape(3, 8, n).transpose(0, 2, 1).copy().view("<i8").reshape(3, n)
    columns[0] = np.cumsum(columns[0])
    return columns


def _pairs_of(codes: np.ndarray, groups: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """Positions where two phrases begin one word apart, the codes of their pairs there, and
    the distinct pairs (bucket, a, b) in the order of their codes, which is that of the three."""
    at = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
    known = len(groups) + 1
    pairs = pa.array(codes[at].astype(np.int64) * known + codes[at + 1], pa.int64()).dictionary_encode()
    which = pairs.dictionary.to_numpy()
    a, b = groups[which // known - 1], groups[which % known - 1]
    mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) * np.uint64(0xD1B54A32D192ED03)
    bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((b, a, bucket))
    code = np.empty(len(order), np.int64)
    code[order] = np.arange(len(order))
    return at, code[pairs.indices.to_numpy()], bucket[order], a[order], b[order]


_PAIRS = "bucket long, at long, pairs binary"


def _pairs(buckets: int):
    """Runs (run, codes, groups) to their distinct pairs by bucket, at: the place of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob, groups in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                _, code, bucket, a, b = _pairs_of(unpacked(blob), groups.values.to_numpy(), buckets)
                if not len(code):
                    continue
                count = np.bincount(code)
                first = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = [*first[1:], len(bucket)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[first]), pa.array((number << _CODE_BITS) + first),
                     pa.array([packed_pairs(a[i:j], b[i:j], count[i:j]) for i, j in zip(first, ends)], pa.binary())],
                    ["bucket", "at", "pairs"],
                )

    return run


_FREQUENT_PAIRS = "number long, a long, b long, f long, run long, places binary"
_FREQUENT_NAMES = ["number", "a", "b", "f", "run", "places"]


def _frequent_pairs(support: int):
    """A bucket's pairs to those that occur often enough (number, a, b, f), and a row (run,
    places) for each run that has any: their codes and numbers."""

    def run(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by("at")
        parts = [unpacked_pairs(blob) for blob in bucket["pairs"].to_pylist()]
        at = np.concatenate([first + np.arange(part.shape[1]) for first, part in zip(bucket["at"].to_pylist(), parts)])
        a, b, c = np.concatenate(parts, axis=1)
        del parts
        order = np.lexsort((b, a))  # keeps the order of places in a pair
        at, a, b, c = at[order], a[order], b[order], c[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        size = np.diff(first, append=len(a))
        f = np.add.reduceat(c, first)
        often = f >= support
        heads = first[often]
        kept = np.repeat(often, size)
        place, number = at[kept], np.repeat(at[first], size)[kept]
        order = np.argsort(place)
        place, number = place[order], number[order]
        of_run, code = place >> _CODE_BITS, place & ((1 << _CODE_BITS) - 1)
        starts = np.flatnonzero(np.diff(of_run, prepend=-1))
        places = [packed_pairs(code[i:j], number[i:j], np.zeros(j - i, np.int64)) for i, j in zip(starts, [*starts[1:], len(code)])]
        none = lambda n, kind=pa.int64(): pa.nulls(n, kind)
        return pa.concat_tables([
            pa.table([pa.array(x) for x in (at[heads], a[heads], b[heads], f[often])] + [none(len(heads)), none(len(heads), pa.binary())], _FREQUENT_NAMES),
            pa.table([none(len(starts))] * 4 + [pa.array(of_run[starts]), pa.array(places, pa.binary())], _FREQUENT_NAMES),
        ])

    return run


def _kept_places(buckets: int):
    """Cogroup of a run with its frequent groups: the next relation. Groups are pairs, dealt
    to ``buckets`` (places), or with 0 of them words (code, number)."""

    def run(relation: pa.Table, frequent: pa.Table) -> pa.Table:
        rows = []
        for number, blob, groups in zip(relation["run"].to_pylist(), relation["codes"].to_pylist(), relation["groups"]):
            if not frequent.num_rows:
                continue
            codes = unpacked(blob)
            if buckets:
                at, found, pairs, _, _ = _pairs_of(codes, groups.values.to_numpy(), buckets)
                old = np.zeros(len(codes), np.int64)
                old[at] = found + 1
                known = len(pairs)
            else:
                old, known = codes.astype(np.int64), int(codes.max(initial=0))
            if buckets:
                code, names, _ = np.concatenate([unpacked_pairs(places) for places in frequent["places"].to_pylist()], axis=1)
            else:
                code, names = frequent["code"].to_numpy(), frequent["number"].to_numpy()
            new = np.zeros(known + 1, np.int64)
            new[code + 1] = np.arange(1, len(code) + 1)
            # Numbered as they come: small codes are the common ones.
            new = new[old]
            hit = np.flatnonzero(new)
            coded = pa.array(new[hit]).dictionary_encode()
            new[hit] = coded.indices.to_numpy() + 1
            rows.append({"run": number, "codes": packed(new), "groups": names[coded.dictionary.to_numpy() - 1]})
        return pa.Table.from_pylist(rows, schema=pa.schema([("run", pa.int64()), ("codes", pa.binary()), ("groups", pa.list_(pa.int64()))]))

    return run


_RELATION = "run long, codes binary, groups array<long>"


def _semi_joined(relation: DataFrame, places: DataFrame, buckets: int) -> DataFrame:
    """The relation of the places of frequent groups; runs without any go."""
    return stored(relation.groupBy("run").cogroup(places.groupBy("run")).applyInArrow(_kept_places(buckets), _RELATION), compression="zstd")


def _frequent(rows: DataFrame, by: list[str], support: int) -> DataFrame:
    """Rows (at, by…, c) of groups that occur often enough, with the group's number and count."""
    group = Window.partitionBy(*by)
    counted = rows.withColumn("f", F.sum("c").over(group)).withColumn("number", F.min("at").over(group))
    return stored(counted.where(F.col("f") >= support).drop("c"))


def phrase_counts(
    documents: DataFrame, text_col: str = "text", lang_col: str = "lang", *, longest: int = 5, support: int = 100
) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (lang, phrase, k, f) of 1 to ``longest`` words, and (lang, n) of all words.

    Words are those of ``collocations``; n counts the rare ones too.
    """
    texts = documents.select(
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.expr(_LANG.format(f"`{lang_col}`")).alias("lang")
    )
    scanned = stored(texts.mapInArrow(_runs, _RUNS), compression="zstd")
    words = scanned.where("codes is null").select((F.shiftleft("run", _CODE_BITS) + F.col("code")).alias("at"), "lang", "word", "c")
    totals = words.groupBy("lang").agg(F.sum("c").alias("n"))

    found = _frequent(words, ["lang", "word"], support)
    relation = scanned.where("codes is not null").select("run", "codes", F.array().cast("array<long>").alias("groups"))
    places = found.select(
        F.shiftright("at", _CODE_BITS).alias("run"), F.col("at").bitwiseAND(F.lit((1 << _CODE_BITS) - 1)).cast("int").alias("code"), "number"
    )
    relation = _semi_joined(relation, places, 0)
    buckets = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), relation.count() // _BUCKET_RUNS)
    phrases = stored(found.where("at = number").select("number", "lang", F.col("word").alias("phrase"), "f", F.lit(1).alias("k")))
    all_phrases = phrases
    for k in range(2, longest + 1):
        pairs = relation.mapInArrow(_pairs(buckets), _PAIRS).groupBy("bucket")
        found = stored(pairs.applyInArrow(_frequent_pairs(support), _FREQUENT_PAIRS))
        heads = found.where("run is null").select("number", "a", "b", "f")
        a = phrases.select(F.col("number").alias("a"), "lang", F.col("phrase").alias("head"))
        b = phrases.select(F.col("number").alias("b"), F.substring_index("phrase", " ", -1).alias("last"))
        phrases = stored(
            heads.join(a, "a").join(b, "b").select("number", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "f", F.lit(k).alias("k"))
        )
        all_phrases = all_phrases.unionAll(phrases)
        if k < longest:
            relation = _semi_joined(relation, found.where("run is not null").select("run", "places"), buckets)
    return all_phrases.select("lang", "phrase", "k", "f"), totals


def collocations(
    documents: DataFrame, text_col: str = "text", lang_col: str = "lang", *, longest: int = 5, support: int = 100, first: int = 2000
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best-scored phrases.

    Texts are lower-cased (A-Z) and split into pieces at ``.,;:!?`` and line ends, pieces
    into words at blanks and tabs. A phrase of 2 to ``longest`` words with a occurrences,
    ``support`` at least, has at each cut the score floor(1000 * a * n / (l * r)), l and r
    the occurrences of its parts and n all words of its language; its lowest counts, ties
    to the earlier cut. A phrase inside a longer one that occurs as often is left out.
    The ``first`` by score, then occurrences, then the phrase's bytes are returned.

    Null texts are empty, a null language is ``und``. Repeated rows count each time. Other
    columns are ignored; no words or no frequent phrase give no rows.
    """
    phrases, totals = phrase_counts(documents, text_col, lang_col, longest=longest, support=support)
    phrases = stored(phrases)
    candidates = phrases.where("k > 1").withColumnRenamed("f", "a")
    # What stands inside a longer phrase as often also stands so inside one that is a word longer.
    longer = candidates.where("k > 2").select(
        "lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))).alias("phrase")
    )
    inside = longer.groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    alone = candidates.join(inside, ["lang", "phrase"], "left").where("inside is null or inside < a").drop("inside")

    cuts = alone.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).withColumns({
        "left": F.expr("substring_index(phrase, ' ', cut)"), "right": F.expr("substring_index(phrase, ' ', cut - k)"),
    })
    part = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    # At most 38 digits hold a * n * 1000 and l * r; the quotient is at most 10 * n.
    d = lambda name: f"cast({name} as decimal(19, 0))"
    score = F.expr(f"cast({d('a')} * {d('n')} as decimal(35, 0)) * 1000bd div cast({d('l')} * {d('r')} as decimal(38, 0))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        lowest.select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
