"""WARC archives with a two-level capture index.

Archives: gzip, one member per record, one file per task. Of records with equal payloads
the one with the smallest id is a response; the others are revisits that name it and
carry no payload.

Index: captures sorted by (URL key, id), the host of a key reversed
("com,example,blog)/path"), in range-partitioned files of gzip blocks of ``BLOCK_LINES``
lines. The sparse directory has one entry per block, its first capture and byte range. A
lookup searches by halves first the index files, then the directory of one file, then the
lines of one block, and reads one range of one archive.

Payload digests come from Spark's functions; equal payloads are found by an aggregation
of digests, which combines before its shuffle. The pages themselves are shuffled at most
once, by id, so neither a common payload nor a common host gathers in a task.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import Ranges, Writer, opened
from .shared import shared_folder, stored

BLOCK_LINES = 3_000
_LEVEL = 4  # of compression
_DATE = "2024-01-01T00:00:00Z"  # pages carry no time of capture
_STAMP = "20240101000000"


def url_key(url: Column) -> Column:
    """Reversed host, then port, path and query: com,example,blog)/path?query, in lower case.

    Scheme, user, a leading www. and the fragment go; a null URL is the empty key.
    """
    rest = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", ""), r"#.*$", "")
    authority = F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^[^@]*@", "")
    host = F.regexp_replace(F.regexp_replace(authority, r":[0-9]*$", ""), r"^www[0-9]*\.", "")
    port = F.regexp_extract(authority, r":(?!80$|443$)[0-9]+$", 0)
    path = F.regexp_replace(rest, r"^[^/?]*", "")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), path)
    return F.coalesce(F.regexp_replace(key, r"[\s]", "%20"), F.lit(""))


def _record_id(number: str) -> str:
    return f"<urn:page:{number}>"


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode("utf-8", "surrogatepass")


def record(kind: str, number: str, url: str, digest: str, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record, gzip-compressed on its own."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(number)), ("WARC-Date", _DATE),
              ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if kind == "revisit":
        fields += [("WARC-Refers-To", _record_id(refers_to)),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        payload = b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(payload)))]
    return gzip.compress(_header(fields) + http + payload + b"\r\n\r\n", _LEVEL, mtime=0)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one compressed record."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


@dataclass
class Archives:
    """Where archives and index are; the directory is read by shard."""

    folder: str
    #: First capture of each index file, and the file's directory; one entry per task.
    shards: list[tuple[tuple[str, str], str]]


# ------------------------------------------------------------------------- writing


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if batch.num_rows and out is None:
                out = Writer(folder, f"pages-{TaskContext.get().partitionId():06d}", "warc.gz")
            at, length = [], []
            for number, url, html, sha, refers in zip(*(c for c in batch.columns[:5])):
                digest = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
                kind = "revisit" if refers.is_valid else "response"
                clean = (url.as_py() or "").replace("\r", "%0D").replace("\n", "%0A")
                payload = html.as_buffer().to_pybytes()
                raw = record(kind, number.as_py(), clean, digest, payload, refers.as_py())
                at.append(out.write(raw))
                length.append(len(raw))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(5), pa.array([out.name if out else ""] * batch.num_rows, pa.string()),
                 pa.array(at, pa.int64()), pa.array(length, pa.int64())],
                ["number", "key", "file", "at", "length"],
            )
        if out is not None:
            out.close()

    return run


def _order(number: str) -> str:
    """Ids as text that sorts like the numbers, the null one first."""
    return "-" if number == "null" else f"{int(number) + (1 << 63):020d}"


def _order_column(number: Column) -> Column:
    shifted = number.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(number.isNull(), F.lit("-")).otherwise(F.lpad(shifted.cast("string"), 20, "0"))


def _indexer(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, lines, entries = None, [], []

        def block() -> None:
            raw = gzip.compress("".join(lines).encode("utf-8", "surrogatepass"), _LEVEL, mtime=0)
            first = lines[0].split(" ", 3)
            entries.append((first[0], first[2], out.write(raw), len(raw)))
            lines.clear()

        for batch in batches:
            for key, number, file, at, length in zip(*(batch[c] for c in ("key", "number", "file", "at", "length"))):
                if out is None:
                    out = Writer(folder, f"index-{TaskContext.get().partitionId():06d}", "cdx.gz")
                lines.append(f"{key} {_STAMP} {_order(number)} {number} {file} {at} {length}\n")
                if len(lines) == BLOCK_LINES:
                    block()
        if out is not None:
            if lines:
                block()
            out.close()
            directory = Writer(folder, f"directory-{TaskContext.get().partitionId():06d}", "idx")
            directory.write("".join(f"{k} {n} {out.name} {at} {length}\n" for k, n, at, length in entries).encode("utf-8", "surrogatepass"))
            directory.close()
            yield pd.DataFrame({"key": [entries[0][0]], "number": [entries[0][1]], "name": [directory.name]})

    return run


def write(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *,
    folder: str | None = None, least_bytes: int = 0,
) -> Archives:
    """Write one record per page, and the index.

    Payloads are the html in UTF-8, null ones empty. Equal payloads of at least
    ``least_bytes`` bytes are one response, the smallest id, and revisits; rows that repeat
    that id are responses too. A null id is never the smallest of several. A null URL is
    written as an empty one. No rows give no files.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    page = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    page = page.withColumn("sha", F.sha1("html")).withColumn("size", F.octet_length("html"))
    prints = stored(page.select("id", "sha", "size"))
    first = prints.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    repeats = (
        prints.join(first.where("n > 1"), ["sha", "size"]).where("first is not null and not (id <=> first)")
        .select(F.col("id").alias("r_id"), F.col("sha").alias("r_sha"), "first").distinct()
    )
    rows = page.join(repeats, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("sha") == F.col("r_sha")), "left").select(
        F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("number"), "url", "html", "sha",
        F.col("first").cast("string").alias("refers"), url_key(F.col("url")).alias("key"),
    )
    written = stored(
        rows.mapInArrow(_writer(folder), "number string, key string, file string, at long, length long")
    )
    order = _order_column(F.when(F.col("number") != "null", F.col("number")).cast("long"))
    indexed = stored(
        written.withColumn("order", order).repartitionByRange(tasks, "key", "order", "file", "at")
        .sortWithinPartitions("key", "order", "file", "at")
        .mapInPandas(_indexer(folder), "key string, number string, name string")
    )
    # One row per index task.
    return Archives(folder, sorted(((r.key, r.number), r.name) for r in indexed.collect()))


# ------------------------------------------------------------------------- reading


class CaptureIndex:
    """Lookups in an index; the last directory and the last block stay in memory."""

    def __init__(self, archives: Archives):
        self.archives, self.ranges = archives, Ranges(archives.folder)
        self.firsts = [first for first, _ in archives.shards]
        self.directory, self.block = (None, [], []), (None, [], [])

    def _directory(self, shard: int) -> tuple[list[tuple[str, str]], list[list[str]]]:
        if self.directory[0] != shard:
            fs, path = opened(self.archives.folder)
            with fs.open_input_file(f"{path}/{self.archives.shards[shard][1]}") as f:
                lines = [x.split(" ") for x in f.read().decode("utf-8", "surrogatepass").split("\n")[:-1]]
            self.directory = shard, [(x[0], x[1]) for x in lines], [x[2:] for x in lines]
        return self.directory[1:]

    def _block(self, shard: int, number: int, file: str, at: str, length: str):
        if self.block[0] != (shard, number):
            raw = zlib.decompress(self.ranges.read(file, int(at), int(length)), 31)
            lines = [x.split(" ") for x in raw.decode("utf-8", "surrogatepass").split("\n")[:-1]]
            self.block = (shard, number), [(x[0], x[2]) for x in lines], lines
        return self.block[1:]

    def captures(self, key: str, order: str | None = None) -> Iterator[tuple[str, str, int, int]]:
        """(id, archive, begin, length) of the captures of a key, or of one id of it."""
        low = (key, order or "")
        shard = max(0, bisect_right(self.firsts, low) - 1)
        # Equal captures may begin at the end of the part before.
        while shard > 0 and self.firsts[shard] >= low:
            shard -= 1
        while shard < len(self.firsts):
            firsts, places = self._directory(shard)
            number = max(0, bisect_right(firsts, low) - 1)
            while number > 0 and firsts[number] >= low:
                number -= 1
            while number < len(places):
                keys, lines = self._block(shard, number, *places[number])
                # The first line at or above the capture asked for.
                at, hi = 0, len(keys)
                while at < hi:
                    mid = (at + hi) // 2
                    at, hi = (mid + 1, hi) if keys[mid] < low else (at, mid)
                for k, line in zip(keys[at:], lines[at:]):
                    if k[0] != key or (order is not None and k[1] != order):
                        return
                    yield line[3], line[4], int(line[5]), int(line[6])
                number += 1
            shard += 1


def lookup(spark, archives: Archives, url: str) -> list[tuple[dict[str, str], bytes]]:
    """Headers and payload of every capture of a URL; revisits have an empty payload."""
    key = spark.range(1).select(url_key(F.lit(url))).first()[0]
    ranges = Ranges(archives.folder)
    return [parsed(ranges.read(file, at, length)) for _, file, at, length in CaptureIndex(archives).captures(key)]


def _finder(archives: Archives):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = CaptureIndex(archives)
        for batch in batches:
            found = [c for key, order in zip(batch["key"], batch["order"]) for c in index.captures(key, order)]
            yield pd.DataFrame(found, columns=["number", "file", "at", "length"])

    return run


def _number_of(record_id: str) -> str:
    return record_id.removeprefix("<urn:page:").removesuffix(">")


def _reader(archives: Archives):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges = Ranges(archives.folder)
        for batch in batches:
            rows = []
            for file, at, length in zip(batch["file"], batch["at"], batch["length"]):
                fields, payload = parsed(ranges.read(file, int(at), int(length)))
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = fields["WARC-Type"]
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{file}: payload does not have its digest")
                refers = _number_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
                size = len(payload) if kind == "response" else None
                rows.append((_number_of(fields["WARC-Record-ID"]), size, digest, kind, refers))
            out = pd.DataFrame(rows, columns=["number", "payload_bytes", "payload_digest", "record_type", "refers"])
            out["payload_bytes"] = out["payload_bytes"].astype("Int64")
            yield out

    return run


def read(pages: DataFrame, archives: Archives, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of the captures of the given pages.

    Pages are looked up by URL key and id in key order, so that a task reads neighbouring
    blocks; the records found are read in file order. A revisit has the size of the
    response it names.
    """
    spark = pages.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = _order_column(F.col(id_col).cast("long"))
    asked = pages.select(url_key(F.col(url_col).cast("string")).alias("key"), order.alias("order")).distinct()
    places = asked.repartitionByRange(tasks, "key", "order").sortWithinPartitions("key", "order").mapInPandas(
        _finder(archives), "number string, file string, at long, length long"
    )
    records = stored(
        places.repartitionByRange(tasks, "file", "at").sortWithinPartitions("file", "at").mapInPandas(
            _reader(archives), "number string, payload_bytes long, payload_digest string, record_type string, refers string"
        )
    )
    sizes = records.where("record_type = 'response'").groupBy("number", "payload_digest").agg(F.max("payload_bytes").alias("full"))
    sizes = sizes.select(F.col("number").alias("s_number"), F.col("payload_digest").alias("s_digest"), "full")
    # Responses know their size already; only revisits take part in the join.
    revisits = records.where("record_type = 'revisit'").join(
        sizes, (F.col("refers") == F.col("s_number")) & (F.col("payload_digest") == F.col("s_digest")), "left"
    )
    columns = ["payload_digest", "record_type"]
    shown = F.when(F.col("number") != "null", F.col("number")).cast("long").alias(id_col)
    return records.where("record_type = 'response'").select(
        shown, "payload_bytes", *columns, F.lit(None).cast("long").alias("refers_to")
    ).unionAll(revisits.select(shown, F.col("full").alias("payload_bytes"), *columns, F.col("refers").cast("long").alias("refers_to")))


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """Write the pages to archives, then read every capture back through the index."""
    return read(pages, write(pages, id_col, url_col, html_col, **options), id_col, url_col)
