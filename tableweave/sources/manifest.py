"""Identity of input files, and the log of runs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 8 << 20
# A table id is this prefix and the first hex digits of the hash.
TABLE_ID_PREFIX, TABLE_ID_LENGTH = "tbl_", 10


def file_manifest(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, sha256, table_id) per file; equal bytes give equal ids.

    Files are streamed: a row of the binary source would hold a whole one.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    hashed = files.select("path", "length").mapInPandas(_stream_hashes, "path string, length bigint, sha256 string")
    return hashed.withColumn(
        "table_id", F.concat(F.lit(TABLE_ID_PREFIX), F.substring("sha256", 1, TABLE_ID_LENGTH))
    )


def distinct_inputs(manifest: DataFrame) -> DataFrame:
    """One row per content: the smallest path stands for its copies."""
    return manifest.groupBy("sha256", "table_id", "length").agg(
        F.min("path").alias("path"), F.count(F.lit(1)).alias("copies")
    )


def _stream_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(sha256=[_hash_file(p) for p in batch["path"]])


def _hash_file(path: str) -> str:
    if path.startswith("file:"):
        system, name = fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    else:
        system, name = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    digest = hashlib.sha256()
    with system.open_input_stream(name) as stream:
        while chunk := stream.read(CHUNK_BYTES):
            digest.update(chunk)
    return digest.hexdigest()


def append_log(entry: DataFrame, path: str) -> None:
    """Append one run to a JSON-lines log."""
    entry.write.mode("append").json(path)
