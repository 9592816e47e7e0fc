"""Results of plan steps kept between runs.

A step's result depends on the tables read so far, their files and the steps up to it. A
hash of all of that names a folder, so a step whose folder is complete is read instead of
run: after a change to the last step, or to its table, only that one runs. Files are known
by path, length and time of change, from listings; no file is opened for it.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .specs import StepSpec, TableSpec


def _hash(*parts: object) -> str:
    text = json.dumps(parts, ensure_ascii=False, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def table_key(spark: SparkSession, spec: TableSpec, location: object, rows: int | None) -> str | None:
    """Name of a table as its files are now; None for one that no files tell."""
    if not isinstance(location, str) or spec.source_kind == "sql":
        return None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(location)
    # Sums over the listing, so that it may be of any length.
    one = F.xxhash64("path", "length", "modificationTime")
    listed = files.select("path", "length", "modificationTime").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.bit_xor(one).alias("mark"),
        F.sum(F.pmod(one, F.lit(1 << 40))).alias("total"),
    ).first()
    return _hash(dataclasses.asdict(spec), location, rows, list(listed))


def step_key(before: str | None, right: str | None, step: StepSpec, growth_limit: float) -> str | None:
    if before is None or right is None:
        return None
    return _hash(before, right, dataclasses.asdict(step), growth_limit)


@dataclass
class KeptStep:
    """A step read from the cache. Extracts are made anew when asked for."""

    step: StepSpec
    output: DataFrame
    report: DataFrame
    remake: Callable[[], object]

    @cached_property
    def _made(self):
        return self.remake()

    @property
    def unmatched_left(self) -> DataFrame:
        return self._made.unmatched_left

    @property
    def unmatched_right(self) -> DataFrame:
        return self._made.unmatched_right


class StepCache:
    """Step results below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, key: str, part: str) -> str:
        return f"{self.folder}/{key}/{part}"

    def has(self, key: str | None) -> bool:
        if key is None:
            return False
        # The report is written last, and its mark when it is complete.
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(key, "report/_SUCCESS"))
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def read(self, key: str, step: StepSpec, remake: Callable[[], object]) -> KeptStep:
        output, report = (self.spark.read.parquet(self._path(key, part)) for part in ("output", "report"))
        return KeptStep(step, output, report, remake)

    def write(self, key: str, result) -> None:
        result.output.write.mode("overwrite").parquet(self._path(key, "output"))
        result.report.write.mode("overwrite").parquet(self._path(key, "report"))
