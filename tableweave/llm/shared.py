"""Where intermediate tables live: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import PlanError


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names.

    Only where the setting is empty and one machine runs everything, as in tests, a local
    one is made; executors elsewhere would write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise PlanError("set spark.checkpoint.dir to a folder all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tableweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tableweave-{uuid.uuid4().hex}"


def stored(df: DataFrame, **options: str) -> DataFrame:
    """The table written to the shared folder and read again: no lineage, known size."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
