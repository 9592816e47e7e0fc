"""Session settings the operators are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import PlanError

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot key is split at run time on every side a join type lets Spark split.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the recommended runtime settings to a running session."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """The table written to the cluster's checkpoint folder, its lineage cut.

    The folder is the one the session has or ``spark.checkpoint.dir`` names; it must
    be shared by all executors, so none is made up here.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise PlanError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Where the setting is empty and one machine runs everything, as in tests, it is set to
    a local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise PlanError("set spark.checkpoint.dir to a folder all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tableweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tableweave-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read again: no lineage, known size."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
