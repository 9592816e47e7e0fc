import datetime

import pytest
from pyspark.sql import SparkSession

import tableweave as tw


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield tw.configure(session)


@pytest.fixture
def no_broadcast(spark):
    """Plan joins as for sides too large to broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def at(text: str) -> datetime.datetime:
    return datetime.datetime.fromisoformat(text)


def rows(df) -> list[tuple]:
    """Rows as tuples, sorted with nulls first."""
    key = lambda row: [(v is not None, str(type(v)), v) for v in row]
    return sorted((tuple(r) for r in df.collect()), key=key)


def only(df) -> dict:
    found = df.collect()
    assert len(found) == 1
    return found[0].asDict()
