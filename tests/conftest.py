import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.default.parallelism", "2")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def log(spark):
    """Builds a small record log: rows of (topic, partition, offset, seconds or None, key, value)."""
    import datetime as dt

    from loglens import LOG_SCHEMA

    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)

    def raw(x):
        return x.encode() if isinstance(x, str) else x

    def build(rows):
        full = [
            (t, p, o, None if s is None else start + dt.timedelta(seconds=s), -1 if s is None else 0, raw(k), raw(v))
            for t, p, o, s, k, v in rows
        ]
        return spark.createDataFrame(full, LOG_SCHEMA)

    return build
