"""A sparse index of times: one row per stretch of offsets, next to a landed log.

Offsets are looked up by time through it: the first stretch that holds a late enough timestamp is read, and nothing else. It
has a row for so many thousand records, so it is small next to the log, and is itself only read and aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.functions.payload import frame
from loglens.functions.times import after_millis, floor_millis
from loglens.plans.sizing import PARTITION, Limits, bound_per_partition

INDEX_ROWS = 100_000
#: Readers of the log don't see a folder of this name.
FOLDER = "_time_index"


def time_index(log: DataFrame, rows: int = INDEX_ROWS) -> DataFrame:
    """topic, partition, first_offset, last_offset, least, largest (timestamps, null if there are none), records, schemas.

    One row per rows offsets of a partition; schemas are the registries and ids of framed values.
    """
    timed = F.when(F.col("timestampType") != -1, F.col("timestamp"))
    head = frame("value")
    schema = F.when(head.isNotNull(), F.concat_ws(" ", head["registry"], head["schema_id"]))
    return (
        log.groupBy(*PARTITION, F.floor(F.col("offset") / rows).alias("stretch"))
        .agg(
            F.min("offset").alias("first_offset"),
            F.max("offset").alias("last_offset"),
            F.min(timed).alias("least"),
            F.max(timed).alias("largest"),
            F.count(F.lit(1)).alias("records"),
            F.sort_array(F.collect_set(schema)).alias("schemas"),
        )
        .drop("stretch")
    )


def write_index(log: DataFrame, path: str, mode: str = "errorifexists", rows: int = INDEX_ROWS) -> None:
    """Writes the index of records that are landed at path; mode append adds those of newly landed ones."""
    time_index(log, rows).write.mode(mode).parquet(f"{path.rstrip('/')}/{FOLDER}")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{FOLDER}")


def _stretches(log: DataFrame, index: DataFrame, late: Column, limits: Limits | None) -> DataFrame:
    """Records of each partition's first stretch with a late enough timestamp."""
    first = F.min(F.struct("first_offset", "last_offset")).alias("s")
    bounds = index.where(late).groupBy(*PARTITION).agg(first).select(*PARTITION, "s.first_offset", (F.col("s.last_offset") + 1).alias("end_offset"))
    return bound_per_partition(log, bounds, lower="first_offset", upper="end_offset", limits=limits)


def indexed_offsets(log: DataFrame, index: DataFrame, times: dict[str, tuple[Column, bool]], limits: Limits | None = None) -> DataFrame:
    """Per partition, the first offset at or after each time (False) or later than it (True), in milliseconds.

    The log must be whole, as far as its partitions are kept: an index knows nothing of other bounds.
    """
    found = None
    for name, (t, later) in times.items():
        least = after_millis(t) if later else floor_millis(t)
        near = _stretches(log, index, F.col("largest") >= least, limits)
        hit = (F.col("timestampType") != -1) & (F.col("timestamp") >= least)
        own = near.where(hit).groupBy(*PARTITION).agg(F.min("offset").alias(name))
        found = own if found is None else found.join(own, PARTITION, "full")
    return found


def indexed_ends(index: DataFrame) -> DataFrame:
    """topic, partition, end_offset: what the log showed when the index was written."""
    return index.groupBy(*PARTITION).agg((F.max("last_offset") + 1).alias("end_offset"))


def indexed_schemas(index: DataFrame) -> DataFrame:
    """registry, schema_id: which schemas the values use."""
    named = index.select(F.explode("schemas").alias("s")).distinct()
    return named.select(F.split_part("s", F.lit(" "), F.lit(1)).alias("registry"), F.split_part("s", F.lit(" "), F.lit(2)).alias("schema_id"))
