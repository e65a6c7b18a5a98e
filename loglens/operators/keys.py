"""Keys and the partitions they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.functions.partitioner import kafka_partition, partition_of
from loglens.functions.text import REPLACEMENT, utf8_lossy
from loglens.operators.catalog import topic_catalog
from loglens.plans.sizing import Limits, attach_per_topic
from loglens.plans.staging import with_computed


def key_is(key: str) -> Column:
    """The key as text equals ``key``; a null key counts as empty.

    Malformed bytes always show a replacement character, so without one in
    ``key`` the bytes can be compared, which the scan can use.
    """
    if REPLACEMENT in key:
        return utf8_lossy(F.coalesce(F.col("key"), F.lit("").cast("binary"))) == key
    same = F.col("key") == F.lit(key.encode())
    return same | F.col("key").isNull() if key == "" else same


def partition_count(log: DataFrame, topic: str) -> int:
    """Partitions of one topic as far as the log shows them."""
    last = log.where(F.col("topic") == topic).agg(F.max("partition")).first()[0]
    if last is None:
        raise ValueError(f"Topic {topic} does not exist.")
    return last + 1


def _wrong_partitioner(topic: str, key: str) -> str:
    return (
        f"Key {key} may be anywhere in {topic}: its partition holds keys which murmur2 would have put elsewhere. "
        f"Name the right one as {topic}-N, or search all partitions for the text {key}."
    )


def in_key_partition(
    log: DataFrame, topic: str, key: str, n_partitions: int | None = None, partition: int | None = None
) -> DataFrame:
    """Only the partition of a key, or the one that was named explicitly."""
    if partition is None:
        partition = partition_of(key, n_partitions or partition_count(log, topic))
    return log.where((F.col("topic") == topic) & (F.col("partition") == partition))


def keep_key(log: DataFrame, topic: str, key: str, n_partitions: int | None = None) -> DataFrame:
    """Records with a key, out of the partition it belongs to.

    With ``n_partitions``, other keys met on the way must belong there too: one
    that does not fails the job, as the topic has another partitioner.
    """
    if n_partitions is None:
        return log.where(key_is(key))
    misplaced = F.col("partition") != F.col("_expected")
    wanted = (
        F.when(F.coalesce(key_is(key), F.lit(False)), True)
        .when(F.coalesce(misplaced, F.lit(False)), F.raise_error(F.lit(_wrong_partitioner(topic, key))).cast("boolean"))
        .otherwise(False)
    )
    return log.withColumn("_expected", kafka_partition("key", n_partitions)).where(wanted).drop("_expected")


def scan_key(
    log: DataFrame,
    topic: str,
    key: str,
    n_partitions: int | None = None,
    partition: int | None = None,
    verify: bool = True,
) -> DataFrame:
    """All records of a key, reading nothing but its partition.

    ``n_partitions`` defaults to what the log shows. An explicit ``partition``
    wins over the computed one and is never verified. ``verify=False`` trusts
    the partitioner and lets the key reach the scan as a pushed filter.
    """
    if partition is None and n_partitions is None:
        n_partitions = partition_count(log, topic)
    scanned = in_key_partition(log, topic, key, n_partitions, partition)
    return keep_key(scanned, topic, key, n_partitions if verify and partition is None else None)


def with_expected_partition(
    log: DataFrame, n_partitions: int | DataFrame | None = None, limits: Limits | None = None
) -> DataFrame:
    """Column ``expected_partition``: where the default partitioner puts the key.

    ``n_partitions`` is a number, a (topic, n_partitions) catalog, or what the
    log shows.
    """
    if isinstance(n_partitions, int):
        counted, n = log, n_partitions
    else:
        catalog = topic_catalog(log) if n_partitions is None else n_partitions
        counted, n = attach_per_topic(log, catalog, "n_partitions", limits), F.col("n_partitions")
    hashed = counted.withColumn("_expected", kafka_partition("key", n))
    return with_computed(hashed, expected_partition=F.col("_expected")).select(*log.columns, "expected_partition")


def partitioner_audit(
    log: DataFrame, n_partitions: int | DataFrame | None = None, limits: Limits | None = None
) -> DataFrame:
    """Keyed records outside the partition of their key."""
    keyed = with_expected_partition(log, n_partitions, limits)
    return keyed.where(F.col("key").isNotNull() & (F.col("partition") != F.col("expected_partition")))


def audit_summary(
    log: DataFrame, n_partitions: int | DataFrame | None = None, limits: Limits | None = None
) -> DataFrame:
    """topic, partition, records, mismatches: keyed records and those outside their partition."""
    keyed = with_expected_partition(log, n_partitions, limits).where(F.col("key").isNotNull())
    return keyed.groupBy("topic", "partition").agg(
        F.count(F.lit(1)).alias("records"),
        F.count(F.when(F.col("partition") != F.col("expected_partition"), 1)).alias("mismatches"),
    )
