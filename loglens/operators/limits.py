"""Stop rules that look at the whole read: number of records, inactivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loglens.operators.bounds import has_time
from loglens.plans.sizing import BROADCAST_ROWS, PARTITION, few_rows, join_side

# Records up to this number fit the heap of a top-n; more are cut by offset.
TOP_N = 10_000
BUCKETS = 10_000


def take_consumed(log: DataFrame, n: int, top_n: int = TOP_N, buckets: int = BUCKETS, from_starts: bool = False) -> DataFrame:
    """The first ``n`` records in the order (offset, topic, partition), or with ``from_starts`` by offsets behind the first one.

    Both are orders in which a consumer may receive them: every
    partition contributes its first records, without gaps. A log that starts at
    other offsets than 0, as after a tail or from a time, should be taken
    from its starts, so that partitions with low offsets don't come first as a whole; these are
    looked up by one narrow aggregate. Bound the log before and filter it after,
    because the limit counts consumed records.
    """
    if n <= 0:
        return log.where(F.lit(False))
    placed, at = log, "offset"
    if from_starts:
        starts = log.groupBy(*PARTITION).agg(F.min("offset").alias("_start"))
        placed, at = log.join(join_side(starts, few_rows(starts, BROADCAST_ROWS)), PARTITION), "_at"
        placed = placed.withColumn(at, F.col("offset") - F.col("_start"))
    taken = placed.orderBy(at, *PARTITION).limit(n) if n <= top_n else _first_records(placed, n, buckets, at)
    return taken.select(*log.columns)


def _first_records(log: DataFrame, n: int, buckets: int, at: str) -> DataFrame:
    """The limit as a predicate on the place (column ``at``), for limits too large for one task.

    Counts per range of places are narrowed down until the n-th record's
    place is found. There, whole partitions are taken in their order; only of
    a record that was delivered repeatedly, the last one taken, some copies
    are cut off.
    """
    low, high = log.agg(F.min(at), F.max(at)).first()
    if low is None:
        return log
    taken = 0
    while True:
        width = -(-(high - low + 1) // max(buckets, 2))
        counts = (
            log.where(F.col(at).between(low, high))
            .groupBy(F.floor((F.col(at) - low) / width).alias("bucket"))
            .count()
            .orderBy("bucket")
            .collect()
        )
        for bucket, count in counts:
            if taken + count > n:
                break
            taken += count
        else:
            return log.where(F.col(at) <= high)
        low, high = low + bucket * width, min(high, low + (bucket + 1) * width - 1)
        if width == 1:
            break
    before = F.col(at) < low
    if n == taken:
        return log.where(before)
    topic = partition = None
    for topic, partition, count in log.where(F.col(at) == low).groupBy(*PARTITION).count().orderBy(*PARTITION).toLocalIterator():
        if taken + count >= n:
            break
        taken += count
    smaller = (F.col("topic") < topic) | ((F.col("topic") == topic) & (F.col("partition") < partition))
    last = (F.col(at) == low) & (F.col("topic") == topic) & (F.col("partition") == partition)
    return log.where(before | ((F.col(at) == low) & smaller)).unionByName(log.where(last).limit(n - taken))


def idle_cut(log: DataFrame, seconds: int) -> int | None:
    """Epoch milliseconds of the last record before the first gap longer than ``seconds``.

    Records are grouped into buckets of that length. The next record can only
    be in the next bucket; otherwise the gap is longer. So every bucket is
    matched with its successor by number, and no global order is needed.
    """
    width = seconds * 1000
    ms = F.unix_millis(F.col("timestamp"))
    bucket = F.floor(ms / width)
    spans = (
        log.where(has_time() & F.col("timestamp").isNotNull())
        .groupBy(bucket.alias("bucket"))
        .agg(F.min(ms).alias("first"), F.max(ms).alias("last"))
    )
    sides = spans.select(
        F.explode(
            F.array(
                F.struct(F.col("bucket"), F.col("last"), F.lit(None).cast("bigint").alias("next")),
                F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(None).cast("bigint").alias("last"), F.col("first").alias("next")),
            )
        ).alias("s")
    ).select("s.*")
    ends = sides.groupBy("bucket").agg(F.max("last").alias("last"), F.max("next").alias("next"))
    gap = F.col("last").isNotNull() & (F.col("next").isNull() | (F.col("next") - F.col("last") > width))
    return ends.where(gap).agg(F.min("last")).first()[0]


def until_idle(log: DataFrame, seconds: int) -> DataFrame:
    """Replay: records up to the first gap of more than ``seconds`` between timestamps.

    Records without a timestamp cannot be placed in time and are kept.
    """
    if seconds <= 0:
        raise ValueError("the number of seconds must be positive")
    cut = idle_cut(log, seconds)
    if cut is None:
        return log
    before = F.col("timestamp") < F.timestamp_millis(F.lit(cut + 1))
    return log.where(before | F.col("timestamp").isNull() | ~has_time())


def observe_consumed(log: DataFrame, name: str = "consumed") -> tuple[DataFrame, Observation]:
    """Counts the records that pass this point while the query runs, at no extra pass."""
    progress = Observation(name)
    return log.observe(progress, F.count(F.lit(1)).alias("records")), progress
