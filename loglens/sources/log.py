"""Reading and landing record logs.

A record log has the columns of Spark's Kafka source, whether it comes from a
broker or from files, so every operator works on both.
"""

from __future__ import annotations

import datetime as dt
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglens.functions.selectors import parse_selector

LOG_SCHEMA = T.StructType(
    [
        T.StructField("topic", T.StringType(), False),
        T.StructField("partition", T.IntegerType(), False),
        T.StructField("offset", T.LongType(), False),
        T.StructField("timestamp", T.TimestampType(), True),
        T.StructField("timestampType", T.IntegerType(), False),
        T.StructField("key", T.BinaryType(), True),
        T.StructField("value", T.BinaryType(), True),
    ]
)
LOG_COLUMNS = LOG_SCHEMA.fieldNames()
# Landed logs have topic and partition inside their files, for row-group statistics, and once more as folders.
FOLDERS = {"topic": "in_topic", "partition": "in_partition"}
SLICE_ROWS = 4_000_000


def as_log(df: DataFrame) -> DataFrame:
    """The seven log columns with their types; without a timestamp type it is 0."""
    if "timestampType" not in df.columns:
        df = df.withColumn("timestampType", F.lit(0))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA])


def _files(reader, format: str, source: str, options: dict[str, str]) -> DataFrame:
    """Files with the log columns; the given schema keeps a topic named 007 a text."""
    return as_log(reader.format(format).schema(LOG_SCHEMA).options(**options).load(source))


def _landed(spark: SparkSession, format: str, source: str, options: dict[str, str]) -> DataFrame:
    """Files, of a landed log with the equality of folders and columns.

    Out of it the optimizer derives that whatever is asked of topic and partition holds for the folders too. So a
    condition on single partitions and their offsets prunes folders, and reaches the row groups as a whole.
    """
    if not set(FOLDERS.values()) <= set(spark.read.format(format).options(**options).load(source).columns):
        return _files(spark.read, format, source, options)
    kinds = {f.name: f for f in LOG_SCHEMA}
    both = T.StructType([*LOG_SCHEMA, *[T.StructField(folder, kinds[c].dataType) for c, folder in FOLDERS.items()]])
    df = spark.read.format(format).schema(both).options(**options).load(source)
    for c, folder in FOLDERS.items():
        df = df.where(F.col(c) == F.col(folder))
    return as_log(df)


def select_partition(log: DataFrame, selector: str | None) -> DataFrame:
    """Records of ``topic`` or ``topic-N``: literal predicates that prune the scan."""
    if selector is None:
        return log
    topic, partition = parse_selector(selector)
    log = log.where(F.col("topic") == topic)
    return log if partition is None else log.where(F.col("partition") == partition)


# How the source names the two ends of a partition, and spellings of them.
KAFKA_EARLIEST, KAFKA_LATEST = -2, -1
ENDS = {"earliest": "earliest", "beginning": "earliest", "latest": "latest", "end": "latest"}


def kafka_offsets(bounds: DataFrame, lower: str | None = None, upper: str | None = None, n_partitions: DataFrame | None = None) -> dict[str, str]:
    """Offsets per partition as options of the Kafka source, which then reads no more than what lies between them.

    ``bounds`` (topic, partition, lower, upper) has one row per partition, as the bounds of time, tail and end have. A
    partition without a bound is read from its first offset, or to its last one. The source wants all partitions of its
    topics: those up to the last one that is named, or of the catalog ``n_partitions``, are filled in. Keep the operator as
    a filter behind the read; offsets that retention has removed since are its business, too.
    """
    rows = bounds.collect()  # one per partition
    counts: dict[str, int] = {}
    for r in rows:
        counts[r["topic"]] = max(counts.get(r["topic"], 0), r["partition"] + 1)
    if n_partitions is not None:
        counts |= {r["topic"]: max(r["n_partitions"], counts.get(r["topic"], 0)) for r in n_partitions.collect()}

    def option(column: str, otherwise: int) -> str:
        out = {t: {str(p): otherwise for p in range(n)} for t, n in sorted(counts.items())}
        for r in rows:
            if r[column] is not None:
                out[r["topic"]][str(r["partition"])] = max(r[column], 0)
        return json.dumps(out)

    found = {}
    if lower is not None:
        found["startingOffsets"] = option(lower, KAFKA_EARLIEST)
    if upper is not None:
        found["endingOffsets"] = option(upper, KAFKA_LATEST)
    return found


def kafka_options(
    servers: str,
    selector: str,
    offset: str = "earliest",
    from_time: dt.datetime | None = None,
    to_time: dt.datetime | None = None,
    streaming: bool = False,
    min_partitions: int | None = None,
    **extra: str,
) -> dict[str, str]:
    """Options of Spark's Kafka source for one topic or partition.

    ``offset`` is an end of the log (earliest or beginning, latest or end), or what ``kafka_offsets`` made of bounds; a
    number of offsets before the end needs these. Times must be aware datetimes. The source starts at the first offset at or
    after ``from_time`` (or at the end if there is none). Its end looks at the
    whole partition, so ``to_time`` is one ms later here and still has to be
    applied as an operator. Connection and login settings
    are passed through ``extra`` (``kafka.security.protocol`` and so on).
    """
    topic, partition = parse_selector(selector)
    if offset not in ENDS and not offset.startswith("{"):
        raise ValueError("An offset of the Kafka source is an end of the log (earliest, latest) or the JSON of kafka_offsets.")
    options = {"kafka.bootstrap.servers": servers, "startingOffsets": ENDS.get(offset, offset)}
    if partition is None:
        options["subscribe"] = topic
    else:
        options["assign"] = json.dumps({topic: [partition]})

    def millis(t: dt.datetime) -> str:
        if t.tzinfo is None:
            raise ValueError("times for the Kafka source need a time zone")
        epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
        return str((t - epoch) // dt.timedelta(milliseconds=1))

    if from_time is not None:
        del options["startingOffsets"]
        options["startingTimestamp"] = millis(from_time)
        options["startingOffsetsByTimestampStrategy"] = "latest"
    if to_time is not None and not streaming:
        options["endingTimestamp"] = str(int(millis(to_time)) + 1)
    if min_partitions is not None:
        options["minPartitions"] = str(min_partitions)
    return options | extra


def _one(ends: DataFrame, topic: str, partition: int) -> str:
    """The start of a single partition, which is all that an assigned source wants to know."""
    row = ends.first()
    return json.dumps({topic: {str(partition): KAFKA_EARLIEST if row is None else max(row["first"], 0)}})


def read_log(
    spark: SparkSession, source: str, selector: str | None = None, format: str = "parquet", **options: str
) -> DataFrame:
    """Bounded read of a landed log, or with ``format="kafka"`` of a broker list."""
    if format == "kafka":
        if selector is None:
            raise ValueError("reading from a broker needs a topic or topic-partition")
        offset = str(options.pop("offset", "earliest"))
        last = int(offset) if re.fullmatch(r"-[1-9][0-9]*", offset) else None
        if last is not None:  # one pass over offsets says where to start, the payloads are read from there
            topic, partition = parse_selector(selector)
            narrow = spark.read.format("kafka").options(**kafka_options(source, selector, **options)).load()
            ends = narrow.groupBy("topic", "partition").agg((F.max("offset") + 1 + last).alias("first"))
            offset = kafka_offsets(ends, "first")["startingOffsets"] if partition is None else _one(ends, topic, partition)
        wanted = kafka_options(source, selector, offset, **options)
        if wanted.get("startingOffsets") == "latest":
            raise ValueError("a bounded read cannot start at the latest offset; follow_log does")
        return as_log(spark.read.format("kafka").options(**wanted).load())
    return select_partition(_landed(spark, format, source, options), selector)


def follow_log(
    spark: SparkSession, source: str, selector: str | None = None, format: str = "parquet", **options: str
) -> DataFrame:
    """Unbounded read. Progress lives in the checkpoint of the query, not in a consumer group.

    Landed files must appear in offset order per partition.
    """
    if format == "kafka":
        if selector is None:
            raise ValueError("following a broker needs a topic or topic-partition")
        wanted = kafka_options(source, selector, streaming=True, **options)
        return as_log(spark.readStream.format("kafka").options(**wanted).load())
    return select_partition(_files(spark.readStream, format, source, options), selector)


def land_log(
    log: DataFrame, path: str, mode: str = "errorifexists", slice_rows: int = SLICE_ROWS, key_filter: bool = True, **options: str
) -> None:
    """Write a log so that later reads prune: by directory, then by offset statistics, then by key.

    A partition is cut into slices of offsets, so a hot one is written by many
    tasks, and every file holds one sorted range of offsets. With ``key_filter``
    each row group says which keys it may hold (a Bloom filter, sized by the keys
    it has, 1 MB at most), as least and greatest key say nothing where keys are mixed;
    ``scan_key`` without ``verify`` reads only those that may hold its key.
    Options are the writer's, such as ``compression``.
    """
    if key_filter:
        options = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.adaptive.enabled": "true"} | options
    slices = F.floor(F.col("offset") / slice_rows)
    (
        as_log(log)
        .repartition(F.col("topic"), F.col("partition"), slices)
        .sortWithinPartitions("topic", "partition", "offset")
        .withColumns({folder: F.col(c) for c, folder in FOLDERS.items()})
        .write.mode(mode)
        .options(**options)
        .partitionBy(*FOLDERS.values())
        .parquet(path)
    )


def read_schemas(spark: SparkSession, path: str, format: str = "parquet", **options: str) -> DataFrame:
    """Exported schemas: registry (``confluent`` or ``glue``), schema_id, definition."""
    return as_schemas(spark.read.format(format).options(**options).load(path))


def as_schemas(df: DataFrame) -> DataFrame:
    return df.select(
        F.lower("registry").alias("registry"),
        F.lower(F.col("schema_id").cast("string")).alias("schema_id"),
        F.col("definition").cast("string").alias("definition"),
    )
