"""Topics: list them, resolve requested names against them, suggest similar ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglens.functions.selectors import split_topic_partition
from loglens.plans.sizing import BROADCAST_ROWS, few_rows, held, join_side

# Number of suggestions shown by default.
SUGGESTIONS = 15
# Topics of a part of the catalog, which a name is compared with in one go.
PART_TOPICS = 500


def topic_catalog(log: DataFrame, partitions: DataFrame | None = None) -> DataFrame:
    """topic, n_partitions. A log only shows partitions with records.

    ``partitions`` (topic, n_partitions), e.g. an export of the broker's
    metadata, overrides the observed counts and adds empty topics.
    """
    seen = log.groupBy("topic").agg((F.max("partition") + 1).alias("n_partitions"))
    if partitions is None:
        return seen
    known = partitions.select("topic", F.col("n_partitions").cast("int").alias("known"))
    return seen.join(known, "topic", "full").select(
        "topic", F.coalesce("known", "n_partitions").alias("n_partitions")
    )


def list_lines(catalog: DataFrame) -> DataFrame:
    """``name (partitions)`` per topic."""
    return catalog.select(F.concat("topic", F.lit(" ("), "n_partitions", F.lit(")")).alias("line"))


def nearest_topics(names: DataFrame, catalog: DataFrame, k: int) -> DataFrame:
    """name, rank, topic, distance: the ``k`` closest topics of every distinct name.

    The catalog is packed into arrays of bounded size, as many as it takes. A
    name meets each array once and leaves with at most ``k`` topics, so no pairs
    are shuffled. Topics whose length alone puts ``k`` others of the same array
    ahead of them are not compared.
    """
    catalog = catalog.select("topic")
    parts = max(1, -(-catalog.count() // PART_TOPICS))
    part = F.pmod(F.xxhash64("topic"), F.lit(parts))
    packed = catalog.groupBy(part.alias("part")).agg(F.collect_list("topic").alias("topics"))
    spread = names.select("name").where(F.col("name").isNotNull()).distinct()
    spread = spread.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    size = F.length("name")
    gap = lambda t: F.abs(F.length(t) - size)  # noqa: E731  a distance is at least that
    nearest = F.slice(F.array_sort(F.transform("topics", lambda t: F.struct(gap(t).alias("gap"), t.alias("topic")))), 1, k)
    bound = F.array_max(F.transform(nearest, lambda x: F.levenshtein(F.col("name"), x["topic"])))
    met = spread.join(packed, "part").withColumn("bound", bound)
    close = F.filter("topics", lambda t: gap(t) <= F.col("bound"))
    ranked = F.array_sort(
        F.transform(close, lambda t: F.struct(F.levenshtein(F.col("name"), t).alias("distance"), t.alias("topic")))
    )
    best = met.select("name", F.explode(F.slice(ranked, 1, k)).alias("near"))
    order = Window.partitionBy("name").orderBy("near.distance", "near.topic")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("name", "rank", "near.topic", "near.distance")
    )


def suggest_topics(names: DataFrame | Sequence[str], catalog: DataFrame, k: int = SUGGESTIONS) -> DataFrame:
    """Closest topics per requested name, by edit distance and then by topic."""
    if not isinstance(names, DataFrame):
        names = catalog.sparkSession.createDataFrame([(n,) for n in names], "name string")
    return nearest_topics(names, held(catalog), k)


def resolve_selectors(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """selector, topic, partition, status, suggestion for a table of requested selectors.

    Status is one of ok, bad_partition, partition_out_of_range, unknown_topic
    (with the closest topic as suggestion), ambiguous and no_topics. A null
    selector means the only topic there is.
    """
    catalog = held(catalog.select("topic", "n_partitions"))
    some = [r["topic"] for r in catalog.select("topic").limit(2).collect()]
    only = some[0] if len(some) == 1 else None
    without = "ok" if only is not None else ("ambiguous" if some else "no_topics")

    topic, partition, named = split_topic_partition("selector")
    parsed = requests.select("selector", topic.alias("name"), partition.alias("partition"), named.alias("_named"))
    # the decision per name is small and made once, however often it is requested
    names = parsed.select("name").where(F.col("name").isNotNull()).distinct()
    known = names.join(catalog.select(F.col("topic").alias("name"), "n_partitions"), "name", "left")
    unknown = known.where(F.col("n_partitions").isNull()).select("name")
    near = nearest_topics(unknown, catalog, 1).select("name", F.col("topic").alias("suggestion"))
    decided = known.join(near, "name", "left")
    decided = join_side(decided, few_rows(decided, BROADCAST_ROWS))

    count = F.col("n_partitions")
    status = (
        F.when(F.col("selector").isNull(), without)
        .when(count.isNull(), "no_topics" if not some else "unknown_topic")
        .when(F.col("_named") & F.col("partition").isNull(), "bad_partition")
        .when(F.col("partition") >= count, "partition_out_of_range")
        .otherwise("ok")
    )
    return parsed.join(decided, "name", "left").select(
        "selector",
        F.when(F.col("selector").isNull(), F.lit(only)).otherwise(F.col("name")).alias("topic"),
        "partition",
        status.alias("status"),
        "suggestion",
    )
