"""Small tables that steer a scan: check their size first, then choose how to use them.

Bounds, partition counts and schemas have one row per partition, topic or
schema, which is small next to the log but is not small by definition. The
functions here look at no more rows than a limit and pick one of three plans:

* a few rows become literals, which reach the scan as pushed filters;
* up to the broadcast limit the rows become a broadcast table, and only the
  extremes of groups of similar rows become literals (long predicates are slow
  to evaluate per row);
* beyond that the lazy table itself is joined, and AQE sizes that join.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

LITERAL_ROWS = 8
PRUNED_PARTITIONS = 1000
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024
PARTITION = ["topic", "partition"]


@dataclass
class Limits:
    literal_rows: int = LITERAL_ROWS
    broadcast_rows: int = BROADCAST_ROWS


def unique(table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key of a lookup table; rows that contradict each other fail the job.

    Whatever plan is chosen for the table, it then never multiplies records and never picks one of several values.
    """
    least, most = F.min(value), F.max(value)
    named = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    clash = F.raise_error(F.concat(F.lit(f"There is more than one {value} for "), named)).cast(table.schema[value].dataType)
    found = table.groupBy(*keys).agg(least.alias("_least"), most.alias("_most"))
    return found.select(*keys, F.when(F.col("_least") != F.col("_most"), clash).otherwise(F.col("_least")).alias(value))


def few_rows(table: DataFrame, most: int) -> list[Row] | None:
    """All rows of a table, or None if there are more than ``most``."""
    rows = table.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def local_table(spark: SparkSession, rows: list[Row], schema: T.StructType) -> DataFrame:
    """Rows as a relation inside the plan, whose exact size the planner knows."""
    kinds = {f.name: to_arrow_type(f.dataType) for f in schema}
    columns = {name: pa.array([r[name] for r in rows], kind) for name, kind in kinds.items()}
    return spark.createDataFrame(pa.table(columns), schema)


def join_side(table: DataFrame, rows: list[Row] | None) -> DataFrame:
    """Fetched rows as a broadcast table; without them the lazy table, whose join AQE sizes."""
    return table if rows is None else F.broadcast(local_table(table.sparkSession, rows, table.schema))


def held(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A small table fetched once, so that plans that use it several times do not rescan the log.

    A table with more rows stays lazy.
    """
    rows = few_rows(table, most)
    return table if rows is None else local_table(table.sparkSession, rows, table.schema)


def _same_partition(row: Row) -> Column:
    return (F.col("topic") == row["topic"]) & (F.col("partition") == row["partition"])


def _any(conditions: list[Column]) -> Column:
    """A balanced OR, so that many conditions do not nest deeply."""
    if not conditions:
        return F.lit(False)
    while len(conditions) > 1:
        pairs = [conditions[i : i + 2] for i in range(0, len(conditions), 2)]
        conditions = [p[0] | p[1] if len(p) == 2 else p[0] for p in pairs]
    return conditions[0]


def _near(rows: list[Row], bound: str, groups: int) -> list[list[Row]]:
    """Rows in so many groups of similar bounds: cut where sorted bounds are farthest apart. Nulls are a group."""
    some = sorted((r for r in rows if r[bound] is not None), key=lambda r: r[bound])
    gaps = sorted(range(1, len(some)), key=lambda i: some[i - 1][bound] - some[i][bound])[: groups - 1]
    cuts = [0, *sorted(gaps), len(some)]
    found = [some[a:b] for a, b in zip(cuts, cuts[1:])] + [[r for r in rows if r[bound] is None]]
    return [g for g in found if g]


def _extremes(rows: list[Row], lower: str | None, upper: str | None, groups: int) -> Column:
    """What groups of partitions with similar bounds have in common, to be pushed into the scan.

    One partition with low offsets then doesn't open up all of a partition with high ones.
    """
    tests = []
    for own in _near(rows, lower or upper, groups):
        test = F.lit(True)
        for name in PARTITION:
            values = sorted({r[name] for r in own})
            if len(values) <= PRUNED_PARTITIONS:
                test = test & F.col(name).isin(values)
        if lower and all(r[lower] is not None for r in own):
            test = test & (F.col("offset") >= min(r[lower] for r in own))
        if upper and all(r[upper] is not None for r in own):
            test = test & (F.col("offset") < max(r[upper] for r in own))
        tests.append(test)
    return _any(tests)


def _stops(rows: list[Row], upper: str, groups: int) -> Column:
    """What stop bounds rule out, to be pushed into the scan; partitions that aren't bounded are kept whole.

    Rows are taken topic by topic, so that a condition on partitions holds for no others.
    """
    by_topic: dict[str, list[Row]] = {}
    for r in rows:
        by_topic.setdefault(r["topic"], []).append(r)
    test = F.lit(True)
    if len(by_topic) > groups:
        return test
    for topic, own in by_topic.items():
        for near in _near(own, upper, max(groups // len(by_topic), 1)):
            named = sorted({r["partition"] for r in near})
            if len(named) <= PRUNED_PARTITIONS and all(r[upper] is not None for r in near):
                other = (F.col("topic") != topic) | ~F.col("partition").isin(named)
                test = test & (other | (F.col("offset") < max(r[upper] for r in near)))
    return test


def bound_per_partition(
    log: DataFrame,
    bounds: DataFrame,
    lower: str | None = None,
    upper: str | None = None,
    keep_unbounded: bool = False,
    limits: Limits | None = None,
) -> DataFrame:
    """Rows of ``log`` with ``lower <= offset < upper`` of their partition.

    ``bounds`` has one row per (topic, partition); a null bound does not
    restrict. Partitions without a row are dropped or, with ``keep_unbounded``,
    kept whole.
    """
    limits = limits or Limits()

    def inside(low, high) -> Column:
        test = F.lit(True)
        if low is not None:
            test = test & (F.col("offset") >= low)
        if high is not None:
            test = test & (F.col("offset") < high)
        return test

    rows = few_rows(bounds, max(limits.literal_rows, limits.broadcast_rows))
    if rows is not None and len(rows) <= limits.literal_rows:
        tests = [
            _same_partition(r) & inside(r[lower] if lower else None, r[upper] if upper else None) for r in rows
        ]
        if keep_unbounded:
            tests.append(~_any([_same_partition(r) for r in rows]))
        return log.where(_any(tests))

    if rows is not None and not keep_unbounded:
        log = log.where(_extremes(rows, lower, upper, LITERAL_ROWS))
    elif rows is not None and upper:
        log = log.where(_stops(rows, upper, LITERAL_ROWS))
    side = join_side(bounds, rows)
    names = {c: f"_{c}" for c in side.columns if c not in PARTITION}
    side = side.withColumnsRenamed(names).withColumn("_bounded", F.lit(True))
    joined = log.join(side, PARTITION, "left" if keep_unbounded else "inner")
    test = F.lit(True)
    if lower:
        test = test & F.coalesce(F.col("offset") >= F.col(f"_{lower}"), F.lit(True))
    if upper:
        test = test & F.coalesce(F.col("offset") < F.col(f"_{upper}"), F.lit(True))
    return joined.where(test).select(*log.columns)


def attach_per_topic(
    log: DataFrame, table: DataFrame, column: str, limits: Limits | None = None
) -> DataFrame:
    """``log`` plus the column of a (topic, column) table; null for unknown topics."""
    limits = limits or Limits()
    table = unique(table, ["topic"], column)
    rows = few_rows(table, max(limits.literal_rows, limits.broadcast_rows))
    if rows is not None and len(rows) <= limits.literal_rows:
        value = F.lit(None).cast(table.schema[column].dataType)
        for r in rows:
            value = F.when(F.col("topic") == r["topic"], r[column]).otherwise(value)
        return log.withColumn(column, value)
    return log.join(join_side(table, rows), "topic", "left").select(*log.columns, column)
