"""Where reading starts and stops: offsets per partition, found by tail or time.

A time is turned into one offset per partition by a small aggregate over two
columns; the log is then read between offsets. A plain timestamp filter would
give other rows as soon as timestamps are out of order.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.functions.times import after_millis, floor_millis, resolve_times, timestamp_literal
from loglens.plans.sizing import PARTITION, Limits, bound_per_partition, unique
from loglens.sources.index import indexed_ends, indexed_offsets

# Names of the two ends of a log.
EARLIEST = ("earliest", "beginning")
LATEST = ("latest", "end")
INVALID_OFFSET = "An offset is one end of the log (earliest or latest) or minus the number of offsets before the latest."

Time = dt.datetime | str | Column


def _bounded_only(log: DataFrame) -> None:
    if log.isStreaming:
        raise ValueError("Bounds of streams need a snapshot of the log to start in; loglens.streaming.Follow stops them.")


def _from(log: DataFrame, bounds: DataFrame, snapshot: DataFrame | None, limits: Limits | None) -> DataFrame:
    """From the bounds (topic, partition, first) on. What a snapshot doesn't know yet is kept whole."""
    if snapshot is None:
        _bounded_only(log)
    return bound_per_partition(log, bounds, lower="first", keep_unbounded=snapshot is not None, limits=limits)


def as_times(log: DataFrame, times: list[tuple[Time, bool]], now: dt.datetime | str | None = None) -> list[Column]:
    """(time, whether its end is meant): datetimes and columns as they are, texts as expressions under one now."""
    texts = [(t, end) for t, end in times if isinstance(t, str)]
    found = iter(resolve_times(log.sparkSession, texts, now) if texts else [])
    return [next(found) if isinstance(t, str) else timestamp_literal(t) for t, _ in times]


def as_time(log: DataFrame, t: Time, now: dt.datetime | str | None = None, end: bool = False) -> Column:
    return as_times(log, [(t, end)], now)[0]


def has_time() -> Column:
    return F.col("timestampType") != -1


def reached(t: Column) -> Column:
    """Records at or after a time, in milliseconds; the literal stays pushable."""
    return has_time() & (F.col("timestamp") >= floor_millis(t))


def passed(t: Column) -> Column:
    """Records later than a time, in milliseconds."""
    return has_time() & (F.col("timestamp") >= after_millis(t))


def first_offsets(log: DataFrame, **conditions: Column) -> DataFrame:
    """Per partition, the first offset that meets each condition."""
    wanted = conditions.values()
    some = list(wanted)[0]
    for c in list(wanted)[1:]:
        some = some | c
    return (
        log.where(some)
        .groupBy(*PARTITION)
        .agg(*[F.min(F.when(c, F.col("offset"))).alias(name) for name, c in conditions.items()])
    )


def from_time(
    log: DataFrame,
    t: Time,
    now: Time | None = None,
    limits: Limits | None = None,
    snapshot: DataFrame | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """From the first offset with a timestamp at or after ``t``, everything that follows.

    Partitions without such a record give no rows. A stream takes its bounds
    from a ``snapshot``, the log as it is now, and such partitions start at its end.
    With the time ``index`` of the landed log, one stretch of each partition is read for the bound.
    """
    known = log if snapshot is None else snapshot
    _bounded_only(known)
    at = as_time(known, t, now)
    bounds = first_offsets(known, first=reached(at)) if index is None else indexed_offsets(known, index, {"first": (at, False)}, limits)
    if snapshot is not None:
        ends = end_offsets(snapshot).join(bounds, PARTITION, "left")
        bounds = ends.select(*PARTITION, F.coalesce("first", "end_offset").alias("first"))
    return _from(log, bounds, snapshot, limits)


def to_time(
    log: DataFrame, t: Time, now: Time | None = None, limits: Limits | None = None, index: DataFrame | None = None
) -> DataFrame:
    """Up to the first record later than ``t``; nothing after it, even if it is older again.

    Records without a timestamp never stop a partition. Apply it to the log
    that is already bounded at its start. A time ``index`` is only for a log that isn't bounded.
    """
    _bounded_only(log)
    at = as_time(log, t, now, end=True)
    bounds = first_offsets(log, stop=passed(at)) if index is None else indexed_offsets(log, index, {"stop": (at, True)}, limits)
    return bound_per_partition(log, bounds, upper="stop", keep_unbounded=True, limits=limits)


def time_range(
    log: DataFrame, start: Time, end: Time, now: Time | None = None, limits: Limits | None = None, index: DataFrame | None = None
) -> DataFrame:
    """``from_time`` then ``to_time`` with a single pass for both bounds, or with the log's time ``index``.

    Any record later than ``end >= start`` is itself at or after ``start``, so
    its offset is never before the start offset: both minima can be taken over
    the whole partition. With ``end < start`` the first record already stops.
    """
    _bounded_only(log)
    first, last = as_times(log, [(start, False), (end, True)], now)
    if index is None:
        bounds = first_offsets(log, first=reached(first), stop=passed(last))
    else:
        bounds = indexed_offsets(log, index, {"first": (first, False), "stop": (last, True)}, limits)
    bounds = bounds.where(F.col("first").isNotNull() & (floor_millis(last) >= floor_millis(first)))
    return bound_per_partition(log, bounds, lower="first", upper="stop", limits=limits)


def end_offsets(log: DataFrame) -> DataFrame:
    """Per partition, the offset after the last visible record."""
    return log.groupBy(*PARTITION).agg((F.max("offset") + 1).alias("end_offset"))


def tail(
    log: DataFrame,
    n: int,
    ends: DataFrame | None = None,
    limits: Limits | None = None,
    snapshot: DataFrame | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """The last ``n`` offsets of every partition; fewer rows where offsets are missing.

    ``ends`` (topic, partition, end_offset) holds the end offsets of the broker
    if they are known, and may not contradict itself; without it the end is the
    last visible offset plus one, or what the log's time ``index`` says. A stream starts n before the end of a
    ``snapshot``, the log as it is now, and goes on.
    """
    if n <= 0:
        raise ValueError(INVALID_OFFSET)
    if snapshot is None:
        _bounded_only(log)
    if ends is not None:
        known = unique(ends, PARTITION, "end_offset")
    else:
        known = end_offsets(log if snapshot is None else snapshot) if index is None else indexed_ends(index)
    return _from(log, known.select(*PARTITION, (F.col("end_offset") - n).alias("first")), snapshot, limits)


def start_at(
    log: DataFrame, offset: str | int, ends: DataFrame | None = None, snapshot: DataFrame | None = None
) -> DataFrame:
    """``earliest``/``beginning``, ``latest``/``end`` or a negative number of offsets."""
    text = str(offset)
    if text in EARLIEST:
        return log
    if text in LATEST:
        return log.where(F.lit(False)) if snapshot is None else after_snapshot(log, snapshot)
    if not re.fullmatch(r"-[0-9]+", text):
        raise ValueError(INVALID_OFFSET)
    return tail(log, -int(text), ends, snapshot=snapshot)


def after_snapshot(stream: DataFrame, log: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Only records of a stream that lie behind the present end of a landed log.

    Partitions that do not exist yet are kept whole.
    """
    return bound_per_partition(stream, end_offsets(log), lower="end_offset", keep_unbounded=True, limits=limits)
