"""One call for the whole look into a topic, in the order in which each step counts."""

from __future__ import annotations

import datetime as dt
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.functions.partitioner import partition_of
from loglens.functions.render import render_line
from loglens.functions.selectors import parse_selector
from loglens.operators.bounds import EARLIEST, Time, from_time, start_at, time_range, to_time
from loglens.operators.catalog import resolve_selectors, topic_catalog
from loglens.operators.keys import in_key_partition, keep_key
from loglens.operators.limits import take_consumed, until_idle
from loglens.operators.payloads import FAILFAST, text_filter, with_payloads
from loglens.sources.log import select_partition
from loglens.streaming.follow import Follow


def _named(selector: str | None, log: DataFrame, catalog: DataFrame | None) -> tuple[str, int | None, int | None]:
    """Topic, partition and number of partitions; an error that helps if there is no such thing."""
    if catalog is None:
        if log.isStreaming:  # its topics are not known beforehand
            if selector is None:
                raise ValueError("following needs a topic")
            return *parse_selector(selector), None
        if selector is not None:  # one narrow aggregate settles it if the topic is there
            topic, partition = parse_selector(selector)
            last = log.where(F.col("topic") == topic).agg(F.max("partition")).first()[0]
            if last is not None and (partition is None or partition <= last):
                return topic, partition, last + 1
        catalog = topic_catalog(log)
    spark = log.sparkSession
    r = resolve_selectors(spark.createDataFrame([(selector,)], "selector string"), catalog).first()
    if r["status"] == "unknown_topic":
        raise ValueError(f"There is no topic {r['topic']}; the nearest name is {r['suggestion']}.")
    if r["status"] == "ambiguous":
        raise ValueError("There are several topics, so one has to be named.")
    if r["status"] == "no_topics":
        raise ValueError("There are no topics.")
    n = catalog.where(catalog["topic"] == r["topic"]).select("n_partitions").first()[0]
    if r["status"] != "ok":
        raise ValueError(f"{r['topic']} has partitions 0 to {n - 1}, so there is no {selector}.")
    return r["topic"], r["partition"], n


def _scan(log: DataFrame, topic: str, partition: int | None, key: str | None, n_partitions: int | None) -> DataFrame:
    if key is None:
        return select_partition(log, topic if partition is None else f"{topic}-{partition}")
    if partition is None and n_partitions is None:
        raise ValueError("the number of partitions is needed to find a key's")
    if partition is not None and n_partitions is not None and partition_of(key, n_partitions) != partition:
        usual = partition_of(key, n_partitions)
        warnings.warn(f"Partition {partition} of {topic} is searched, but key {key} usually is in partition {usual}.", stacklevel=3)
    return in_key_partition(log, topic, key, n_partitions, partition)


def _show(
    scan: DataFrame, topic: str, key: str | None, n_partitions: int | None, text: str | None, schemas: DataFrame | None, indent: bool, mode: str
) -> DataFrame:
    """Key, decoding, text and lines: the steps that look at single records."""
    if key is not None:
        scan = keep_key(scan, topic, key, n_partitions)
    if text is None:
        shown = with_payloads(scan, schemas, indent=indent, mode=mode)
    else:
        shown = text_filter(scan, text, schemas, indent=indent, mode=mode)
    return shown.withColumn("line", render_line())


def look(
    log: DataFrame,
    selector: str | None = None,
    offset: str | int | None = None,
    start: Time | None = None,
    end: Time | None = None,
    max_records: int | None = None,
    idle_seconds: int | None = None,
    key: str | None = None,
    text: str | None = None,
    schemas: DataFrame | None = None,
    n_partitions: int | None = None,
    indent: bool = False,
    mode: str = FAILFAST,
    now: dt.datetime | str | None = None,
    catalog: DataFrame | None = None,
    snapshot: DataFrame | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """Records of a topic or partition, bounded, searched and rendered.

    Order: partition, start, end, number of records or idle time, key, decoding,
    text. Adds the rendered payloads and ``line``. ``offset`` and ``start``
    exclude each other, and so do ``end`` and ``max_records``. The topic may be
    left out if there is only one. Topic and partition must exist in the
    ``catalog``, which is by default what the log shows. A stream can start in a
    ``snapshot`` of its log; what stops it is for ``follow_look``. With the time
    ``index`` of a landed log, times are looked up instead of searched.
    """
    if offset is not None and start is not None:
        raise ValueError("offset and start cannot be used together")
    if end is not None and max_records is not None:
        raise ValueError("end and max_records cannot be used together")
    if log.isStreaming and not (end is None and max_records is None and idle_seconds is None):
        raise ValueError("a stream is stopped by follow_look")

    topic, partition, known = _named(selector, log, catalog)
    scan = _scan(log, topic, partition, key, n_partitions or known)
    if snapshot is not None:
        snapshot = _scan(snapshot, topic, partition, key, n_partitions or known)
    if index is not None:  # of the partitions that are read
        index = index.where(F.col("topic") == topic)
        only = partition if partition is not None or key is None else partition_of(key, n_partitions or known)
        index = index if only is None else index.where(F.col("partition") == only)
    if start is not None and end is not None:
        scan = time_range(scan, start, end, now, index=index)
    else:
        whole = str(offset or "earliest") in EARLIEST
        scan = from_time(scan, start, now, snapshot=snapshot, index=index) if start is not None else start_at(scan, offset or "earliest", snapshot=snapshot)
        scan = to_time(scan, end, now, index=index if start is None and whole else None) if end is not None else scan
    if max_records is not None:
        scan = take_consumed(scan, max_records, from_starts=start is not None or str(offset or "earliest") not in EARLIEST)
    if idle_seconds is not None:
        scan = until_idle(scan, idle_seconds)
    return _show(scan, topic, key, (n_partitions or known) if partition is None else None, text, schemas, indent, mode)


def follow_look(
    stream: DataFrame,
    emit: Callable[[DataFrame, int], None],
    checkpoint: str,
    selector: str,
    offset: str | int | None = None,
    start: Time | None = None,
    end: Time | None = None,
    max_records: int | None = None,
    key: str | None = None,
    text: str | None = None,
    schemas: DataFrame | None = None,
    n_partitions: int | None = None,
    indent: bool = False,
    mode: str = FAILFAST,
    now: dt.datetime | str | None = None,
    catalog: DataFrame | None = None,
    snapshot: DataFrame | None = None,
) -> Follow:
    """``look`` on a stream, with its stop rules; ``emit`` gets the rendered records of each micro-batch.

    Start bounds come from ``snapshot``, the log as it is now. The stop rules
    count before key and text are looked at. ``Follow.start`` runs it, and
    ``Follow.wait`` stops it, also after inactivity.
    """
    if offset is not None and start is not None:
        raise ValueError("offset and start cannot be used together")
    topic, partition, known = _named(selector, stream, catalog)
    count = n_partitions or known
    scan = _scan(stream, topic, partition, key, count)
    seen = None if snapshot is None else _scan(snapshot, topic, partition, key, count)
    scan = from_time(scan, start, now, snapshot=seen) if start is not None else start_at(scan, offset or "earliest", snapshot=seen)

    def shown(batch: DataFrame, batch_id: int) -> None:
        emit(_show(batch, topic, key, count if partition is None else None, text, schemas, indent, mode), batch_id)

    return Follow(scan, shown, checkpoint, end=end, max_records=max_records, now=now)
