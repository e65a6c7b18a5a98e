"""Following a log: the stop rules of a read, applied to a stream.

The stream itself stays a plain map-only plan. What has to be remembered is one
offset per partition and one counter, so it is not kept per record in a state
store (which would send every payload of a hot partition through one task) but
found per micro-batch by a small aggregate and written next to the checkpoint.
A restarted or repeated batch reads what its predecessor wrote; two folders,
which batches write by turns, are all that is kept. A batch is read once and held
while it is aggregated and emitted.
"""

from __future__ import annotations

import datetime as dt
import threading
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from loglens.operators.bounds import Time, as_time, passed
from loglens.operators.limits import take_consumed
from loglens.plans.sizing import BROADCAST_ROWS, PARTITION, bound_per_partition, few_rows, local_table

STATE = "batch long, topic string, partition int, last long, stop long, consumed long"
UNORDERED = "Records of {}-{} did not arrive in offset order."


def take_stream(stream: DataFrame, n: int) -> DataFrame:
    """Any first ``n`` records of a stream, in append mode; see ``Follow`` for a fixed order."""
    return stream.limit(n)


class _Progress(StreamingQueryListener):
    """What the query of a follow reports: records so far, and when some came last."""

    def __init__(self):
        self.run, self.consumed, self.last_input = None, 0, time.monotonic()
        self.news = threading.Event()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        if str(p.runId) == self.run and p.numInputRows > 0:
            self.consumed += p.numInputRows
            self.last_input = time.monotonic()
            self.news.set()

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if str(event.runId) == self.run:
            self.news.set()


class Follow:
    """A bounded follow: stops per partition at a time, or after a number of records.

    ``emit(df, batch_id)`` gets the records of every micro-batch that are still
    within the bounds. Like any foreachBatch sink it may see the same batch
    again after a failure, with the same rows. A checkpoint goes on with the stop
    rule that it began with.
    """

    def __init__(
        self,
        stream: DataFrame,
        emit: Callable[[DataFrame, int], None],
        checkpoint: str,
        end: Time | None = None,
        max_records: int | None = None,
        now: dt.datetime | str | None = None,
        most_partitions: int = BROADCAST_ROWS,
    ):
        if end is not None and max_records is not None:
            raise ValueError("end and max_records cannot be used together")
        self.spark = stream.sparkSession
        self.stream, self.emit, self.max_records = stream, emit, max_records
        self.checkpoint, self.state, self.rule_at = f"{checkpoint}/query", f"{checkpoint}/bounds", f"{checkpoint}/rule"
        self.end = None if end is None else as_time(stream, end, now, end=True)
        self.rule = "end" if end is not None else "max_records" if max_records is not None else "none"
        self.most_partitions = most_partitions
        self.finished = False
        self.query: StreamingQuery | None = None
        self.progress = _Progress()
        self._held: tuple[int, dict] | None = None  # the bounds that a batch left, if they are few

    @property
    def consumed(self) -> int:
        """Records that the running query has read."""
        return self.progress.consumed

    def _same_rule(self) -> None:
        try:
            began = self.spark.read.schema("rule string").json(self.rule_at).first()["rule"]
        except AnalysisException:  # a new checkpoint
            self.spark.createDataFrame([(self.rule,)], "rule string").coalesce(1).write.json(self.rule_at)
            return
        if began != self.rule:
            raise ValueError(f"The checkpoint {self.checkpoint} began with the stop rule {began}, so it can't go on with {self.rule}.")

    def start(self, **trigger) -> StreamingQuery:
        """Start with the options of ``DataStreamWriter.trigger``."""
        self._same_rule()
        writer = self.stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", self.checkpoint)
        self.query = (writer.trigger(**trigger) if trigger else writer).start()
        return self.query

    def wait(self, idle_seconds: float | None = None, n_partitions: int | None = None, poll: float = 0.5) -> None:
        """Block until the query ends by itself, is done, or had no input for a while.

        Done means: the number of records is reached, or all ``n_partitions``
        have passed the end time. A batch that takes long isn't idle.
        """
        self.n_partitions = n_partitions
        self.progress.run, self.progress.last_input = str(self.query.runId), time.monotonic()
        self.spark.streams.addListener(self.progress)
        try:
            while self.query.isActive:
                self.progress.news.wait(poll)
                self.progress.news.clear()
                if self.query.status["isTriggerActive"] and self.query.status["isDataAvailable"]:
                    self.progress.last_input = time.monotonic()
                idle = idle_seconds is not None and time.monotonic() - self.progress.last_input > idle_seconds
                if self.query.isActive and (idle or self._done()):
                    self.query.stop()
        finally:
            self.spark.streams.removeListener(self.progress)
        if self.query.exception() is not None:
            raise self.query.exception()

    def _done(self) -> bool:
        stopped = getattr(self, "stopped", 0)
        return self.finished or (self.n_partitions is not None and stopped >= self.n_partitions)

    def _slot(self, batch_id: int) -> str:
        return f"{self.state}/slot={batch_id % 2}"

    def _before(self, batch_id: int) -> DataFrame | None:
        """The bounds as the last earlier batch left them."""
        if batch_id == 0:
            return None
        return self.spark.read.schema(STATE).parquet(self._slot(batch_id - 1)).where(F.col("batch") == batch_id - 1)

    def _remember(self, bounds: DataFrame, batch_id: int) -> DataFrame:
        bounds.coalesce(1).write.mode("overwrite").parquet(self._slot(batch_id))
        return self.spark.read.schema(STATE).parquet(self._slot(batch_id))

    def _batch(self, batch: DataFrame, batch_id: int) -> None:
        if self.rule == "none":
            self.emit(batch, batch_id)
            return
        batch = batch.persist()
        try:
            (self._until_end if self.rule == "end" else self._until_max)(batch, batch_id)
        finally:
            batch.unpersist()

    def _few_before(self, batch_id: int) -> dict | None:
        """(topic, partition) to (last, stop) as the batch before left it, if they are few."""
        if self._held is not None and self._held[0] == batch_id - 1:
            return self._held[1]
        before = self._before(batch_id)
        rows = [] if before is None else few_rows(before, self.most_partitions)
        return None if rows is None else {(r["topic"], r["partition"]): (r["last"], r["stop"]) for r in rows}

    def _until_end(self, batch: DataFrame, batch_id: int) -> None:
        seen = batch.groupBy(*PARTITION).agg(
            F.min("offset").alias("first"),
            F.max("offset").alias("last"),
            F.min(F.when(passed(self.end), F.col("offset"))).alias("stop"),
        )
        rows, before = few_rows(seen, self.most_partitions), self._few_before(batch_id)
        if rows is None or before is None or len(before) + len(rows) > self.most_partitions:
            bounds = self._joined(seen, batch_id)
        else:
            bounds = self._merged(rows, before, batch_id)
        inside = bound_per_partition(batch, bounds.select(*PARTITION, "stop"), upper="stop", keep_unbounded=True)
        self.emit(inside, batch_id)

    def _merged(self, rows: list, before: dict, batch_id: int) -> DataFrame:
        """Bounds of few partitions, kept by the driver and written for a restart."""
        now = dict(before)
        for r in rows:
            key = (r["topic"], r["partition"])
            last, stop = before.get(key, (None, None))
            if last is not None and r["first"] <= last:
                raise ValueError(UNORDERED.format(*key))
            now[key] = (r["last"], r["stop"] if stop is None else stop)
        state = self.spark.createDataFrame([(batch_id, *k, *v, None) for k, v in now.items()], STATE)
        state.coalesce(1).write.mode("overwrite").parquet(self._slot(batch_id))
        self._held = (batch_id, now)
        stopped = [(*k, stop) for k, (_, stop) in now.items() if stop is not None]
        self.stopped = len(stopped)
        bounds = self.spark.createDataFrame([], "topic string, partition int, stop long")
        found = [dict(zip(("topic", "partition", "stop"), x)) for x in stopped]
        return local_table(self.spark, found, bounds.schema)

    def _joined(self, seen: DataFrame, batch_id: int) -> DataFrame:
        """The same for any number of partitions."""
        self._held = None
        before = self._before(batch_id)
        if before is None:
            before = self.spark.createDataFrame([], STATE)
        before = before.select(*PARTITION, F.col("last").alias("_last"), F.col("stop").alias("_stop"))
        late = F.format_string(UNORDERED.replace("{}", "%s"), "topic", "partition")
        merged = before.join(seen, PARTITION, "full").select(
            F.lit(batch_id).cast("long").alias("batch"),
            *PARTITION,
            F.when(F.col("first") <= F.col("_last"), F.raise_error(late).cast("long"))
            .otherwise(F.greatest("_last", "last"))
            .alias("last"),
            F.coalesce("_stop", "stop").alias("stop"),
            F.lit(None).cast("long").alias("consumed"),
        )
        bounds = self._remember(merged, batch_id).where(F.col("stop").isNotNull())
        self.stopped = bounds.count()
        return bounds

    def _until_max(self, batch: DataFrame, batch_id: int) -> None:
        before = None if batch_id == 0 else self._before(batch_id).first()
        consumed = 0 if before is None else before["consumed"]
        left = max(self.max_records - consumed, 0)
        taken = min(batch.count(), left)
        state = [(batch_id, None, None, None, None, consumed + taken)]
        self._remember(self.spark.createDataFrame(state, STATE), batch_id)
        self.emit(take_consumed(batch, left), batch_id)
        self.finished = consumed + taken >= self.max_records
