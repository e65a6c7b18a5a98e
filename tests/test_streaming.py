"""Streams against the batch operators, over several micro-batches and a restart."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import loglens as L

START = dt.datetime(2024, 1, 1)


def rows(partitions=3, count=30):
    """Timestamps that go back and forth; partition 2 never reaches the end time."""
    out = []
    for p in range(partitions):
        for o in range(count):
            seconds = None if o % 11 == 5 else o * (1 if p == 2 else 4) + (o * 7919) % 9
            out.append(("t", p, o, seconds, f"k{o % 4}", f"v{p}-{o}"))
    return out


def keys(df):
    return sorted((r["partition"], r["offset"]) for r in df.select("partition", "offset").collect())


class Sink:
    """Keeps what was emitted per batch, as an idempotent sink does."""

    def __init__(self):
        self.batches = {}

    def __call__(self, df, batch_id):
        self.batches[batch_id] = keys(df)

    def all(self):
        return sorted(x for b in self.batches.values() for x in b)


def land_waves(log, path, waves):
    for low, high in waves:
        part = [r for r in rows() if low <= r[2] < high]
        L.land_log(log(part), path, mode="append")


def run(spark, path, sink, checkpoint, **bounds):
    follow = L.Follow(L.follow_log(spark, path), sink, checkpoint, **bounds)
    follow.start(availableNow=True)
    follow.wait()
    return follow


END = START + dt.timedelta(seconds=60)


def test_end_time_over_batches_and_restarts(spark, log, tmp_path):
    path, checkpoint, sink = str(tmp_path / "log"), str(tmp_path / "checkpoint"), Sink()
    for wave in ((0, 10), (10, 20), (20, 30)):
        land_waves(log, path, [wave])
        follow = run(spark, path, sink, checkpoint, end=END)
    assert len(sink.batches) == 3
    assert sink.all() == keys(L.to_time(log(rows()), END))
    assert follow.stopped == 2


def test_record_limit_over_batches_and_restarts(spark, log, tmp_path):
    path, checkpoint, sink = str(tmp_path / "log"), str(tmp_path / "checkpoint"), Sink()
    for wave in ((0, 10), (10, 20), (20, 30)):
        land_waves(log, path, [wave])
        follow = run(spark, path, sink, checkpoint, max_records=40)
    assert sink.all() == keys(L.take_consumed(log(rows()), 40))
    assert follow.finished and sink.batches[2] == []


@pytest.mark.parametrize("most", [100, 1])
def test_few_and_many_partitions_stop_alike(spark, log, tmp_path, most):
    path, checkpoint, sink = str(tmp_path / "log"), str(tmp_path / "checkpoint"), Sink()
    for wave in ((0, 5), (5, 15), (15, 20), (20, 30)):
        land_waves(log, path, [wave])
        follow = run(spark, path, sink, checkpoint, end=END, most_partitions=most)
    assert sink.all() == keys(L.to_time(log(rows()), END)) and follow.stopped == 2
    assert len([x for x in (tmp_path / "checkpoint" / "bounds").iterdir() if x.is_dir()]) == 2


def test_checkpoint_keeps_its_stop_rule(spark, log, tmp_path):
    path, checkpoint = str(tmp_path / "log"), str(tmp_path / "checkpoint")
    land_waves(log, path, [(0, 10)])
    run(spark, path, Sink(), checkpoint)
    with pytest.raises(ValueError, match="began with the stop rule none"):
        run(spark, path, Sink(), checkpoint, end=END)
    run(spark, path, Sink(), checkpoint)


def test_progress_counts_records(spark, log, tmp_path):
    path = str(tmp_path / "log")
    land_waves(log, path, [(0, 20)])
    follow = L.Follow(L.follow_log(spark, path, maxFilesPerTrigger="1"), Sink(), str(tmp_path / "c"))
    follow.start()
    follow.wait(idle_seconds=3)
    assert 0 < follow.consumed <= 60


def test_repeated_batch_gives_the_same_rows(spark, log, tmp_path):
    sink = Sink()
    df = log(rows())
    stream = L.follow_log(spark, str(tmp_path))
    follow = L.Follow(stream, sink, str(tmp_path / "checkpoint"), end=END)
    for batch_id, (low, high) in enumerate(((0, 12), (12, 30))):
        for _ in range(2):
            follow._batch(df.where(F.col("offset").between(low, high - 1)), batch_id)
    assert sink.all() == keys(L.to_time(df, END))


def test_records_out_of_order_fail(spark, log, tmp_path):
    path, checkpoint = str(tmp_path / "log"), str(tmp_path / "checkpoint")
    land_waves(log, path, [(10, 20)])
    run(spark, path, Sink(), checkpoint, end=END)
    land_waves(log, path, [(0, 10)])
    with pytest.raises(Exception, match="did not arrive in offset order"):
        run(spark, path, Sink(), checkpoint, end=END)


def test_follow_ends_when_done_or_idle(spark, log, tmp_path):
    path = str(tmp_path / "log")
    land_waves(log, path, [(0, 30)])
    sink = Sink()
    follow = L.Follow(L.follow_log(spark, path, "t-0"), sink, str(tmp_path / "c1"), end=END)
    follow.start()
    follow.wait(n_partitions=1)
    assert not follow.query.isActive and sink.all() == keys(L.to_time(L.select_partition(log(rows()), "t-0"), END))

    sink = Sink()
    follow = L.Follow(L.follow_log(spark, path), sink, str(tmp_path / "c2"))
    follow.start()
    follow.wait(idle_seconds=3)
    assert not follow.query.isActive and len(sink.all()) == len(rows())

    sink = Sink()
    follow = L.Follow(L.follow_log(spark, path), sink, str(tmp_path / "c3"), max_records=5)
    follow.start()
    follow.wait()
    assert len(sink.all()) == 5
    with pytest.raises(ValueError, match="together"):
        L.Follow(L.follow_log(spark, path), sink, "x", end=END, max_records=1)


def test_stateless_steps_on_a_stream(spark, log, tmp_path):
    path = str(tmp_path / "log")
    land_waves(log, path, [(0, 10)])
    stream = L.follow_log(spark, path, "t-1")
    found = L.text_filter(L.scan_key(stream, "t", "k1", partition=1), "v1")
    query = L.stream_lines(found, "memory").queryName("found").trigger(availableNow=True).start()
    query.awaitTermination()
    lines = sorted(r["line"] for r in spark.sql("select * from found").collect())
    batch = L.text_filter(L.scan_key(log([r for r in rows() if r[2] < 10]), "t", "k1", partition=1), "v1")
    assert lines == sorted(r["line"] for r in L.to_lines(batch).collect()) and lines


def test_stream_limit_and_latest(spark, log, tmp_path):
    path = str(tmp_path / "log")
    land_waves(log, path, [(0, 10)])
    snapshot = spark.createDataFrame(L.read_log(spark, path).collect(), L.LOG_SCHEMA)
    newer = L.after_snapshot(L.follow_log(spark, path), snapshot)
    land_waves(log, path, [(10, 12)])
    query = newer.writeStream.format("memory").queryName("newer").trigger(availableNow=True).start()
    query.awaitTermination()
    assert keys(spark.table("newer")) == [(p, o) for p in range(3) for o in (10, 11)]
    some = L.take_stream(L.follow_log(spark, path), 7)
    query = some.writeStream.format("memory").queryName("some").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("some").count() == 7


def test_streams_start_in_a_snapshot(spark, log, tmp_path):
    path = str(tmp_path / "log")
    land_waves(log, path, [(0, 10), (10, 20)])
    snapshot = L.read_log(spark, path)
    for name, start, bounded in (
        ("tail", lambda df, s: L.tail(df, 4, snapshot=s), lambda df: L.tail(df, 4)),
        ("time", lambda df, s: L.from_time(df, END, snapshot=s), lambda df: L.from_time(df, END)),
        ("end", lambda df, s: L.start_at(df, "latest", snapshot=s), lambda df: df.where(F.lit(False))),
    ):
        sink, checkpoint = Sink(), str(tmp_path / name)
        stream = L.follow_log(spark, path, maxFilesPerTrigger="1")
        L.Follow(start(stream, snapshot.persist()), sink, checkpoint).start(availableNow=True).awaitTermination()
        assert sink.all() == keys(bounded(snapshot)), name
    with pytest.raises(ValueError, match="snapshot"):
        L.tail(L.follow_log(spark, path), 4)


def test_look_on_a_stream(spark, log, tmp_path):
    path = str(tmp_path / "log")
    land_waves(log, path, [(0, 15), (15, 30)])
    seen = []

    def emit(df, batch_id):
        seen.extend(r["line"] for r in df.collect())

    whole = L.read_log(spark, path)
    stream = L.follow_log(spark, path, maxFilesPerTrigger="1")
    follow = L.follow_look(stream, emit, str(tmp_path / "c"), "t", offset=-20, text="-1", snapshot=whole, end=END)
    follow.start(availableNow=True).awaitTermination()
    want = L.text_filter(L.to_time(L.tail(whole, 20), END), "-1").withColumn("line", L.render_line())
    assert sorted(seen) == sorted(r["line"] for r in want.collect()) and seen
    with pytest.raises(ValueError, match="follow_look"):
        L.look(stream, "t", max_records=3)
