"""Times looked up through an index, stop bounds in the scan, and offsets for the Kafka source."""

import json

import pytest
from pyspark.sql import functions as F

import loglens as L
from loglens.plans.sizing import Limits
from tests.test_operators import ALL_PLANS, at, brute_from, brute_to, keys, random_rows, scanned


@pytest.mark.parametrize("limits", ALL_PLANS)
@pytest.mark.parametrize("size", [1, 7, 1000])
def test_index_gives_the_same_bounds(spark, log, tmp_path, limits, size):
    rows = random_rows(11)
    path = str(tmp_path / "log")
    L.land_log(log(rows), path)
    L.write_index(L.read_log(spark, path), path, rows=size)
    df, index = L.read_log(spark, path).cache(), L.read_index(spark, path).cache()
    assert df.count() == len(rows)  # the index is no part of the log
    for t, u in [(30, 60), (60, 30), (0, 500), (500, 600)]:
        assert keys(L.from_time(df, at(t), limits=limits, index=index)) == brute_from(rows, t)
        assert keys(L.to_time(df, at(u), limits=limits, index=index)) == brute_to(rows, u)
        started = [r for r in rows if r[:3] in set(brute_from(rows, t))]
        assert keys(L.time_range(df, at(t), at(u), limits=limits, index=index)) == brute_to(started, u)
    assert keys(L.tail(df, 5, index=index)) == keys(L.tail(df, 5))
    df.unpersist()


def test_index_of_appended_records(spark, log, tmp_path):
    rows = random_rows(12)
    path = str(tmp_path / "log")
    for half in (rows[::2], rows[1::2]):  # stretches overlap
        L.land_log(log(half), path, mode="append")
        L.write_index(log(half), path, mode="append", rows=10)
    df, index = L.read_log(spark, path), L.read_index(spark, path)
    assert keys(L.from_time(df, at(40), index=index)) == brute_from(rows, 40)
    assert keys(L.to_time(df, at(40), index=index)) == brute_to(rows, 40)


def test_look_with_an_index(spark, log, tmp_path):
    rows = random_rows(13)
    path = str(tmp_path / "log")
    L.land_log(log(rows), path)
    df = L.read_log(spark, path)
    L.write_index(df, path, rows=9)
    index = L.read_index(spark, path)
    for selector, bounds in (("a", {"start": at(20), "end": at(50)}), ("b-1", {"start": at(30)}), ("a-2", {"end": at(30)}), ("a", {"offset": -9, "end": at(60)})):
        assert keys(L.look(df, selector, **bounds, index=index)) == keys(L.look(df, selector, **bounds)), selector


def test_schemas_of_an_index(spark, log):
    index = L.time_index(log([("t", 0, 0, 0, "k", b"\0\0\0\0\x07x"), ("t", 0, 1, 0, "k", "plain"), ("t", 1, 0, None, "k", b"\0\0\0\0\x07y")]))
    assert [tuple(r) for r in L.indexed_schemas(index).collect()] == [("confluent", "7")]
    assert {r["partition"]: (r["records"], r["largest"] is None) for r in index.collect()} == {0: (2, False), 1: (1, True)}


def test_a_lookup_reads_one_stretch(spark, tmp_path):
    n = 200_000
    rows = spark.range(n).select(
        F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") + (F.col("id") * 7919) % 50).alias("timestamp"),
        F.lit(0).alias("timestampType"), F.lit(b"k").alias("key"), F.lit(b"v").alias("value"),
    )
    path = str(tmp_path / "log")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.setInt("parquet.block.size", 100_000)
    try:
        L.land_log(rows, path, slice_rows=5000)
    finally:
        hadoop.unset("parquet.block.size")
    L.write_index(L.read_log(spark, path), path, rows=5000)
    from loglens.sources.index import indexed_offsets

    log, index = L.read_log(spark, path), L.read_index(spark, path)
    for later in (False, True):
        found = indexed_offsets(log, index, {"at": (F.timestamp_seconds(F.lit(1_700_150_000)), later)})
        assert scanned(found) < 0.05 * n
        assert abs(found.first()["at"] - 150_000) < 100


def test_many_stop_bounds_reach_the_scan(spark, log, tmp_path):
    """Partitions that aren't bounded stay whole, whatever is pushed."""
    rows = [(t, p, o, o, "k", "v") for t in ("a", "b") for p in range(12) for o in range(40)]
    path = str(tmp_path / "log")
    L.land_log(log(rows), path)
    df = L.read_log(spark, path)
    stops = [(t, p, 3 + p) for t in ("a", "b") for p in range(12) if (t, p) != ("b", 5)] + [("a", 77, None)]
    bounds = spark.createDataFrame(stops, "topic string, partition int, stop long")
    from loglens.plans.sizing import bound_per_partition

    got = bound_per_partition(df, bounds, upper="stop", keep_unbounded=True, limits=Limits(8, 1000))
    known = {(t, p): s for t, p, s in stops}
    assert keys(got) == sorted(r[:3] for r in rows if known.get(r[:2]) is None or r[2] < known[r[:2]])
    assert "offset" in got._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1].split("]")[0]


def test_kafka_offsets(spark):
    bounds = spark.createDataFrame([("t", 0, 5, 9), ("t", 2, -3, None), ("u", 1, None, 4)], "topic string, partition int, first long, stop long")
    got = L.kafka_offsets(bounds, "first", "stop")
    assert json.loads(got["startingOffsets"]) == {"t": {"0": 5, "1": -2, "2": 0}, "u": {"0": -2, "1": -2}}
    assert json.loads(got["endingOffsets"]) == {"t": {"0": 9, "1": -1, "2": -1}, "u": {"0": -1, "1": 4}}
    catalog = spark.createDataFrame([("t", 4)], "topic string, n_partitions int")
    assert json.loads(L.kafka_offsets(bounds.where("topic = 't'"), "first", n_partitions=catalog)["startingOffsets"]) == {"t": {"0": 5, "1": -2, "2": 0, "3": -2}}
    options = L.kafka_options("broker:9092", "t", got["startingOffsets"])
    assert options["startingOffsets"] == got["startingOffsets"]
    assert L.kafka_options("b:1", "t", "beginning")["startingOffsets"] == "earliest" and L.kafka_options("b:1", "t", "end")["startingOffsets"] == "latest"
    for bad in ("-5", "first", "0"):
        with pytest.raises(ValueError, match="An offset"):
            L.kafka_options("b:1", "t", bad)


@pytest.mark.parametrize("top_n, buckets", [(1000, 10), (0, 2), (0, 50)])
def test_limits_count_from_the_starts(log, top_n, buckets):
    rows = [("t", p, 1000 * p + o, o, "k", "v") for p in range(4) for o in range(20)]
    rows += [("t", 3, 3010, 1, "k", "again")] * 2 + [("u", 0, 5, 1, "k", "v")]
    df = log(rows)
    for n in (0, 1, 7, 30, 45, 500):
        for bounded in (df, L.tail(df, 12), L.from_time(df, at(6))):
            own = keys(bounded)
            first = {}
            for t, p, o in own:
                first[t, p] = min(o, first.get((t, p), o))
            want = sorted(own, key=lambda k: (k[2] - first[k[:2]], *k[:2]))[:n]
            assert keys(L.take_consumed(bounded, n, top_n, buckets, from_starts=True)) == sorted(want)
    some = L.take_consumed(L.tail(df, 12), 8, from_starts=True)
    assert some.select("topic", "partition").distinct().count() == 5
    assert L.look(df, "t", offset=-12, max_records=8).select("partition").distinct().count() == 4
