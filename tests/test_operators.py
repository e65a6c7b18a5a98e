"""Operators on small logs, against expectations and brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import loglens as L
from loglens.functions.text import mentions
from loglens.operators.limits import TOP_N
from loglens.operators.payloads import may_show
from loglens.plans.sizing import Limits

START = dt.datetime(2024, 1, 1)
LITERAL, BROADCAST, JOIN = Limits(64, 1000), Limits(0, 1000), Limits(0, 0)
ALL_PLANS = [LITERAL, BROADCAST, JOIN]


def at(seconds, millis=0):
    return START + dt.timedelta(seconds=seconds, milliseconds=millis)


def keys(df):
    return sorted((r["topic"], r["partition"], r["offset"]) for r in df.select("topic", "partition", "offset").collect())


def offsets(df):
    return sorted(r["offset"] for r in df.select("offset").collect())


def random_rows(seed, partitions=4, most=40):
    """Out-of-order timestamps, records without one, holes in the offsets."""
    rnd = random.Random(seed)
    rows = []
    for topic in ("a", "b"):
        for p in range(partitions):
            offset = rnd.randint(0, 20)
            for i in range(rnd.randint(0, most)):
                offset += rnd.choice([1, 1, 1, 2, 5])
                seconds = None if rnd.random() < 0.1 else max(0, i * 3 + rnd.randint(-15, 15))
                rows.append((topic, p, offset, seconds, f"k{rnd.randint(0, 9)}", f"v{i}"))
    return rows


def groups(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[:3]):
        out.setdefault(r[:2], []).append(r)
    return out.values()


def brute_from(rows, t):
    out = []
    for g in groups(rows):
        first = next((r[2] for r in g if r[3] is not None and r[3] >= t), None)
        out += [r[:3] for r in g if first is not None and r[2] >= first]
    return sorted(out)


def brute_to(rows, t):
    out = []
    for g in groups(rows):
        for r in g:
            if r[3] is not None and r[3] > t:
                break
            out.append(r[:3])
    return sorted(out)


@pytest.mark.parametrize("limits", ALL_PLANS)
def test_time_bounds_against_brute_force(log, limits):
    rows = random_rows(1)
    df = log(rows).cache()
    for t, u in [(30, 60), (60, 60), (60, 30), (0, 500), (500, 600)]:
        started = [r for r in rows if r[:3] in set(brute_from(rows, t))]
        assert keys(L.from_time(df, at(t), limits=limits)) == brute_from(rows, t)
        assert keys(L.to_time(df, at(u), limits=limits)) == brute_to(rows, u)
        both = brute_to(started, u)
        assert keys(L.time_range(df, at(t), at(u), limits=limits)) == both
        assert keys(L.to_time(L.from_time(df, at(t), limits=limits), at(u), limits=limits)) == both
    df.unpersist()


@pytest.mark.parametrize("limits", ALL_PLANS)
def test_tail_counts_offsets(log, limits):
    rows = random_rows(2)
    df = log(rows)
    for n in (1, 7, 1000):
        want = sorted(r[:3] for g in groups(rows) for r in g if r[2] >= g[-1][2] + 1 - n)
        assert keys(L.tail(df, n, limits=limits)) == want


def test_tail_with_end_offsets_of_the_broker(spark, log):
    df = log([("t", 0, o, o, "k", "v") for o in range(5)])
    ends = spark.createDataFrame([("t", 0, 7)], "topic string, partition int, end_offset long")
    assert offsets(L.tail(df, 4, ends)) == [3, 4]


def test_start_at(log):
    df = log([("t", 0, o, o, "k", "v") for o in range(5)])
    for name in ("earliest", "beginning"):
        assert offsets(L.start_at(df, name)) == [0, 1, 2, 3, 4]
    for name in ("latest", "end"):
        assert offsets(L.start_at(df, name)) == []
    assert offsets(L.start_at(df, -2)) == offsets(L.start_at(df, "-2")) == [3, 4]
    for bad in ("0", "1", "+1", "-", "first", 3):
        with pytest.raises(ValueError, match="An offset"):
            L.start_at(df, bad)
    with pytest.raises(ValueError):
        L.tail(df, 0)


def test_bounds_compare_milliseconds(spark, log):
    df = log([("t", 0, 0, 1, "k", "v"), ("t", 0, 1, 2, "k", "v")])
    df = df.withColumn("timestamp", F.expr("timestamp + INTERVAL '0.000900' SECOND"))
    assert offsets(L.to_time(df, at(1))) == [0]
    assert offsets(L.from_time(df, at(2) + dt.timedelta(microseconds=950))) == [1]
    aware = at(1).replace(tzinfo=dt.timezone.utc)
    assert offsets(L.to_time(df, aware)) == [0]


def test_relative_times(log):
    df = log([("t", 0, o, 3600 * o, "k", "v") for o in range(10)])
    now = "2024-01-01 09:30:00"
    assert offsets(L.from_time(df, "-2h", now)) == [8, 9]
    assert offsets(L.time_range(df, "-2h", "08:00", now)) == [8]
    assert offsets(L.to_time(df, "2024-01-01 02:00")) == [0, 1, 2]


def test_small_end_to_end_cases(log):
    with pytest.raises(ValueError, match="no topics"):
        L.look(log([]), "t", offset="earliest")
    first = log([("t", 0, 0, 1, "key0", "value0"), ("t", 0, 1, 2, "key1", "value1")])
    lines = [r["line"] for r in L.look(first, "t-0", offset="earliest").orderBy("offset").collect()]
    assert lines == ["t-0 2024-01-01 00:00:01.000 0 key0 value0", "t-0 2024-01-01 00:00:02.000 1 key1 value1"]

    chain = ["foo", "bar", "baz", "qux", "quux", "baz"]
    filtered = log([("t", 0, i, i, chain[i], chain[i + 1]) for i in range(4)] + [("t", 0, 4, 4, "x", "baz")])
    assert offsets(L.look(filtered, "t", max_records=4, text="baz")) == [1, 2]

    keyed = log([("t", 0, 0, 0, "b", "value"), ("t", 1, 0, 0, "d", "value"), ("t", 0, 1, 1, "a", "value")])
    assert keys(L.look(keyed, "t", key="a", max_records=2)) == [("t", 0, 1)]
    assert keys(L.look(keyed, "t", key="a", max_records=1)) == []

    wrong = log([("t", p, k, k, str(k), "value") for p in (0, 1) for k in range(4)])
    with pytest.raises(Exception, match="murmur2.*t-N.*text 4"):
        L.look(wrong, "t", key="4").collect()
    assert keys(L.look(wrong, "t-1", key="3")) == [("t", 1, 3)]

    waves = ((0, "before"), (10, "actual"), (20, "after"))
    ranged = log([("t", k % 2, 2 * w + k // 2, s, str(k), v) for w, (s, v) in enumerate(waves) for k in range(4)])
    found = L.look(ranged, "t", start="2024-01-01 00:00:10", end="2024-01-01 00:00:10")
    assert {r["value_text"] for r in found.collect()} == {"actual"} and found.count() == 4
    found = L.look(ranged, "t", start="-10s", end="-10s", now="2024-01-01 00:00:20")
    assert {r["value_text"] for r in found.collect()} == {"actual"}
    assert {r["value_text"] for r in L.look(ranged, "t", start="now", now="2024-01-01 00:00:20").collect()} == {"after"}


def test_look_options_exclude_each_other(log):
    df = log([("t", 0, 0, 0, "k", "v")])
    with pytest.raises(ValueError, match="together"):
        L.look(df, "t", offset="earliest", start="now")
    with pytest.raises(ValueError, match="together"):
        L.look(df, "t", end="now", max_records=1)


def test_take_consumed(log):
    rows = random_rows(3)
    df = log(rows).cache()
    order = sorted(rows, key=lambda r: (r[2], r[0], r[1]))
    for n in (0, 1, 5, 50, len(rows), len(rows) + 10):
        want = sorted(r[:3] for r in order[:n])
        assert keys(L.take_consumed(df, n)) == want
        for buckets in (2, 3, 7, 10_000):
            assert keys(L.take_consumed(df, n, top_n=0, buckets=buckets)) == want, (n, buckets)
    assert L.take_consumed(log([]), TOP_N + 1).count() == 0
    df.unpersist()


def test_until_idle(log):
    for seed in range(4):
        rnd = random.Random(seed)
        seconds, rows = 0, []
        for i in range(60):
            seconds += rnd.choice([0, 1, 1, 2, 3, 9, 10, 11])
            rows.append(("t", i % 3, i, seconds, "k", "v"))
        rows.append(("t", 0, 100, None, "k", "v"))
        df = log(rows)
        for n in (1, 2, 9, 10, 11, 100):
            cut = next((a[3] for a, b in zip(rows[:-2], rows[1:-1]) if b[3] - a[3] > n), 10**9)
            assert keys(L.until_idle(df, n)) == sorted(r[:3] for r in rows if r[3] is None or r[3] <= cut), (seed, n)
    with pytest.raises(ValueError):
        L.until_idle(df, 0)


def test_scan_key(log):
    p = {k: L.partition_of(k, 3) for k in ("a", "b", "c", "", "�")}
    rows = [("t", p[k], i, i, k, "v") for i, k in enumerate(("a", "b", "c", "a"))]
    df = log(rows + [("t", p[""], 10, 1, None, "v"), ("t", p[""], 11, 1, "", "v"), ("u", p["a"], 0, 0, "a", "v")])
    assert offsets(L.scan_key(df, "t", "a", 3)) == [0, 3]
    assert offsets(L.scan_key(df, "t", "a", 3, verify=False)) == [0, 3]
    assert offsets(L.scan_key(df, "t", "", 3)) == [10, 11]
    broken = log([("t", 0, 0, 0, b"\xff", "v"), ("t", 0, 1, 0, "x", "v")])
    assert offsets(L.scan_key(broken, "t", "�", 1)) == [0]
    with pytest.raises(ValueError, match="does not exist"):
        L.scan_key(df, "nope", "a")


def test_scan_key_reads_one_partition_and_pushes_the_key(spark, log, tmp_path, capsys):
    L.land_log(log([("t", L.partition_of(str(k), 4), k, k, str(k), "v") for k in range(40)]), str(tmp_path / "log"))
    landed = L.read_log(spark, str(tmp_path / "log"))
    L.scan_key(landed, "t", "7", 4, verify=False).explain("formatted")
    plan = capsys.readouterr().out
    assert f"(partition#" in plan and f"= {L.partition_of('7', 4)})" in plan and "EqualTo(key" in plan
    L.time_range(landed, at(5), at(9)).select("offset").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(offset" in plan and "LessThan(offset" in plan and "Join" not in plan
    assert "ReadSchema: struct<topic:string,partition:int,offset:bigint>" in plan  # not the payloads


@pytest.mark.parametrize("limits", ALL_PLANS)
def test_audit(log, limits):
    rows = [("t", (L.partition_of(str(k), 3) + k % 2) % 3, k, k, str(k), "v") for k in range(60)]
    rows += [("u", L.partition_of(str(k), 2), k, k, str(k), "v") for k in range(10)] + [("u", 1, 99, 0, None, "v")]
    df = log(rows)
    bad = L.partitioner_audit(df, limits=limits)
    assert keys(bad) == [("t", r[1], r[2]) for r in sorted(rows[:60], key=lambda r: r[1:3]) if r[2] % 2]
    assert all(r["expected_partition"] == L.partition_of(bytes(r["key"]), 3) for r in bad.collect())
    summary = {(r["topic"], r["partition"]): (r["records"], r["mismatches"]) for r in L.audit_summary(df, limits=limits).collect()}
    assert sum(n for (t, _), (n, _) in summary.items() if t == "u") == 10
    assert sum(m for (t, _), (_, m) in summary.items() if t == "t") == 30
    assert L.partitioner_audit(df.where("topic = 't'"), 3).count() == 30


def test_catalog(spark, log):
    df = log([("a", 0, 0, 0, "k", "v"), ("a", 4, 0, 0, "k", "v"), ("b", 0, 0, 0, "k", "v")])
    assert sorted(map(tuple, L.topic_catalog(df).collect())) == [("a", 5), ("b", 1)]
    known = spark.createDataFrame([("a", 8), ("empty", 2)], "topic string, n_partitions int")
    assert sorted(map(tuple, L.topic_catalog(df, known).collect())) == [("a", 8), ("b", 1), ("empty", 2)]
    assert sorted(r["line"] for r in L.list_lines(L.topic_catalog(df)).collect()) == ["a (5)", "b (1)"]
    assert L.topic_catalog(log([])).count() == 0


def test_resolve_selectors(spark):
    catalog = spark.createDataFrame([("orders", 4), ("events", 6), ("invoices", 1)], "topic string, n_partitions int")
    names = ["orders", "orders-3", "orders-4", "order", "evnts-1", "orders-99999999999", None]
    requests = spark.createDataFrame([(n,) for n in names], "selector string")
    got = {r["selector"]: tuple(r)[1:] for r in L.resolve_selectors(requests, catalog).collect()}
    assert got == {
        "orders": ("orders", None, "ok", None),
        "orders-3": ("orders", 3, "ok", None),
        "orders-4": ("orders", 4, "partition_out_of_range", None),
        "order": ("order", None, "unknown_topic", "orders"),
        "evnts-1": ("evnts", 1, "unknown_topic", "events"),
        "orders-99999999999": ("orders", None, "bad_partition", None),
        None: (None, None, "ambiguous", None),
    }
    one = L.resolve_selectors(requests.where("selector is null"), catalog.where("topic = 'events'")).first()
    assert (one["topic"], one["status"]) == ("events", "ok")
    none = L.resolve_selectors(requests, catalog.where("false"))
    assert {r["status"] for r in none.collect()} == {"no_topics"}


def test_suggest_topics(spark):
    names = [f"topic{i:03d}" for i in range(200)] + ["alpha", "alpine", "beta"]
    catalog = spark.createDataFrame([(n, 1) for n in names], "topic string, n_partitions int")
    got = L.suggest_topics(["alpah", "topic007"], catalog, 3).orderBy("name", "rank").collect()
    assert [(r["name"], r["rank"], r["topic"], r["distance"]) for r in got][:2] == [("alpah", 1, "alpha", 2), ("alpah", 2, "alpine", 3)]
    assert [(r["topic"], r["distance"]) for r in got[3:]] == [("topic007", 0), ("topic000", 1), ("topic001", 1)]


@pytest.mark.parametrize(
    "value, needle, indent, found",
    [
        (None, "null", False, True),
        (None, "nil", False, False),
        ("", "null", False, False),
        ("string", "rin", False, True),
        ("string", '"string', False, False),
        ('"string"', '"string', False, True),
        ('{"foo": "bar"}', '"foo":"bar"', False, True),
        ('{"foo": "bar"}', '"foo": "bar"', False, True),
        ('{"foo":"bar"}', '{ "foo": "bar" }', False, False),
        ('{"foo":"bar"}', '{ "foo": "bar" }', True, True),
        (r'{"a":"x\"y"}', 'x"y', False, True),
        (r'{"a":"\u0041bc"}', "Abc", False, True),
        (r'{"a":"\u0041bc"}', "u0041", False, True),
        ('{"a":1e3}', "1000", False, True),
        ('{"a":[1.50]}', "1.5", False, True),
        ('{"a": 12}', ":12}", False, True),
        ("[true]", "true", False, True),
        ("[1]", "null", False, False),
        ("x", "ul", False, False),
        (None, "ul", False, True),
        (None, '{ "', False, False),
        ('{"a":1}', '{ "', True, True),
        (b"\xff\xfeabc", "abc", False, True),
        (b"\xff\xfeabc", "�abc", False, True),
    ],
)
def test_text_filter(log, value, needle, indent, found):
    df = log([("t", 0, 0, 0, "key", value)])
    assert L.text_filter(df, needle, indent=indent).count() == int(found)
    assert L.text_filter(df, "ke").count() == 1


def test_search_before_parsing_loses_nothing(log):
    rnd = random.Random(5)

    def value(depth=0):
        kind = rnd.randint(0, 9 if depth < 2 else 6)
        if kind == 0:
            return rnd.choice(["true", "false", "null"])
        if kind <= 3:
            whole = str(rnd.randint(-(10 ** rnd.randint(1, 45)), 10**5))
            return whole + rnd.choice(["", "", ".50", "e3", "E-2", ".0e1"])
        if kind <= 6:
            return '"' + "".join(rnd.choice(["ab", "Cd1", "7", " ", "\\n", "\\u0041", '\\"', "é", ":", ","]) for _ in range(4)) + '"'
        items = [value(depth + 1) for _ in range(rnd.randint(0, 3))]
        if kind == 7:
            return "[" + rnd.choice(["", " "]) + ", ".join(items) + "]"
        return "{" + ",".join(f'"k{rnd.randint(0, 9)}": {i}' for i in items) + "}"

    texts = [value() for _ in range(300)] + [None, "", "plain ab1", "x" + value(), b"\xffab12\xfe"]
    df = log([("t", 0, i, 0, None, v) for i, v in enumerate(texts)])
    shown = {m: L.with_payloads(df, indent=m).cache() for m in (False, True)}
    for indent, rendered in shown.items():
        seen = [r["value_text"] for r in rendered.collect()]
        needles = {"null", "ul", "E", "1.0E", '{ "', "0"}
        while len(needles) < 50:
            text = rnd.choice(seen + [t for t in texts if isinstance(t, str)])
            at = rnd.randint(0, len(text))
            needles.add(text[at : at + rnd.randint(1, 7)] or "a")
        lost = [
            F.count(
                F.when((F.contains("value_text", F.lit(n)) | mentions(L.utf8_lossy("value"), n)) & ~may_show("value", n), 1)
            ).alias(str(i))
            for i, n in enumerate(sorted(needles))
        ]
        counts = rendered.agg(*lost).first()
        assert [n for n, c in zip(sorted(needles), counts) if c] == []
        rendered.unpersist()


def test_payload_columns(log):
    df = log([("t", 0, 0, None, None, '{"b":1,"a":[true,null]}'), ("t", 0, 1, 0, "", b"\xff")])
    got = L.with_payloads(df).withColumn("line", L.render_line()).orderBy("offset").collect()
    assert [(r["key_kind"], r["key_text"], r["value_kind"], r["value_text"]) for r in got] == [
        ("null", "null", "json", '{"a":[true,null],"b":1}'),
        ("string", "", "unknown", "�"),
    ]
    assert [r["line"] for r in got] == [
        't-0  0 null {"a":[true,null],"b":1}',
        "t-0 2024-01-01 00:00:00.000 1  �",
    ]
    assert L.with_kinds(df).orderBy("offset").first()["value_kind"] == "json"


def test_observe(log):
    df, progress = L.observe_consumed(log([("t", 0, o, 0, "k", "v") for o in range(5)]))
    assert df.where("offset > 2").count() == 2
    assert progress.get["records"] == 5


@pytest.mark.parametrize("codec", ["gzip", "snappy", "lz4raw", "zstd", "none"])
def test_landed_logs_of_every_codec(spark, log, tmp_path, codec):
    rows = [("007", p, o, o, "k", "v") for p in range(2) for o in range(5)]
    spark.conf.set("spark.sql.parquet.compression.codec", {"lz4raw": "lz4_raw"}.get(codec, codec))
    try:
        L.land_log(log(rows), str(tmp_path / "log"), slice_rows=2)
    finally:
        spark.conf.unset("spark.sql.parquet.compression.codec")
    landed = L.read_log(spark, str(tmp_path / "log"))
    assert keys(landed) == sorted(r[:3] for r in rows) and landed.schema["topic"].dataType.typeName() == "string"
    assert keys(L.read_log(spark, str(tmp_path / "log"), "007-1")) == [("007", 1, o) for o in range(5)]


def test_lines(spark, log, tmp_path):
    shown = L.with_payloads(log([("t", 0, 0, 0, "k", "v"), ("t", 0, 1, 1, "k", None)]))
    L.write_lines(shown, str(tmp_path / "lines"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()) == [
        "t-0 2024-01-01 00:00:00.000 0 k v",
        "t-0 2024-01-01 00:00:01.000 1 k null",
    ]


def test_kafka_options():
    utc = dt.timezone.utc
    topic = L.kafka_options("broker:9092", "some-topic", from_time=at(1).replace(tzinfo=utc), to_time=at(2, 7).replace(tzinfo=utc))
    assert topic["subscribe"] == "some-topic" and "startingOffsets" not in topic
    assert topic["startingTimestamp"] == "1704067201000" and topic["endingTimestamp"] == "1704067202008"
    assert topic["startingOffsetsByTimestampStrategy"] == "latest"
    one = L.kafka_options("broker:9092", "some-topic-2", "latest", min_partitions=9, **{"kafka.security.protocol": "SSL"})
    assert one["assign"] == '{"some-topic": [2]}' and one["startingOffsets"] == "latest"
    assert one["minPartitions"] == 9 or one["minPartitions"] == "9"
    assert one["kafka.security.protocol"] == "SSL"
    with pytest.raises(ValueError, match="time zone"):
        L.kafka_options("broker:9092", "t", from_time=START)


def test_parse_selector():
    assert L.parse_selector("a-b-12") == ("a-b", 12) and L.parse_selector("a") == ("a", None)
    with pytest.raises(ValueError):
        L.parse_selector("a-99999999999")


def test_schemas_and_kafka_guards(spark, tmp_path):
    rows = [("GLUE", "AB-1", "{}"), ("confluent", "7", None)]
    spark.createDataFrame(rows, "registry string, schema_id string, definition string").write.json(str(tmp_path / "s"))
    got = L.read_schemas(spark, str(tmp_path / "s"), "json").orderBy("schema_id").collect()
    assert [tuple(r) for r in got] == [("confluent", "7", None), ("glue", "ab-1", "{}")]
    with pytest.raises(ValueError, match="needs a topic"):
        L.read_log(spark, "broker:9092", format="kafka")
    with pytest.raises(ValueError, match="latest"):
        L.read_log(spark, "broker:9092", "t", format="kafka", offset="latest")


def test_bounds_refuse_streams(spark, log, tmp_path):
    L.land_log(log([("t", 0, 0, 0, "k", "v")]), str(tmp_path / "log"))
    stream = L.follow_log(spark, str(tmp_path / "log"))
    for bound in (lambda: L.from_time(stream, at(0)), lambda: L.to_time(stream, at(0)), lambda: L.tail(stream, 1)):
        with pytest.raises(ValueError, match="streams"):
            bound()


# ---- plans that must not change results


def scanned(df) -> int:
    """Rows that the scans of an executed plan produced."""
    df.collect()

    def walk(node):
        below = [node.children().apply(i) for i in range(node.children().size())]
        below += [node.executedPlan()] if node.nodeName().startswith("AdaptiveSparkPlan") else []
        below += [node.plan()] if "QueryStage" in node.nodeName() else []
        own = node.metrics().apply("numOutputRows").value() if node.nodeName().startswith("Scan parquet") else 0
        return own + sum(walk(x) for x in below)

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("partitions", [4, 50])
def test_bounds_prune_a_hot_partition(spark, tmp_path, partitions):
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.setInt("parquet.block.size", 100_000)
    columns = ["timestamp_micros(id * 1000) AS timestamp", "0 AS timestampType", "CAST(CAST(id AS STRING) AS BINARY) AS key", "CAST('x' AS BINARY) AS value"]
    hot = spark.range(120_000).selectExpr("'t' AS topic", "0 AS partition", "id AS offset", *columns)
    cold = spark.range(30 * partitions).selectExpr("'t' AS topic", f"CAST(1 + id % {partitions} AS INT) AS partition", f"id DIV {partitions} AS offset", *columns)
    try:
        L.land_log(hot.unionByName(cold), str(tmp_path / "log"), slice_rows=20_000)
    finally:
        hadoop.unset("parquet.block.size")
    log = L.read_log(spark, str(tmp_path / "log"))
    got = L.tail(log, 5)
    assert got.groupBy("partition").count().where("count = 5").count() == partitions + 1
    assert scanned(got) < 20_000


def test_a_key_is_sought_only_where_it_may_be(spark, tmp_path):
    """Keys are mixed over all row groups, too many for dictionaries; one key is in a single slice."""
    key = "CASE WHEN id = 70007 THEN 'key-5' ELSE concat('key-', md5(CAST(id AS STRING))) END"
    columns = [f"CAST({key} AS BINARY) AS key", "CAST('x' AS BINARY) AS value", "timestamp_micros(id) AS timestamp"]
    rows = spark.range(500_000).selectExpr("'t' AS topic", "0 AS partition", "id AS offset", *columns)
    read = {}
    for key_filter in (True, False):
        path = str(tmp_path / f"log-{key_filter}")
        L.land_log(rows, path, slice_rows=100_000, key_filter=key_filter)
        found = L.scan_key(L.read_log(spark, path), "t", "key-5", n_partitions=1, verify=False)
        absent = L.scan_key(L.read_log(spark, path), "t", "key-6", n_partitions=1, verify=False)
        read[key_filter] = scanned(found), scanned(absent)
        assert [r.offset for r in found.collect()] == [70007]
        assert absent.isEmpty()
        checked = L.scan_key(L.read_log(spark, path), "t", "key-5", n_partitions=1)
        assert scanned(checked) == 500_000  # a look at other keys has to read them
    assert read[False] == (500_000, 500_000)
    assert read[True][0] < 500_000 and read[True][1] == 0  # a file holds the slices that met in one task


def test_a_landed_log_reads_like_any_other(spark, tmp_path, log):
    df = log([("007", 0, 1, 5, "a", "b"), ("t", 1, 2, None, None, "c")])
    L.land_log(df, str(tmp_path / "landed"))
    df.write.partitionBy("topic", "partition").parquet(str(tmp_path / "plain"))
    want = sorted(df.collect(), key=str)
    for place in ("landed", "plain"):
        back = L.read_log(spark, str(tmp_path / place))
        assert back.columns == df.columns and sorted(back.collect(), key=str) == want
        assert L.read_log(spark, str(tmp_path / place), "007-0").count() == 1


@pytest.mark.parametrize("n", [5, 7, 23])
def test_take_consumed_with_repeated_records(log, n):
    df = log([("t", p, o, o, None, f"{p}-{o}") for o in range(4) for p in range(3) for _ in range(1 + (p + o) % 3)])
    key = lambda r: (r["offset"], r["topic"], r["partition"])
    want = sorted((key(r) for r in L.take_consumed(df, n).collect()))
    for buckets in (1, 2, 100):
        assert sorted(key(r) for r in L.take_consumed(df, n, top_n=0, buckets=buckets).collect()) == want
    assert len(want) == min(n, df.count())


def test_lookup_tables_that_repeat_rows(spark, log):
    df = log([("t", p, o, o, "k", "v") for p in range(2) for o in range(6)])
    ends = spark.createDataFrame([("t", 0, 6), ("t", 0, 6), ("t", 1, 6)], "topic string, partition int, end_offset long")
    for limits in (None, Limits(0, 10), Limits(0, 0)):
        assert L.tail(df, 2, ends, limits).count() == 4
        catalog = spark.createDataFrame([("t", 2), ("t", 2)], "topic string, n_partitions int")
        assert L.with_expected_partition(df, catalog, limits).count() == 12
    clash = ends.unionByName(spark.createDataFrame([("t", 1, 7)], ends.schema))
    with pytest.raises(Exception, match="more than one end_offset"):
        L.tail(df, 2, clash).count()


@pytest.mark.parametrize("schema_rows", [10_000, 1, 0])
def test_decode_avro_looks_up_once(spark, log, schema_rows):
    body = lambda i: b"\x00" + i.to_bytes(4, "big") + b"\x06abc"
    df = log([("t", 0, 0, 0, None, body(1)), ("t", 0, 1, 0, None, b"plain"), ("t", 0, 2, 0, None, body(1)), ("t", 0, 3, 0, None, None)])
    rows = [("confluent", "1", '"string"')] * 2 + [("confluent", str(i), '"long"') for i in range(2, 9)]
    got = L.decode_avro(df, spark.createDataFrame(rows, "registry string, schema_id string, definition string"), schema_rows=schema_rows)
    assert [r.value_avro and r.value_avro.text for r in got.orderBy("offset").collect()] == ['"abc"', None, '"abc"', None]
    clash = spark.createDataFrame([*rows, ("confluent", "1", '"int"')], "registry string, schema_id string, definition string")
    with pytest.raises(Exception, match="more than one definition"):
        L.decode_avro(df, clash, schema_rows=schema_rows).collect()


def test_permissive_takes_whatever_is_broken(spark, log):
    df = log([("t", 0, i, 0, None, b"\x00" + (i + 1).to_bytes(4, "big") + b) for i, b in enumerate([b"\x02" * 60_000, b"\x00", b"\x80\x80\x80\x80\x80\x40"])])
    definitions = ['{"type":"record","name":"R","fields":[{"name":"r","type":["null","R"]}]}', '{"type":"int","logicalType":5}', '{"type":"array","items":"null"}']
    rows = [("confluent", str(i), d) for i, d in enumerate(definitions, 1)]
    schemas = spark.createDataFrame(rows, "registry string, schema_id string, definition string")
    got = L.decode_avro(df, schemas, mode="permissive").orderBy("offset").collect()
    assert got[0].value_avro.error and got[2].value_avro.error
    with pytest.raises(Exception, match="schema 1 of confluent"):
        L.decode_avro(df.where("offset = 0"), schemas).collect()


def test_look_checks_names(log):
    one = log([("orders", p, 0, 0, "a", "v") for p in range(2)])
    two = one.unionByName(log([("odds", 0, 0, 0, None, "v")]))
    assert L.look(one).count() == 2
    for df, selector, message in ((two, None, "several topics"), (two, "oders", "nearest name is orders"), (two, "orders-7", "partitions 0 to 1"), (one, "x-1", "no topic x")):
        with pytest.raises(ValueError, match=message):
            L.look(df, selector)
    elsewhere = 1 - L.partition_of("a", 2)
    with pytest.warns(UserWarning, match="usually is in partition"):
        assert L.look(one, f"orders-{elsewhere}", key="a").count() == 1


def test_local_times_that_clocks_skip_or_repeat(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        for wrong in ("2024-03-31 02:30", "2024-10-27 02:30:00", "-" + "9" * 30 + "d", "2024-02-30", "25:00"):
            with pytest.raises(ValueError, match="exactly once"):
                L.resolve_time(spark, wrong, "2024-06-01 12:00:00")
        for fine, hours in (("2024-03-31", 23), ("2024-10-27", 25), ("2024-06-01", 24)):
            first, last = (L.resolve_time(spark, fine, "2024-06-01 12:00:00", end=e) for e in (False, True))
            assert spark.range(1).select(F.unix_millis(last) - F.unix_millis(first)).first()[0] == hours * 3_600_000 - 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
