"""Vectors of single functions."""

import base64
import datetime as dt
import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from loglens import (
    classify_payload,
    confluent_header,
    glue_header,
    kafka_partition,
    kafka_partition_native,
    parse_json_payload,
    partition_of,
    record_age,
    render_json,
    render_timestamp,
    resolve_time,
    split_topic_partition,
    time_bounds,
    utf8_lossy,
)

# Keys with their partition of 6.
PARTITIONS_OF_6 = {
    "control+e2e-zgddu3j-delete": 5,
    "control+e2e-6n304jn-delete": 1,
    "834408c2-6061-7057-bdc1-320cc24c8873": 3,
    "control+e2e-bgrl0v-delete": 0,
    "control+e2e-5ijyt78-delete": 5,
    "03b40832-b061-703d-4d68-895dee9e1f90": 4,
    "control+e2e-86d8ra-delete": 2,
    "control+e2e-lhwcl2-delete": 1,
}


def java_murmur2(data: bytes) -> int:
    """Plain scalar form of the published hash, as an independent check."""
    m, mask = 0x5BD1E995, 0xFFFFFFFF
    h = 0x9747B28C ^ len(data)
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        k = int.from_bytes(data[i : i + 4], "little") * m & mask
        k = (k ^ k >> 24) * m & mask
        h = h * m & mask ^ k
    if data[whole:]:
        h = (h ^ int.from_bytes(data[whole:], "little")) * m & mask
    h = (h ^ h >> 13) * m & mask
    return h ^ h >> 15


def column(spark, values, kind, c):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r["out"] for r in df.select("i", c(F.col("v")).alias("out")).orderBy("i").collect()]


def test_partition_vectors(spark):
    keys = list(PARTITIONS_OF_6)
    assert [partition_of(k, 6) for k in keys] == list(PARTITIONS_OF_6.values())
    assert column(spark, keys, "string", lambda v: kafka_partition(v, 6)) == list(PARTITIONS_OF_6.values())
    assert column(spark, keys, "string", lambda v: kafka_partition_native(v, 6)) == list(PARTITIONS_OF_6.values())
    assert [partition_of(k, 2) for k in "abd"] == [0, 0, 1]


def test_partition_of_all_lengths(spark):
    keys = [bytes((7 * i + 3 * n) % 256 for i in range(n)) for n in range(40)] + ["grün€".encode(), bytes(5000)]
    want = [(java_murmur2(k) & 0x7FFFFFFF) % 101 for k in keys] + [None]
    assert column(spark, keys + [None], "binary", lambda v: kafka_partition(v, 101)) == want
    assert column(spark, keys + [None], "binary", lambda v: kafka_partition_native(v, 101)) == want


@pytest.mark.parametrize(
    "raw, kind",
    [
        (None, "null"),
        (b"", "string"),
        (b"string", "string"),
        (b'"string"', "json"),
        (bytes.fromhex("000000012A"), "avro"),
        (bytes.fromhex("00000204"), "string"),
        (bytes.fromhex("00FF00000107"), "unknown"),
        (bytes.fromhex("0000000000"), "string"),
        (bytes.fromhex("0300") + uuid.UUID(int=7).bytes, "avro"),
        (bytes.fromhex("0305") + uuid.UUID(int=7).bytes + b"x", "avro"),
        (bytes.fromhex("0301"), "string"),
        (bytes.fromhex("030002"), "string"),
        (bytes.fromhex("03"), "string"),
        (bytes.fromhex("8f3c77fe"), "unknown"),
        (b"1 2", "string"),
        (b'{"a":1}x', "string"),
        (b"1] , [2", "string"),
        (b"1,2", "string"),
        (b"007", "string"),
        (b"{'a':1}", "string"),
        (b"NaN", "string"),
        (b"[1,]", "string"),
        (b"\xef\xbb\xbf1", "string"),
        (b"1e999", "string"),
        (b'["Infinity", 1e999]', "string"),
        (b'["Infinity", 1e99]', "json"),
        (b"9" * 400, "string"),
        (b'"\\ud800"', "string"),
        (b'"\\ud83d\\ude00"', "json"),
        (b'"\\\\ud800"', "json"),
        (b"[" * 127 + b"]" * 127, "json"),
        (b"[" * 128 + b"]" * 128, "string"),
        (b'"' + b"[" * 200 + b'"', "json"),
        (b"[" + b"[]," * 200 + b"1]", "json"),
        (b"  ", "string"),
        (b"42", "json"),
        (b" null", "json"),
        (b"nulls", "string"),
        (b"true\n", "json"),
        (b' {"a":1} ', "json"),
        (b'{"a":1,"a":2}', "json"),
    ],
)
def test_classify(spark, raw, kind):
    assert column(spark, [raw], "binary", classify_payload) == [kind]


def test_headers(spark):
    some = uuid.UUID("01234567-89ab-cdef-0123-456789abcdef")
    rows = [bytes.fromhex("0000000200") + b"x", b"\x03\x05" + some.bytes + b"body", b"plain", b"\x00\xff\xff\xff\xff1"]
    assert column(spark, rows, "binary", confluent_header) == [("512", bytearray(b"x")), None, None, None]
    assert column(spark, rows, "binary", glue_header) == [None, (str(some), True, bytearray(b"body")), None, None]
    packed = b"\x03\x00" + some.bytes
    assert column(spark, [packed], "binary", glue_header) == [(str(some), False, bytearray(b""))]


# A text with its rendering on one line and with spaces.
@pytest.mark.parametrize(
    "text, plain, indented",
    [
        (
            '{"name":"Jane Doe","age":25,"city":"San Francisco"}',
            '{"age":25,"city":"San Francisco","name":"Jane Doe"}',
            '{ "age": 25, "city": "San Francisco", "name": "Jane Doe" }',
        ),
        ('"string"', '"string"', '"string"'),
        ("null", "null", "null"),
        ("[[],{},[1,{}]]", "[[],{},[1,{}]]", "[ [], {}, [ 1, {} ] ]"),
        (r'{"a":"x\"y{,}\\n\n\u0001:"}', '{"a":"x"y{,}\\n\n\x01:"}', '{ "a": "x"y{,}\\n\n\x01:" }'),
        (r'["\\u0041","\\\\"]', '["\\u0041","\\\\"]', '[ "\\u0041", "\\\\" ]'),
        ('{"a":1,"a":2}', '{"a":2}', '{ "a": 2 }'),
        ('["é","\\u00e9","\\/"]', '["é","é","/"]', '[ "é", "é", "/" ]'),
    ],
)
def test_render_json(spark, text, plain, indented):
    assert column(spark, [text], "string", lambda v: render_json(parse_json_payload(v))) == [plain]
    assert column(spark, [text], "string", lambda v: render_json(parse_json_payload(v), indent=True)) == [indented]


def test_render_json_escaped(spark):
    text = r'{"b":"x\"y\\","a":[1]}'
    assert column(spark, [text], "string", lambda v: render_json(parse_json_payload(v), escape=True)) == [
        r'{"a":[1],"b":"x\"y\\"}'
    ]


def test_utf8_lossy(spark):
    rows = ["FFFE", "61E282", "F09F98", "C328", "EDA080", "E282FF80", "6162", ""]
    raw = [bytes.fromhex(r) for r in rows]
    assert column(spark, raw, "binary", utf8_lossy) == [r.decode("utf-8", "replace") for r in raw]


def test_split_topic_partition(spark):
    names = ["topic", "topic-1", "a-b-12", "topic-", "-1", "topic-99999999999", "topic-1-x"]
    out = column(spark, names, "string", lambda v: F.struct(*split_topic_partition(v)))
    assert [tuple(r) for r in out] == [
        ("topic", None, False),
        ("topic", 1, True),
        ("a-b", 12, True),
        ("topic-", None, False),
        ("-1", None, False),
        ("topic", None, True),
        ("topic-1-x", None, False),
    ]


NOW = "2025-02-13 12:00:00"


@pytest.mark.parametrize(
    "expression, start, end",
    [
        ("now", "2025-02-13 12:00:00.000", "2025-02-13 12:00:00.000"),
        ("-1d", "2025-02-12 12:00:00.000", "2025-02-12 12:00:00.000"),
        ("-30m", "2025-02-13 11:30:00.000", "2025-02-13 11:30:00.000"),
        ("-10h", "2025-02-13 02:00:00.000", "2025-02-13 02:00:00.000"),
        ("-3s", "2025-02-13 11:59:57.000", "2025-02-13 11:59:57.000"),
        ("2021-01-01", "2021-01-01 00:00:00.000", "2021-01-01 23:59:59.999"),
        ("2021-01-01 01:02", "2021-01-01 01:02:00.000", "2021-01-01 01:02:59.999"),
        ("2021-01-01 01:02:03", "2021-01-01 01:02:03.000", "2021-01-01 01:02:03.999"),
        ("01:02", "2025-02-13 01:02:00.000", "2025-02-13 01:02:59.999"),
        ("01:02:03", "2025-02-13 01:02:03.000", "2025-02-13 01:02:03.999"),
        ("-1h30m", None, None),
        ("2021-02-30", None, None),
        ("2021-01-01T01:02", None, None),
        ("-", None, None),
        ("yesterday", None, None),
        ("", None, None),
    ],
)
def test_times(spark, expression, start, end):
    show = lambda c: F.when(c.isNotNull(), render_timestamp(c))
    got = column(spark, [expression], "string", lambda v: F.struct(*[show(c) for c in time_bounds(v, NOW)]))
    assert tuple(got[0]) == (start, end)
    if start is None:
        with pytest.raises(ValueError, match="Cannot read the time"):
            resolve_time(spark, expression, NOW)
    else:
        row = spark.range(1).select(
            render_timestamp(resolve_time(spark, expression, NOW)), render_timestamp(resolve_time(spark, expression, NOW, end=True))
        )
        assert tuple(row.first()) == (start, end)


def test_times_in_another_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        micros = spark.range(1).select(F.unix_millis(resolve_time(spark, "2024-07-01", NOW))).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert micros == 1000 * int(dt.datetime(2024, 6, 30, 22, tzinfo=dt.timezone.utc).timestamp())


def test_timestamp_text_and_age(spark):
    rows = [dt.datetime(2024, 5, 1, 23, 59, 59, 999999), dt.datetime(2024, 5, 2, 0, 0), dt.datetime(2024, 5, 2, 12, 0, 0, 900), dt.datetime(2024, 5, 2, 12, 0, 0, 1000), None]
    df = spark.createDataFrame([(str(r) if r else None,) for r in rows], "t string").select(F.col("t").cast("timestamp").alias("t"))
    got = df.select(render_timestamp("t"), record_age("t", "2024-05-02 12:00:00")).collect()
    assert [tuple(r) for r in got] == [
        ("2024-05-01 23:59:59.999", "older"),
        ("2024-05-02 00:00:00.000", "today"),
        ("2024-05-02 12:00:00.000", "today"),
        ("2024-05-02 12:00:00.001", "new"),
        ("", None),
    ]


def test_framed_text_from_base64(spark):
    raw = base64.b64decode("AAAAAAEOdmFsdWU0Mg==")
    assert column(spark, [raw], "binary", lambda v: confluent_header(v)["schema_id"]) == ["1"]
    assert zlib.decompress(zlib.compress(raw)) == raw
