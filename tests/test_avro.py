"""Framed Avro: vectors of every type, broken data, schemas, the round trip through a log."""

import base64
import datetime as dt
import json
import random
import struct
import uuid
import zlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import loglens as L
from loglens.functions.avro import avro_reader, json_avro, render_avro
from workload.queries import REGISTRY


def varint(n):
    n, out = (n << 1) ^ (n >> 63), b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def block(raw):
    return varint(len(raw)) + raw


def record(*fields):
    return json.dumps({"type": "record", "name": "R", "fields": [{"name": f"f{i}", "type": t} for i, t in enumerate(fields)]})


def shown(schema, raw, indent=False):
    return render_avro(avro_reader(json.dumps(schema))(raw), indent)


def logical(kind, name, **extra):
    return {"type": kind, "logicalType": name, **extra}


ENUM = {"type": "enum", "name": "E", "symbols": ["A", "B"]}
FIXED = {"type": "fixed", "name": "F", "size": 2}


@pytest.mark.parametrize(
    "schema, raw, text",
    [
        ("null", b"", "null"),
        ("boolean", b"\1", "true"),
        ("boolean", b"\0", "false"),
        ("int", varint(-65), "-65"),
        ("long", varint(2**63 - 1), "9223372036854775807"),
        ("long", varint(-(2**63)), "-9223372036854775808"),
        ("float", struct.pack("<f", 0.1), "0.1"),
        ("float", struct.pack("<f", 1.0), "1"),
        ("double", struct.pack("<d", 1e21), "1000000000000000000000"),
        ("double", struct.pack("<d", -2.5e-7), "-0.00000025"),
        ("double", struct.pack("<d", float("nan")), "NaN"),
        ("double", struct.pack("<d", float("-inf")), "-inf"),
        ("bytes", block(b"\1\xff"), '"[1, 255]"'),
        ("string", block("grün".encode()), '"grün"'),
        ("string", block(b'a"b'), '"a"b"'),
        (ENUM, varint(1), '"B"'),
        (FIXED, b"\1\2", '"[1, 2]"'),
        (["null", "string"], varint(0), "null"),
        (["null", "string"], varint(1) + block(b"x"), '"x"'),
        ({"type": "array", "items": "int"}, varint(0), "[]"),
        ({"type": "array", "items": "int"}, varint(2) + varint(1) + varint(2) + varint(1) + varint(3) + varint(0), "[1,2,3]"),
        ({"type": "array", "items": "int"}, varint(-2) + varint(2) + varint(1) + varint(2) + varint(0), "[1,2]"),
        ({"type": "map", "values": "long"}, varint(1) + block(b"k") + varint(7) + varint(0), '{"k":7}'),
        (logical("int", "date"), varint(4), '"1970-01-05"'),
        (logical("int", "time-millis"), varint(1234567890), '"1234567890ms"'),
        (logical("long", "time-micros"), varint(1234567890), '"1234567890µs"'),
        (logical("long", "timestamp-millis"), varint(1234567890), '"1970-01-15 06:56:07.890 UTC"'),
        (logical("long", "timestamp-micros"), varint(1234567890000), '"1970-01-15 06:56:07.890 UTC"'),
        (logical("long", "timestamp-micros"), varint(1234567890001), '"1970-01-15 06:56:07.890001 UTC"'),
        (logical("long", "timestamp-nanos"), varint(1234567890000000001), '"2009-02-13 23:31:30.000000001 UTC"'),
        (logical("long", "local-timestamp-millis"), varint(-1), '"1969-12-31 23:59:59.999 UTC"'),
        (logical("long", "timestamp-millis"), varint(1000), '"1970-01-01 00:00:01 UTC"'),
        (logical("bytes", "decimal", precision=9, scale=2), block((-12345).to_bytes(3, "big", signed=True)), '"-123.45"'),
        (logical("bytes", "big-decimal"), block(block((123000000004).to_bytes(5, "big", signed=True)) + varint(11)), "1.23000000004"),
        ({**FIXED, "size": 12, "logicalType": "duration"}, struct.pack("<III", 1, 2, 3), '"Duration { months: Months(1), days: Days(2), millis: Millis(3) }"'),
        (logical("string", "uuid"), block(b"01234567-89AB-CDEF-0123-456789ABCDEF"), '"01234567-89ab-cdef-0123-456789abcdef"'),
        ({**FIXED, "size": 16, "logicalType": "uuid"}, uuid.UUID(int=1).bytes, '"00000000-0000-0000-0000-000000000001"'),
        (logical("int", "unheard-of"), varint(5), "5"),
        ({"type": {"type": "int"}}, varint(5), "5"),
    ],
)
def test_values(schema, raw, text):
    assert shown(schema, raw + b"trailing") == text


def test_records_keep_their_order():
    schema = json.loads(record("string", "int", "string"))
    raw = block(b"Jane Doe") + varint(25) + block(b"San Francisco")
    assert shown(schema, raw) == '{"f0":"Jane Doe","f1":25,"f2":"San Francisco"}'
    assert shown(schema, raw, True) == '{ "f0": "Jane Doe", "f1": 25, "f2": "San Francisco" }'


def test_named_types_and_recursion():
    tree = {
        "type": "record", "name": "Node", "namespace": "x.y",
        "fields": [
            {"name": "e", "type": {**ENUM, "namespace": "z"}},
            {"name": "again", "type": "z.E"},
            {"name": "next", "type": ["null", "Node"]},
        ],
    }
    raw = varint(0) + varint(1) + varint(1) + varint(1) + varint(0) + varint(0)
    assert shown(tree, raw) == '{"e":"A","again":"B","next":{"e":"B","again":"A","next":null}}'


@pytest.mark.parametrize(
    "schema, raw",
    [
        ("string", varint(5) + b"abc"),
        ("string", varint(-1)),
        ("long", b"\xff"),
        ("long", b"\xff" * 11),
        ("double", b"123"),
        ("boolean", b"\2"),
        ("string", block(b"\xff")),
        (ENUM, varint(2)),
        (["null"], varint(1)),
        ({"type": "array", "items": "int"}, varint(2) + varint(1)),
    ],
)
def test_broken_data(schema, raw):
    with pytest.raises((ValueError, struct.error)):
        shown(schema, raw)


def test_json_form_is_valid():
    value = avro_reader(record("string", "double", {"type": "map", "values": "string"}))(
        block(b'a"\n') + struct.pack("<d", float("inf")) + varint(1) + block(b'k"') + block(b"\\") + varint(0)
    )
    assert json.loads(json_avro(value)) == {"f0": 'a"\n', "f1": "inf", "f2": {'k"': "\\"}}


def test_random_records_round_trip():
    rnd = random.Random(7)
    definition = record("long", ["null", "double"], {"type": "array", "items": "string"})
    read = avro_reader(definition)
    for _ in range(200):
        number, real = rnd.randint(-(2**40), 2**40), rnd.choice([None, rnd.uniform(-1e9, 1e9)])
        texts = ["".join(rnd.choice("aé€😀") for _ in range(rnd.randint(0, 5))) for _ in range(rnd.randint(0, 4))]
        raw = varint(number) + (varint(0) if real is None else varint(1) + struct.pack("<d", real))
        raw += (varint(len(texts)) + b"".join(block(t.encode()) for t in texts) if texts else b"") + varint(0)
        assert json.loads(json_avro(read(raw))) == {"f0": number, "f1": real, "f2": texts}


STRING_FIELD = '{"type":"record","name":"T","fields":[{"name":"f1","type":"string"}]}'
GLUE = uuid.UUID("01234567-89ab-cdef-0123-456789abcdef")


@pytest.fixture
def schemas(spark):
    rows = [("confluent", "1", STRING_FIELD), ("glue", str(GLUE).upper(), record("string", "int"))]
    return spark.createDataFrame(rows, "registry string, schema_id string, definition string")


def wire(log):
    body = block(b"field1") + varint(42)
    values = [
        base64.b64decode("AAAAAAEOdmFsdWU0Mg=="),
        b"\3\0" + GLUE.bytes + body,
        b"\3\5" + GLUE.bytes + zlib.compress(body),
        b"plain",
        None,
    ]
    return log([("t", 0, i, i, "k", v) for i, v in enumerate(values)])


@pytest.mark.parametrize("joined", [False, True])
def test_decode(monkeypatch, log, schemas, joined):
    if joined:
        monkeypatch.setattr("loglens.operators.payloads.SCHEMA_ROWS", 1)
    got = L.decode_avro(wire(log), schemas, with_json=True).orderBy("offset").collect()
    assert [r["value_avro"] and r["value_avro"]["text"] for r in got] == [
        '{"f1":"value42"}', '{"f0":"field1","f1":42}', '{"f0":"field1","f1":42}', None, None,
    ]
    assert json.loads(got[0]["value_avro"]["json"]) == {"f1": "value42"}
    assert L.text_filter(wire(log), "value42", schemas).count() == 1
    assert L.text_filter(wire(log), '{ "f1": "value42" }', schemas, indent=True).count() == 1
    assert [r["value_kind"] for r in L.with_payloads(wire(log), schemas).orderBy("offset").collect()] == ["avro"] * 3 + ["string", "null"]


def test_missing_schema_and_broken_data(log, schemas):
    unknown = log([("t", 0, 0, 0, "k", b"\0\0\0\0\x09x"), ("t", 0, 1, 0, "k", b"\0\0\0\0\1\x0ex")])
    got = L.decode_avro(unknown, schemas, mode="permissive").orderBy("offset").collect()
    assert "no schema 9 of registry confluent" in got[0]["value_avro"]["error"] and got[0]["value_avro"]["text"] is None
    assert "end of data" in got[1]["value_avro"]["error"]
    with pytest.raises(Exception, match="no schema 9"):
        L.decode_avro(unknown.where("offset = 0"), schemas).collect()
    with pytest.raises(Exception, match="no schemas were given"):
        L.with_payloads(unknown).collect()
    assert [r["value_text"] for r in L.with_payloads(unknown, mode="permissive").collect()] == [None, None]
    with pytest.raises(ValueError, match="mode"):
        L.decode_avro(unknown, schemas, mode="other")


def test_required_schemas(log, schemas):
    df = wire(log)
    got = sorted(tuple(r) for r in L.required_schemas(df).collect())
    assert got == [("confluent", "1", 1), ("glue", str(GLUE), 2)]
    both = df.withColumn("key", F.col("value"))
    assert sorted(r["records"] for r in L.required_schemas(both).collect()) == [2, 4]
    heads = df.select("offset", L.frame("value")["registry"].alias("registry"), L.frame("value")["schema_id"].alias("schema_id"))
    joined = {r["offset"]: r["definition"] for r in L.join_schemas(heads, schemas).collect()}
    assert joined[0] == STRING_FIELD and joined[1] == record("string", "int") and joined[3] is None


def test_typed_columns_from_the_json_form(log, schemas):
    decoded = L.decode_avro(wire(log), schemas, with_json=True).where("offset = 1")
    row = decoded.select(F.from_json("value_avro.json", "f0 string, f1 int").alias("v")).first()
    assert row["v"] == ("field1", 42) and Decimal(row["v"]["f1"]) == 42 and dt.date(1970, 1, 5) > dt.date(1970, 1, 1)


@pytest.mark.parametrize("joined", [False, True])
def test_payloads_pass_through_python_once(monkeypatch, capsys, log, schemas, joined):
    """A task starts one Python worker, whatever its payloads need: decoding, and numbers of JSON."""
    if joined:
        monkeypatch.setattr("loglens.operators.payloads.SCHEMA_ROWS", 1)
    df = wire(log).unionByName(log([("t", 0, 9, 0, "1.50", '{"a": 2.0}')])).withColumn("topic", F.lit("t"))
    for shown in (L.with_payloads(df, schemas), L.text_filter(df, "field1", schemas)):
        shown.explain()
        assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    got = {r["offset"]: (r["key_text"], r["value_text"]) for r in L.with_payloads(df, schemas).collect()}
    assert got[9] == ("1.5", '{"a":2.0}') and got[2] == ("k", '{"f0":"field1","f1":42}')
    assert sorted(r["offset"] for r in L.text_filter(df, "field1", schemas).collect()) == [1, 2]


def test_framed_logs_are_encoded_before_they_are_read(spark, tmp_path, capsys):
    day = dt.datetime(2024, 1, 5)
    events = [(i, day, i % 3, ("purchase", "view")[i % 2], i / 2, "{}") for i in range(12)]
    orders = [(i, i % 5, "FOP"[i % 3], i / 4, day, "1-URGENT" if i % 3 else "5-LOW") for i in range(32)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame(
        orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    wanted = {
        "text_filter_avro": [i for i in range(12) if i % 2 == 0],
        "text_filter_orders": [i for i in range(32) if i % 4 != 3 and i % 2 == 0 and i % 3],
    }
    for name, offsets in wanted.items():
        found = REGISTRY[name](spark, str(tmp_path))
        found.explain()
        assert capsys.readouterr().out.count("ArrowEvalPython") == 1
        assert sorted(r["offset"] for r in found.collect()) == offsets
