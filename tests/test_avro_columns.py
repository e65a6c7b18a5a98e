"""Avro read by columns: against the reader of single values, typed columns, other writers' schemas, needles in bytes."""

import datetime as dt
import json
import random
import struct
import uuid
import zlib
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import loglens as L
from loglens.functions.avro import avro_reader, json_avro, render_avro
from loglens.functions.avro_columns import Form, compiled, read, spark_type
from loglens.operators.payloads import avro_needles
from tests.test_avro import STRING_FIELD, block, logical, record, test_broken_data, test_values, varint

VECTORS = test_values.pytestmark[0].args[1]
BROKEN = test_broken_data.pytestmark[0].args[1]


@pytest.mark.parametrize("schema, raw, text", VECTORS)
def test_values_by_columns(schema, raw, text):
    node = compiled(json.dumps(schema))
    values, bad = read(node, [raw + b"trailing", raw])
    assert not bad.any() and node.text(values, Form()).to_pylist() == [text, text]
    assert node.typed(values).type == node.type and spark_type(node.type)


@pytest.mark.parametrize("schema, raw", BROKEN)
def test_broken_data_is_marked(schema, raw):
    good = {"string": block(b"ok"), "long": varint(3), "double": struct.pack("<d", 1), "boolean": b"\1"}
    rows = [raw] + ([good[schema]] if isinstance(schema, str) else [])
    _, bad = read(compiled(json.dumps(schema)), rows)
    assert bad.tolist() == [True] + [False] * (len(rows) - 1)


class Maker:
    """Random schemas and values."""

    def __init__(self, seed):
        self.rnd, self.names = random.Random(seed), 0

    def text(self):
        return "".join(self.rnd.choice('aZ"\\\n é€😀') for _ in range(self.rnd.choice([0, 1, 3, 90])))

    def schema(self, depth=3):
        simple = ["null", "boolean", "int", "long", "float", "double", "bytes", "string", "enum", "fixed", "date", "millis", "decimal", "uuid"]
        kind = self.rnd.choice(simple + ["record", "array", "map", "union"] * 3 * (depth > 0))
        self.names += 1
        name = f"N{self.names}"
        if kind == "record":
            fields = [{"name": f"f{i}", "type": self.schema(depth - 1)} for i in range(self.rnd.randint(0, 4))]
            return {"type": "record", "name": name, "fields": fields}
        if kind == "array":
            return {"type": "array", "items": self.schema(depth - 1)}
        if kind == "map":
            return {"type": "map", "values": self.schema(depth - 1)}
        if kind == "union":
            return ["null", *(self.schema(0) for _ in range(self.rnd.randint(1, 3)))]
        return {
            "enum": {"type": "enum", "name": name, "symbols": ["A", "BC"]},
            "fixed": {"type": "fixed", "name": name, "size": self.rnd.choice([0, 1, 5])},
            "date": logical("int", "date"),
            "millis": logical("long", "timestamp-millis"),
            "decimal": logical("bytes", "decimal", precision=20, scale=3),
            "uuid": logical("string", "uuid"),
        }.get(kind, kind)

    def blocks(self, items):
        out = b""
        while items:
            n = self.rnd.randint(1, len(items))
            data, items = b"".join(items[:n]), items[n:]
            out += varint(n) + data if self.rnd.random() < 0.6 else varint(-n) + varint(len(data)) + data
        return out + varint(0)

    def value(self, schema):
        r = self.rnd
        if isinstance(schema, list):
            i = r.randrange(len(schema))
            return varint(i) + self.value(schema[i])
        form = schema if isinstance(schema, dict) else {}
        kind = form.get("logicalType") or form.get("type", schema)
        n = r.choice([0, 0, 1, 2, 5, 40])
        if kind == "record":
            return b"".join(self.value(f["type"]) for f in form["fields"])
        if kind == "array":
            return self.blocks([self.value(form["items"]) for _ in range(n)])
        if kind == "map":
            return self.blocks([block(r.choice(["k", "k2", self.text()]).encode()) + self.value(form["values"]) for _ in range(n)])
        return {
            "null": lambda: b"",
            "boolean": lambda: bytes([r.randint(0, 1)]),
            "int": lambda: varint(r.choice([0, 1, -1, 2**31 - 1, -(2**31), r.randint(-9999, 9999)])),
            "long": lambda: varint(r.choice([0, -1, 2**63 - 1, -(2**63), r.randint(-(2**40), 2**40)])),
            "float": lambda: struct.pack("<f", r.choice([0.0, 1e30, -2.5, float("nan")])),
            "double": lambda: struct.pack("<d", r.choice([0.1, 1e300, -0.0, float("inf"), r.random()])),
            "bytes": lambda: block(r.randbytes(r.choice([0, 3, 200]))),
            "string": lambda: block(self.text().encode()),
            "enum": lambda: varint(r.randint(0, 1)),
            "fixed": lambda: r.randbytes(form["size"]),
            "date": lambda: varint(r.randint(-9999, 9999)),
            "timestamp-millis": lambda: varint(r.randint(-(10**13), 10**13)),
            "decimal": lambda: block(r.randint(-(10**15), 10**15).to_bytes(8, "big", signed=True)),
            "uuid": lambda: block(str(uuid.UUID(int=r.getrandbits(128))).upper().encode()),
        }[kind]()


@pytest.mark.parametrize("seed", range(40))
def test_random_schemas_equal_the_reader_of_single_values(seed):
    make = Maker(seed)
    schema = make.schema()
    definition = json.dumps(schema)
    node, single = compiled(definition), avro_reader(definition)
    bodies = [make.value(schema) for _ in range(30)]
    cut = [b[: make.rnd.randint(0, len(b))] for b in bodies]
    values, bad = read(node, [*bodies, *cut])
    good = [i for i, b in enumerate(bad) if not b]
    values = values.take(pa.array(good, pa.int64()))
    texts, jsons = (dict(zip(good, node.text(values, f).to_pylist())) for f in (Form(True), Form(as_json=True)))
    for i, body in enumerate([*bodies, *cut]):
        try:
            want = single(body)
        except (ValueError, struct.error):
            assert bad[i]
            continue
        if i < len(bodies):
            assert not bad[i]
        if not bad[i]:
            assert texts[i] == render_avro(want, True) and jsons[i] == json_avro(want)
    assert node.typed(values).type == node.type


def test_items_without_data_are_bounded_by_an_argument():
    for items, shown in (("null", "null"), ({"type": "record", "name": "E", "fields": []}, "{}")):
        node = compiled(json.dumps({"type": "array", "items": items}))
        body = varint(20_000) + varint(0)
        values, bad = read(node, [body])
        assert not bad.any() and node.text(values, Form()).to_pylist() == ["[" + ",".join([shown] * 20_000) + "]"]
        assert read(node, [body], 10_000)[1].all()
        assert len(avro_reader(json.dumps({"type": "array", "items": items}))(body)) == 20_000
        with pytest.raises(ValueError, match="without data"):
            avro_reader(json.dumps({"type": "array", "items": items}), 10_000)(body)
    assert read(compiled('{"type":"array","items":"null"}'), [varint(2**62) + varint(0)])[1].all()


ALL = {
    "type": "record",
    "name": "All",
    "fields": [
        {"name": "day", "type": logical("int", "date")},
        {"name": "at", "type": logical("long", "timestamp-millis")},
        {"name": "local", "type": logical("long", "local-timestamp-micros")},
        {"name": "price", "type": logical("bytes", "decimal", precision=9, scale=2)},
        {"name": "maybe", "type": ["null", "string"]},
        {"name": "either", "type": ["null", "string", "long"]},
        {"name": "wide", "type": ["int", "long"]},
        {"name": "kind", "type": {"type": "enum", "name": "K", "symbols": ["ONE", "TWO"]}},
        {"name": "tags", "type": {"type": "array", "items": "string"}},
        {"name": "counts", "type": {"type": "map", "values": {"type": "array", "items": "int"}}},
        {"name": "inner", "type": ["null", {"type": "record", "name": "In", "fields": [{"name": "x", "type": "double"}]}]},
        {"name": "raw", "type": {"type": "fixed", "name": "Raw", "size": 2}},
        {"name": "long_ago", "type": {"type": "fixed", "name": "Dur", "size": 12, "logicalType": "duration"}},
    ],
}


def all_body(i):
    out = varint(i) + varint(1000 * i) + varint(10**6 * i + 5) + block((-12345 - i).to_bytes(3, "big", signed=True))
    out += varint(0) if i % 2 else varint(1) + block(b"yes")
    out += [varint(0), varint(1) + block(b"text"), varint(2) + varint(7)][i % 3]
    out += varint(i % 2) + varint(i) + varint(i % 2)
    out += varint(2) + block(b"a") + block("ü".encode()) + varint(0)
    out += varint(1) + block(b"k") + varint(-2) + varint(2) + varint(1) + varint(2) + varint(0) + varint(0)
    out += varint(0) if i % 2 else varint(1) + struct.pack("<d", 0.5)
    return out + b"\1\2" + struct.pack("<III", 1, 2, 3)


def framed(log, bodies, schema_id=1):
    return log([("t", 0, i, i, "k", b if b is None else b"\0" + struct.pack(">i", schema_id) + b) for i, b in enumerate(bodies)])


def registry(spark, *definitions):
    rows = [("confluent", str(i + 1), d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(definitions)]
    return spark.createDataFrame(rows, "registry string, schema_id string, definition string")


def test_typed_columns(spark, log):
    df = L.decode_avro_typed(framed(log, [all_body(0), all_body(1), None]), registry(spark, ALL), json.dumps(ALL))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema["value_typed"].dataType["value"].dataType}
    assert kinds == {
        "day": "date", "at": "timestamp", "local": "timestamp_ntz", "price": "decimal(9,2)", "maybe": "string",
        "either": "struct<member0:string,member1:bigint>", "wide": "bigint", "kind": "string", "tags": "array<string>",
        "counts": "map<string,array<int>>", "inner": "struct<x:double>", "raw": "binary",
        "long_ago": "struct<months:bigint,days:bigint,millis:bigint>",
    }
    a, b, c = [r["value_typed"] for r in df.orderBy("offset").collect()]
    assert c is None and a["error"] is None
    assert a["value"].asDict(True) | {"raw": bytes(a["value"]["raw"])} == {
        "day": dt.date(1970, 1, 1), "at": a["value"]["at"], "local": dt.datetime(1970, 1, 1, 0, 0, 0, 5), "price": Decimal("-123.45"),
        "maybe": "yes", "either": None, "wide": 0, "kind": "ONE", "tags": ["a", "ü"], "counts": {"k": [1, 2]}, "inner": {"x": 0.5},
        "raw": b"\1\2", "long_ago": {"months": 1, "days": 2, "millis": 3},
    }
    assert b["value"]["either"].asDict() == {"member0": "text", "member1": None} and b["value"]["inner"] is None
    assert df.select(F.unix_millis("value_typed.value.at")).where("offset = 1").first()[0] == 1000


def rec(*fields):
    return {"type": "record", "name": "R", "fields": list(fields)}


def test_other_writers_are_read_as_the_reader_wants(spark, log):
    reader = rec(
        {"name": "id", "type": "long"},
        {"name": "title", "type": "string", "aliases": ["name"]},
        {"name": "score", "type": ["null", "double"], "default": None},
        {"name": "tags", "type": {"type": "array", "items": "string"}, "default": ["none"]},
        {"name": "more", "type": {"type": "map", "values": "double"}, "default": {"a": 1}},
    )
    old = rec({"name": "name", "type": "string"}, {"name": "gone", "type": "int"}, {"name": "id", "type": "int"}, {"name": "score", "type": "float"})
    df = framed(log, [block(b"x") + varint(9) + varint(5) + struct.pack("<f", 0.5)], 1)
    got = L.decode_avro_typed(df, registry(spark, old), json.dumps(reader)).first()["value_typed"]["value"]
    assert got.asDict() == {"id": 5, "title": "x", "score": 0.5, "tags": ["none"], "more": {"a": 1.0}}
    lacking = rec({"name": "id", "type": "long"}, {"name": "needed", "type": "string"})
    with pytest.raises(Exception, match="no field needed"):
        L.decode_avro_typed(df, registry(spark, old), json.dumps(lacking)).collect()
    said = L.decode_avro_typed(df, registry(spark, old), json.dumps(lacking), mode="permissive").first()["value_typed"]
    assert said["value"] is None and "no field needed" in said["error"]


def test_broken_rows_among_good_ones(spark, log):
    bodies = [block(b"a"), varint(9) + b"short", block(b"b"), block(b"\xff"), block(b"")]
    df = framed(log, bodies)
    got = L.decode_avro(df, registry(spark, STRING_FIELD), mode="permissive", with_json=True).orderBy("offset").collect()
    assert [r["value_avro"]["text"] for r in got] == ['{"f1":"a"}', None, '{"f1":"b"}', None, '{"f1":""}']
    assert "end of data" in got[1]["value_avro"]["error"] and "utf-8" in got[3]["value_avro"]["error"]
    typed = L.decode_avro_typed(df, registry(spark, STRING_FIELD), STRING_FIELD, mode="permissive").orderBy("offset").collect()
    assert [r["value_typed"]["value"] and r["value_typed"]["value"]["f1"] for r in typed] == ["a", None, "b", None, ""]
    assert "end of data" in typed[1]["value_typed"]["error"]
    with pytest.raises(Exception, match="Cannot decode"):
        L.decode_avro_typed(df, registry(spark, STRING_FIELD), STRING_FIELD).collect()


def test_recursive_schemas_and_large_bodies(spark, log):
    node = {"type": "record", "name": "Node", "fields": [{"name": "next", "type": ["null", "Node"]}]}
    df = framed(log, [varint(1) + varint(0)])
    assert L.decode_avro(df, registry(spark, node)).first()["value_avro"]["text"] == '{"next":{"next":null}}'
    with pytest.raises(Exception, match="holds itself"):
        L.decode_avro_typed(df, registry(spark, node), record("int")).collect()
    texts = [f"t{i}" * 9 for i in range(20_000)]
    body = varint(len(texts)) + b"".join(block(t.encode()) for t in texts) + varint(0)
    shown = L.decode_avro(framed(log, [body]), registry(spark, record({"type": "array", "items": "string"}))).first()["value_avro"]["text"]
    assert json.loads(shown) == {"f0": texts}


def test_needles_of_schemas():
    schemas = {("c", "1"): record("string"), ("c", "2"): json.dumps(ALL), ("c", "3"): json.dumps(logical("string", "uuid")), ("c", "4"): "broken"}
    assert avro_needles(schemas, '"f0":"purchase"') == dict.fromkeys([("c", "1"), ("c", "2"), ("c", "3")], b"purchase")
    assert avro_needles(schemas, "counts") == dict.fromkeys([("c", "1"), ("c", "3")], b"counts")
    assert avro_needles(schemas, "cafe") == {} and avro_needles(schemas, "1234") == {} and avro_needles(schemas, "null") == {}
    assert avro_needles(schemas, 'ONE x "yes"')[("c", "2")] == b"yes"


@pytest.mark.parametrize("needle", ["yes", "text", "ONE", "counts", "-123.4", "months", "null", '"tags":["a"', "ü", "purchase", "1970-01-02", "zz"])
def test_search_loses_no_record(spark, log, needle):
    """The search that skips bodies equals one over everything that is rendered."""
    glue = uuid.UUID(int=7)
    schemas = registry(spark, ALL, STRING_FIELD).union(spark.createDataFrame([("glue", str(glue), json.dumps(ALL))]))
    values = [b"\0" + struct.pack(">i", 1) + all_body(i) for i in range(4)]
    values += [b"\3\5" + glue.bytes + zlib.compress(all_body(i)) for i in range(4)]
    values += [b"\3\0" + glue.bytes + all_body(i) for i in range(4)]
    values += [b"\0" + struct.pack(">i", 2) + block(t) for t in (b"purchase", b"zz\\", "ü".encode(), b"counts")] + [b"plain text", None]
    df = log([("t", 0, i, i, ("zz" if i == 5 else "k"), v) for i, v in enumerate(values)])
    every = L.with_payloads(df, schemas)
    want = {r["offset"]: r["value_text"] for r in L.text_filter(every, needle).collect()}
    got = {r["offset"]: r["value_text"] for r in L.text_filter(df, needle, schemas).collect()}
    assert got == want
