"""Numbers of JSON payloads, alone and in rendered records."""

import json

import pytest
from pyspark.sql import functions as F

import loglens as L
from loglens.functions.numbers import compact, shown_integer, shown_real


@pytest.mark.parametrize(
    "text, shown",
    [
        ("1.0", "1.0"), ("1", "1"), ("-0", "-0.0"), ("-0.0", "-0.0"), ("0.0", "0.0"), ("1e20", "1e20"), ("1E+2", "100.0"), ("1.50", "1.5"),
        ("0.00001", "0.00001"), ("0.000001", "1e-6"), ("123456789012345680.0", "1.2345678901234568e17"), ("1e15", "1000000000000000.0"),
        ("1e16", "1e16"), ("-2.5e-7", "-2.5e-7"), ("18446744073709551615", "18446744073709551615"), ("18446744073709551616", "1.8446744073709552e19"),
        ("-9223372036854775808", "-9223372036854775808"), ("-9223372036854775809", "-9.223372036854776e18"), ("1" * 44, "1.1111111111111111e43"),
        ("12.75", "12.75"), ("100000.25", "100000.25"), ("5e-324", "5e-324"), ("1.7976931348623157e308", "1.7976931348623157e308"),
    ],
)
def test_numbers(text, shown):
    got = shown_real(float(text)) if any(c in text for c in ".eE") else shown_integer(text)
    assert got == shown and float(got) == float(text)


def test_compact_is_json_with_sorted_keys():
    value = json.loads('{"b":[1,{"z":null,"a":true}],"a\\u0001\\"\\\\":"x\\n\\u001f/é","":{}}', parse_int=shown_integer)
    text = compact(value)
    assert json.loads(text) == {"": {}, 'a\x01"\\': "x\n\x1f/é", "b": [1, {"a": True, "z": None}]}
    assert text.startswith('{"":{},"a\\u0001')


def test_rendered_numbers(log):
    values = ['{"b":1.0,"a":1e20}', "1.50", "[1, -0, 12345678901234567890123]", '{"t":"1.0","n":7}', '{"x":"\\u0007\\"q\\"","y":2.0}', "1.0x", None]
    df = log([("t", 0, i, i, "1e2" if i == 0 else "k", v) for i, v in enumerate(values)])
    got = L.with_payloads(df).orderBy("offset").collect()
    assert [r["value_text"] for r in got] == [
        '{"a":1e20,"b":1.0}', "1.5", "[1,-0.0,1.2345678901234568e22]", '{"n":7,"t":"1.0"}', '{"x":"\x07"q"","y":2.0}', "1.0x", "null",
    ]
    assert got[0]["key_text"] == "100.0"
    spaced = L.with_payloads(df, indent=True).orderBy("offset").collect()
    assert spaced[0]["value_text"] == '{ "a": 1e20, "b": 1.0 }'


@pytest.mark.parametrize("needle", ["1e20", "1.5", "100.0", "2345678901234568", '"n":7', "1.0x", "-0.0", "e22"])
def test_search_finds_what_is_shown(log, needle):
    values = ['{"b":1.0,"a":1e20}', "1.50", "[1, -0, 12345678901234567890123]", '{"t":"1.0","n":7}', "1.0x", None]
    df = log([("t", 0, i, i, "1e2" if i == 0 else "k", v) for i, v in enumerate(values)])
    every = L.with_payloads(df)
    want = sorted(r["offset"] for r in L.text_filter(every, needle).collect())
    assert want and sorted(r["offset"] for r in L.text_filter(df, needle).collect()) == want


def test_only_such_payloads_are_read_again(log):
    df = log([("t", 0, 0, 0, "k", '{"a":1}'), ("t", 0, 1, 1, "k", '{"a":1.0}')])
    from loglens.functions.numbers import OTHERWISE

    assert [r[0] for r in df.orderBy("offset").select(F.col("value").cast("string").rlike(OTHERWISE)).collect()] == [False, True]
