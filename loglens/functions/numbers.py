"""Numbers of JSON payloads as they are shown.

Spark's VARIANT shows 1.0 as 1 and 1e20 as 1.0E20. The few payloads with such numbers are read once more and written with
integers of 64 bits as they are and all other numbers as the shortest digits that give the same double: plain from
0.00001 up to 16 digits before the point, with an exponent beyond.
"""

from __future__ import annotations

import json
import re
import sys
from decimal import Decimal

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Executors need no installed copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Number tokens that VARIANT shows otherwise, and the range of numbers without an exponent.
OTHERWISE = r"(?:^|[:\[,\s])-?[0-9]+[.eE]|[0-9]{19}|(?:^|[:\[,\s])-0"
LEAST_POINT, MOST_POINT = -5, 16
QUOTED = re.compile(r'["\\\x00-\x1f]')
SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


class Token(str):
    """A number as it is shown."""

    __slots__ = ()


def shown_real(value: float) -> Token:
    """The shortest digits of a double, always with a point or an exponent."""
    sign, digits, exponent = Decimal(repr(value)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0")
    if not text:
        return Token("-0.0" if sign else "0.0")
    exponent += len(digits) - len(text)
    point = len(text) + exponent  # where the point is, counted from the first digit
    if LEAST_POINT < point <= 0:
        out = "0." + "0" * -point + text
    elif 0 < point <= MOST_POINT:
        out = text + "0" * exponent + ".0" if exponent >= 0 else f"{text[:point]}.{text[point:]}"
    else:
        out = f"{text[0]}{'.' if len(text) > 1 else ''}{text[1:]}e{point - 1}"
    return Token("-" + out if sign else out)


def shown_integer(text: str) -> Token:
    if text != "-0" and len(text) <= 20 and -(1 << 63) <= int(text) < 1 << 64:
        return Token(text)
    return shown_real(float(text))


def _quoted(text: str) -> str:
    return '"' + QUOTED.sub(lambda m: SHORT.get(m[0]) or f"\\u{ord(m[0]):04X}", text) + '"'


def compact(value) -> str:
    """One line without gaps, keys sorted by their bytes."""
    if isinstance(value, Token):
        return value
    if isinstance(value, str):
        return _quoted(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{_quoted(k)}:{compact(v)}" for k, v in sorted(value.items(), key=lambda x: x[0].encode())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(compact, value)) + "]"
    return {None: "null", True: "true", False: "false"}[value]


def _rewritten(texts: pa.Array) -> pa.Array:
    read = json.JSONDecoder(parse_float=lambda x: shown_real(float(x)), parse_int=shown_integer, strict=False).decode
    return pa.array([None if t is None else compact(read(t)) for t in texts.to_pylist()], pa.string())


def own_numbers(text: Column, json_text: Column) -> Column:
    """The compact JSON of a text with numbers as they are shown; null where ``json_text`` has them already, or is null."""
    return F.arrow_udf(_rewritten, "string")(F.when(json_text.isNotNull() & text.rlike(OTHERWISE), text))
