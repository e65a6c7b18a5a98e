"""Payloads and records as text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglens.functions.text import col, once
from loglens.functions.times import after_millis, floor_millis, timestamp_literal

# The short escapes of JSON and what they stand for.
ESCAPES = (('\\"', '"'), ("\\/", "/"), ("\\b", "\b"), ("\\f", "\f"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"))
# The other control characters, as the JSON writer escapes them.
CODES = tuple((f"\\u{code:04X}", chr(code)) for code in range(0x20) if code != 1)
# JSON text holds no raw control characters, so U+0001 can mark a backslash and itself.
BACKSLASH, ITSELF = "\x01b", "\x01i"
PADDING = (("{", "{ "), ("[", "[ "), (",", ", "), (":", ": "), ("}", " }"), ("]", " ]"), ("{  }", "{}"), ("[  ]", "[]"))


def _replace_all(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _pad(json: Column) -> Column:
    """Spaces inside brackets and after separators, but never inside strings."""
    marked = _replace_all(json, (("\\\\", "\x01"), ('\\"', "\x02")))
    pieces = F.transform(
        F.split(marked, '"'), lambda piece, i: F.when(i % 2 == 0, _replace_all(piece, PADDING)).otherwise(piece)
    )
    return _replace_all(F.array_join(pieces, '"'), (("\x02", '\\"'), ("\x01", "\\\\")))


def _unescape(json: Column) -> Column:
    """Strings as they are, without JSON escapes (the quotes around them stay)."""
    short = _replace_all(json, (("\\\\", BACKSLASH), *ESCAPES, ("\\u0001", ITSELF)))
    codes = F.when(F.contains(json, F.lit("\\u00")), _replace_all(short, CODES)).otherwise(short)
    plain = _replace_all(codes, ((BACKSLASH, "\\"), (ITSELF, "\x01")))
    return F.when(F.contains(json, F.lit("\\")), plain).otherwise(json)


def show_json(json: Column, indent: bool = False, escape: bool = False) -> Column:
    """A compact JSON text as it is shown."""
    json = _pad(json) if indent else json
    return json if escape else _unescape(json)


def render_json(value: Column | str, indent: bool = False, escape: bool = False) -> Column:
    """A VARIANT on one line, keys sorted; ``indent`` adds spaces.

    Text inside strings is shown as it is. ``escape=True`` keeps the escapes
    and thereby valid JSON.
    """
    return once(F.to_json(col(value)), lambda json: show_json(json, indent, escape))


def render_timestamp(ts: Column | str, timestamp_type: Column | str | None = None) -> Column:
    """``yyyy-MM-dd HH:mm:ss.SSS`` in the session time zone; empty without a timestamp."""
    text = F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss.SSS")
    if timestamp_type is not None:
        text = F.when(col(timestamp_type) != -1, text)
    return F.coalesce(text, F.lit(""))


def record_age(ts: Column | str, start: dt.datetime | str | Column) -> Column:
    """``new`` (after the start), ``today`` (same day) or ``older``; null without a timestamp."""
    ts, start = col(ts), timestamp_literal(start)
    return (
        F.when(ts.isNull(), F.lit(None))
        .when(floor_millis(ts) >= after_millis(start), "new")
        .when(F.to_date(ts) == F.to_date(start), "today")
        .otherwise("older")
    )


def render_line(key_text: Column | str = "key_text", value_text: Column | str = "value_text") -> Column:
    """``topic-partition timestamp offset key value`` of a record with rendered payloads."""
    return F.concat_ws(
        " ",
        F.concat(F.col("topic"), F.lit("-"), F.col("partition")),
        render_timestamp("timestamp", "timestampType"),
        F.col("offset"),
        F.coalesce(col(key_text), F.lit("null")),
        F.coalesce(col(value_text), F.lit("null")),
    )
