"""Bytes and text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

REPLACEMENT = "�"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time, however often it is used.

    Expressions have no local names, but the variable of a one-element transform is one.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def utf8_lossy(c: Column | str) -> Column:
    """Bytes as text; every malformed sequence becomes one U+FFFD."""
    return F.make_valid_utf8(col(c).cast("string"))


def is_text(c: Column | str) -> Column:
    """True where the bytes are valid UTF-8."""
    return F.is_valid_utf8(col(c).cast("string"))


def mentions(text: Column, needle: str) -> Column:
    """Substring test which is false, not null, on null text."""
    return F.coalesce(F.contains(text, F.lit(needle)), F.lit(False))
