"""Avro bodies of many records read column by column.

A schema compiles to nodes. Each node reads one value for every record of a batch at once: the records' bytes lie in one
buffer, each record has a position in it, and a step moves all positions by numpy. The result is an Arrow array per
node, nested as the schema is, from which both typed columns and rendered text are made. Blocks of numbers are read
as a whole; other items take as many steps as the longest array has.

A record whose bytes don't fit its schema is marked, and read again value by value, which says what is wrong.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Callable, Iterator
from decimal import Decimal
from json.encoder import encode_basestring

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from loglens.functions.avro import MOST_EMPTY, PRIMITIVES, Bare, NotANumber, _big_decimal, _leaf, _number

# Executors need no installed copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PADDING = 16
LONGEST_VARINT = 10
SLICED = 64
MOST_DECIMAL = 38
MOST_MS = (1 << 63) // 1000 - 1


def _ragged(lengths: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


class Cursor:
    """Where each record of a batch is read next, and which are broken."""

    def __init__(self, bodies: list[bytes], most_empty: int = MOST_EMPTY):
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        self.raw = b"".join(bodies) + bytes(PADDING)
        self.buf = np.frombuffer(self.raw, np.uint8)
        self.end = np.cumsum(sizes)
        self.pos = self.end - sizes
        self.bad = np.zeros(len(bodies), bool)
        self.most_empty = most_empty
        self._stops = None

    def spoil(self, rows: np.ndarray, broken: np.ndarray) -> None:
        self.bad[rows[broken]] = True

    def take(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Starts of as many bytes of each row; those that lack them are broken and give none."""
        start = self.pos[rows]
        broken = (sizes < 0) | (sizes > self.end[rows] - start)
        self.spoil(rows, broken)
        self.pos[rows] = np.where(broken, start, start + np.where(broken, 0, sizes))
        return start

    def longs(self, rows: np.ndarray) -> np.ndarray:
        """One number of each row."""
        start = self.pos[rows].copy()
        out = np.zeros(len(rows), np.uint64)
        at, more = start.copy(), np.arange(len(rows))
        for i in range(LONGEST_VARINT):
            byte = self.buf[at[more]].astype(np.uint64)
            out[more] |= (byte & np.uint64(0x7F)) << np.uint64(7 * i)
            at[more] += 1
            more = more[byte >= 0x80]
            if not len(more):
                break
        broken = at > self.end[rows]
        broken[more] = True
        broken |= (at - start == LONGEST_VARINT) & (self.buf[at - 1] > 1)
        self.spoil(rows, broken)
        self.pos[rows] = np.where(broken, start, at)
        return np.where(broken, 0, (out >> np.uint64(1)).astype(np.int64) ^ -(out & np.uint64(1)).astype(np.int64))

    def many_longs(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """So many numbers of each row, one after another."""
        if self._stops is None:
            self._stops = np.flatnonzero(self.buf < 0x80)
        first = np.searchsorted(self._stops, self.pos[rows])
        last = np.minimum(first + counts, len(self._stops))
        end = np.where(counts > 0, self._stops[np.maximum(last, 1) - 1] + 1, self.pos[rows])
        broken = (last - first < counts) | (end > self.end[rows])
        self.spoil(rows, broken)
        own = np.where(broken, 0, counts)
        stop = self._stops[np.repeat(first, own) + _ragged(own)]
        start = np.concatenate([stop[:1], stop[:-1] + 1])
        opens = (np.cumsum(own) - own)[own > 0]
        start[opens] = self.pos[rows][own > 0]
        size = stop - start + 1
        of = np.repeat(np.arange(len(rows)), own)
        long = (size > LONGEST_VARINT) | ((size == LONGEST_VARINT) & (self.buf[stop] > 1))
        self.spoil(rows, np.bincount(of[long], minlength=len(rows)) > 0)
        out = np.zeros(len(start), np.uint64)
        for i in range(min(int(size.max(initial=0)), LONGEST_VARINT)):
            some = size > i
            out[some] |= (self.buf[start[some] + i].astype(np.uint64) & np.uint64(0x7F)) << np.uint64(7 * i)
        self.pos[rows] = np.where(broken, self.pos[rows], end)
        values = (out >> np.uint64(1)).astype(np.int64) ^ -(out & np.uint64(1)).astype(np.int64)
        if broken.any():  # as many values as asked for
            full = np.zeros(int(counts.sum()), np.int64)
            full[np.repeat(~broken, counts)] = values
            return full
        return values

    def fixed(self, rows: np.ndarray, size: int, counts: np.ndarray | None = None) -> np.ndarray:
        """A table of bytes: one value of each row, or so many of each."""
        counts = np.ones(len(rows), np.int64) if counts is None else counts
        start = self.take(rows, counts * size)
        start = np.minimum(np.repeat(start, counts) + _ragged(counts) * size, len(self.buf) - PADDING)
        at = np.minimum(start[:, None] + np.arange(size), len(self.buf) - 1)
        return self.buf[at]

    def binary(self, rows: np.ndarray) -> pa.Array:
        sizes = self.longs(rows)
        start = self.take(rows, sizes)
        sizes = np.where(self.bad[rows], 0, sizes)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        if offsets[-1] > SLICED * max(len(rows), 1) or offsets[-1] >= 1 << 31:
            return pa.array([self.raw[a : a + n] for a, n in zip(start.tolist(), sizes.tolist())], pa.binary())
        data = self.buf[np.repeat(start, sizes) + _ragged(sizes)]
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _utf8(cur: Cursor, rows: np.ndarray, raw: pa.Array) -> pa.Array:
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        texts, broken = [], np.zeros(len(rows), bool)
        for i, x in enumerate(raw.to_pylist()):
            try:
                texts.append(x.decode())
            except UnicodeDecodeError:
                texts.append("")
                broken[i] = True
        cur.spoil(rows, broken)
        return pa.array(texts, pa.string())


Style = Callable[[pa.Array], pa.Array]


def _as_is(texts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar('"'), texts, pa.scalar('"'), "")


def _escaped(texts: pa.Array) -> pa.Array:
    odd = pc.match_substring_regex(texts, r'["\\\x00-\x1f]')
    if not pc.any(odd).as_py():
        return _as_is(texts)
    return pa.array([None if x is None else encode_basestring(x) for x in texts.to_pylist()], pa.string())


class Form:
    """How text is written: readable or JSON, with or without gaps."""

    def __init__(self, indent: bool = False, as_json: bool = False):
        self.gap, self.colon = (" ", ": ") if indent else ("", ":")
        self.as_json = as_json
        self.quote: Style = _escaped if as_json else _as_is

    def name(self, text: str) -> str:
        return encode_basestring(text) if self.as_json else f'"{text}"'

    def shown(self, values: list) -> pa.Array:
        """Texts of leaves: bare ones as they are, others in quotes."""
        out = []
        for v in values:
            if isinstance(v, NotANumber) and self.as_json:
                v = f'"{v}"'
            elif v is not None and not isinstance(v, Bare):
                v = self.name(v)
            out.append(v)
        return pa.array(out, pa.string())


class Node:
    """One type of a schema: reads values as Arrow arrays, turns them into typed columns and text."""

    type: pa.DataType
    empty = False  # whether values take no bytes

    def read(self, cur: Cursor, rows: np.ndarray) -> pa.Array:
        raise NotImplementedError

    def read_many(self, cur: Cursor, rows: np.ndarray, counts: np.ndarray) -> pa.Array | None:
        """So many values of each row, if that needs no step for each."""
        return None

    def typed(self, raw: pa.Array) -> pa.Array:
        return raw

    def text(self, raw: pa.Array, form: Form) -> pa.Array:
        raise NotImplementedError

    def constants(self) -> Iterator[str]:
        """Texts that may be shown without being in the bytes."""
        return iter(())


class Null(Node):
    type, empty = pa.null(), True

    def read(self, cur, rows):
        return pa.nulls(len(rows))

    def read_many(self, cur, rows, counts):
        return pa.nulls(int(counts.sum()))

    def text(self, raw, form):
        return pa.repeat(pa.scalar("null"), len(raw))

    def constants(self):
        yield "null"


class Boolean(Node):
    type = pa.bool_()

    def _values(self, cur, rows, raw):
        cur.spoil(rows, raw[:, 0] > 1)
        return pa.array(raw[:, 0] == 1)

    def read(self, cur, rows):
        return self._values(cur, rows, cur.fixed(rows, 1))

    def read_many(self, cur, rows, counts):
        return self._values(cur, np.repeat(rows, counts), cur.fixed(rows, 1, counts))

    def text(self, raw, form):
        return pc.if_else(raw, "true", "false")

    def constants(self):
        yield from ("true", "false")


# How logical types of numbers are typed; others stay numbers.
NUMBERS = {
    ("int", "date"): pa.date32(),
    ("long", "timestamp-millis"): pa.timestamp("ms", "UTC"),
    ("long", "timestamp-micros"): pa.timestamp("us", "UTC"),
    ("long", "local-timestamp-millis"): pa.timestamp("ms"),
    ("long", "local-timestamp-micros"): pa.timestamp("us"),
}


class Integer(Node):
    def __init__(self, kind: str, schema: dict):
        self.kind, self.logical = kind, schema.get("logicalType", "")
        self.show = _leaf(kind, schema)
        self.plain = isinstance(self.show(0), Bare)
        self.moment = NUMBERS.get((kind, self.logical))
        if self.moment is None:
            self.type = pa.int32() if kind == "int" else pa.int64()
        else:
            self.type = self.moment if kind == "int" else pa.timestamp("us", self.moment.tz)

    def _values(self, cur, rows, values):
        if self.kind == "int":
            cur.spoil(rows, (values < -(1 << 31)) | (values >= 1 << 31))
        elif self.moment is not None and self.moment.unit == "ms":  # Spark counts µs
            cur.spoil(rows, np.abs(values) > MOST_MS)
        return pa.array(values)

    def read(self, cur, rows):
        return self._values(cur, rows, cur.longs(rows))

    def read_many(self, cur, rows, counts):
        return self._values(cur, np.repeat(rows, counts), cur.many_longs(rows, counts))

    def typed(self, raw):
        if self.moment is None:
            return raw.cast(self.type, safe=False)
        width = raw.cast(pa.int32(), safe=False) if self.kind == "int" else raw
        return width.cast(self.moment).cast(self.type)

    def text(self, raw, form):
        return raw.cast(pa.string()) if self.plain else form.shown([None if v is None else self.show(v) for v in raw.to_pylist()])

    def constants(self):
        if not self.plain:
            yield from ("UTC", "ms", "µs")


class Real(Node):
    def __init__(self, single: bool):
        self.kind, self.type, self.show = ("<f4", pa.float32(), _number(True)) if single else ("<f8", pa.float64(), _number(False))
        self.size = int(self.kind[-1])

    def _values(self, raw):
        return pa.array(np.ascontiguousarray(raw).view(self.kind)[:, 0], self.type)

    def read(self, cur, rows):
        return self._values(cur.fixed(rows, self.size))

    def read_many(self, cur, rows, counts):
        return self._values(cur.fixed(rows, self.size, counts))

    def text(self, raw, form):
        return form.shown([None if v is None else self.show(v) for v in raw.to_pylist()])

    def constants(self):
        yield from ("NaN", "inf")


class Text(Node):
    type = pa.string()

    def __init__(self, schema: dict):
        self.uuid = schema.get("logicalType") == "uuid"

    def read(self, cur, rows):
        out = _utf8(cur, rows, cur.binary(rows))
        if self.uuid:
            texts, broken = [], np.zeros(len(rows), bool)
            for i, x in enumerate(out.to_pylist()):
                try:
                    texts.append(str(uuid.UUID(x)))
                except ValueError:
                    texts.append("")
                    broken[i] = True
            cur.spoil(rows, broken)
            return pa.array(texts, pa.string())
        return out

    def text(self, raw, form):
        return form.quote(raw)

    def constants(self):
        if self.uuid:  # shown in lower case, whatever the bytes are
            yield from ("abcdef"[i:j] for i in range(6) for j in range(i + 1, 7))


def _decimal_type(schema: dict) -> pa.DataType | None:
    precision, scale = schema.get("precision", 0), schema.get("scale", 0)
    return pa.decimal128(precision, scale) if 0 <= scale <= precision and 0 < precision <= MOST_DECIMAL else None


class Bytes(Node):
    """bytes, and fixed if a size is given."""

    def __init__(self, schema: dict, size: int | None = None):
        self.size, self.schema = size, schema
        kind, logical = "bytes" if size is None else "fixed", schema.get("logicalType", "")
        self.show = _leaf(kind, schema)
        self.logical = logical
        self.type = pa.binary()
        if logical == "decimal":
            self.type = _decimal_type(schema) or pa.string()
        elif (logical == "big-decimal" and size is None) or (logical == "uuid" and size == 16):
            self.type = pa.string()
        elif logical == "duration" and size == 12:
            self.type = pa.struct([("months", pa.int64()), ("days", pa.int64()), ("millis", pa.int64())])

    def _table(self, raw):
        data = np.ascontiguousarray(raw)
        offsets = np.arange(len(raw) + 1, dtype=np.int32) * self.size
        return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(data)])

    def _checked(self, cur, rows, raw):
        broken = np.zeros(len(rows), bool)
        limit = 10**self.type.precision if self.logical == "decimal" and pa.types.is_decimal(self.type) else None
        if limit is not None or (self.logical == "big-decimal" and self.size is None):
            for i, x in enumerate(raw.to_pylist()):
                try:
                    if limit is None:
                        _big_decimal(x)
                    else:
                        broken[i] = abs(int.from_bytes(x, "big", signed=True)) >= limit
                except ValueError:
                    broken[i] = True
            cur.spoil(rows, broken)
        return raw

    def read(self, cur, rows):
        return self._checked(cur, rows, cur.binary(rows) if self.size is None else self._table(cur.fixed(rows, self.size)))

    def read_many(self, cur, rows, counts):
        if self.size is None:
            return None
        return self._checked(cur, np.repeat(rows, counts), self._table(cur.fixed(rows, self.size, counts)))

    @property
    def empty(self):
        return self.size == 0

    def typed(self, raw):
        if self.type == pa.binary():
            return raw
        values = raw.to_pylist()
        if pa.types.is_struct(self.type):
            parts = [None if x is None else dict(zip(("months", "days", "millis"), np.frombuffer(x, "<u4").tolist())) for x in values]
            return pa.array(parts, self.type)
        if pa.types.is_decimal(self.type):
            least, scale = 10**self.type.precision, self.type.scale
            numbers = [None if x is None else int.from_bytes(x, "big", signed=True) for x in values]
            return pa.array([None if n is None or abs(n) >= least else Decimal(n).scaleb(-scale) for n in numbers], self.type)
        return pa.array([x and self._plain(x) for x in values], pa.string())

    def _plain(self, x):
        try:
            return str(self.show(x))
        except ValueError:  # of a broken record
            return None

    def text(self, raw, form):
        values = raw.to_pylist()
        try:
            return form.shown([None if v is None else self.show(v) for v in values])
        except ValueError:
            return form.shown([None if v is None else self._plain(v) for v in values])

    def constants(self):
        if self.logical == "duration":
            yield "Duration { months: Months(), days: Days(), millis: Millis() }"
        if self.logical == "uuid":
            yield from ("abcdef"[i:j] for i in range(6) for j in range(i + 1, 7))


class Enum(Node):
    type = pa.string()

    def __init__(self, symbols: list[str]):
        self.symbols = pa.array(symbols, pa.string())

    def _values(self, cur, rows, at):
        broken = (at < 0) | (at >= len(self.symbols))
        cur.spoil(rows, broken)
        return self.symbols.take(pa.array(np.where(broken, 0, at), mask=broken))

    def read(self, cur, rows):
        return self._values(cur, rows, cur.longs(rows))

    def read_many(self, cur, rows, counts):
        return self._values(cur, np.repeat(rows, counts), cur.many_longs(rows, counts))

    def text(self, raw, form):
        return form.quote(raw)

    def constants(self):
        yield from self.symbols.to_pylist()


class Record(Node):
    def __init__(self, fields: list[tuple[str, Node]], defaults: dict | None = None, aliases: dict | None = None):
        self.fields = fields
        self.defaults, self.aliases = defaults or {}, aliases or {}
        self.type = pa.struct([(name, n.type) for name, n in fields])
        self.empty = all(n.empty for _, n in fields)

    def read(self, cur, rows):
        columns = [n.read(cur, rows) for _, n in self.fields]
        if not columns:
            return pa.nulls(len(rows))
        return pa.StructArray.from_arrays(columns, [name for name, _ in self.fields])

    def typed(self, raw):
        if not self.fields:
            return pa.array([{}] * len(raw), self.type)
        columns = [n.typed(c) for (_, n), c in zip(self.fields, raw.flatten())]
        return pa.StructArray.from_arrays(columns, fields=list(self.type), mask=raw.is_null())

    def text(self, raw, form):
        if not self.fields:
            return pa.repeat(pa.scalar("{}"), len(raw))
        parts: list = []
        for i, ((name, n), c) in enumerate(zip(self.fields, raw.flatten())):
            parts += [pa.scalar(("{" if i == 0 else ",") + form.gap + form.name(name) + form.colon), n.text(c, form)]
        joined = pc.binary_join_element_wise(*parts, pa.scalar(form.gap + "}"), "")
        return pc.if_else(raw.is_valid(), joined, None)

    def constants(self):
        for name, n in self.fields:
            yield name
            yield from n.constants()


class Items(Node):
    """Arrays, and maps if the keys have a node."""

    def __init__(self, entry: Node, key: Node | None = None):
        self.entry, self.key = entry, key
        self.type = pa.list_(entry.type) if key is None else pa.map_(pa.string(), entry.type)

    def read(self, cur, rows):
        left, open_ = np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
        chunks, keys, owners = [], [], []
        while True:
            ask = np.flatnonzero(open_ & (left == 0) & ~cur.bad[rows])
            if len(ask):
                count = cur.longs(rows[ask])
                sized = np.flatnonzero(count < 0)
                cur.longs(rows[ask[sized]])
                count = np.abs(count)
                open_[ask[count == 0]] = False
                # Every item takes a byte at least, or is bounded on its own.
                room = np.full(len(ask), cur.most_empty) if self.key is None and self.entry.empty else cur.end[rows[ask]] - cur.pos[rows[ask]]
                cur.spoil(rows[ask], (count < 0) | (count > room))
                left[ask] = count
            act = np.flatnonzero((left > 0) & ~cur.bad[rows])
            if not len(act):
                if (open_ & ~cur.bad[rows]).any():
                    continue
                break
            whole = self.entry.read_many(cur, rows[act], left[act]) if self.key is None else None
            if whole is not None:
                owners.append(np.repeat(act, left[act]))
                left[act] = 0
            else:
                if self.key is not None:
                    keys.append(self.key.read(cur, rows[act]))
                whole = self.entry.read(cur, rows[act])
                owners.append(act)
                left[act] -= 1
            chunks.append(whole)
        if not chunks:
            none = np.zeros(0, np.int64)
            chunks, owners = [self.entry.read(cur, none)], [none]
            keys = [self.key.read(cur, none)] if self.key else []
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        values, owner = pa.concat_arrays(chunks).take(pa.array(order)), owner[order]
        if self.key is not None:
            names = pa.concat_arrays(keys).take(pa.array(order))
            names, values, owner = self._last_of_each(names, values, owner)
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(rows)))]).astype(np.int32))
        if self.key is None:
            return pa.ListArray.from_arrays(offsets, values)
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([names, values], ["key", "value"]))

    @staticmethod
    def _last_of_each(names, values, owner):
        """A key that a map has again stays in its place and gets the later value."""
        code = names.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pair = owner << 32 | code
        kinds, first, of = np.unique(pair, return_index=True, return_inverse=True)
        if len(kinds) == len(pair):
            return names, values, owner
        last = np.zeros(len(kinds), np.int64)
        np.maximum.at(last, of, np.arange(len(pair)))
        order = np.argsort(first)
        return names.take(pa.array(first[order])), values.take(pa.array(last[order])), owner[first[order]]

    def typed(self, raw):
        offsets, inner = pa.array(raw.offsets.to_numpy()), raw.values
        if self.key is None:
            return pa.ListArray.from_arrays(offsets, self.entry.typed(inner), type=self.type, mask=raw.is_null())
        names, values = inner.flatten()
        whole = pa.MapArray.from_arrays(offsets, names, self.entry.typed(values), type=self.type)
        return pc.if_else(raw.is_valid(), whole, pa.scalar(None, self.type)) if raw.null_count else whole

    def text(self, raw, form):
        inner = raw.values
        if self.key is None:
            own, (left, right) = self.entry.text(inner, form), "[]"
        else:
            names, values = inner.flatten()
            own, (left, right) = pc.binary_join_element_wise(form.quote(names), self.entry.text(values, form), form.colon), "{}"
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(raw.offsets.to_numpy()), own), "," + form.gap)
        full = pc.binary_join_element_wise(pa.scalar(left + form.gap), joined, pa.scalar(form.gap + right), "")
        sizes = np.diff(raw.offsets.to_numpy())
        return pc.if_else(raw.is_valid(), pc.if_else(pa.array(sizes == 0), left + right, full), None)

    def constants(self):
        return self.entry.constants()


class Union(Node):
    """Read as a struct of the branch and a column for each, null where another one was taken."""

    def __init__(self, branches: list[Node]):
        self.branches = branches
        self.some = [i for i, n in enumerate(branches) if not isinstance(n, Null)]
        kinds = [branches[i].type for i in self.some]
        self.wide = next((w for s, w in (({pa.int32(), pa.int64()}, pa.int64()), ({pa.float32(), pa.float64()}, pa.float64())) if set(kinds) == s), None)
        if not kinds:
            self.type = pa.null()
        elif len(kinds) == 1:
            self.type = kinds[0]
        else:
            self.type = self.wide or pa.struct([(f"member{i}", t) for i, t in enumerate(kinds)])

    def read(self, cur, rows):
        branch = cur.longs(rows)
        cur.spoil(rows, (branch < 0) | (branch >= len(self.branches)))
        columns = [pa.array(branch)]
        for i, n in enumerate(self.branches):
            own = np.flatnonzero((branch == i) & ~cur.bad[rows])
            place = np.zeros(len(rows), np.int64)
            place[own] = np.arange(len(own))
            absent = np.ones(len(rows), bool)
            absent[own] = False
            columns.append(n.read(cur, rows[own]).take(pa.array(place, mask=absent)))
        return pa.StructArray.from_arrays(columns, ["branch", *(f"m{i}" for i in range(len(self.branches)))])

    def typed(self, raw):
        parts = raw.flatten()
        own = [self.branches[i].typed(parts[1 + i]) for i in self.some]
        if not own:
            return pa.nulls(len(raw))
        if len(own) == 1:
            return own[0]
        if self.wide is not None:
            return pc.coalesce(*(c.cast(self.wide) for c in own))
        taken = pc.is_in(parts[0], pa.array(self.some, pa.int64()))
        return pa.StructArray.from_arrays(own, fields=list(self.type), mask=pc.invert(pc.fill_null(taken, False)))

    def text(self, raw, form):
        parts = raw.flatten()
        out = pc.if_else(raw.is_valid(), "null", None)
        for i in self.some:
            out = pc.if_else(pc.fill_null(pc.equal(parts[0], i), False), self.branches[i].text(parts[1 + i], form), out)
        return out

    def constants(self):
        for n in self.branches:
            yield from n.constants()


class Recursive(ValueError):
    """A type that holds itself has no finite column."""


def compiled(definition: str) -> Node:
    """The node of a schema definition; Recursive if it holds itself."""
    return _compile(json.loads(definition), {}, "")


def _compile(schema, names: dict, space: str) -> Node:
    if isinstance(schema, list):
        return Union([_compile(s, names, space) for s in schema])
    if isinstance(schema, str):
        if schema not in PRIMITIVES:
            full = schema if "." in schema or not space else f"{space}.{schema}"
            known = full if full in names else schema
            if known not in names:
                raise ValueError(f"schema does not define {schema}")
            if names[known] is None:
                raise Recursive(f"{schema} holds itself")
            return names[known]
        schema = {"type": schema}
    kind = schema["type"]
    if not isinstance(kind, str):
        return _compile(kind, names, space)
    name = None
    if kind in ("record", "error", "enum", "fixed"):
        name = schema["name"]
        if "." in name:
            space = name.rpartition(".")[0]
        else:
            space = schema.get("namespace", space)
            name = f"{space}.{name}" if space else name
        names[name] = None
    node = _node(kind, schema, names, space)
    if name is not None:
        names[name] = node
    return node


def _node(kind: str, schema: dict, names: dict, space: str) -> Node:
    if kind in ("record", "error"):
        fields = schema["fields"]
        defaults = {f["name"]: f["default"] for f in fields if "default" in f}
        aliases = {f["name"]: f.get("aliases", []) for f in fields}
        return Record([(f["name"], _compile(f["type"], names, space)) for f in fields], defaults, aliases)
    if kind == "enum":
        return Enum(schema["symbols"])
    if kind == "fixed":
        return Bytes(schema, schema["size"])
    if kind == "array":
        return Items(_compile(schema["items"], names, space))
    if kind == "map":
        return Items(_compile(schema["values"], names, space), Text({}))
    if kind == "null":
        return Null()
    if kind == "boolean":
        return Boolean()
    if kind in ("int", "long"):
        return Integer(kind, schema)
    if kind in ("float", "double"):
        return Real(kind == "float")
    if kind == "bytes":
        return Bytes(schema)
    if kind == "string":
        return Text(schema)
    raise ValueError(f"schema has the unknown type {kind}")


def read(node: Node, bodies: list[bytes], most_empty: int = MOST_EMPTY) -> tuple[pa.Array, np.ndarray]:
    """Raw values of the bodies, and a mask of those that are broken. Trailing bytes are ignored."""
    cur = Cursor(bodies, most_empty)
    return node.read(cur, np.arange(len(bodies))), cur.bad


# ---- from a writer's types to those a reader wants


def _default(node: Node, value):
    """A default of a schema as a value of the node's type."""
    if isinstance(node, Union):
        return None if value is None else _default(node.branches[0], value)
    if isinstance(node, Record):
        return {name: _default(n, value.get(name, node.defaults.get(name))) for name, n in node.fields}
    if isinstance(node, Bytes):
        raw = value.encode("latin-1")
        return node.typed(pa.array([raw], pa.binary()))[0].as_py()
    if isinstance(node, Integer):
        return node.typed(pa.array([value], pa.int64()))[0].as_py()
    if isinstance(node, Items) and node.key is not None:
        return [(k, _default(node.entry, v)) for k, v in value.items()]
    if isinstance(node, Items):
        return [_default(node.entry, v) for v in value]
    return value


def conform(node: Node, values: pa.Array) -> pa.Array:
    """Typed values of a writer as those of a reader's node: fields by name or alias, defaults for absent ones, wider numbers."""
    if values.type == node.type:
        return values
    inner = node
    while isinstance(inner, Union) and len(inner.some) == 1:
        inner = inner.branches[inner.some[0]]
    if isinstance(inner, Record) and pa.types.is_struct(values.type):
        own = dict(zip((f.name for f in values.type), values.flatten()))
        columns = []
        for name, n in inner.fields:
            found = next((a for a in (name, *inner.aliases.get(name, [])) if a in own), None)
            if found is not None:
                columns.append(conform(n, own[found]))
            elif name in inner.defaults:
                columns.append(pa.array([_default(n, inner.defaults[name])] * len(values), n.type))
            else:
                raise ValueError(f"the record has no field {name}, which has no default")
        return pa.StructArray.from_arrays(columns, fields=list(inner.type), mask=values.is_null())
    if isinstance(inner, Items) and inner.key is None and pa.types.is_list(values.type):
        own = pa.array(values.offsets.to_numpy())
        return pa.ListArray.from_arrays(own, conform(inner.entry, values.values), type=inner.type, mask=values.is_null())
    if isinstance(inner, Items) and inner.key is not None and pa.types.is_map(values.type):
        whole = pa.MapArray.from_arrays(pa.array(values.offsets.to_numpy()), values.keys, conform(inner.entry, values.items), type=inner.type)
        return pc.if_else(values.is_valid(), whole, pa.scalar(None, inner.type)) if values.null_count else whole
    if pa.types.is_nested(values.type) or pa.types.is_nested(inner.type):
        raise ValueError(f"{values.type} can't be read as {inner.type}")
    return values.cast(inner.type)


def spark_type(kind: pa.DataType) -> str:
    """The DDL of a typed column."""
    if pa.types.is_struct(kind):
        return "struct<" + ", ".join(f"`{f.name}`: {spark_type(f.type)}" for f in kind) + ">"
    if pa.types.is_map(kind):
        return f"map<string, {spark_type(kind.item_type)}>"
    if pa.types.is_list(kind):
        return f"array<{spark_type(kind.value_type)}>"
    if pa.types.is_decimal(kind):
        return f"decimal({kind.precision},{kind.scale})"
    if pa.types.is_timestamp(kind):
        return "timestamp" if kind.tz else "timestamp_ntz"
    names = {
        pa.null(): "void", pa.bool_(): "boolean", pa.int32(): "int", pa.int64(): "bigint", pa.float32(): "float",
        pa.float64(): "double", pa.string(): "string", pa.binary(): "binary", pa.date32(): "date",
    }
    return names[kind]
