"""Framed Avro inside Arrow batches: bodies are inflated, sorted by schema and read column by column."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from loglens.functions.avro import MOST_EMPTY, avro_reader, json_avro, render_avro
from loglens.functions.avro_columns import Form, Node, Recursive, compiled, conform, read, spark_type

# Executors need no installed copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A longer body is rendered alone, as it may hold one very long array.
LARGE = 1 << 18
#: Of a body: as it is, compressed, compressed and only of interest if it holds the needle of its schema.
PLAIN, ZIPPED, SEARCHED = 0, 1, 2


class Schemas:
    """Nodes and readers of definitions, built once per worker."""

    def __init__(self, known: dict[tuple[str, str], str], most_empty: int):
        self.known, self.most_empty = known, most_empty
        self.nodes: dict = {}
        self.readers: dict = {}

    def text(self, where: tuple[str, str], definition: str | None) -> str:
        text = self.known.get(where) if definition is None else definition
        if text is None:
            raise ValueError(f"there is no schema {where[1]} of registry {where[0]}")
        return text

    def node(self, definition: str) -> Node | None:
        if definition not in self.nodes:
            try:
                self.nodes[definition] = compiled(definition)
            except Recursive:
                self.nodes[definition] = None
        return self.nodes[definition]

    def value(self, definition: str, body: bytes):
        if definition not in self.readers:
            self.readers[definition] = avro_reader(definition, self.most_empty)
        return self.readers[definition](body)


def _failure(where: tuple[str, str], error: Exception | str) -> str:
    return f"Cannot decode the Avro payload with schema {where[1]} of {where[0]}: {error}"


class Batch:
    """Bodies of a batch by schema; errors of rows."""

    def __init__(self, schemas: Schemas, columns: tuple[pa.Array, ...], failfast: bool, wanted: Callable[[tuple[str, str]], bytes | None]):
        self.schemas, self.failfast = schemas, failfast
        registries, ids, zips, bodies, definitions = columns
        self.size = len(registries)
        self.errors: dict[int, str] = {}
        self.groups: dict[str, tuple[list[int], list[bytes]]] = {}
        self.where: dict[int, tuple[str, str]] = {}
        rows = np.flatnonzero(registries.is_valid().to_numpy(zero_copy_only=False))
        at = pa.array(rows)
        own = (c.take(at).to_pylist() for c in (registries, ids, zips, bodies, definitions))
        for i, reg, sid, zipped, body, text in zip(rows.tolist(), *own):
            self.where[i] = (reg, sid)
            try:
                definition = schemas.text((reg, sid), text)
                if zipped != PLAIN:
                    body = zlib.decompressobj().decompress(body)
                    needle = wanted((reg, sid)) if zipped == SEARCHED else None
                    if needle is not None and needle not in body:
                        continue
                group = self.groups.setdefault(definition, ([], []))
                group[0].append(i)
                group[1].append(body)
            except Exception as e:  # whatever a broken frame brings about
                self.fail(i, e)

    def fail(self, i: int, error: Exception | str) -> None:
        if self.failfast:
            raise ValueError(_failure(self.where[i], error)) from (error if isinstance(error, Exception) else None)
        self.errors[i] = f"{type(error).__name__}: {error}" if isinstance(error, Exception) else error

    def error_column(self) -> pa.Array:
        if not self.errors:
            return pa.nulls(self.size, pa.string())
        return pa.array([self.errors.get(i) for i in range(self.size)], pa.string())

    def placed(self, parts: list[tuple[list[int], pa.Array]], kind: pa.DataType) -> pa.Array:
        """Values of rows as a column of the batch."""
        if not parts:
            return pa.nulls(self.size, kind)
        rows = np.concatenate([np.array(r, np.int64) for r, _ in parts])
        place, absent = np.zeros(self.size, np.int64), np.ones(self.size, bool)
        place[rows] = np.arange(len(rows))
        absent[rows] = False
        return pa.concat_arrays([a for _, a in parts]).take(pa.array(place, mask=absent))


def _texts(batch: Batch, forms: list[Form]) -> list[pa.Array]:
    """A column of text for each form."""
    parts: list[list] = [[] for _ in forms]

    def one_by_one(definition: str, rows: list[int], bodies: list[bytes]) -> None:
        done, texts = [], []
        for i, body in zip(rows, bodies):
            try:
                value = batch.schemas.value(definition, body)
                texts.append([json_avro(value) if f.as_json else render_avro(value, f.gap == " ") for f in forms])
                done.append(i)
            except Exception as e:  # whatever a broken schema or datum brings about
                batch.fail(i, e)
        for k, own in enumerate(parts):
            own.append((done, pa.array([t[k] for t in texts], pa.string())))

    for definition, (rows, bodies) in batch.groups.items():
        try:
            node = batch.schemas.node(definition)
        except Exception as e:  # whatever a broken schema brings about
            for i in rows:
                batch.fail(i, e)
            continue
        small = [k for k, b in enumerate(bodies) if len(b) <= LARGE] if node is not None else []
        apart = sorted(set(range(len(rows))) - set(small))
        if small:
            own = [bodies[k] for k in small]
            try:
                raw, bad = read(node, own, batch.schemas.most_empty)
                good = np.flatnonzero(~bad)
                raw = raw if len(good) == len(own) else raw.take(pa.array(good))
                shown = [node.text(raw, f) for f in forms]
            except (ValueError, OverflowError, ArithmeticError, pa.ArrowException):  # a value that can't be shown, in some row
                bad, good, shown = np.ones(len(own), bool), [], []
            for part, text in zip(parts, shown):
                part.append(([rows[small[k]] for k in good], text))
            apart = sorted([*apart, *(small[k] for k in np.flatnonzero(bad))])
        if apart:
            one_by_one(definition, [rows[k] for k in apart], [bodies[k] for k in apart])
    return [batch.placed(p, pa.string()) for p in parts]


def _typed(batch: Batch, target: Node) -> pa.Array:
    parts = []
    for definition, (rows, bodies) in batch.groups.items():
        try:
            node = batch.schemas.node(definition)
            if node is None:
                raise ValueError("the schema holds itself, so it has no columns")
            raw, bad = read(node, bodies, batch.schemas.most_empty)
            good = np.flatnonzero(~bad)
            values = conform(target, node.typed(raw if len(good) == len(rows) else raw.take(pa.array(good))))
        except Exception as e:  # of a schema that can't be read as the wanted one
            for i in rows:
                batch.fail(i, e)
            continue
        parts.append(([rows[k] for k in good], values))
        for k in np.flatnonzero(bad):
            try:
                batch.schemas.value(definition, bodies[k])
                batch.fail(rows[k], "a value is out of the range of its type")
            except Exception as e:  # says what is wrong, or is the failure above
                if str(e).startswith("Cannot decode"):
                    raise
                batch.fail(rows[k], e)
    return batch.placed(parts, target.type)


def _columns(registry, schema_id, compressed, body, definition) -> tuple[Column, ...]:
    return registry, schema_id, compressed, body, F.lit(None).cast("string") if definition is None else definition


def decode_frame(
    registry: Column,
    schema_id: Column,
    compressed: Column,
    body: Column,
    definition: Column | None,
    schemas: dict[tuple[str, str], str],
    indent: bool = False,
    failfast: bool = True,
    with_json: bool = False,
    most_empty: int = MOST_EMPTY,
    needles: dict[tuple[str, str], bytes] | None = None,
) -> Column:
    """struct<text, json, error> of framed Avro; null where ``registry`` is null.

    ``compressed`` is PLAIN, ZIPPED or SEARCHED; a searched body without the needle of its schema stays null. The
    definition comes from the column, if given, else from ``schemas``.
    """
    forms = [Form(indent)] + [Form(as_json=True)] * with_json
    wanted = (needles or {}).get
    built = Schemas(schemas, most_empty)

    @F.arrow_udf("struct<text: string, json: string, error: string>")
    def decode(registries: pa.Array, ids: pa.Array, zips: pa.Array, bodies: pa.Array, definitions: pa.Array) -> pa.Array:
        batch = Batch(built, (registries, ids, zips, bodies, definitions), failfast, wanted)
        texts = _texts(batch, forms)
        columns = [texts[0], texts[1] if with_json else pa.nulls(len(registries), pa.string()), batch.error_column()]
        return pa.StructArray.from_arrays(columns, ["text", "json", "error"], mask=registries.is_null())

    return decode(*_columns(registry, schema_id, compressed, body, definition))


def decode_typed(
    registry: Column,
    schema_id: Column,
    compressed: Column,
    body: Column,
    definition: Column | None,
    schemas: dict[tuple[str, str], str],
    reader: str,
    failfast: bool = True,
    most_empty: int = MOST_EMPTY,
) -> Column:
    """struct<value, error> of framed Avro, with the types of the reader's definition; null where ``registry`` is null."""
    target = compiled(reader)
    built = Schemas(schemas, most_empty)

    @F.arrow_udf(f"struct<value: {spark_type(target.type)}, error: string>")
    def decode(registries: pa.Array, ids: pa.Array, zips: pa.Array, bodies: pa.Array, definitions: pa.Array) -> pa.Array:
        batch = Batch(built, (registries, ids, zips, bodies, definitions), failfast, lambda where: None)
        columns = [_typed(batch, target), batch.error_column()]
        return pa.StructArray.from_arrays(columns, ["value", "error"], mask=registries.is_null())

    return decode(*_columns(registry, schema_id, compressed, body, definition))
