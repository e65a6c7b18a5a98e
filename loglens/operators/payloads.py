"""Keys and values read, decoded, rendered and searched."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from loglens.functions.avro import MOST_EMPTY
from loglens.functions.avro_columns import Null, Recursive, compiled
from loglens.functions.frames import PLAIN, SEARCHED, ZIPPED, decode_frame, decode_typed
from loglens.functions.numbers import own_numbers
from loglens.functions.payload import AVRO, JSON, frame, is_framed, kind_of, with_json_text
from loglens.functions.render import show_json
from loglens.functions.text import mentions, utf8_lossy
from loglens.plans.sizing import BROADCAST_BYTES, join_side, unique
from loglens.plans.staging import with_computed
from loglens.sources.log import as_schemas

SCHEMA_ROWS = 10_000
UNFRAMED_PARTS = 1000
FAILFAST, PERMISSIVE = "failfast", "permissive"


def required_schemas(log: DataFrame, columns: tuple[str, ...] = ("key", "value")) -> DataFrame:
    """registry, schema_id, records: which schemas to export before decoding."""
    head = F.explode(F.array(*[frame(c) for c in columns])).alias("head")
    ids = log.where(_any_framed(columns)).select(head).where(F.col("head").isNotNull())
    return ids.groupBy("head.registry", "head.schema_id").agg(F.count(F.lit(1)).alias("records"))


def _any_framed(columns: tuple[str, ...]) -> Column:
    test = is_framed(columns[0])
    for c in columns[1:]:
        test = test | is_framed(c)
    return test


def _definitions(schemas: DataFrame) -> DataFrame:
    """One definition per registry and id."""
    return unique(as_schemas(schemas).where(F.col("definition").isNotNull()), ["registry", "schema_id"], "definition")


def _few_definitions(schemas: DataFrame, most: int = SCHEMA_ROWS, most_bytes: int = BROADCAST_BYTES) -> list[Row] | None:
    """All definitions, or None if they are too many or too large; looked up before any is fetched."""
    size = schemas.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("definition")), F.lit(0)).alias("bytes")).first()
    return schemas.collect() if size["rows"] <= most and size["bytes"] <= most_bytes else None


def join_schemas(heads: DataFrame, schemas: DataFrame) -> DataFrame:
    """Left join of (registry, schema_id) with their definitions; null without a schema.

    The schemas are broadcast only if their number and size are small. Definitions that contradict each other fail
    the job.
    """
    schemas = _definitions(schemas)
    return heads.join(join_side(schemas, _few_definitions(schemas)), ["registry", "schema_id"], "left")


class Registry:
    """The definitions that the framed payloads of some columns need, looked up once for all of them.

    A small registry, or a small part of it that the log uses, travels to the tasks once; else definitions are joined
    to the records. A schema that is listed twice counts once, and must not contradict itself.
    """

    def __init__(self, log: DataFrame, schemas: DataFrame, columns: tuple[str, ...], most: int | None = None):
        most = SCHEMA_ROWS if most is None else most
        self.table = _definitions(schemas)
        rows = _few_definitions(self.table, most)
        if rows is None:  # of a large registry, only what the log uses
            used = required_schemas(log, columns).select("registry", "schema_id").distinct()
            self.table = self.table.join(used, ["registry", "schema_id"], "left_semi")
            rows = _few_definitions(self.table, most)
        self.small = rows is not None
        self.known = {(r["registry"], r["schema_id"]): r["definition"] for r in rows} if self.small else {}

    def with_heads(self, log: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        """Adds _head_{column}, and _definition_{column} where definitions are joined."""
        for c in columns:
            head = f"_head_{c}"
            log = log.withColumn(head, frame(c))
            if not self.small:
                # Unframed records have no partner; a key of their own spreads them.
                nowhere = F.concat(F.lit("-"), F.pmod(F.col("offset"), F.lit(UNFRAMED_PARTS)).cast("string"))
                own = log.withColumn("registry", F.coalesce(F.col(head)["registry"], nowhere))
                own = own.withColumn("schema_id", F.coalesce(F.col(head)["schema_id"], F.lit("")))
                named = self.table.withColumnRenamed("definition", f"_definition_{c}")
                log = own.join(named, ["registry", "schema_id"], "left").drop("registry", "schema_id")
        return log

    def arguments(self, column: str, searched: Column | None = None) -> tuple:
        """What the decoding functions take. searched: where a compressed body is of interest only with its needle."""
        head = F.col(f"_head_{column}")
        definition = None if self.small else F.col(f"_definition_{column}")
        zipped = F.lit(ZIPPED) if searched is None else F.when(searched, SEARCHED).otherwise(ZIPPED)
        compressed = F.when(head["zlib"], zipped).otherwise(PLAIN)
        return head["registry"], head["schema_id"], compressed, head["body"], definition, self.known


def _checked(mode: str) -> bool:
    if mode not in (FAILFAST, PERMISSIVE):
        raise ValueError(f"mode must be {FAILFAST} or {PERMISSIVE}")
    return mode == FAILFAST


def decode_avro(
    log: DataFrame,
    schemas: DataFrame,
    column: str = "value",
    indent: bool = False,
    mode: str = FAILFAST,
    with_json: bool = False,
    schema_rows: int | None = None,
    most_empty: int = MOST_EMPTY,
) -> DataFrame:
    """Adds ``{column}_avro``: struct<text, json, error> of framed Avro, else null.

    ``failfast`` fails on a missing schema or broken data, ``permissive`` reports it in ``error``. A block of more
    than ``most_empty`` array items that take no bytes counts as broken.
    """
    failfast = _checked(mode)
    registry = Registry(log, schemas, (column,), schema_rows)
    framed = registry.with_heads(log, (column,))
    decoded = decode_frame(*registry.arguments(column), indent, failfast, with_json, most_empty)
    framed = with_computed(framed.withColumn("_decoded", decoded), **{f"{column}_avro": F.col("_decoded")})
    return framed.select(*log.columns, f"{column}_avro")


def decode_avro_typed(
    log: DataFrame,
    schemas: DataFrame,
    reader: str,
    column: str = "value",
    mode: str = FAILFAST,
    schema_rows: int | None = None,
    most_empty: int = MOST_EMPTY,
) -> DataFrame:
    """Adds ``{column}_typed``: struct<value, error>, with framed Avro as columns of the ``reader`` definition's types.

    Records, arrays and maps become structs, arrays and maps; a union with null becomes nullable, int with long and
    float with double the wider one, any other a struct of member0, member1 and so on. Dates, timestamps in ms and µs
    (local ones without zone), decimals up to 38 digits and durations are typed; times of day and timestamps in ns stay
    numbers, UUIDs and big decimals are text. Records written with another schema are resolved: fields by name or
    alias, absent ones by the reader's default, numbers to wider ones. ``failfast`` fails on what can't be decoded,
    ``permissive`` leaves ``value`` null and says why in ``error``. Both are null for what isn't framed.
    """
    failfast = _checked(mode)
    registry = Registry(log, schemas, (column,), schema_rows)
    framed = registry.with_heads(log, (column,))
    decoded = decode_typed(*registry.arguments(column), reader, failfast, most_empty)
    framed = with_computed(framed.withColumn("_decoded", decoded), **{f"{column}_typed": F.col("_decoded")})
    return framed.select(*log.columns, f"{column}_typed")


class Search:
    """A text that is looked for: what bodies of each schema must hold for it, and whether payloads may show it."""

    def __init__(self, registry: Registry | None, needle: str, columns: tuple[str, ...]):
        self.needles = avro_needles(registry.known, needle) if registry is not None else {}
        self.may = {c: may_show(c, needle, self.needles) for c in columns}

    def anywhere(self) -> Column:
        return reduce(or_, self.may.values())

    def only_in(self, column: str) -> Column:
        """Whether no other payload of the record may show it."""
        return ~reduce(or_, (m for c, m in self.may.items() if c != column), F.lit(False))


def _decoded(registry: Registry, columns: tuple[str, ...], indent: bool, failfast: bool, search: Search | None) -> dict[str, Column]:
    """_decoded_{column} of a log with heads."""
    decoded = {}
    for c in columns:
        arguments = registry.arguments(c, None if search is None else search.only_in(c))
        decoded[f"_decoded_{c}"] = decode_frame(*arguments, indent, failfast, needles=search and search.needles)
    return decoded


def with_payloads(
    log: DataFrame,
    schemas: DataFrame | None = None,
    columns: tuple[str, ...] = ("key", "value"),
    indent: bool = False,
    mode: str = FAILFAST,
) -> DataFrame:
    """Adds ``{column}_kind`` and ``{column}_text`` (rendered) for keys and values.

    Bound and filter the log first. Framed Avro needs ``schemas``; without them
    ``failfast`` fails on the first such payload and ``permissive`` leaves its
    text null.
    """
    registry = None if schemas is None else Registry(log, schemas, columns)
    return _rendered(log, registry, columns, indent, mode)


def _rendered(log: DataFrame, registry: Registry | None, columns: tuple[str, ...], indent: bool, mode: str, search: Search | None = None) -> DataFrame:
    """With a search, bodies that rule a record out have no text."""
    kept = log.columns
    for c in columns:
        log = with_json_text(log, F.col(c), f"_{c}_json")
    # Framed payloads and numbers that need it go through Python together: one worker for a task, not one for each.
    python = {f"_numbers_{c}": own_numbers(F.col(c).cast("string"), F.col(f"_{c}_json")) for c in columns}
    read = {f"_shown_{c}": F.coalesce(F.col(f"_numbers_{c}"), F.col(f"_{c}_json")) for c in columns}
    if registry is not None:
        log = registry.with_heads(log, columns)
        python |= _decoded(registry, columns, indent, _checked(mode), search)
        read |= {f"_avro_{c}": F.col(f"_decoded_{c}") for c in columns}
    log = with_computed(log.withColumns(python), **read)
    for c in columns:
        if registry is not None:
            avro = F.col(f"_avro_{c}")["text"]
        elif mode == FAILFAST:
            avro = F.raise_error(F.lit("Received an Avro encoded record, but no schemas were given.")).cast("string")
        else:
            avro = F.lit(None).cast("string")
        is_json = F.col(f"_{c}_json").isNotNull()
        text = (
            F.when(F.col(c).isNull(), "null")
            .when(is_json, show_json(F.col(f"_shown_{c}"), indent))
            .when(is_framed(c), avro)
            .otherwise(utf8_lossy(c))
        )
        log = log.withColumns({f"{c}_kind": kind_of(c, is_json), f"{c}_text": text})
    added = [f"{c}_{part}" for c in columns for part in ("kind", "text")]
    return log.select(*kept, *added)


# A number token of JSON that may be shown with other digits than written.
REWRITTEN_NUMBER = r"(?:^|[:\[,\s])-?[0-9]+[.eE]|[0-9]{19}"
LONG_INTEGER = 19


def _runs(needle: str) -> list[str]:
    """Letters next to each other in a text, longest first."""
    return sorted(re.findall(r"[A-Za-z]{2,}", needle), key=len, reverse=True)


def avro_needles(known: dict[tuple[str, str], str], needle: str) -> dict[tuple[str, str], bytes]:
    """For schemas, letters that the bytes of a body must hold if its rendered text holds the needle.

    Letters next to each other in rendered text are one piece of a string or map key, which lies in the bytes as it is, or
    of what the schema or the rendering adds: names, symbols and signs of logical types. So the longest letters of the needle
    that aren't part of these must be in the bytes. Schemas without such letters have no entry.
    """
    by_text: dict[str, bytes | None] = {}
    out = {}
    for where, definition in known.items():
        if definition not in by_text:
            try:
                constants = list(compiled(definition).constants()) + list(Null().constants())
            except Recursive:
                constants = [definition, "null", "true", "false", "NaN", "inf", "UTC", "ms", "Months", "Days", "Millis", "Duration", "months"]
            except Exception:  # a broken definition fails where it is used
                constants = None
            own = [] if constants is None else [r for r in _runs(needle) if not any(r in c for c in constants)]
            by_text[definition] = own[0].encode() if own and not (set(own[0]) <= set("abcdef")) else None
        if by_text[definition] is not None:
            out[where] = by_text[definition]
    return out


def _framed_may_show(column: str, needles: dict[tuple[str, str], bytes]) -> Column:
    """False only for framed payloads, not compressed, whose bytes lack what their schema makes necessary."""
    head = frame(column)
    lacks = F.lit(False)
    for letters in sorted(set(needles.values())):
        own = [f"{r} {s}" for (r, s), n in needles.items() if n == letters]
        named = F.concat_ws(" ", head["registry"], head["schema_id"]).isin(own)
        lacks = lacks | (named & ~F.contains(F.col(column), F.lit(letters)))
    return F.coalesce(~(lacks & ~head["zlib"]), F.lit(True))


def may_show(column: str, needle: str, needles: dict[tuple[str, str], bytes] | None = None) -> Column:
    """False only if a payload cannot contain ``needle``, raw or rendered; needs no parsing.

    Letters and digits next to each other in rendered text come from the same place of the raw text, unless that has
    escapes or numbers that are shown differently. Framed payloads always may, but for those that ``needles`` rule out.
    """
    text = F.col(column).cast("string")
    letters = max(re.findall(r"[A-Za-z]{2,}", needle), key=len, default="")
    digits = max(re.findall(r"[0-9]+", needle), key=len, default="")
    if not letters and not digits:
        return F.lit(True)
    raw = mentions(text, letters if len(letters) >= len(digits) else digits) | mentions(text, "\\")
    if len(letters) < len(digits):
        marks = mentions(text, ".") | mentions(text, "e") | mentions(text, "E")
        marks = marks | (F.octet_length(F.col(column)) >= LONG_INTEGER)
        raw = raw | (marks & F.coalesce(text.rlike(REWRITTEN_NUMBER), F.lit(False)))
    absent = F.col(column).isNull() if needle in "null" else F.lit(False)
    return F.when(is_framed(column), _framed_may_show(column, needles) if needles else F.lit(True)).otherwise(raw | absent)


def text_filter(
    log: DataFrame,
    needle: str,
    schemas: DataFrame | None = None,
    columns: tuple[str, ...] = ("key", "value"),
    indent: bool = False,
    mode: str = FAILFAST,
) -> DataFrame:
    """Records with a text in the raw or the rendered key or value.

    The result carries the rendered payloads of ``with_payloads``; a log that already has them is not rendered again. A
    framed payload is decoded only if its bytes hold letters of the text that its schema doesn't explain; of a record
    that is found by its other payload, both are shown.
    """
    if not all(f"{c}_{part}" in log.columns for c in columns for part in ("kind", "text")):
        registry = None if schemas is None else Registry(log, schemas, columns)
        search = Search(registry, needle, columns)
        log = _rendered(log.where(search.anywhere()), registry, columns, indent, mode, search)
    found = F.lit(False)
    for c in columns:
        # any other kind is shown exactly as its raw text
        differs = F.col(f"{c}_kind").isin(JSON, AVRO)
        found = found | mentions(F.col(f"{c}_text"), needle) | (differs & mentions(utf8_lossy(c), needle))
    return log.where(found)
