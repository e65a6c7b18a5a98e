"""What the bytes of a key or value are: framing headers, JSON, text.

Everything here is a native expression. Headers are recognised by comparing
byte slices, so classifying a record never builds hex strings; ids are spelled
out only where they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.functions.text import col, is_text, once
from loglens.plans.staging import with_computed

# Fixed values of the two wire formats.
CONFLUENT, CONFLUENT_HEADER = "confluent", 5
GLUE, GLUE_HEADER = "glue", 18

# Names of the payload kinds.
NULL, STRING, JSON, AVRO, UNKNOWN = "null", "string", "json", "avro", "unknown"

# Depth of arrays and objects from which a JSON text counts as plain text.
JSON_DEPTH = 128  # fixed value: text that is nested this deep counts as text, not as JSON
# Fewer digits than this are in the range of a double.
DOUBLE_DIGITS = 309
# Closes the wrapper around a JSON text, see ``parse_json_payload``.
JSON_END = "5f0c8d3e-7a41-49b2-9c67-e2d1b80f4a95-end-of-payload"


def _bytes(hex_text: str) -> Column:
    return F.unhex(F.lit(hex_text))


def is_confluent(b: Column | str) -> Column:
    """Magic byte 0 and a positive big-endian int32."""
    b = col(b)
    return (
        (F.octet_length(b) >= CONFLUENT_HEADER)
        & (F.substring(b, 1, 1) == _bytes("00"))
        & (F.substring(b, 2, 4) > _bytes("00000000"))
        & (F.substring(b, 2, 1) < _bytes("80"))
    )


def is_glue(b: Column | str) -> Column:
    """Version 3, compression none (0) or zlib (5), 16 bytes of schema version id."""
    b = col(b)
    return (F.octet_length(b) >= GLUE_HEADER) & F.substring(b, 1, 2).isin(_bytes("0300"), _bytes("0305"))


def is_framed(b: Column | str) -> Column:
    """True or false for every payload: does it carry a schema id?"""
    return F.coalesce(is_confluent(b) | is_glue(b), F.lit(False))


def confluent_header(b: Column | str) -> Column:
    """struct<schema_id: string, body: binary>, null without that header."""
    b = col(b)
    number = F.conv(F.hex(F.substring(b, 2, 4)), 16, 10)
    return F.when(
        is_confluent(b), F.struct(number.alias("schema_id"), F.substr(b, F.lit(CONFLUENT_HEADER + 1)).alias("body"))
    )


def glue_header(b: Column | str) -> Column:
    """struct<schema_id: string, zlib: boolean, body: binary>, null without that header."""
    b = col(b)
    digits = F.lower(F.hex(F.substring(b, 3, 16)))
    uuid = F.concat_ws("-", *[F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.when(
        is_glue(b),
        F.struct(
            uuid.alias("schema_id"),
            (F.substring(b, 2, 1) == _bytes("05")).alias("zlib"),
            F.substr(b, F.lit(GLUE_HEADER + 1)).alias("body"),
        ),
    )


def frame(b: Column | str) -> Column:
    """struct<registry, schema_id, zlib, body> of either framing, else null."""
    c, g = confluent_header(b), glue_header(b)
    return F.when(
        is_confluent(b),
        F.struct(
            F.lit(CONFLUENT).alias("registry"),
            c["schema_id"].alias("schema_id"),
            F.lit(False).alias("zlib"),
            c["body"].alias("body"),
        ),
    ).when(
        is_glue(b),
        F.struct(
            F.lit(GLUE).alias("registry"),
            g["schema_id"].alias("schema_id"),
            g["zlib"].alias("zlib"),
            g["body"].alias("body"),
        ),
    )


def allow_duplicate_keys() -> None:
    """Let the last of several equal object keys win, instead of rejecting the text."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def _too_deep(text: Column) -> Column:
    """Nested deeper than the reader allows; walks the text only if it could be."""
    structure = F.regexp_replace(text, r"\\.", "")
    structure = F.regexp_replace(structure, r'"[^"]*"', "")
    structure = F.regexp_replace(structure, r"[^\[\]{}]", "")
    deepest = F.aggregate(
        F.split(structure, ""),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, c: F.struct(
            (s["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"),
            F.greatest(s["most"], s["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most"),
        ),
        lambda s: s["most"],
    )
    openings = F.length(text) - F.length(F.translate(text, "[{", ""))
    return (F.octet_length(text) >= 2 * JSON_DEPTH) & (openings >= JSON_DEPTH) & (deepest >= JSON_DEPTH)


def _lone_surrogate(text: Column) -> Column:
    escapes = F.regexp_replace(text, r"\\\\", "")
    high, low = r"\\u[dD][89abAB][0-9a-fA-F]{2}", r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    return F.contains(text, F.lit("\\u")) & F.regexp_replace(escapes, high + low, "").rlike(f"{high}|{low}")


def _may_overflow(text: Column) -> Column:
    """Has an exponent or enough digits at all; cheap to rule out."""
    return (
        F.contains(text, F.lit("e")) | F.contains(text, F.lit("E")) | (F.octet_length(text) >= DOUBLE_DIGITS)
    ) & text.rlike(rf"[0-9][eE][+]?[0-9]{{2}}|[0-9]{{{DOUBLE_DIGITS}}}")


def _overflow(text: Column, json: Column) -> Column:
    """A number beyond the range of a double, which the parser turns into infinity."""

    def count(c: Column) -> Column:
        return F.length(c) - F.length(F.replace(c, F.lit("Infinity"), F.lit("Infinit")))

    return count(json) > count(text)


def _likely_json(text: Column) -> Column:
    """A look at the first character keeps prose from being copied and parsed."""
    return text.rlike(r'^[ \t\r\n]*(?:[\[{"0-9-]|(?:true|false|null)[ \t\r\n]*$)')


def _wrapped(text: Column) -> Column:
    """The text as first item of an array that ends with a long constant, as VARIANT.

    ``try_parse_json`` ignores what follows the first value; only if exactly
    these two items come back was the text a single value.
    """
    allow_duplicate_keys()
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{JSON_END}"]')))


def _wrapped_payload(payload: Column) -> Column:
    """The same for bytes: framed and malformed ones are no text."""
    text = payload.cast("string")
    return F.when(~is_framed(payload) & _likely_json(text) & is_text(payload), _wrapped(text))


def _single(wrapped: Column, text: Column) -> Column:
    exactly = (F.try_variant_get(wrapped, "$[1]", "string") == JSON_END) & (
        # a third item is only possible if the text itself brought the constant along
        ~F.contains(text, F.lit(JSON_END)) | F.try_variant_get(wrapped, "$[2]", "variant").isNull()
    )
    return F.when(exactly, F.try_variant_get(wrapped, "$[0]", "variant"))


def _rejected(text: Column, json: Column, suspect: Column) -> Column:
    """Texts the parser is more lenient about than the format."""
    return _too_deep(text) | _lone_surrogate(text) | (suspect & _overflow(text, json))


def parse_json_payload(text: Column) -> Column:
    """VARIANT of a text which is exactly one JSON value, else null.

    For whole columns ``with_json_text`` is faster: it computes each step once
    and stays compiled.
    """
    single = once(F.when(_likely_json(text), _wrapped(text)), lambda w: _single(w, text))
    return once(single, lambda v: F.when(~_rejected(text, F.to_json(v), _may_overflow(text)), v))


def with_json_text(df: DataFrame, payload: Column, name: str) -> DataFrame:
    """Adds ``name``: the JSON value of a text payload as compact JSON with sorted keys, else null.

    Framed and malformed bytes are not text. The text is parsed once, whatever
    is filtered afterwards.
    """
    kept, text = df.columns, payload.cast("string")
    df = with_computed(df, _wrapped=_wrapped_payload(payload))
    df = with_computed(df, _compact=F.to_json(_single(F.col("_wrapped"), text)))
    compact = F.col("_compact")
    return df.select(*kept, F.when(compact.isNotNull() & ~_rejected(text, compact, F.contains(compact, F.lit("Infinity")) & _may_overflow(text)), compact).alias(name))


def kind_of(b: Column | str, is_json: Column) -> Column:
    b = col(b)
    return (
        F.when(b.isNull(), NULL)
        .when(F.octet_length(b) == 0, STRING)
        .when(is_framed(b), AVRO)
        .when(~is_text(b), UNKNOWN)
        .when(is_json, JSON)
        .otherwise(STRING)
    )


def classify_payload(b: Column | str) -> Column:
    """null, string, json, avro or unknown, of one payload expression."""
    return kind_of(b, parse_json_payload(col(b).cast("string")).isNotNull())


def with_kinds(df: DataFrame, columns: tuple[str, ...] = ("key", "value")) -> DataFrame:
    """Adds ``{column}_kind``: ``classify_payload`` of whole columns."""
    kept = df.columns
    for c in columns:
        df = with_json_text(df, F.col(c), f"_{c}_json")
    kinds = [kind_of(c, F.col(f"_{c}_json").isNotNull()).alias(f"{c}_kind") for c in columns]
    return df.select(*kept, *kinds)
