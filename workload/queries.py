"""Registered queries: every operator over a whole log or table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import loglens as L
from workload import logs

START, END = "2024-01-05 12:00", "2024-01-20 11:59"
NOW = "2024-02-01 12:00:00"
AGE_START = "2024-01-15 12:00:00"
EVENTS = "events"
TAIL, CONSUMED, CONSUMED_MANY, IDLE, SUGGESTED = 400, 500, 6000, 1800, 3
ABSENT_KEY = "7-"
KEY, NEEDLE, WORD = "7", '"k":5', "the "
MIXED_TOPICS = 40
SNAPSHOT = 100
# Offsets at which a growing log ends for a while.
GROWN = (20, 50)
CODECS = ("none", "gzip", "snappy", "lz4", "zstd")

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        logs.prepare(spark)
        return f(spark, sf_dir)

    REGISTRY[f.__name__] = run
    return run


def _text(c: str) -> Column:
    return F.col(c).cast("string").alias(c)


def _ts() -> Column:
    return L.render_timestamp("timestamp", "timestampType").alias("ts")


def _records(log: DataFrame) -> DataFrame:
    return log.select("topic", "partition", "offset", _ts(), _text("key"), _text("value"))


def _all_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = L.as_log(logs.events_log(spark, sf_dir))
    for other in (logs.orders_log, logs.documents_log):
        log = log.unionByName(L.as_log(other(spark, sf_dir)))
    return log


def _selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested selectors of all kinds, one per order."""
    form, number = F.col("o_orderkey") % 8, F.col("o_custkey").cast("string")
    selector = (
        F.when(form == 0, F.lit(None).cast("string"))
        .when(form == 1, "events")
        .when(form == 2, F.concat(F.lit("events-"), (F.col("o_custkey") % 9).cast("string")))
        .when(form == 3, F.concat(F.lit("src"), (F.col("o_custkey") % MIXED_TOPICS).cast("string")))
        .when(form == 4, F.concat(F.lit("src"), (F.col("o_custkey") % MIXED_TOPICS).cast("string"), F.lit("-1")))
        .when(form == 5, F.concat(F.lit("orders-99999999"), number))
        .when(form == 6, "oders")
        .otherwise("event-log")
    )
    return logs.table(spark, sf_dir, "orders").select(selector.alias("selector"))


# --- topics and partitions -------------------------------------------------


@query
def topic_catalog(spark, sf_dir):
    return L.topic_catalog(_all_logs(spark, sf_dir))


@query
def list_topics(spark, sf_dir):
    return L.list_lines(L.topic_catalog(_all_logs(spark, sf_dir)))


@query
def select_partition(spark, sf_dir):
    return _records(L.select_partition(logs.events_log(spark, sf_dir), f"{EVENTS}-3"))


@query
def split_topic_partition(spark, sf_dir):
    topic, partition, named = L.split_topic_partition("selector")
    return _selectors(spark, sf_dir).select(
        "selector", topic.alias("topic"), partition.alias("partition"), F.coalesce(named, F.lit(False)).alias("named")
    )


@query
def resolve_selectors(spark, sf_dir):
    return L.resolve_selectors(_selectors(spark, sf_dir), L.topic_catalog(_all_logs(spark, sf_dir)))


@query
def resolve_selectors_single(spark, sf_dir):
    """With one topic only, a missing selector means that one."""
    return L.resolve_selectors(_selectors(spark, sf_dir), L.topic_catalog(logs.orders_log(spark, sf_dir)))


@query
def suggest_topics(spark, sf_dir):
    topic, _, _ = L.split_topic_partition("selector")
    names = _selectors(spark, sf_dir).select(topic.alias("name"))
    return L.suggest_topics(names, L.topic_catalog(_all_logs(spark, sf_dir)), SUGGESTED)


# --- bounds and limits -----------------------------------------------------


@query
def tail_n(spark, sf_dir):
    return _records(L.tail(logs.events_log_compacted(spark, sf_dir), TAIL))


@query
def tail_skewed(spark, sf_dir):
    """Tails of all logs: more partitions than fit literal bounds, of very different lengths."""
    return L.tail(_all_logs(spark, sf_dir), TAIL).select("topic", "partition", "offset")


@query
def start_at_ends(spark, sf_dir):
    log = logs.events_log(spark, sf_dir)
    both = L.start_at(log, "earliest").unionByName(L.start_at(log, "latest"))
    return _records(both)


@query
def observe_consumed(spark, sf_dir):
    """Records counted while they are limited and written, next to those that a filter leaves."""
    watched, progress = L.observe_consumed(L.take_consumed(logs.events_log(spark, sf_dir), CONSUMED_MANY, top_n=CONSUMED))
    left = L.text_filter(watched, NEEDLE)
    out = logs.workspace(spark, sf_dir, f"observed-{uuid.uuid4().hex}")
    left.select("offset").write.parquet(out)
    kept = spark.read.parquet(out).agg(F.count(F.lit(1)).alias("kept"))
    return kept.select(F.lit(progress.get["records"]).cast("long").alias("consumed"), "kept")


@query
def from_time(spark, sf_dir):
    return _records(L.from_time(logs.events_log(spark, sf_dir), START))


@query
def to_time(spark, sf_dir):
    return _records(L.to_time(logs.events_log_partly_untimed(spark, sf_dir), END))


@query
def time_range(spark, sf_dir):
    return _records(L.time_range(logs.events_log(spark, sf_dir), START, END))


@query
def time_range_indexed(spark, sf_dir):
    """Both bounds looked up in the log's time index."""
    return _records(L.time_range(logs.events_log(spark, sf_dir), START, END, index=logs.events_index(spark, sf_dir)))


@query
def from_time_indexed(spark, sf_dir):
    return _records(L.from_time(logs.events_log(spark, sf_dir), START, index=logs.events_index(spark, sf_dir)))


@query
def to_time_indexed(spark, sf_dir):
    return _records(L.to_time(logs.events_log(spark, sf_dir), END, index=logs.events_index(spark, sf_dir)))


@query
def resolve_time_bounds(spark, sf_dir):
    events = logs.table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    form = F.col("event_id") % 10
    ago = F.concat(F.lit("-"), F.col("user_id").cast("string"))
    expression = (
        F.when(form == 0, "now")
        .when(form == 1, F.date_format("at", "yyyy-MM-dd"))
        .when(form == 2, F.date_format("at", "yyyy-MM-dd HH:mm"))
        .when(form == 3, F.date_format("at", "yyyy-MM-dd HH:mm:ss"))
        .when(form == 4, F.date_format("at", "HH:mm"))
        .when(form == 5, F.date_format("at", "HH:mm:ss"))
        .when(form == 6, F.concat(ago, F.lit("d")))
        .when(form == 7, F.concat(ago, F.lit("h")))
        .when(form == 8, F.concat(ago, F.lit("m")))
        .otherwise(F.concat(ago, F.lit("x")))
    )
    start, end = L.time_bounds("expression", NOW)
    return events.select("event_id", expression.alias("expression")).select(
        "event_id",
        "expression",
        F.when(start.isNotNull(), L.render_timestamp(start)).alias("start_ts"),
        F.when(end.isNotNull(), L.render_timestamp(end)).alias("end_ts"),
    )


@query
def take_consumed_then_filter(spark, sf_dir):
    first = L.take_consumed(logs.events_log(spark, sf_dir), CONSUMED)
    return _records(L.text_filter(first, NEEDLE))


@query
def take_consumed_many(spark, sf_dir):
    return _records(L.take_consumed(logs.events_log(spark, sf_dir), CONSUMED_MANY, top_n=CONSUMED))


@query
def take_consumed_from_tail(spark, sf_dir):
    """The first records behind a tail, of every partition alike."""
    return _records(L.take_consumed(L.tail(logs.events_log(spark, sf_dir), TAIL), CONSUMED, from_starts=True))


@query
def until_idle(spark, sf_dir):
    return _records(L.until_idle(logs.events_log_ordered(spark, sf_dir), IDLE))


# --- keys ------------------------------------------------------------------


@query
def kafka_partition(spark, sf_dir):
    key = F.col("user_id").cast("string")
    return logs.table(spark, sf_dir, "events").select(
        "event_id", key.alias("key"), L.kafka_partition(key, logs.EVENT_PARTITIONS).alias("partition")
    )


@query
def kafka_partition_native(spark, sf_dir):
    key = F.concat_ws("+", "event_type", F.col("event_id").cast("string"))
    return logs.table(spark, sf_dir, "events").select(
        "event_id", key.alias("key"), L.kafka_partition_native(key, logs.EVENT_PARTITIONS).alias("partition")
    )


@query
def scan_key(spark, sf_dir):
    return _records(L.scan_key(logs.events_log(spark, sf_dir), EVENTS, KEY))


@query
def scan_key_trusted(spark, sf_dir):
    """A key by the filters of its partition's row groups, and one that no record has."""
    log = logs.events_log(spark, sf_dir)
    both = [L.scan_key(log, EVENTS, k, n_partitions=logs.EVENT_PARTITIONS, verify=False) for k in (KEY, ABSENT_KEY)]
    return _records(both[0].unionByName(both[1]))


@query
def scan_key_in_partition(spark, sf_dir):
    return _records(L.scan_key(logs.orders_log(spark, sf_dir), "orders", KEY, partition=int(KEY) % logs.ORDER_PARTITIONS))


@query
def partitioner_audit(spark, sf_dir):
    found = L.partitioner_audit(logs.orders_log(spark, sf_dir), logs.ORDER_PARTITIONS)
    return found.select("topic", "partition", "offset", _text("key"), "expected_partition")


@query
def audit_summary(spark, sf_dir):
    both = L.as_log(logs.events_log(spark, sf_dir)).unionByName(L.as_log(logs.orders_log(spark, sf_dir)))
    return L.audit_summary(both)


# --- payloads --------------------------------------------------------------


@query
def classify_payload(spark, sf_dir):
    kinds = L.with_kinds(_all_logs(spark, sf_dir))
    return kinds.select("topic", "partition", "offset", "key_kind", "value_kind")


@query
def json_render(spark, sf_dir):
    parsed = L.with_json_text(logs.orders_log(spark, sf_dir), F.col("value"), "json")
    return parsed.select(
        "offset",
        L.show_json(F.col("json")).alias("plain"),
        L.show_json(F.col("json"), indent=True).alias("indented"),
    )


@query
def render_odd_payloads(spark, sf_dir):
    """Kind and text of payloads of all kinds: nested and broken JSON, numbers of all sizes, framed and malformed bytes."""
    shown = L.with_payloads(logs.odd_log(spark, sf_dir))
    return shown.select("offset", "key_kind", "value_kind", F.when(F.col("value_kind").isin("json", "string"), F.col("value_text")).alias("value_text"))


@query
def text_filter(spark, sf_dir):
    found = L.text_filter(logs.events_log(spark, sf_dir), NEEDLE)
    return found.select("partition", "offset", "key_text", "value_kind", "value_text")


@query
def text_filter_documents(spark, sf_dir):
    found = L.text_filter(logs.documents_log(spark, sf_dir), WORD)
    return found.select("topic", "partition", "offset", "key_text", F.md5("value").alias("value_md5"))


@query
def utf8_lossy(spark, sf_dir):
    """Every text with a malformed byte in its middle."""
    half = F.floor(F.length("text") / 2).cast("int")
    left, right = F.substring(F.col("text"), F.lit(1), half), F.substr(F.col("text"), half + 1)
    broken = F.concat(left.cast("binary"), F.unhex(F.lit("FF")), right.cast("binary"))
    shown = L.utf8_lossy(broken)
    return logs.table(spark, sf_dir, "documents").select(
        "doc_id", F.length(shown).alias("chars"), F.md5(shown.cast("binary")).alias("text_md5")
    )


@query
def render_line(spark, sf_dir):
    return L.to_lines(L.with_payloads(logs.events_log_partly_untimed(spark, sf_dir)))


@query
def record_age(spark, sf_dir):
    return logs.events_log_partly_untimed(spark, sf_dir).select(
        "partition", "offset", L.record_age("timestamp", AGE_START).alias("age")
    )


@query
def line_sink(spark, sf_dir):
    path = logs.workspace(spark, sf_dir, f"lines-{uuid.uuid4().hex}")
    L.write_lines(L.with_payloads(logs.orders_log(spark, sf_dir)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


# --- framed Avro -----------------------------------------------------------


@query
def confluent_headers(spark, sf_dir):
    head = logs.wire_log(spark, sf_dir).select("offset", L.confluent_header("value").alias("h"))
    return head.where(F.col("h").isNotNull()).select(
        "offset", F.col("h.schema_id").alias("schema_id"), F.octet_length("h.body").alias("body_bytes")
    )


@query
def glue_headers(spark, sf_dir):
    head = logs.wire_log(spark, sf_dir).select("offset", L.glue_header("value").alias("h"))
    return head.where(F.col("h").isNotNull()).select(
        "offset",
        F.col("h.schema_id").alias("schema_id"),
        F.col("h.zlib").alias("zlib"),
        F.when(~F.col("h.zlib"), F.octet_length("h.body")).alias("body_bytes"),
    )


@query
def required_schemas(spark, sf_dir):
    return L.required_schemas(logs.wire_log(spark, sf_dir))


@query
def join_schemas(spark, sf_dir):
    head = L.frame("value")
    heads = logs.wire_log(spark, sf_dir).select("offset", head["registry"].alias("registry"), head["schema_id"].alias("schema_id"))
    return L.join_schemas(heads, logs.schemas(spark)).select("offset", "registry", "schema_id", "definition")


@query
def read_schemas_from_files(spark, sf_dir):
    """Schemas exported to files of another format, with other spellings of registry and id."""
    path = logs.workspace(spark, sf_dir, f"schemas-{uuid.uuid4().hex}")
    logs.schemas(spark).select(F.upper("registry").alias("registry"), F.upper("schema_id").alias("schema_id"), "definition").write.json(path)
    head = L.frame("value")
    heads = logs.wire_log(spark, sf_dir).select("offset", head["registry"].alias("registry"), head["schema_id"].alias("schema_id"))
    return L.join_schemas(heads, L.read_schemas(spark, path, "json")).select("offset", "registry", "schema_id", "definition")


@query
def landed_codecs(spark, sf_dir):
    """The log landed with each codec reads alike."""
    log, found = L.as_log(logs.events_log(spark, sf_dir)), None
    for codec in CODECS:
        path = logs.workspace(spark, sf_dir, f"landed-{codec}-{uuid.uuid4().hex}")
        L.land_log(log, path, compression=codec)
        own = L.read_log(spark, path).groupBy("topic", "partition").agg(
            F.count(F.lit(1)).alias("records"), F.max("offset").alias("last"), F.sum(F.octet_length("value")).alias("value_bytes")
        )
        own = own.select(F.lit(codec).alias("codec"), "*")
        found = own if found is None else found.unionByName(own)
    return found


@query
def decode_avro(spark, sf_dir):
    decoded = L.decode_avro(logs.wire_log(spark, sf_dir), logs.schemas(spark), with_json=True)
    json = F.parse_json("value_avro.json")
    return decoded.select("offset", json.alias("json")).select(
        F.variant_get("json", "$.event_id", "bigint").alias("event_id"),
        F.variant_get("json", "$.event_type", "string").alias("event_type"),
        F.variant_get("json", "$.value", "double").alias("value"),
    )


@query
def render_avro(spark, sf_dir):
    shown = L.with_payloads(logs.wire_log(spark, sf_dir), logs.schemas(spark))
    return shown.select("offset", "key_kind", "value_kind", "value_text")


@query
def text_filter_avro(spark, sf_dir):
    found = L.text_filter(logs.wire_log(spark, sf_dir), '"event_type": "purchase"', logs.schemas(spark), indent=True)
    return found.select("offset", "value_text")


@query
def decode_avro_typed(spark, sf_dir):
    """Dates, instants, decimals, enums, unions, arrays, maps and records as columns, of two writers' schemas."""
    typed = L.decode_avro_typed(logs.order_wire_log(spark, sf_dir), logs.order_schemas(spark), logs.ORDER_SCHEMA, mode="permissive")
    v = F.col("value_typed.value")
    return typed.select(
        "offset",
        F.col("value_typed.error").isNotNull().alias("failed"),
        v["id"].alias("id"),
        F.date_add(v["day"], 1).cast("string").alias("next_day"),
        F.unix_millis(v["at"]).alias("at_ms"),
        (v["price"] * 100).cast("bigint").alias("cents"),
        v["status"].alias("status"),
        v["note"].alias("note"),
        v["code"]["member0"].alias("code_text"),
        v["code"]["member1"].alias("code_number"),
        F.when(v["parts"].isNotNull(), F.array_join(v["parts"].cast("array<string>"), ",")).alias("parts"),
        v["counts"]["a"].alias("count_a"),
        v["buyer"]["customer"].alias("customer"),
        v["buyer"]["paid"].alias("paid"),
    )


@query
def decode_avro_many_schemas(spark, sf_dir):
    """Text of the old schema's records, and what can't be decoded."""
    decoded = L.decode_avro(logs.order_wire_log(spark, sf_dir), logs.order_schemas(spark), mode="permissive")
    return decoded.where(F.col("offset") % 4 == 3).select(
        "offset", F.col("value_avro.text").alias("text"), F.col("value_avro.error").contains("no schema 99").alias("unknown")
    )


@query
def text_filter_orders(spark, sf_dir):
    """A text that no other field of the schema explains, in one branch of a union."""
    found = L.text_filter(logs.order_wire_log(spark, sf_dir).where("offset % 8 <> 7"), "URGENT", logs.order_schemas(spark))
    return found.select("offset", "value_kind")


# --- the whole look --------------------------------------------------------


@query
def range_search(spark, sf_dir):
    """A time range of a topic, searched for a text, as lines."""
    found = L.look(logs.events_log(spark, sf_dir), EVENTS, start=START, end=END, text=NEEDLE)
    return found.select("partition", "offset", "line")


@query
def key_search(spark, sf_dir):
    """The last offsets of the partition of a key, searched for that key."""
    found = L.look(logs.events_log(spark, sf_dir), EVENTS, offset=-10 * TAIL, key=KEY)
    return found.select("partition", "offset", "line")


# --- streams ---------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, **options: str) -> tuple[DataFrame, str]:
    """The landed events as a stream, and a folder for a run."""
    logs.events_log(spark, sf_dir)
    run = logs.workspace(spark, sf_dir, f"follow-{uuid.uuid4().hex}")
    return L.follow_log(spark, logs.workspace(spark, sf_dir, "events"), EVENTS, **options), run


def _followed(spark: SparkSession, run: str, make: Callable) -> DataFrame:
    """What a follow emits until the landed files are read."""
    parts: list[str] = []

    def emit(df: DataFrame, batch_id: int) -> None:
        parts.append(f"{run}/out/batch={batch_id}")
        df.write.mode("overwrite").parquet(parts[-1])

    make(emit, f"{run}/checkpoint").start(availableNow=True).awaitTermination()
    return spark.read.parquet(*dict.fromkeys(parts))


# One landed file, so one partition, per micro-batch.
SINGLE = {"maxFilesPerTrigger": "1"}


@query
def follow_to_time(spark, sf_dir):
    stream, run = _stream(spark, sf_dir, **SINGLE)
    return _records(_followed(spark, run, lambda emit, checkpoint: L.Follow(stream, emit, checkpoint, end=END)))


@query
def follow_tail(spark, sf_dir):
    stream, run = _stream(spark, sf_dir, **SINGLE)
    started = L.tail(stream, TAIL, snapshot=logs.events_log(spark, sf_dir))
    return _records(_followed(spark, run, lambda emit, checkpoint: L.Follow(started, emit, checkpoint)))


@query
def follow_from_time(spark, sf_dir):
    stream, run = _stream(spark, sf_dir, **SINGLE)
    started = L.from_time(stream, START, snapshot=logs.events_log(spark, sf_dir))
    return _records(_followed(spark, run, lambda emit, checkpoint: L.Follow(started, emit, checkpoint)))


@query
def follow_search(spark, sf_dir):
    """A live look: from a time to a time, searched for a text and shown as lines."""
    stream, run = _stream(spark, sf_dir, **SINGLE)
    log = logs.events_log(spark, sf_dir)
    make = lambda emit, checkpoint: L.follow_look(stream, emit, checkpoint, EVENTS, start=START, end=END, text=NEEDLE, snapshot=log)
    return _followed(spark, run, make).select("partition", "offset", "line")


@query
def follow_until_idle(spark, sf_dir):
    """A live follow that ends when nothing has come for a while."""
    stream, run = _stream(spark, sf_dir, **SINGLE)
    parts: list[str] = []

    def emit(df: DataFrame, batch_id: int) -> None:
        parts.append(f"{run}/out/batch={batch_id}")
        df.write.mode("overwrite").parquet(parts[-1])

    follow = L.Follow(stream, emit, f"{run}/checkpoint")
    follow.start()
    follow.wait(idle_seconds=2)
    return _records(spark.read.parquet(*dict.fromkeys(parts)))


@query
def follow_latest(spark, sf_dir):
    """Only what came after a snapshot."""
    stream, run = _stream(spark, sf_dir, **SINGLE)
    started = L.start_at(stream, "end", snapshot=logs.events_log(spark, sf_dir).where(F.col("offset") < SNAPSHOT))
    return _records(_followed(spark, run, lambda emit, checkpoint: L.Follow(started, emit, checkpoint)))


@query
def follow_audit(spark, sf_dir):
    """Running counts of records outside the partition of their key, kept by the stream itself."""
    stream, run = _stream(spark, sf_dir, **SINGLE)
    parts: list[str] = []

    def emit(df: DataFrame, batch_id: int) -> None:
        parts.append(f"{run}/out/batch={batch_id}")
        df.write.mode("overwrite").parquet(parts[-1])

    counts = L.audit_summary(stream, logs.EVENT_PARTITIONS - 1)
    writer = counts.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", f"{run}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    # Of the counts of a partition, which only grow, the latest ones count.
    every = spark.read.parquet(*dict.fromkeys(parts))
    return every.groupBy("topic", "partition").agg(F.max("records").alias("records"), F.max("mismatches").alias("mismatches"))


@query
def follow_limit(spark, sf_dir):
    """The first records of a log that grows while it is followed, until there are enough; the query restarts in between."""
    log = logs.events_log(spark, sf_dir)
    run = logs.workspace(spark, sf_dir, f"follow-{uuid.uuid4().hex}")
    parts: list[str] = []

    def emit(df: DataFrame, batch_id: int) -> None:
        parts.append(f"{run}/out/batch={batch_id}")
        df.write.mode("overwrite").parquet(parts[-1])

    for first, end in zip((0, *GROWN), (*GROWN, None)):
        part = log.where(F.col("offset") >= first)
        L.land_log(part if end is None else part.where(F.col("offset") < end), f"{run}/log", mode="append")
        stream = L.follow_log(spark, f"{run}/log", EVENTS)
        L.Follow(stream, emit, f"{run}/checkpoint", max_records=CONSUMED).start(availableNow=True).awaitTermination()
    return _records(spark.read.parquet(*dict.fromkeys(parts)))
