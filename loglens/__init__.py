"""Look into message logs with Spark: bound, search, decode and render records."""

from loglens.functions.partitioner import kafka_partition, kafka_partition_native, partition_of
from loglens.functions.payload import (
    classify_payload,
    confluent_header,
    frame,
    glue_header,
    parse_json_payload,
    with_json_text,
    with_kinds,
)
from loglens.functions.render import record_age, render_json, render_line, render_timestamp, show_json
from loglens.functions.selectors import parse_selector, split_topic_partition
from loglens.functions.text import utf8_lossy
from loglens.functions.times import resolve_time, time_bounds
from loglens.operators.bounds import after_snapshot, end_offsets, from_time, start_at, tail, time_range, to_time
from loglens.operators.catalog import list_lines, resolve_selectors, suggest_topics, topic_catalog
from loglens.operators.keys import audit_summary, partitioner_audit, scan_key, with_expected_partition
from loglens.operators.limits import observe_consumed, take_consumed, until_idle
from loglens.operators.payloads import decode_avro, decode_avro_typed, join_schemas, required_schemas, text_filter, with_payloads
from loglens.plans.look import follow_look, look
from loglens.sources.index import indexed_ends, indexed_schemas, read_index, time_index, write_index
from loglens.sources.log import (
    LOG_SCHEMA,
    as_log,
    follow_log,
    kafka_offsets,
    kafka_options,
    land_log,
    read_log,
    read_schemas,
    select_partition,
)
from loglens.sources.sinks import stream_lines, to_lines, write_lines
from loglens.streaming.follow import Follow, take_stream

__all__ = [name for name in dir() if not name.startswith("_")]
