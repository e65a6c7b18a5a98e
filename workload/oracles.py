"""The registered queries once more, as SQL over the given tables."""

from __future__ import annotations

from workload import logs
from workload import queries as Q

TS = "%Y-%m-%d %H:%M:%S.%g"
FROM_TS, TO_TS = "TIMESTAMP '2024-01-05 12:00:00'", "TIMESTAMP '2024-01-20 11:59:59.999'"
NOW_TS = "TIMESTAMP '2024-02-01 12:00:00'"
AGE_TS = "TIMESTAMP '2024-01-15 12:00:00'"


def _partitioned(name: str, source: str, key: str, n: int) -> str:
    """CTEs that add ``partition``: murmur2 of a text key."""

    def byte(at: str) -> str:
        return f"('0x' || substr(hx, 2 * ({at}) + 1, 2))::BIGINT"

    size = "(length(hx) // 2)"
    word = "('0x' || substr(hx,i*8+7,2) || substr(hx,i*8+5,2) || substr(hx,i*8+3,2) || substr(hx,i*8+1,2))::BIGINT"
    m, mask = 1540483477, 4294967295
    rest, at = f"({size} % 4)", f"({size} - {size} % 4)"
    tails = {
        1: byte(at),
        2: f"({byte(at)} | ({byte(at + ' + 1')} << 8))",
        3: f"({byte(at)} | ({byte(at + ' + 1')} << 8) | ({byte(at + ' + 2')} << 16))",
    }
    cases = " ".join(f"WHEN {r} THEN (xor(h0, {tail}) * {m}) & {mask}" for r, tail in tails.items())
    return f"""
{name}_hex AS (SELECT *, hex(encode({key})) AS hx FROM {source}),
{name}_body AS (SELECT *, list_reduce(
    list_prepend(xor(2538058380::BIGINT, {size}::BIGINT),
      list_transform(list_transform(range(0, length(hx) // 8), lambda i: ({word} * {m}) & {mask}),
                     lambda x: (xor(x, x >> 24) * {m}) & {mask})),
    lambda h, x: xor((h * {m}) & {mask}, x)) AS h0 FROM {name}_hex),
{name}_tail AS (SELECT *, CASE {rest} {cases} ELSE h0 END AS h1 FROM {name}_body),
{name}_mix AS (SELECT *, (xor(h1, h1 >> 13) * {m}) & {mask} AS h2 FROM {name}_tail),
{name} AS (SELECT * EXCLUDE (hx, h0, h1, h2), ((xor(h2, h2 >> 15) & 2147483647) % {n})::INTEGER AS partition
  FROM {name}_mix)"""


EVENT_VALUE = """CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN event_type
    WHEN 3 THEN props || 'x' ELSE props END"""

EVENTS_LOG = f"""
keyed_events AS (SELECT *, user_id::VARCHAR AS key FROM events),
{_partitioned("placed_events", "keyed_events", "key", logs.EVENT_PARTITIONS)},
events_log AS (SELECT 'events' AS topic, partition,
    row_number() OVER (PARTITION BY partition ORDER BY event_id) - 1 AS "offset",
    date_trunc('millisecond', ts + to_seconds((event_id * 7919) % 86400 - 43200)) AS t,
    key, {EVENT_VALUE} AS value FROM placed_events)"""

UNTIMED_LOG = """untimed_log AS (SELECT topic, partition, "offset", CASE WHEN "offset" % 2 = 0 THEN t END AS t,
    key, value FROM events_log)"""

ORDER_PARTS = """SELECT *, o_orderkey % 4 = 3 AS old, o_orderkey % 8 = 7 AS unknown, round(o_totalprice * 100)::BIGINT AS cents
    FROM orders"""

ORDERS_LOG = """orders_log AS (SELECT 'orders' AS topic, (o_custkey % 4)::INTEGER AS partition, o_orderkey AS "offset",
    o_orderdate::TIMESTAMP AS t, o_custkey::VARCHAR AS key,
    '{"status": "' || o_orderstatus || '", "priority": "' || o_orderpriority || '"}' AS value FROM orders)"""

DOCUMENTS_LOG = f"""
{_partitioned("placed_documents", "documents", "lang", logs.LANG_PARTITIONS)},
documents_log AS (SELECT source AS topic, partition, doc_id AS "offset", NULL::TIMESTAMP AS t, lang AS key,
    text AS value FROM placed_documents)"""

ALL_LOGS = f"""{EVENTS_LOG}, {ORDERS_LOG}, {DOCUMENTS_LOG},
all_logs AS (SELECT * FROM events_log UNION ALL SELECT * FROM orders_log UNION ALL SELECT * FROM documents_log)"""

CATALOG = f"""{ALL_LOGS},
catalog AS (SELECT topic, max(partition) + 1 AS n_partitions FROM all_logs GROUP BY topic)"""

SELECTORS = f"""
selectors AS (SELECT CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'events'
    WHEN 2 THEN 'events-' || (o_custkey % 9) WHEN 3 THEN 'src' || (o_custkey % {Q.MIXED_TOPICS})
    WHEN 4 THEN 'src' || (o_custkey % {Q.MIXED_TOPICS}) || '-1' WHEN 5 THEN 'orders-99999999' || o_custkey
    WHEN 6 THEN 'oders' ELSE 'event-log' END AS selector FROM orders),
parsed AS (SELECT selector, coalesce(regexp_matches(selector, '^(.+)-([0-9]+)$'), false) AS named,
    CASE WHEN regexp_matches(selector, '^(.+)-([0-9]+)$') THEN regexp_extract(selector, '^(.+)-([0-9]+)$', 1)
      ELSE selector END AS topic,
    CASE WHEN regexp_matches(selector, '^(.+)-([0-9]+)$')
      THEN try_cast(regexp_extract(selector, '^(.+)-([0-9]+)$', 2) AS INTEGER) END AS partition FROM selectors)"""


def _records(log: str, extra: str = "") -> str:
    return f"""SELECT topic, partition, "offset", coalesce(strftime(t, '{TS}'), '') AS ts, key, value FROM {log} {extra}"""


def _kind(column: str) -> str:
    return f"""CASE WHEN {column} IS NULL THEN 'null' WHEN {column} = '' THEN 'string'
      WHEN json_valid({column}) THEN 'json' ELSE 'string' END"""


# the JSON texts of the events log have one key and a space after the colon
EVENT_TEXT = """CASE WHEN value IS NULL THEN 'null'
    WHEN value LIKE '{%}' THEN replace(value, ': ', ':') ELSE value END"""
EVENT_LINE = f"""'events-' || partition || ' ' || coalesce(strftime(t, '{TS}'), '') || ' ' || "offset" || ' ' || key
    || ' ' || {EVENT_TEXT}"""
ORDER_TEXT = """'{"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}'"""
NUMBER = "regexp_replace(value::VARCHAR, '\\.0$', '')"
FIRST = f"""(SELECT partition, min("offset") AS first FROM events_log WHERE t >= {FROM_TS} GROUP BY partition)"""
VARINT_BYTES = "(1 + (2 * event_id >= 128)::INT + (2 * event_id >= 16384)::INT + (2 * event_id >= 2097152)::INT + (2 * event_id >= 268435456)::INT)"
BODY_BYTES = f"({VARINT_BYTES} + 1 + length(event_type) + 8)::INTEGER"

TIME_RANGE = f"""
started AS (SELECT l.* FROM events_log l JOIN {FIRST} b ON l.partition = b.partition AND l."offset" >= b.first),
stops AS (SELECT partition, min("offset") AS stop FROM started WHERE t > {TO_TS} GROUP BY partition),
ranged AS (SELECT l.* FROM started l LEFT JOIN stops s ON l.partition = s.partition
    WHERE s.stop IS NULL OR l."offset" < s.stop)"""

# values that must be the same on both sides
SCHEMA_TEXT = logs.EVENT_SCHEMA
SCHEMA_ID = f"CASE WHEN event_id % 3 = 0 THEN (1 + event_id % 2)::VARCHAR ELSE '{logs.GLUE_ID}' END"
REGISTRY_NAME = "CASE WHEN event_id % 3 = 0 THEN 'confluent' ELSE 'glue' END"


def oracle_sql() -> dict[str, str]:
    sql = _own()
    # Streams that are read to their end give what the bounded read gives.
    streams = {"follow_from_time": sql["from_time"], "follow_search": sql["range_search"]}
    # An index changes where bounds are looked up, not the bounds.
    indexed = {"from_time_indexed": sql["from_time"], "time_range_indexed": sql["time_range"], "to_time_indexed": sql["follow_to_time"]}
    return sql | streams | indexed | {"read_schemas_from_files": sql["join_schemas"]}


def _own() -> dict[str, str]:
    return {
        "topic_catalog": f"WITH {CATALOG} SELECT topic, n_partitions FROM catalog",
        "list_topics": f"WITH {CATALOG} SELECT topic || ' (' || n_partitions || ')' AS line FROM catalog",
        "select_partition": f"WITH {EVENTS_LOG} " + _records("events_log", "WHERE partition = 3"),
        "split_topic_partition": f"WITH {SELECTORS} SELECT selector, topic, partition, named FROM parsed",
        "resolve_selectors": f"""WITH {CATALOG}, {SELECTORS},
            distances AS (SELECT n.topic AS name, c.topic, levenshtein(n.topic, c.topic) AS d
              FROM (SELECT DISTINCT topic FROM parsed WHERE topic IS NOT NULL) n, catalog c),
            nearest AS (SELECT name, arg_min(topic, d * 1000000 + r) AS suggestion
              FROM (SELECT *, row_number() OVER (ORDER BY topic) AS r FROM distances) GROUP BY name)
            SELECT p.selector, p.topic, p.partition,
              CASE WHEN p.selector IS NULL THEN 'ambiguous' WHEN c.topic IS NULL THEN 'unknown_topic'
                WHEN p.named AND p.partition IS NULL THEN 'bad_partition'
                WHEN p.partition >= c.n_partitions THEN 'partition_out_of_range' ELSE 'ok' END AS status,
              CASE WHEN c.topic IS NULL THEN n.suggestion END AS suggestion
            FROM parsed p LEFT JOIN catalog c ON p.topic = c.topic LEFT JOIN nearest n ON p.topic = n.name""",
        "suggest_topics": f"""WITH {CATALOG}, {SELECTORS},
            distances AS (SELECT n.topic AS name, c.topic, levenshtein(n.topic, c.topic) AS distance
              FROM (SELECT DISTINCT topic FROM parsed WHERE topic IS NOT NULL) n, catalog c),
            ranked AS (SELECT name, row_number() OVER (PARTITION BY name ORDER BY distance, topic) AS rank, topic,
              distance FROM distances)
            SELECT name, rank::INTEGER AS rank, topic, distance::INTEGER AS distance FROM ranked
            WHERE rank <= {Q.SUGGESTED}""",
        "tail_n": f"""WITH {EVENTS_LOG}, kept AS (SELECT * FROM events_log WHERE "offset" % 3 <> 1),
            ends AS (SELECT partition AS p, max("offset") + 1 AS e FROM kept GROUP BY partition),
            last AS (SELECT * FROM kept JOIN ends ON partition = p WHERE "offset" >= e - {Q.TAIL}) """
        + _records("last"),
        "tail_skewed": f"""WITH {ALL_LOGS},
            ends AS (SELECT topic AS n, partition AS p, max("offset") + 1 AS e FROM all_logs GROUP BY ALL)
            SELECT topic, partition, "offset" FROM all_logs JOIN ends ON topic = n AND partition = p
            WHERE "offset" >= e - {Q.TAIL}""",
        "start_at_ends": f"WITH {EVENTS_LOG} " + _records("events_log"),
        "observe_consumed": f"""WITH {EVENTS_LOG},
            first AS (SELECT * FROM events_log ORDER BY "offset", topic, partition LIMIT {Q.CONSUMED_MANY})
            SELECT count(*) AS consumed,
              count(*) FILTER (WHERE contains({EVENT_TEXT}, '{Q.NEEDLE}') OR contains(coalesce(value, ''), '{Q.NEEDLE}')) AS kept
            FROM first""",
        "follow_tail": f"""WITH {EVENTS_LOG},
            ends AS (SELECT partition AS p, max("offset") + 1 AS e FROM events_log GROUP BY partition),
            last AS (SELECT * FROM events_log JOIN ends ON partition = p WHERE "offset" >= e - {Q.TAIL}) """
        + _records("last"),
        "from_time": f"""WITH {EVENTS_LOG},
            started AS (SELECT l.* FROM events_log l JOIN {FIRST} b ON l.partition = b.partition
              WHERE l."offset" >= b.first) """
        + _records("started"),
        "to_time": f"""WITH {EVENTS_LOG}, {UNTIMED_LOG},
            flagged AS (SELECT *, max(coalesce(t > {TO_TS}, false)::INT) OVER (PARTITION BY partition
              ORDER BY "offset" ROWS UNBOUNDED PRECEDING) AS passed FROM untimed_log) """
        + _records("flagged", "WHERE passed = 0"),
        "time_range": f"WITH {EVENTS_LOG}, {TIME_RANGE} " + _records("ranged"),
        "resolve_time_bounds": f"""WITH e AS (SELECT event_id, user_id, event_id % 10 AS form, ts,
              CASE event_id % 10 WHEN 0 THEN 'now' WHEN 1 THEN strftime(ts, '%Y-%m-%d')
                WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
                WHEN 4 THEN strftime(ts, '%H:%M') WHEN 5 THEN strftime(ts, '%H:%M:%S')
                WHEN 6 THEN '-' || user_id || 'd' WHEN 7 THEN '-' || user_id || 'h' WHEN 8 THEN '-' || user_id || 'm'
                ELSE '-' || user_id || 'x' END AS expression FROM events),
            day AS (SELECT *, date_trunc('day', {NOW_TS}) + (ts - date_trunc('day', ts)) AS today FROM e),
            resolved AS (SELECT event_id, expression,
              CASE form WHEN 0 THEN {NOW_TS} WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('minute', ts)
                WHEN 3 THEN date_trunc('second', ts) WHEN 4 THEN date_trunc('minute', today)
                WHEN 5 THEN date_trunc('second', today) WHEN 6 THEN {NOW_TS} - to_hours(24 * user_id)
                WHEN 7 THEN {NOW_TS} - to_hours(user_id) WHEN 8 THEN {NOW_TS} - to_minutes(user_id) END AS s,
              CASE WHEN form = 1 THEN INTERVAL 1 DAY WHEN form IN (2, 4) THEN INTERVAL 1 MINUTE
                WHEN form IN (3, 5) THEN INTERVAL 1 SECOND END AS span FROM day)
            SELECT event_id, expression, strftime(s, '{TS}') AS start_ts,
              strftime(CASE WHEN span IS NULL THEN s ELSE s + span - INTERVAL 1 MILLISECOND END, '{TS}') AS end_ts
            FROM resolved""",
        "take_consumed_then_filter": f"""WITH {EVENTS_LOG},
            first AS (SELECT * FROM events_log ORDER BY "offset", topic, partition LIMIT {Q.CONSUMED}),
            shown AS (SELECT *, {EVENT_TEXT} AS text FROM first) """
        + _records("shown", f"WHERE contains(text, '{Q.NEEDLE}') OR contains(coalesce(value, ''), '{Q.NEEDLE}')"),
        "take_consumed_many": f"""WITH {EVENTS_LOG},
            first AS (SELECT * FROM events_log ORDER BY "offset", topic, partition LIMIT {Q.CONSUMED_MANY}) """
        + _records("first"),
        "take_consumed_from_tail": f"""WITH {EVENTS_LOG}, ends AS (SELECT partition AS p, max("offset") + 1 AS e FROM events_log GROUP BY partition),
            last AS (SELECT * FROM events_log JOIN ends ON partition = p WHERE "offset" >= e - {Q.TAIL}),
            starts AS (SELECT partition AS p2, min("offset") AS s FROM last GROUP BY partition),
            first AS (SELECT last.* FROM last JOIN starts ON partition = p2 ORDER BY "offset" - s, topic, partition LIMIT {Q.CONSUMED}) """
        + _records("first"),
        "landed_codecs": f"""WITH {EVENTS_LOG}, codecs AS (SELECT unnest([{", ".join(f"'{c}'" for c in Q.CODECS)}]) AS codec)
            SELECT codec, topic, partition, count(*) AS records, max("offset") AS last, sum(strlen(value))::BIGINT AS value_bytes
            FROM events_log, codecs GROUP BY codec, topic, partition""",
        "resolve_selectors_single": f"""WITH {ORDERS_LOG}, {SELECTORS},
            one AS (SELECT topic AS t, (max(partition) + 1)::INTEGER AS n FROM orders_log GROUP BY topic)
            SELECT selector, coalesce(topic, t) AS topic, partition,
              CASE WHEN selector IS NULL THEN 'ok' WHEN topic <> t THEN 'unknown_topic' WHEN named AND partition IS NULL THEN 'bad_partition'
                WHEN partition >= n THEN 'partition_out_of_range' ELSE 'ok' END AS status,
              CASE WHEN topic <> t THEN t END AS suggestion FROM parsed, one""",
        "until_idle": f"""WITH ordered AS (SELECT 'events' AS topic, user_id::INTEGER AS partition, event_id AS "offset",
              date_trunc('millisecond', ts) AS t, user_id::VARCHAR AS key, {EVENT_VALUE} AS value FROM events),
            gaps AS (SELECT t, t - lag(t) OVER (ORDER BY t) AS gap FROM ordered),
            cut AS (SELECT min(t) AS t FROM gaps WHERE gap > INTERVAL {Q.IDLE} SECOND),
            kept AS (SELECT o.* FROM ordered o, cut c WHERE c.t IS NULL OR o.t < c.t) """
        + _records("kept"),
        "kafka_partition": f"""WITH keyed AS (SELECT event_id, user_id::VARCHAR AS key FROM events),
            {_partitioned("placed", "keyed", "key", logs.EVENT_PARTITIONS)} SELECT event_id, key, partition FROM placed""",
        "kafka_partition_native": f"""WITH keyed AS (SELECT event_id, event_type || '+' || event_id AS key FROM events),
            {_partitioned("placed", "keyed", "key", logs.EVENT_PARTITIONS)} SELECT event_id, key, partition FROM placed""",
        "scan_key": f"WITH {EVENTS_LOG} " + _records("events_log", f"WHERE key = '{Q.KEY}'"),
        "scan_key_trusted": f"WITH {EVENTS_LOG} " + _records("events_log", f"WHERE key IN ('{Q.KEY}', '{Q.ABSENT_KEY}')"),
        "scan_key_in_partition": f"WITH {ORDERS_LOG} " + _records("orders_log", f"WHERE key = '{Q.KEY}'"),
        "partitioner_audit": f"""WITH {ORDERS_LOG}, renamed AS (SELECT * EXCLUDE (partition), partition AS seen
              FROM orders_log), {_partitioned("placed", "renamed", "key", logs.ORDER_PARTITIONS)}
            SELECT topic, seen AS partition, "offset", key, partition AS expected_partition FROM placed
            WHERE seen <> partition""",
        "audit_summary": f"""WITH {EVENTS_LOG}, {ORDERS_LOG}, renamed AS (SELECT * EXCLUDE (partition),
              partition AS seen FROM orders_log), {_partitioned("placed", "renamed", "key", logs.ORDER_PARTITIONS)}
            SELECT topic, seen AS partition, count(*) AS records, count(*) FILTER (WHERE seen <> partition) AS mismatches
            FROM placed GROUP BY ALL
            UNION ALL SELECT topic, partition, count(*), 0 FROM events_log GROUP BY ALL""",
        "classify_payload": f"""WITH {ALL_LOGS} SELECT topic, partition, "offset", {_kind("key")} AS key_kind,
            {_kind("value")} AS value_kind FROM all_logs""",
        "json_render": f"""SELECT o_orderkey AS "offset", {ORDER_TEXT} AS plain,
            '{{ "priority": "' || o_orderpriority || '", "status": "' || o_orderstatus || '" }}' AS indented FROM orders""",
        "render_odd_payloads": r"""WITH odd AS (SELECT event_id, event_type, user_id AS n, event_id % 10 AS k,
              '{"z": [1.0, 1e20, -0, {"b": null, "a": "q\"\\\u00e9\n' || user_id || '"}], "a": {"y": ' || repeat('1234567890', 4)
              || ', "x": ' || user_id || '}}' AS nested FROM events)
            SELECT event_id AS "offset", CASE WHEN k = 9 THEN 'null' ELSE 'unknown' END AS key_kind,
              CASE WHEN k IN (0, 2, 4) THEN 'json' WHEN k IN (1, 3, 5) THEN 'string' WHEN k IN (6, 7) THEN 'avro'
                WHEN k = 8 THEN 'unknown' ELSE 'null' END AS value_kind,
              CASE k WHEN 0 THEN '{"a":{"x":' || n || ',"y":1.2345678901234568e39},"z":[1.0,1e20,-0.0,{"a":"q"\é' || chr(10) || n || '","b":null}]}'
                WHEN 1 THEN nested || '}'
                WHEN 2 THEN '[' || n || '.5,2.5e-6,0.00001,12345678901234567890]'
                WHEN 3 THEN repeat('[', 128) || n || repeat(']', 128)
                WHEN 4 THEN '"' || event_type || '"'
                WHEN 5 THEN event_type || ' é ' || n END AS value_text
            FROM odd""",
        "text_filter": f"""WITH {EVENTS_LOG}, shown AS (SELECT *, {EVENT_TEXT} AS text FROM events_log)
            SELECT partition, "offset", key AS key_text, {_kind("value")} AS value_kind, text AS value_text FROM shown
            WHERE contains(text, '{Q.NEEDLE}') OR contains(coalesce(value, ''), '{Q.NEEDLE}')""",
        "text_filter_documents": f"""WITH {DOCUMENTS_LOG} SELECT topic, partition, "offset", key AS key_text,
            md5(value) AS value_md5 FROM documents_log WHERE contains(value, '{Q.WORD}')""",
        "utf8_lossy": """WITH broken AS (SELECT doc_id, substr(text, 1, (length(text) // 2)::INT) || chr(65533)
              || substr(text, (length(text) // 2)::INT + 1) AS shown FROM documents)
            SELECT doc_id, length(shown)::INTEGER AS chars, md5(shown) AS text_md5 FROM broken""",
        "render_line": f"WITH {EVENTS_LOG}, {UNTIMED_LOG} SELECT {EVENT_LINE} AS line FROM untimed_log",
        "record_age": f"""WITH {EVENTS_LOG}, {UNTIMED_LOG} SELECT partition, "offset", CASE WHEN t IS NULL THEN NULL
            WHEN t > {AGE_TS} THEN 'new' WHEN t::DATE = {AGE_TS}::DATE THEN 'today' ELSE 'older' END AS age
            FROM untimed_log""",
        "line_sink": f"""SELECT 'orders-' || (o_custkey % 4) || ' ' || strftime(o_orderdate, '{TS}') || ' ' || o_orderkey
            || ' ' || o_custkey || ' ' || {ORDER_TEXT} AS line FROM orders""",
        "confluent_headers": f"""SELECT event_id AS "offset", {SCHEMA_ID} AS schema_id, {BODY_BYTES} AS body_bytes
            FROM events WHERE event_id % 3 = 0""",
        "glue_headers": f"""SELECT event_id AS "offset", {SCHEMA_ID} AS schema_id, event_id % 3 = 2 AS zlib,
            CASE WHEN event_id % 3 = 1 THEN {BODY_BYTES} END AS body_bytes FROM events WHERE event_id % 3 <> 0""",
        "required_schemas": f"""SELECT {REGISTRY_NAME} AS registry, {SCHEMA_ID} AS schema_id, count(*) AS records
            FROM events GROUP BY ALL""",
        "join_schemas": f"""SELECT event_id AS "offset", {REGISTRY_NAME} AS registry, {SCHEMA_ID} AS schema_id,
            '{SCHEMA_TEXT}' AS definition FROM events""",
        "decode_avro": "SELECT event_id, event_type, value FROM events",
        "render_avro": f"""SELECT event_id AS "offset", 'json' AS key_kind, 'avro' AS value_kind,
            '{{"event_id":' || event_id || ',"event_type":"' || event_type || '","value":' || {NUMBER} || '}}' AS value_text
            FROM events""",
        "text_filter_avro": f"""SELECT event_id AS "offset", '{{ "event_id": ' || event_id || ', "event_type": "'
            || event_type || '", "value": ' || {NUMBER} || ' }}' AS value_text
            FROM events WHERE event_type = 'purchase'""",
        "decode_avro_typed": f"""WITH o AS ({ORDER_PARTS}) SELECT o_orderkey AS "offset", unknown AS failed,
            CASE WHEN NOT unknown THEN o_orderkey END AS id,
            CASE WHEN NOT unknown THEN CAST(CAST(o_orderdate AS DATE) + 1 AS VARCHAR) END AS next_day,
            CASE WHEN old AND NOT unknown THEN 0 WHEN NOT old THEN epoch_ms(o_orderdate) + o_orderkey END AS at_ms,
            CASE WHEN NOT unknown THEN cents END AS cents, CASE WHEN NOT unknown THEN o_orderstatus END AS status,
            CASE WHEN NOT old AND o_orderkey % 2 = 0 THEN o_orderpriority END AS note,
            CASE WHEN NOT old AND o_orderkey % 3 = 1 THEN 'c' || o_custkey END AS code_text,
            CASE WHEN NOT old AND o_orderkey % 3 = 2 THEN o_custkey END AS code_number,
            CASE WHEN NOT old THEN array_to_string(list_transform(range(0, o_orderkey % 5), lambda j: o_custkey + j), ',')
              WHEN NOT unknown THEN '' END AS parts,
            CASE WHEN NOT old AND o_orderkey % 6 <> 0 THEN o_orderkey END AS count_a,
            CASE WHEN NOT old AND o_orderkey % 7 <> 0 THEN o_custkey END AS customer,
            CASE WHEN NOT old AND o_orderkey % 7 <> 0 THEN o_totalprice END AS paid FROM o""",
        "decode_avro_many_schemas": f"""WITH o AS ({ORDER_PARTS}) SELECT o_orderkey AS "offset",
            CASE WHEN NOT unknown THEN '{{"price":"' || (cents // 100) || '.' || lpad((cents % 100)::VARCHAR, 2, '0') || '","id":' || o_orderkey
              || ',"gone":"x","day":"' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '","status":"' || o_orderstatus || '"}}' END AS text,
            CASE WHEN unknown THEN true END AS unknown FROM o WHERE old""",
        "text_filter_orders": """SELECT o_orderkey AS "offset", 'avro' AS value_kind FROM orders
            WHERE o_orderkey % 4 <> 3 AND o_orderkey % 2 = 0 AND contains(o_orderpriority, 'URGENT')""",
        "range_search": f"""WITH {EVENTS_LOG}, {TIME_RANGE} SELECT partition, "offset", {EVENT_LINE} AS line FROM ranged
            WHERE contains({EVENT_TEXT}, '{Q.NEEDLE}') OR contains(coalesce(value, ''), '{Q.NEEDLE}')""",
        "key_search": f"""WITH {EVENTS_LOG}, ends AS (SELECT partition AS p, max("offset") + 1 AS e FROM events_log
              GROUP BY partition)
            SELECT partition, "offset", {EVENT_LINE} AS line FROM events_log JOIN ends ON partition = p
            WHERE key = '{Q.KEY}' AND "offset" >= e - {10 * Q.TAIL}""",
        "follow_to_time": f"""WITH {EVENTS_LOG}, flagged AS (SELECT *, max((t > {TO_TS})::INT) OVER (PARTITION BY partition
              ORDER BY "offset" ROWS UNBOUNDED PRECEDING) AS passed FROM events_log) """
        + _records("flagged", "WHERE passed = 0"),
        "follow_until_idle": f"WITH {EVENTS_LOG} " + _records("events_log"),
        "follow_latest": f"WITH {EVENTS_LOG} " + _records("events_log", f'WHERE "offset" >= {Q.SNAPSHOT}'),
        "follow_audit": f"""WITH {EVENTS_LOG}, renamed AS (SELECT * EXCLUDE (partition), partition AS seen FROM events_log),
            {_partitioned("placed", "renamed", "key", logs.EVENT_PARTITIONS - 1)}
            SELECT topic, seen AS partition, count(*) AS records, count(*) FILTER (WHERE seen <> partition) AS mismatches
            FROM placed GROUP BY ALL""",
        "follow_limit": f"""WITH {EVENTS_LOG},
            first AS (SELECT * FROM events_log ORDER BY "offset", topic, partition LIMIT {Q.CONSUMED}) """
        + _records("first"),
    }
