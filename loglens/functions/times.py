"""Time expressions: ``now``, ``-15m``, ``2024-01-31``, ``2024-01-31 12:00``, ``12:00:30``."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from loglens.functions.text import col

# Accepted spellings and their units.
AGO = r"^-([0-9]+)([dhms])$"
UNIT_SECONDS = {"d": 86400, "h": 3600, "m": 60, "s": 1}
CLOCK = r"^[0-9]{2}:[0-9]{2}(:[0-9]{2})?$"
DAY, MINUTE, SECOND = "yyyy-MM-dd", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss"
SPELLINGS = {
    DAY: r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    MINUTE: r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}$",
    SECOND: r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$",
}
LENGTHS = {DAY: "INTERVAL '1' DAY", MINUTE: "INTERVAL '1' MINUTE", SECOND: "INTERVAL '1' SECOND"}
# Time zones whose clocks are never set.
FIXED_ZONE = r"^(Z|UTC|GMT|(UTC|GMT)?[+-][0-9:]+|Etc/.*)$"
# Steps in which the clocks of a zone are looked at, and from when to when (seconds since 1970): a table of about 700,000 rows.
ZONE_STEP, ZONE_FIRST, ZONE_LAST = 3 * 3600, -5_364_662_400, 2_208_988_800
HELP = "a time is now, a number of d, h, m or s ago such as -15m, a day, a clock time or both, such as 2024-01-31 12:00:30"


def timestamp_literal(t: dt.datetime | str | Column) -> Column:
    """A literal in the session time zone (naive) or in its own zone (aware)."""
    if isinstance(t, Column):
        return t
    if isinstance(t, dt.datetime):
        t = t.astimezone(dt.timezone.utc).isoformat() if t.tzinfo else t.isoformat(sep=" ")
    return F.lit(t).cast("timestamp")


def floor_millis(ts: Column) -> Column:
    return F.date_trunc("millisecond", ts)


def after_millis(ts: Column) -> Column:
    """The first instant that is later than ``ts`` when both are compared in ms."""
    return floor_millis(ts) + F.expr("INTERVAL '0.001' SECOND")


_set_back: dict[str, tuple[int, ...]] = {}


def set_back(spark: SparkSession) -> tuple[int, ...]:
    """By how many seconds the clocks of the session's zone are ever set back, looked up once per zone.

    Later years repeat the rules of the last ones, so they bring no other number.
    """
    zone = spark.conf.get("spark.sql.session.timeZone")
    if re.match(FIXED_ZONE, zone):
        return ()
    if zone not in _set_back:

        def offset(seconds: Column) -> Column:
            local = F.timestamp_seconds(seconds).cast("timestamp_ntz")
            clock = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
            return F.unix_date(local.cast("date")).cast("long") * 86400 + clock - seconds

        now = spark.range(ZONE_FIRST, ZONE_LAST, ZONE_STEP).select(offset(F.col("id")).alias("a"), offset(F.col("id") + ZONE_STEP).alias("b"))
        _set_back[zone] = tuple(sorted(r[0] for r in now.where("b < a").select(F.col("a") - F.col("b")).distinct().collect()))
    return _set_back[zone]


def _local(text: Column, form: str, overlaps: tuple[int, ...] | None) -> Column:
    """The instant of a local time; null if the clocks skip it or show it twice. A day is always one.

    Of two instants the earlier one is found first, so only later ones have to be looked for. Without overlaps to
    look for the clocks are never set.
    """
    local = text.try_cast("timestamp_ntz")
    start = local.cast("timestamp")
    if form == DAY or not overlaps:
        return start
    once = start.cast("timestamp_ntz") == local
    for seconds in overlaps:
        once = once & (F.timestamp_micros(F.unix_micros(start) + seconds * 1_000_000).cast("timestamp_ntz") != local)
    return F.when(once, start)


def time_bounds(expression: Column | str, now: dt.datetime | str | Column) -> tuple[Column, Column]:
    """(start, end) meaning of a time expression; null where it is not valid.

    A day, minute or second is inclusive: its end is its last millisecond. A local time that the clocks skip or show
    twice is not valid.
    """
    e, now = col(expression), timestamp_literal(now)
    unit = F.create_map(*[F.lit(x) for pair in UNIT_SECONDS.items() for x in pair])[F.regexp_extract(e, AGO, 2)]
    number = F.regexp_extract(e, AGO, 1).try_cast("bigint")
    micros = F.try_subtract(F.unix_micros(now), F.try_multiply(F.try_multiply(number, unit), F.lit(1_000_000)))
    relative = F.when(e == "now", now).when(e.rlike(AGO), F.timestamp_micros(micros))
    overlaps = set_back(SparkSession.getActiveSession())
    text = F.when(e.rlike(CLOCK), F.concat_ws(" ", F.date_format(now, DAY), e)).otherwise(e)
    # Relative times and days never meet the checks of local times.
    start = end = relative
    for form, spelling in SPELLINGS.items():
        instant = F.when(text.rlike(spelling), _local(text, form, overlaps))
        start = F.coalesce(start, instant)
        end = F.coalesce(end, instant + F.expr(LENGTHS[form]) - F.expr("INTERVAL '0.001' SECOND"))
    return start, end


def resolve_times(
    spark: SparkSession, expressions: list[tuple[str, bool]], now: dt.datetime | str | Column | None = None
) -> list[Column]:
    """(expression, whether its end is meant) as timestamp literals, ready to be pushed into a scan; all see one now."""
    at = F.current_timestamp() if now is None else now
    bounds = [time_bounds(F.lit(e), at)[int(end)] for e, end in expressions]
    found = spark.sql("SELECT 1").select(*[F.unix_micros(b).alias(f"t{i}") for i, b in enumerate(bounds)]).first()
    for (e, _), micros in zip(expressions, found):
        if micros is None:
            zone = spark.conf.get("spark.sql.session.timeZone")
            raise ValueError(f"Cannot read the time {e!r}: {HELP}. It must be shown exactly once by the clocks of {zone}.")
    return [F.timestamp_micros(F.lit(micros)) for micros in found]


def resolve_time(
    spark: SparkSession, expression: str, now: dt.datetime | str | Column | None = None, end: bool = False
) -> Column:
    """One expression as a timestamp literal."""
    return resolve_times(spark, [(expression, end)], now)[0]
