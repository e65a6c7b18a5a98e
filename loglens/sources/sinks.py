"""Lines out: one line per record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from loglens.functions.render import render_line


def to_lines(log: DataFrame) -> DataFrame:
    """Column ``line`` of a log with rendered payloads (``with_payloads``)."""
    return log.select(render_line().alias("line"))


def write_lines(log: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
    to_lines(log).write.mode(mode).option("compression", compression).text(path)


def stream_lines(log: DataFrame, format: str = "console") -> DataStreamWriter:
    """A writer to start; the console shows whole lines."""
    writer = to_lines(log).writeStream.format(format).outputMode("append")
    return writer.option("truncate", "false") if format == "console" else writer
