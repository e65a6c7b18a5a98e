"""Names of topics and partitions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglens.functions.text import col

# Fixed value: "name-N" addresses partition N of topic "name" (greedy name).
TOPIC_PARTITION = r"^(.+)-([0-9]+)$"


def split_topic_partition(selector: Column | str) -> tuple[Column, Column, Column]:
    """Topic, partition and whether a partition was written, from ``topic`` or ``topic-N``.

    The partition is null when none was written and also when the number does
    not fit an int; the third column tells these apart.
    """
    c = col(selector)
    named = c.rlike(TOPIC_PARTITION)
    topic = F.when(named, F.regexp_extract(c, TOPIC_PARTITION, 1)).otherwise(c)
    partition = F.when(named, F.regexp_extract(c, TOPIC_PARTITION, 2).try_cast("int"))
    return topic, partition, named


def parse_selector(selector: str) -> tuple[str, int | None]:
    """One selector on the driver, so that it becomes a literal predicate."""
    match = re.match(TOPIC_PARTITION, selector)
    if not match:
        return selector, None
    partition = int(match.group(2))
    if partition > 2**31 - 1:
        raise ValueError(f"Partition {partition} of {match.group(1)} is not a valid partition number.")
    return match.group(1), partition
