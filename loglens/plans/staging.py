"""Computing a column once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``withColumns`` whose results are read, not computed again, by what follows.

    The optimizer moves filters below projections by copying their expressions,
    which repeats expensive ones (parsing, Python) for every mention. A lateral
    table of one row is not copied: filters on its columns stay above it, while
    filters on other columns still reach the scan.
    """
    lateral = F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return df.select("*", lateral)
