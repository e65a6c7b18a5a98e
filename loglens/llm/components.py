"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import written

#: Tasks that share the links of one node.
PARTS = 64


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link to another; root is the smallest node of its component.

    Alternates large and small stars: each node passes its smallest neighbour on to its larger neighbours, then to the
    others. The number of rounds grows with the logarithm of a component's size, each round's links are a table in
    the shared folder, and no node's neighbours are ever gathered: minima are combined before the shuffle, and the links
    of a node, a large component's root for one, meet their minimum in up to PARTS places.
    """
    edges = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u <> v").distinct()
    edges = written(edges, "links")
    seen = None
    while True:
        both = edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        both = both.withColumn("part", F.pmod(F.xxhash64("u"), F.lit(PARTS)))
        parts = both.groupBy("v", "part").agg(F.min("u").alias("m"))
        least = parts.groupBy("v").agg(F.least(F.min("m"), F.col("v")).alias("m"))
        spread = parts.select("v", "part").join(least, "v")
        large = both.where("u > v").join(spread, ["v", "part"]).select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        small = (
            least.select("v", F.col("m").alias("u"))
            .unionByName(small.select(F.col("u").alias("v"), F.col("m").alias("u")))
            .where("u <> v")
            .distinct()
        )
        edges = written(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    ends = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return ends.unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
