"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn, limit: int, max_chars: int) -> DataFrame:
    """(text, y) of at most limit learning documents, the same ones in every run and for any partitioning.

    Labels are taken in the order of a hash of their id, so the sample is spread evenly. Of several labels of one
    id the largest counts. Null labels, null ids and null texts aren't learnt from; nor are texts of more than max_chars
    characters, which bounds the sample's size. An id given to several documents brings them all, equal rows once; if
    they are more than limit, those with the smallest hashes of id and text are taken, which executors find out.
    """
    ids = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("_id").isNotNull() & F.col("y").isNotNull() & learn(F.col("_id")))
        .groupBy("_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(limit)
    )
    texts = docs.select(F.col("doc_id").alias("_id"), "text").where(F.length("text") <= max_chars)
    rows = texts.join(F.broadcast(ids), "_id").select("text", (F.col("y") > 0).cast("int").alias("y"), F.xxhash64("_id", "text").alias("_h"))
    first = rows.select("_h").distinct().orderBy("_h").limit(limit).agg(F.max("_h")).first()[0]
    return rows.where(F.col("_h") <= F.lit(first)).dropDuplicates(["_h"]).select("text", "y")
