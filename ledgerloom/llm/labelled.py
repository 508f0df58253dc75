"""Labelled training rows for the classifiers: a bounded, documented sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(remainder: int, of: int, id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % of == remainder, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, remainder: int, of: int, most: int) -> DataFrame:
    """doc_id, text and y of at most `most` labelled documents that are not held out, the first by a hash of their ids.

    The sample of ids is bounded by `most`, so it can be broadcast. Rows without an id or label are left out; an id with
    several labels has the largest, one with several texts the least of them.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(remainder, of))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
