"""Sharding [native]: contiguous shards of near-equal bytes from global prefix sums.

Rows are dealt into ranges of doc_id, each range sums its sizes, an exclusive prefix sum over the few range totals
gives each range its place, and a window inside each range gives each row its own. A row goes to the shard that holds
the middle of its byte interval when all bytes are cut at n_shards equal targets, so shards are contiguous in doc_id
and differ from the target by no more than one row.

Only ids, sizes and checksums are shuffled, never texts. Defined results: a null text has no bytes and checksum 0; a
null doc_id sorts first; repeated rows and ids keep one place each, in the order of reading; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, saved, text_or_empty

ROW_BYTES = 16


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, row_bytes: int = ROW_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, start_byte, shard, slot: one row per row of docs.

    row_bytes is what each row counts beside its text. Law: `bytes` only; equal texts are not kept together, as one
    group of copies may be larger than a shard.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    # The tie tells equal ids apart, so that a repeated id can be split among ranges.
    sized = saved(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(row_bytes)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),
    ))
    # The range number is written as data: a task that runs again cannot change it.
    ranged = saved(sized.repartitionByRange(partitions(spark), F.asc_nulls_first("doc_id"), "tie").withColumn("range", F.spark_partition_id()))
    totals = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, so at most as many as there are shuffle partitions: one task and a broadcast will do.
    places = totals.select(
        "range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("range").orderBy(F.asc_nulls_first("doc_id"), "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged.withColumn("upto", F.sum("size").over(inside))
        .withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(places), "range")
        .select(
            "doc_id", "size", "text_crc32",
            (F.col("bytes_before") + F.col("upto") - F.col("size")).alias("start_byte"),
            (F.col("rows_before") + F.col("nth") - 1).alias("place"),
            F.least(F.lit(n_shards - 1), F.expr(f"((2 * (bytes_before + upto) - size) * {n_shards} div (2 * greatest(all_bytes, 1)))")).cast("int").alias("shard"),
        )
    )
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first_place"))  # at most n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "start_byte", "shard", (F.col("place") - F.col("first_place")).alias("slot"))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_by_bytes(docs, 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "start_byte",
    )
