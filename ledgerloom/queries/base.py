"""Ledgers and rendered statements made of the driver's tables, which the queries of several families start from.

A customer is a document and their orders, by date and number, its rows. An amount is the order's price in cents rather
than whole units, owed if the order's number is a multiple of three; its day is ten years later, as statements are of
2000 or later; the opening balance is 100,000.00.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import as_text
from ..plans.stages import compiled

OPENING_C = 10_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    compiled(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, row_idx (from 1), day, o_orderkey, amount_c, balance_c."""
    w = Window.partitionBy("doc_id").orderBy("day", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), "o_orderkey", F.add_months(F.col("o_orderdate").cast("date"), 120).alias("day"),
        (F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(1) * F.floor("o_totalprice").cast("long")).alias("amount_c"),
    )
    return rows.withColumn("row_idx", F.row_number().over(w).cast("long")).withColumn("balance_c", OPENING_C + F.sum("amount_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))


LEDGER_SQL = f"""
base AS (
  SELECT o_custkey AS doc_id, o_orderkey, CAST(o_orderdate + INTERVAL 10 YEAR AS DATE) AS day, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * CAST(floor(o_totalprice) AS BIGINT) AS amount_c,
    row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate + INTERVAL 10 YEAR AS DATE), o_orderkey) AS row_idx
  FROM orders
), ledger AS (
  SELECT *, CAST({OPENING_C} + sum(amount_c) OVER (PARTITION BY doc_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance_c FROM base
)"""


def rendered(rows: DataFrame, line: Column, head: Column | str = "", foot: Column | str = "") -> DataFrame:
    """doc_id, text: the lines of each document in order between a head and a foot."""
    head, foot = (F.lit(x) if isinstance(x, str) else x for x in (head, foot))
    grouped = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", line.alias("line")))).alias("l"))
    return grouped.select("doc_id", F.concat(head, F.array_join("l.line", "\n"), foot).alias("text"))


def printed(day: Column) -> Column:
    return F.date_format(day, "dd/MM/yyyy")


def rands(c: Column) -> Column:
    """-R1,234.56"""
    return F.concat(F.when(c < 0, "-").otherwise(""), F.lit("R"), as_text(F.abs(c)))
