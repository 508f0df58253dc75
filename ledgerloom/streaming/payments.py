"""Payments while they happen: completions in time, late ones, and expiries, by interval joins of two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.entitle import PENDING_MINUTES


def payment_outcomes(created: DataFrame, completed: DataFrame, honour: bool = True, minutes: int = PENDING_MINUTES, late_minutes: int = 1440, watermark: str = "0 seconds") -> DataFrame:
    """reference, created, completed, outcome: what becomes of each payment, as it becomes certain.

    created: reference, created; completed: reference, completed (the first notice of a completion counts). Two joins on
    the reference and an interval of time. Completions at most `minutes` after the payment are credited; payments that
    have none by then come out of the join's outer side as Expired, once the watermark has passed. Completions after
    that, up to late_minutes, are credited_late (honour) or skipped; still later ones are not looked at. So a reference
    has one row, or Expired and then a late one: state (the last row by reference) is that of late_completion and pending_state.

    Plans work on streams and on tables; on streams each side's rows are kept as long as a partner may come.
    watermark: how late notices may be; later ones have no effect.
    """
    stream = created.isStreaming
    if stream:
        created, completed = created.withWatermark("created", watermark), completed.withWatermark("completed", watermark)
    first = completed.select("reference", "completed")
    first = first.dropDuplicatesWithinWatermark(["reference"]) if stream else first.groupBy("reference").agg(F.min("completed").alias("completed"))
    due, last = (F.col("p.created") + F.expr(f"INTERVAL {m} MINUTES") for m in (minutes, late_minutes))
    p, c = created.select("reference", "created").alias("p"), first.alias("c")
    same = F.col("p.reference") == F.col("c.reference")
    picked = (F.col("p.reference").alias("reference"), F.col("p.created").alias("created"), F.col("c.completed").alias("completed"))
    in_time = p.join(c, same & (F.col("c.completed") >= F.col("p.created")) & (F.col("c.completed") <= due), "left_outer")
    late = p.join(c, same & (F.col("c.completed") > due) & (F.col("c.completed") <= last))
    return in_time.select(*picked, F.when(F.col("c.completed").isNull(), "Expired").otherwise("credited").alias("outcome")).unionByName(late.select(*picked, F.lit("credited_late" if honour else "skipped").alias("outcome")))


def payment_state(outcomes: DataFrame) -> DataFrame:
    """reference, created, completed, outcome: the last outcome of each reference; a completion comes after an expiry."""
    return outcomes.groupBy("reference").agg(*(F.max_by(c, F.coalesce("completed", F.col("created"))).alias(c) for c in ("created", "completed", "outcome")))
