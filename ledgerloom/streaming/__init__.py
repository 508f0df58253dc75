"""The streaming side: rate windows, payment notices, statements as they arrive. Plans work on batch and stream tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .limits import LIMITS, WINDOW, first_hit_windows, limited_stream, rate_windows
from .payments import payment_outcomes, payment_state
from .statements import Intake

__all__ = ["LIMITS", "WINDOW", "Intake", "first_hit_windows", "limited_stream", "once", "payment_outcomes", "payment_state", "rate_windows"]


def once(notices: DataFrame, key: str, watermark: str | None = None, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The first of the notices of each key, by the columns of order; on a stream the first to arrive, and keys are remembered as long as the watermark says."""
    if watermark:
        return notices.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])
    return notices.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*notices.columns), F.struct(*order)).alias("first")).select("first.*")
