"""One shape for all banks' rows and statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import blank_to_null, contains_any
from .classify import FEE_FOLLOWUPS, REVERSAL, SUMMARY_PHRASES, bank_name


def plain_rows(rows: DataFrame) -> DataFrame:
    """Trimmed texts, nothing else changed."""
    return rows.withColumns({"date": F.trim("date"), "description": F.trim("description")})


def removed(description: Column) -> Column:
    """Rows that are summaries, markers, reversals or fees that follow one."""
    d = F.upper(F.coalesce(description, F.lit("")))
    return contains_any(d, (REVERSAL, *FEE_FOLLOWUPS, *SUMMARY_PHRASES)) | (d == "##")


def standard_rows(rows: DataFrame, period_end: Column, default_year: int = 2026) -> DataFrame:
    """Rows that are not removed; implausible dates (dd/MM/yyyy text) read from the description; credits positive."""
    d = F.trim(F.coalesce("description", F.lit("")))
    upper = F.upper(d)
    kept = rows.where(~removed(F.col("description")))
    return kept.withColumns({
        "date": F.when(dates.plausible(F.col("date")), F.col("date")).otherwise(dates.from_description(d, dates.end_year(period_end, default_year))),
        "description": d,
        "amount_c": F.when(upper.contains("CREDIT") & ~upper.contains("DEBIT"), F.abs("amount_c")).otherwise(F.col("amount_c")),
    })


def statement_envelope(headers: DataFrame) -> DataFrame:
    """Statements with a bank's name for the bank or subtype found, empty texts as null, and all fields in one order."""
    kind = F.when(F.coalesce("bank_name", F.lit("unknown")) != "unknown", F.col("bank_name")).otherwise(F.col("document_subtype"))
    text = lambda c: blank_to_null(F.col(c)).alias(c)
    return headers.select("doc_id", bank_name(kind).alias("bank_name"), text("account_number"), text("client_name"), text("period_start"), text("period_end"), "opening_c", "closing_c", text("source_file"))


def debit_credit(rows: DataFrame) -> DataFrame:
    """rows with debit_c and credit_c, each null where the amount is the other's."""
    return rows.withColumns({"debit_c": F.when(F.col("amount_c") < 0, -F.col("amount_c")), "credit_c": F.when(F.col("amount_c") > 0, F.col("amount_c"))})
