"""Validation: typed issues per row and per statement, a status and a score.

statements: doc_id, account_number, client_name, period_start, period_end, opening_c, closing_c (null: missing).
transactions: doc_id, row_idx (consecutive), date, description, amount_c, balance_c, and where known amount_raw (double).
Money is compared in cents, so nothing depends on how doubles round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, contains_any
from .ledger import by_row

# Words that tell which way money went (they match inside words too).
DEBIT_WORDS = ("fee", "charge", "withdrawal", "debit", "proof of pmt email", "admin charge", "monthly acc fee", "transaction charge", "notific fee")
CREDIT_WORDS = ("credit", "payment cr", "deposit", "acb credit", "salary", "refund", "cash deposit")
# What an error and a warning cost.
ERROR_COST, WARNING_COST = 35, 5
# What each issue says.
MESSAGES = {
    "no_transactions": "No transactions were extracted from the statement.",
    "missing_account_number": "Account number could not be extracted.",
    "missing_client_name": "Client name could not be extracted.",
    "missing_statement_period": "Statement period could not be extracted fully.",
    "missing_opening_balance": "Opening balance is missing or invalid.",
    "missing_closing_balance": "Closing balance is missing or invalid.",
    "opening_balance_precision_issue": "Opening balance has suspicious precision and may be inferred incorrectly.",
    "closing_balance_precision_issue": "Closing balance has suspicious precision.",
    "missing_date": "Transaction is missing a date.",
    "missing_description": "Transaction is missing a description.",
    "invalid_amount": "Transaction amount is missing or invalid.",
    "missing_balance": "Transaction balance is missing or invalid.",
    "zero_amount": "Transaction amount is zero. This may indicate a parsing error.",
    "amount_precision_issue": "Transaction amount has suspicious precision.",
    "possible_wrong_sign_debit": "Debit-like transaction has a positive amount.",
    "possible_wrong_sign_credit": "Credit-like transaction has a negative amount.",
    "balance_continuity_mismatch": "Balance does not reconcile cleanly with the previous row.",
    "opening_balance_mismatch": "Opening balance does not reconcile with the first transaction.",
    "closing_balance_mismatch": "Closing balance does not match the final transaction balance.",
}
# End of fixed values.

ISSUE = "doc_id long, row_idx long, severity string, issue_type string, message string, metadata map<string,string>"


def too_precise(raw: Column) -> Column:
    """Whether an amount has more than two decimals."""
    return F.coalesce(F.abs(raw * 100 - F.round(raw * 100)) > 1e-6, F.lit(False))


def _issues(rules: list[tuple[str, str, Column]]) -> Column:
    found = F.array(*(F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("issue_type"))) for severity, kind, when in rules))
    return F.filter(found, lambda x: x.isNotNull())


def _told(found: DataFrame, metadata: dict[str, tuple[Column, tuple[str, ...] | None]]) -> DataFrame:
    """ISSUE's columns from doc_id, row_idx, i: with the message, and the named values that the kind of issue is about (None: any kind); missing values are left out."""
    kind = F.col("i.issue_type")
    says = F.create_map(*(F.lit(x) for pair in MESSAGES.items() for x in pair))
    values = [(F.lit(name), F.when(kind.isin(*kinds) if kinds else F.lit(True), c.cast("string"))) for name, (c, kinds) in metadata.items()]
    about = F.map_filter(F.create_map(*(x for pair in values for x in pair)), lambda _, v: v.isNotNull())
    return found.select("doc_id", "row_idx", "i.*", says[kind].alias("message"), about.alias("metadata"))


def row_issues(transactions: DataFrame) -> DataFrame:
    """ISSUE's columns; metadata is the transaction, and where balances don't follow, the one before and the move. One window by doc_id; a row without an amount has that issue and earlier ones only."""
    raw = F.col("amount_raw") if "amount_raw" in transactions.columns else F.lit(None).cast("double")
    moved = F.col("balance_c") - F.lag("balance_c").over(by_row())
    words = F.lower(F.coalesce("description", F.lit("")))
    has = F.col("amount_c").isNotNull()
    rules = [
        ("warning", "missing_date", blank_to_null(F.col("date").cast("string")).isNull()),
        ("warning", "missing_description", blank_to_null(F.col("description")).isNull()),
        ("error", "invalid_amount", ~has),
        ("warning", "missing_balance", has & F.col("balance_c").isNull()),
        ("warning", "zero_amount", F.col("amount_c") == 0),
        ("warning", "amount_precision_issue", has & too_precise(raw)),
        ("warning", "possible_wrong_sign_debit", contains_any(words, DEBIT_WORDS) & (F.col("amount_c") > 0)),
        ("warning", "possible_wrong_sign_credit", contains_any(words, CREDIT_WORDS) & (F.col("amount_c") < 0)),
        # A balance that did not move is not judged here; operators.ledger.fee_continuity does.
        ("warning", "balance_continuity_mismatch", has & (F.col("moved") != 0) & (F.col("moved") != F.col("amount_c"))),
    ]
    found = transactions.withColumn("moved", moved).select("doc_id", F.col("row_idx").cast("long").alias("row_idx"), "date", "description", "amount_c", "balance_c", "moved", F.explode(_issues(rules)).alias("i"))
    apart = ("balance_continuity_mismatch",)
    own = {c: (F.col(c), None) for c in ("date", "description", "amount_c", "balance_c")}
    return _told(found, {**own, "previous_balance_c": (F.col("balance_c") - F.col("moved"), apart), "expected_delta_c": (F.col("moved"), apart)})


def statement_issues(statements: DataFrame, transactions: DataFrame) -> DataFrame:
    """ISSUE's columns: issues of whole statements (row_idx null, or the row that a balance disagrees with). A statement without rows has that issue alone."""
    edges = transactions.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"),
        F.min_by("amount_c", "row_idx").alias("first_amount"), F.min_by("balance_c", "row_idx").alias("first_balance"), F.max_by("balance_c", "row_idx").alias("last_balance"),
    )
    all_ = statements.join(edges, "doc_id", "left")
    some = F.col("n").isNotNull()
    empty = lambda c: blank_to_null(F.col(c).cast("string")).isNull()
    raw = lambda c: F.col(c) if c in statements.columns else F.lit(None).cast("double")
    rules = [
        ("error", "no_transactions", ~some),
        ("warning", "missing_account_number", some & empty("account_number")),
        ("warning", "missing_client_name", some & empty("client_name")),
        ("warning", "missing_statement_period", some & (empty("period_start") | empty("period_end"))),
        ("warning", "missing_opening_balance", some & F.col("opening_c").isNull()),
        ("warning", "missing_closing_balance", some & F.col("closing_c").isNull()),
        ("warning", "opening_balance_precision_issue", some & too_precise(raw("opening_raw"))),
        ("warning", "closing_balance_precision_issue", some & too_precise(raw("closing_raw"))),
        ("warning", "opening_balance_mismatch", F.col("opening_c") + F.col("first_amount") != F.col("first_balance")),
        ("warning", "closing_balance_mismatch", F.col("closing_c") != F.col("last_balance")),
    ]
    row = F.when(F.col("i.issue_type") == "opening_balance_mismatch", F.col("first_row")).when(F.col("i.issue_type") == "closing_balance_mismatch", F.col("last_row"))
    first, last, period = ("opening_balance_mismatch",), ("closing_balance_mismatch",), ("missing_statement_period",)
    return _told(all_.withColumn("i", F.explode(_issues(rules))).withColumn("row_idx", row.cast("long")), {
        "period_start": (F.col("period_start"), period), "period_end": (F.col("period_end"), period),
        "opening_c": (F.col("opening_c"), (*first, "opening_balance_precision_issue")), "closing_c": (F.col("closing_c"), (*last, "closing_balance_precision_issue")),
        "expected_first_balance_c": (F.col("opening_c") + F.col("first_amount"), first), "first_balance_c": (F.col("first_balance"), first), "last_balance_c": (F.col("last_balance"), last),
    })


def issues(statements: DataFrame, transactions: DataFrame) -> DataFrame:
    return statement_issues(statements, transactions).unionByName(row_issues(transactions))


def summary(statements: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_errors, n_warnings, status, score (0 to 1, two decimals): a row for each statement."""
    counts = found.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"), F.max(F.col("issue_type") == "no_transactions").alias("nothing"))
    out = statements.select("doc_id").join(counts, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_errors", "n_warnings")})
    points = F.greatest(F.lit(0), 100 - ERROR_COST * F.col("n_errors") - WARNING_COST * F.col("n_warnings"))
    return out.select(
        "doc_id", "n_errors", "n_warnings", F.when(F.col("n_errors") > 0, "failed").when(F.col("n_warnings") > 0, "passed_with_warnings").otherwise("passed").alias("status"),
        (F.when(F.col("nothing"), 0).otherwise(points) / F.lit(100.0)).alias("score"),
    )
