"""Validation of ledgers that were spoilt on purpose, so that every rule fires."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import validate as V
from .base import LEDGER_SQL, OPENING_C, ledger, table


def spoilt(spark, d) -> tuple[DataFrame, DataFrame]:
    """(statements, transactions): by order number some balances are off or missing, amounts zero, missing or too precise, dates and descriptions missing; by customer some headers are."""
    k = F.col("o_orderkey")
    rows = ledger(spark, d).select(
        "doc_id", "row_idx", F.when(k % 13 == 0, None).otherwise(F.col("day").cast("string")).alias("date"),
        F.when(k % 17 == 0, "").when(k % 4 == 0, "Coffee").when(k % 4 == 1, "Cash deposit").otherwise("Order").alias("description"),
        F.when(k % 11 == 0, 0).when(k % 19 == 0, None).otherwise(F.col("amount_c")).alias("amount_c"),
        F.when(k % 23 == 0, None).when(k % 7 == 0, F.col("balance_c") + 1).otherwise(F.col("balance_c")).alias("balance_c"),
        F.when(k % 29 == 0, F.lit(1.005)).otherwise(F.lit(1.5)).alias("amount_raw"),
    )
    c = F.col("c_custkey")
    heads = table(spark, d, "customer").select(
        c.alias("doc_id"), F.when(c % 3 == 0, "").otherwise("123").alias("account_number"), F.when(c % 4 == 0, None).otherwise("x").alias("client_name"), F.when(c % 5 == 0, None).otherwise("a").alias("period_start"), F.lit("b").alias("period_end"),
        F.when(c % 6 == 0, None).otherwise(F.lit(OPENING_C)).cast("long").alias("opening_c"), F.when(c % 7 == 0, None).otherwise(F.lit(1)).cast("long").alias("closing_c"), F.when(c % 8 == 0, F.lit(0.125)).alias("opening_raw"),
    )
    return heads, rows


def issue_rows(spark, d) -> DataFrame:
    found = V.issues(*spoilt(spark, d))
    return found.select("doc_id", F.coalesce("row_idx", F.lit(-1)).alias("row_idx"), "severity", "issue_type")


def issue_messages(spark, d) -> DataFrame:
    """What each issue says, and some of the values that it is about."""
    found = V.issues(*spoilt(spark, d))
    about = [F.col("metadata")[c].alias(c) for c in ("amount_c", "previous_balance_c", "expected_delta_c", "period_end", "opening_c", "expected_first_balance_c", "last_balance_c")]
    return found.select("doc_id", F.coalesce("row_idx", F.lit(-1)).alias("row_idx"), "issue_type", "message", *about)


def issue_summary(spark, d) -> DataFrame:
    heads, rows = spoilt(spark, d)
    return V.summary(heads, V.issues(heads, rows))


QUERIES = {f.__name__: f for f in (issue_rows, issue_messages, issue_summary)}

_ISSUES = f"""{LEDGER_SQL}, rows_ AS (
  SELECT doc_id, row_idx, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(day AS VARCHAR) END AS date,
    CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 4 = 0 THEN 'coffee' WHEN o_orderkey % 4 = 1 THEN 'cash deposit' ELSE 'order' END AS words,
    CASE WHEN o_orderkey % 11 = 0 THEN 0 WHEN o_orderkey % 19 = 0 THEN NULL ELSE amount_c END AS a,
    CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN balance_c + 1 ELSE balance_c END AS b, o_orderkey % 29 = 0 AS precise_ FROM ledger
), moves AS (SELECT *, b - lag(b) OVER (PARTITION BY doc_id ORDER BY row_idx) AS m FROM rows_), heads AS (
  SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE {OPENING_C} END AS o, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 1 END AS c FROM customer
), edges AS (SELECT doc_id, min(row_idx) AS lo, max(row_idx) AS hi FROM rows_ GROUP BY doc_id), found AS (
  SELECT doc_id, row_idx, 'warning' AS severity, 'missing_date' AS issue_type FROM moves WHERE date IS NULL
  UNION ALL SELECT doc_id, row_idx, 'warning', 'missing_description' FROM moves WHERE words = ''
  UNION ALL SELECT doc_id, row_idx, 'error', 'invalid_amount' FROM moves WHERE a IS NULL
  UNION ALL SELECT doc_id, row_idx, 'warning', 'missing_balance' FROM moves WHERE a IS NOT NULL AND b IS NULL
  UNION ALL SELECT doc_id, row_idx, 'warning', 'zero_amount' FROM moves WHERE a = 0
  UNION ALL SELECT doc_id, row_idx, 'warning', 'amount_precision_issue' FROM moves WHERE a IS NOT NULL AND precise_
  UNION ALL SELECT doc_id, row_idx, 'warning', 'possible_wrong_sign_debit' FROM moves WHERE words = 'coffee' AND a > 0
  UNION ALL SELECT doc_id, row_idx, 'warning', 'possible_wrong_sign_credit' FROM moves WHERE words = 'cash deposit' AND a < 0
  UNION ALL SELECT doc_id, row_idx, 'warning', 'balance_continuity_mismatch' FROM moves WHERE a IS NOT NULL AND m <> 0 AND m <> a
  UNION ALL SELECT doc_id, -1, 'error', 'no_transactions' FROM heads WHERE doc_id NOT IN (SELECT doc_id FROM rows_)
  UNION ALL SELECT doc_id, -1, 'warning', 'missing_account_number' FROM edges WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, -1, 'warning', 'missing_client_name' FROM edges WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, -1, 'warning', 'missing_statement_period' FROM edges WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, -1, 'warning', 'missing_opening_balance' FROM edges WHERE doc_id % 6 = 0
  UNION ALL SELECT doc_id, -1, 'warning', 'missing_closing_balance' FROM edges WHERE doc_id % 7 = 0
  UNION ALL SELECT doc_id, -1, 'warning', 'opening_balance_precision_issue' FROM edges WHERE doc_id % 8 = 0
  UNION ALL SELECT doc_id, row_idx, 'warning', 'opening_balance_mismatch' FROM rows_ JOIN edges USING (doc_id) JOIN heads USING (doc_id) WHERE row_idx = lo AND o + a <> b
  UNION ALL SELECT doc_id, row_idx, 'warning', 'closing_balance_mismatch' FROM rows_ JOIN edges USING (doc_id) JOIN heads USING (doc_id) WHERE row_idx = hi AND c <> b
)"""

ORACLES = {
    "issue_rows": f"WITH {_ISSUES} SELECT doc_id, CAST(row_idx AS BIGINT) AS row_idx, severity, issue_type FROM found",
    "issue_messages": f"""WITH {_ISSUES}, says(issue_type, message) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in V.MESSAGES.items())}), k AS (
          SELECT *, issue_type LIKE '%ing_balance_mismatch' AS edge, issue_type = 'balance_continuity_mismatch' AS apart, issue_type = 'opening_balance_mismatch' AS opens FROM found
        ) SELECT k.doc_id, CAST(k.row_idx AS BIGINT) AS row_idx, issue_type, message, CASE WHEN NOT edge THEN CAST(a AS VARCHAR) END AS amount_c, CASE WHEN apart THEN CAST(b - m AS VARCHAR) END AS previous_balance_c, CASE WHEN apart THEN CAST(m AS VARCHAR) END AS expected_delta_c,
          CASE WHEN issue_type = 'missing_statement_period' THEN 'b' END AS period_end, CASE WHEN opens OR issue_type = 'opening_balance_precision_issue' THEN CAST(o AS VARCHAR) END AS opening_c,
          CASE WHEN opens THEN CAST(o + a AS VARCHAR) END AS expected_first_balance_c, CASE WHEN issue_type = 'closing_balance_mismatch' THEN CAST(b AS VARCHAR) END AS last_balance_c
        FROM k JOIN says USING (issue_type) LEFT JOIN moves mv ON mv.doc_id = k.doc_id AND mv.row_idx = k.row_idx LEFT JOIN heads h ON h.doc_id = k.doc_id""",
    "issue_summary": f"""WITH {_ISSUES}, n AS (SELECT doc_id, count(*) FILTER (WHERE severity = 'error') AS e, count(*) FILTER (WHERE severity = 'warning') AS w, bool_or(issue_type = 'no_transactions') AS none_ FROM found GROUP BY doc_id)
        SELECT h.doc_id, coalesce(e, 0) AS n_errors, coalesce(w, 0) AS n_warnings, CASE WHEN e > 0 THEN 'failed' WHEN w > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS status,
          CASE WHEN none_ THEN 0.0 ELSE greatest(0, 100 - 35 * coalesce(e, 0) - 5 * coalesce(w, 0)) / CAST(100 AS DOUBLE) END AS score FROM heads h LEFT JOIN n USING (doc_id)""",
}
