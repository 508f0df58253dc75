"""Header fields of each layout, rendered from customers in the spellings that the rules know, and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import as_text
from ..operators import metadata as M
from ..operators import segment as S
from .base import rands, table


def _texts(spark, d, body) -> DataFrame:
    """doc_id, text: body(number, account of ten digits, balance in cents) of each customer."""
    k, cents = F.col("c_custkey"), F.abs(F.round(F.col("c_acctbal").cast("decimal(18,2)") * 100)).cast("long")
    return table(spark, d, "customer").select(k.alias("doc_id"), body(k, F.lpad(k.cast("string"), 10, "7"), cents).alias("text"))


def _parted(account: Column, by: str) -> Column:
    return F.concat_ws(by, F.substring(account, 1, 2), F.substring(account, 3, 4), F.substring(account, 7, 4))


def _one_of(k: Column, *texts) -> Column:
    """The text whose place is the number modulo their count."""
    parts = [F.lit(t) if isinstance(t, str) else t for t in texts]
    out = F.when(k % len(parts) == 0, parts[0])
    for i, t in enumerate(parts[1:], 1):
        out = out.when(k % len(parts) == i, t)
    return out


def meta_absa(spark, d) -> DataFrame:
    return M.absa(_texts(spark, d, lambda k, account, cents: F.concat(
        F.lit("Absa Bank\n"), _one_of(k, F.concat(F.lit("Cheque Account Number: "), _parted(account, "-")), F.concat(F.lit("Account Number: "), account), F.concat(F.lit("No. 1\n"), account)),
        _one_of(k, "\nCheque account statement ACME AND SONS 40-1234-5678", "\nACME AND SONS 40-1234-5678"), F.lit("\n1 Jan 2005 to 31 Dec 2011\nx Bal Brought Forward "), F.replace(as_text(cents, " "), F.lit("."), F.lit(",")), _one_of(k, "-", "", "", "", ""), F.lit("\n"),
    )))


def meta_capitec(spark, d) -> DataFrame:
    return M.capitec(_texts(spark, d, lambda k, account, cents: F.concat(
        F.lit("Capitec Bank Limited\nUnique Document No.: ab-"), k.cast("string"), _one_of(k, "\nAccount\n", "\nNo 1\n"), account, _one_of(k, "\nMain Account Statement\nMR JOHN DOE\n", " x\nMRS JANE DOE\n", "\n"),
    )))


def meta_fnb(spark, d) -> DataFrame:
    return M.fnb(_texts(spark, d, lambda k, account, cents: F.concat(
        F.lit("First National Bank\n"), _one_of(k, "Gold Business Account : ", "Account number ", "No "), F.lpad(k.cast("string"), 11, "6"), _one_of(k, "\n*ACME LTD  x\n", "\n*ACME LTD\n"),
        F.lit("Tax Invoice/Statement Number : "), k.cast("string"), F.lit("\nStatement Date : 31 December 2009\nStatement Period : 1 January 2009 to 31 December 2009\n2009/12/31\nOpening Balance "), as_text(cents), _one_of(k, " Cr", "Dr", ""),
        F.lit("\nClosing Balance "), as_text(cents), _one_of(k, "Dr", " Cr"), F.lit("\nTotal VAT charged "), as_text(cents), _one_of(k, " Dr", " Cr"), F.lit("\n"),
    )))


def meta_nedbank(spark, d) -> DataFrame:
    return M.nedbank(_texts(spark, d, lambda k, account, cents: F.concat(
        F.lit("Nedbank Ltd\n"), _one_of(k, F.concat(F.lit("Account number "), account), F.concat(F.lit("Account number\n"), account), F.concat(F.lit("No 1605"), F.lpad(k.cast("string"), 6, "0"))), _one_of(k, "\nMr JOHN DOEMANN\n", "\n"),
    )))


def meta_discovery(spark, d) -> DataFrame:
    return M.discovery(_texts(spark, d, lambda k, account, cents: F.concat(
        F.lit("Discovery Bank Limited\nTransaction Account: "), account, F.lit("\nProf Jane Doe\n"), _one_of(k, "", F.concat(F.lit("Opening balance "), rands(cents), F.lit("\n"))), F.lit("Closing balance: "), rands(-cents), F.lit("\n"),
    )))


def meta_standard(spark, d) -> DataFrame:
    return M.standard_bank(_texts(spark, d, lambda k, account, cents: F.concat(F.lit("Account Number "), _parted(account, " "), F.lit("\n"), _one_of(k, "mr. john  doe\n", "MR. JOHN DOE\n", "x\n"))))


def meta_mended(spark, d) -> DataFrame:
    """Balances with a piece of a date or a stray digit before them, and the name before a formatted account number."""
    docs = _texts(spark, d, lambda k, account, cents: F.concat(
        _one_of(k, F.concat(F.lit("BALANCE BROUGHT FORWARD 05 "), as_text(cents)), "Balance brought forward 12934567.89", ""), F.lit("\nMonth-end BalanceR"), as_text(cents), _one_of(k, "-", ""), _one_of(k, "\nCheque account statement ACME 40-1234-5678", "\n"),
    ))
    t = F.col("text")
    return docs.select("doc_id", M.mended_opening(t).alias("opening_c"), M.mended_closing(t).alias("closing_c"), M.absa_client(t).alias("client_name"))


def meta_closing(spark, d) -> DataFrame:
    """A closing balance by each of its labels, and by a line that ends in a balance."""
    docs = _texts(spark, d, lambda k, account, cents: F.concat(_one_of(k, "closing balance ", "Final balance: ", "CURRENT BALANCE R", "Month-end Balance", "x Balance ", "Balance due "), as_text(cents), F.lit("\nend")))
    return docs.select("doc_id", M.closing_balance(F.col("text")).alias("closing_c"))


def meta_label(spark, d) -> DataFrame:
    """Account numbers beside a label or on the line after it, in the first lines of a text."""
    docs = _texts(spark, d, lambda k, account, cents: F.concat(_one_of(k, "", F.repeat(F.lit("line\n"), 60)), _one_of(k, F.concat(F.lit("Account number: "), account), F.concat(F.lit("Account number\n"), account), F.concat(F.lit("Number "), account)), F.lit("\n")))
    return docs.select("doc_id").join(M.account_by_label(S.lines(docs)), "doc_id", "left")


def header_fnb(spark, d) -> DataFrame:
    return M.strict_header(_texts(spark, d, lambda k, account, cents: F.concat(
        F.when(k % 4 == 0, "").otherwise("MR JOHN SMITH\n"), F.when(k % 4 == 1, "").otherwise(F.when(k % 8 < 4, F.concat(F.lit("Account : "), account)).otherwise(F.concat(account, F.lit(" FNB")))), F.when(k % 4 == 2, "").otherwise("\nStaat Periode : 1 Januarie 2001 tot 28 Februarie 2001\n"),
    )), "fnb")


def header_summary(spark, d) -> DataFrame:
    docs = _texts(spark, d, lambda k, account, cents: _one_of(
        k, F.concat(F.lit("Statement MR JOHN DOE "), _parted(account, "-")),
        F.concat(F.lit("Account number "), account, F.lit(" Mr JOHN DOE. Statement date: 31/01/2001 Statement period: 01/01/2001 - 31/01/2001 Opening balance R"), as_text(cents), F.lit(" Closing balance "), as_text(cents)),
        F.concat(F.lit("Account Number "), _parted(account, " "), F.lit(" MR. JOHN DOE 31 January 2001 Statement from 1 January 2001 to 31 January 2001 BANK STATEMENT BALANCE BROUGHT FORWARD 01 02 "), as_text(cents), F.lit("- Balance outstanding at date of statement "), as_text(cents)),
    ))
    parts = [M.summary_header(docs.where(F.col("doc_id") % 3 == i), bank) for i, bank in enumerate(("absa", "nedbank", "standard_bank"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {f.__name__: f for f in (meta_absa, meta_capitec, meta_fnb, meta_nedbank, meta_discovery, meta_standard, meta_mended, meta_closing, meta_label, header_fnb, header_summary)}

_C = "WITH c AS (SELECT c_custkey AS k, lpad(CAST(c_custkey AS VARCHAR), 10, '7') AS a, CAST(abs(round(CAST(c_acctbal AS DECIMAL(18,2)) * 100)) AS BIGINT) AS b FROM customer)"
_NO = "CAST(NULL AS VARCHAR)"
ORACLES = {
    "meta_absa": f"{_C} SELECT k AS doc_id, 'ABSA' AS bank_name, a AS account_number, 'ACME AND SONS' AS client_name, '1 Jan 2005' AS period_start, '31 Dec 2011' AS period_end, CASE WHEN k % 5 = 0 THEN -b ELSE b END AS opening_c FROM c",
    "meta_capitec": f"{_C} SELECT k AS doc_id, 'Capitec' AS bank_name, a AS account_number, CASE k % 3 WHEN 0 THEN 'MR JOHN DOE' WHEN 1 THEN 'MRS JANE DOE' END AS client_name, 'ab-' || k AS statement_id FROM c",
    "meta_fnb": f"""{_C} SELECT k AS doc_id, 'First National Bank' AS bank_name, lpad(CAST(k AS VARCHAR), 11, '6') AS account_number, 'ACME LTD' AS client_name, CAST(k AS VARCHAR) AS statement_id, '31 December 2009' AS statement_date, '1 January 2009' AS period_start, '31 December 2009' AS period_end,
        CASE WHEN k % 3 = 0 THEN b ELSE -b END AS opening_c, CASE WHEN k % 2 = 1 THEN b ELSE -b END AS closing_c, CASE WHEN k % 2 = 1 THEN b ELSE -b END AS total_vat_c, 2009 AS year FROM c""",
    "meta_nedbank": f"{_C} SELECT k AS doc_id, 'Nedbank' AS bank_name, CASE WHEN k % 3 = 2 THEN '1605' || lpad(CAST(k AS VARCHAR), 6, '0') ELSE a END AS account_number, CASE WHEN k % 2 = 0 THEN 'Mr JOHN DOEMANN' END AS client_name FROM c",
    "meta_discovery": f"{_C} SELECT k AS doc_id, 'Discovery' AS bank_name, a AS account_number, 'Prof Jane Doe' AS client_name, CASE WHEN k % 2 = 1 THEN b ELSE 0 END AS opening_c, -b AS closing_c FROM c",
    "meta_standard": f"{_C} SELECT k AS doc_id, 'Standard Bank' AS bank_name, a AS account_number, CASE WHEN k % 3 < 2 THEN 'MR. JOHN DOE' END AS client_name FROM c",
    "meta_mended": f"{_C} SELECT k AS doc_id, CASE k % 3 WHEN 0 THEN b WHEN 1 THEN 123456789 END AS opening_c, CASE WHEN k % 2 = 0 THEN -b ELSE b END AS closing_c, CASE WHEN k % 2 = 0 THEN 'ACME' END AS client_name FROM c",
    "meta_closing": f"{_C} SELECT k AS doc_id, CASE WHEN k % 6 < 5 THEN b END AS closing_c FROM c",
    "meta_label": f"{_C} SELECT k AS doc_id, CASE WHEN k % 2 = 0 AND k % 3 < 2 THEN a END AS account_number FROM c",
    "header_fnb": f"""{_C} SELECT k AS doc_id, CASE WHEN k % 4 <> 0 THEN 'JOHN SMITH' END AS full_name, CASE WHEN k % 4 <> 1 THEN a END AS account_number, CASE WHEN k % 4 <> 2 THEN '2001-01-01' END AS period_from, CASE WHEN k % 4 <> 2 THEN '2001-02-28' END AS period_to, CAST(NULL AS BIGINT) AS opening_c, CAST(NULL AS BIGINT) AS closing_c,
        CASE k % 4 WHEN 0 THEN 'METADATA_NAME_NOT_FOUND' WHEN 1 THEN 'METADATA_ACCOUNT_NOT_FOUND' WHEN 2 THEN 'METADATA_PERIOD_NOT_FOUND' END AS error_code FROM c""",
    "header_summary": f"""{_C} SELECT k AS doc_id, a AS account_number, CASE k % 3 WHEN 0 THEN 'MR JOHN DOE' WHEN 1 THEN 'Mr JOHN DOE' ELSE 'MR. JOHN DOE' END AS client_name, CASE k % 3 WHEN 1 THEN '31/01/2001' WHEN 2 THEN '31 January 2001' END AS statement_date,
        CASE k % 3 WHEN 1 THEN '01/01/2001' WHEN 2 THEN '1 January 2001' END AS period_start, CASE k % 3 WHEN 1 THEN '31/01/2001' WHEN 2 THEN '31 January 2001' END AS period_end, CASE k % 3 WHEN 1 THEN b WHEN 2 THEN -b END AS opening_c, CASE WHEN k % 3 > 0 THEN b END AS closing_c FROM c""",
}
