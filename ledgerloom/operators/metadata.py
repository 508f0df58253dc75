"""Header fields by ordered patterns: the first that matches and passes its check. Narrow projections only.

What is missing is null, never a word for it. Balances are cents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, money
from ..functions.text import bind, blank_to_null, first_match, squeeze

_I = "(?i)"
# Header patterns, in order of precedence.
ACCOUNT_PATTERNS = (
    r"account number[:\s]*([0-9][0-9\s]{6,30})",
    r"acc(?:ount)?\s*(?:no|number)?[:\s]*([0-9][0-9\s]{6,30})",
    r"account no[:\s]*([0-9][0-9\s]{6,30})",
    r"cheque account number[:\s]*([0-9][0-9\s-]{6,30})",
    r"cheque account[:\s]*([0-9][0-9\s-]{6,30})",
    r"\b(\d{2}-\d{4}-\d{4})\b",
    r"\b(\d{10,12})\b",
)
CLIENT_PATTERNS = (
    r"Cheque account statement\s+([A-Z][A-Z0-9\s&'.()/-]{5,120}?)\s+40-\d{4}-\d{4}",
    r"account holder[:\s]+([A-Z][A-Z\s'.&/-]{3,120})",
    r"customer name[:\s]+([A-Z][A-Z\s'.&/-]{3,120})",
    r"\b(MR\.\s+[A-Z][A-Z\s'.&-]{2,80})\b",
    r"\b(MRS\.\s+[A-Z][A-Z\s'.&-]{2,80})\b",
    r"\b(MS\.\s+[A-Z][A-Z\s'.&-]{2,80})\b",
    r"(?m)^\s*([A-Z][A-Z0-9\s&'.()/-]{5,120}\b(?:CC|PTY LTD|LIMITED|LTD))\s*$",
    r"(?m)^\s*([A-Z][A-Z0-9\s&'.()/-]{5,120})\s*\nPOSTNET SUITE",
)
NOT_A_CLIENT = r"(?i)date\s*transaction\s*description|charge\s*debit\s*amount\s*credit\s*amount\s*balance|absa bank limited"
OPENING_LABELS = ("opening balance", "balance brought forward", "bal brought forward")
CLOSING_LABELS = ("closing balance", "final balance", "current balance", "Month-end BalanceR?")
CLOSING_LINE = r"(?im)\bBalance[: \t]*R?[ \t]*([0-9][0-9,. ]*-?)[ \t]*$"
_DAY = r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}"
PERIOD_PATTERNS = (
    rf"statement period[:\s]+({_DAY})\s+(?:to|-)\s+({_DAY})",
    rf"period[:\s]+({_DAY})\s+(?:to|-)\s+({_DAY})",
    rf"from[:\s]+({_DAY})\s+(?:to|-)\s+({_DAY})",
    r"Statement from\s+([0-9]{1,2}\s+[A-Za-z]+\s+[0-9]{4})\s+to\s+([0-9]{1,2}\s+[A-Za-z]+\s+[0-9]{4})",
    r"Your transactions\s*([0-9]{1,2}\s+[A-Za-z]{3,9}\s+[0-9]{4})\s*to\s*([0-9]{1,2}\s+[A-Za-z]{3,9}\s+[0-9]{4})",
)
_ABSA_NUMBER, _ABSA_DAY = r"([0-9]{2}[-\s]?[0-9]{4}[-\s]?[0-9]{4})", r"\d{1,2}\s+[A-Za-z]{3}\s+\d{4}"
ABSA_ACCOUNT = (rf"(?i)Cheque\s+Account\s+Number[:\s]*{_ABSA_NUMBER}", rf"(?i)Account\s+Number[:\s]*{_ABSA_NUMBER}", r"\b(\d{10})\b", r"\b(\d{2}[-\s]?\d{4}[-\s]?\d{4})\b")
ABSA_CLIENT = (r"(?i)Cheque account statement\s+([A-Z0-9&.,'()\-/ ]+?)\s+\d{2}[-\s]?\d{4}[-\s]?\d{4}", r"\b([A-Z][A-Z0-9&.,'()\-/ ]{5,})\s+\d{2}[-\s]?\d{4}[-\s]?\d{4}\b")
ABSA_PERIOD = rf"(?i)\b({_ABSA_DAY})\s+to\s+({_ABSA_DAY})\b"
# A date may follow the amount on its line; it is no part of it.
ABSA_OPENING = r"(?i)Bal(?:ance)?\s+Brought\s+Forward\s+(-?[0-9][0-9 ]*(?:[.,][0-9]{2})-?)"
CAPITEC_ACCOUNT = (r"(?i)Account\s*\n\s*(\d{10,})", r"\b(\d{10,11})\b")
CAPITEC_CLIENT = (r"(?i)Main Account Statement\s*\n\s*((?:MR|MRS|MS|DR)[ \t]+[A-Z \t]+)", r"\b((?:MR|MRS|MS|DR)\s+[A-Z]+\s+[A-Z]+)")
CAPITEC_ID = r"(?i)Unique Document No\.:\s*([a-f0-9\-]+)"
FNB_ACCOUNT = (r"(?i)Gold Business Account\s*:\s*(\d+)", r"(?i)Account\D*?(\d{11})", r"(\d{11})")
FNB_CLIENT = (r"\*(.+?)\s{2,}", r"\*(.+?)\n")
FNB_ID = r"(?i)Tax Invoice/Statement Number\s*:\s*(\d+)"
FNB_DATE = r"(?i)Statement Date\s*:\s*(.+)"
FNB_PERIOD = r"(?i)Statement Period\s*:\s*(.+?)\s*to\s*(.+)"
FNB_VAT = rf"(?i)Total VAT.*?({money.AMOUNT})\s*(Dr|Cr)"
FNB_YEAR = r"(20\d{2})/\d{2}/\d{2}"
NEDBANK_ACCOUNT = (r"(?i)Account\s*number[^\n\d]*(\d{10})", r"(?i)Account\s*number[^\n]*\n\s*(\d{10})\s*(?:\n|\z)", r"(1605\d{6})")
NEDBANK_CLIENT = r"(?i)((?:Mr|Mrs|Ms|Dr|Prof)[ \t]+[A-Z \t]{5,})"
NEDBANK_CLOSING = r"(?im)^[ \t]*\d{2}/\d{2}/\d{4}[^\n]*Closing\s*balance[^\n]*"
_RAND = r"(-?\s?R[\d\s,.]+\.\d{2})"
DISCOVERY_ACCOUNT = r"(?i)Transaction Account[^\d]*(\d{10,15})"
DISCOVERY_CLIENT = r"((?:Mr|Mrs|Ms|Dr|Prof)[ \t]+[A-Za-z \t]+)"
DISCOVERY_OPENING, DISCOVERY_CLOSING = (rf"(?i){edge} balance[^\d-]*?{_RAND}" for edge in ("Opening", "Closing"))
STANDARD_ACCOUNT = r"(?i)account number[ \t]*([\d \t]+)"
STANDARD_CLIENT = r"(?i)(mr\.[ \t]+[a-z \t]+)"
# Headers that are read strictly, and in short.
ABSA_HEADED_CLIENT = r"(?i)Cheque account statement\s+([A-Z][A-Z0-9&.,'/\- ]+?)\s+40-\d{4}-\d{4}"
STRICT_NAME = r"MR\s+([A-Z]+)\s+([A-Z]+)"
CAPITEC_STRICT_ACCOUNT = (r"Account\s+(\d{6,})",)
CAPITEC_STRICT_DATES = tuple(rf"{edge} Date:\s+(\d{{2}}/\d{{2}}/\d{{4}})" for edge in ("From", "To"))
CAPITEC_STRICT_BALANCES = tuple(rf"{edge} Balance:\s+R([\d,.]+)" for edge in ("Opening", "Closing"))
FNB_STRICT_ACCOUNT = (r"(?i)Account\s*:\s*(\d{6,})", r"(?i)(\d{6,})\s+FNB")
FNB_STRICT_PERIOD = r"(?i)Staat Periode\s*:\s*(\d{1,2}\s+\w+\s+\d{4})\s+tot\s+(\d{1,2}\s+\w+\s+\d{4})"
ABSA_SHORT_ACCOUNT, ABSA_SHORT_CLIENT = r"(\d{2}-\d{4}-\d{4})", r"(?i)(MR\s+[A-Z\s]{2,30})"
NEDBANK_SHORT_PERIOD = r"(?i)Statement period:\s*([\d/\-]+)\s*[–-]\s*([\d/\-]+)"
NEDBANK_SHORT_BALANCES = tuple(rf"(?i){edge} balance\s*R?([\d,]+\.\d{{2}})" for edge in ("Opening", "Closing"))
NEDBANK_SHORT_ACCOUNT, NEDBANK_SHORT_CLIENT, NEDBANK_SHORT_DATE = r"(?i)Account number\s*(\d{8,12})", r"\b((?:Mr|MR|Mrs|Ms)\s+[A-Z\s]+)", r"(?i)Statement date:\s*([\d/\-]+)"
STANDARD_SHORT_PERIOD = r"(?i)Statement from\s+(.+?)\s+to\s+(.+?)\s+BANK STATEMENT"
STANDARD_SHORT_ACCOUNT, STANDARD_SHORT_CLIENT, STANDARD_SHORT_DATE = r"(?i)Account Number\s*([\d\s]{10,20})", r"(MR\.\s+[A-Z\s]+)", r"(\d{2}\s+[A-Za-z]+\s+20\d{2})"
STANDARD_SHORT_BALANCES = (r"BALANCE BROUGHT FORWARD\s+\d+\s+\d+\s+([\d,]+\.\d{2}-?)", r"Balance outstanding at date of statement\s+([\d,]+\.\d{2}-?)")
# End of fixed values.


def account_number(text: Column) -> Column:
    """Digits of the first pattern that gives ten or more."""
    tries = [F.regexp_replace(F.regexp_extract(text, _I + p, 1), r"\D", "") for p in ACCOUNT_PATTERNS]
    return F.coalesce(*(bind(t, lambda x: F.when(F.length(x) >= 10, x)) for t in tries))


def client_name(text: Column) -> Column:
    tries = [squeeze(F.regexp_extract(text, _I + p, 1)) for p in CLIENT_PATTERNS]
    return F.coalesce(*(bind(t, lambda x: F.when((x != "") & ~x.rlike(NOT_A_CLIENT), x)) for t in tries))


def _labelled(text: Column, labels: tuple[str, ...], read) -> Column:
    """The amount after the first label that has one (an R may stand between)."""
    return F.coalesce(*(bind(F.trim(F.regexp_extract(text, _I + p + r"[:\s]*R?\s*((?:[0-9][0-9,. ]*)-?)", 1)), lambda x: read(blank_to_null(x))) for p in labels))


def opening_balance(text: Column) -> Column:
    return _labelled(text, OPENING_LABELS, money.loose)


def closing_balance(text: Column) -> Column:
    return F.coalesce(_labelled(text, CLOSING_LABELS, money.loose), money.loose(blank_to_null(F.trim(F.regexp_extract(text, CLOSING_LINE, 1)))))


def mended_opening(text: Column) -> Column:
    """An opening balance printed after a piece of a date."""
    return _labelled(text, ("balance brought forward",), money.repaired_balance)


def mended_closing(text: Column) -> Column:
    return _labelled(text, ("Month-end BalanceR?", "closing balance", "final balance", "current balance"), money.repaired_balance)


def period(text: Column) -> Column:
    """start, end of the statement period, as printed."""
    return F.struct(period_edge(text, 1).alias("start"), period_edge(text, 2).alias("end"))


def period_edge(text: Column, which: int) -> Column:
    """The start (1) or end (2) of the statement period, as printed."""
    return F.coalesce(*(bind(squeeze(F.regexp_extract(text, _I + p, which)), blank_to_null) for p in PERIOD_PATTERNS))


def statement_fields(t: Column) -> list[Column]:
    """All general header fields of a text."""
    p = period(t)
    return [
        account_number(t).alias("account_number"), client_name(t).alias("client_name"), p["start"].alias("period_start"), p["end"].alias("period_end"), opening_balance(t).alias("opening_c"), closing_balance(t).alias("closing_c"),
    ]


def statement_header(docs: DataFrame) -> DataFrame:
    """doc_id and all general header fields."""
    return docs.select("doc_id", *statement_fields(F.col("text")))


def _digits(c: Column) -> Column:
    return blank_to_null(F.regexp_replace(c, r"[-\s]", ""))


def _crdr(text: Column, label: str) -> Column:
    """An amount with Cr or Dr behind; without Cr it is owed."""
    p = _I + label + rf"\s*({money.AMOUNT})\s*(Cr|Dr)?"
    size = money.plain(blank_to_null(F.regexp_extract(text, p, 1)))
    return F.when(F.lower(F.regexp_extract(text, p, 2)) == "cr", size).otherwise(-F.abs(size))


def absa_fields(t: Column) -> dict[str, Column]:
    opening = first_match(t, (ABSA_OPENING,))
    return {
        "account_number": _digits(first_match(t, ABSA_ACCOUNT)), "client_name": squeeze(first_match(t, ABSA_CLIENT)),
        "period_start": blank_to_null(F.regexp_extract(t, ABSA_PERIOD, 1)), "period_end": blank_to_null(F.regexp_extract(t, ABSA_PERIOD, 2)),
        "opening_c": F.when(opening.isNotNull(), money.either_separator(opening)),
    }


def capitec_fields(t: Column) -> dict[str, Column]:
    return {"account_number": first_match(t, CAPITEC_ACCOUNT), "client_name": squeeze(first_match(t, CAPITEC_CLIENT)), "statement_id": first_match(t, (CAPITEC_ID,))}


def fnb_fields(t: Column) -> dict[str, Column]:
    vat_c = money.plain(blank_to_null(F.regexp_extract(t, FNB_VAT, 1)))
    return {
        "account_number": first_match(t, FNB_ACCOUNT), "client_name": F.trim(first_match(t, FNB_CLIENT)), "statement_id": first_match(t, (FNB_ID,)), "statement_date": F.trim(first_match(t, (FNB_DATE,))),
        "period_start": F.trim(first_match(t, (FNB_PERIOD,), 1)), "period_end": F.trim(first_match(t, (FNB_PERIOD,), 2)),
        "opening_c": _crdr(t, "Opening Balance"), "closing_c": _crdr(t, "Closing Balance"), "total_vat_c": F.when(F.lower(F.regexp_extract(t, FNB_VAT, 2)) == "cr", vat_c).otherwise(-vat_c),
        "year": fnb_year(t),
    }


def nedbank_fields(t: Column) -> dict[str, Column]:
    return {"account_number": first_match(t, NEDBANK_ACCOUNT), "client_name": squeeze(first_match(t, (NEDBANK_CLIENT,)))}


def nedbank_statement(t: Column) -> dict[str, Column]:
    """nedbank_fields and the balance of the last dated closing line."""
    closing = F.regexp_extract_all(t, F.lit(NEDBANK_CLOSING), F.lit(0))
    found = money.tokens(F.when(F.size(closing) > 0, F.element_at(closing, -1)))
    return {**nedbank_fields(t), "closing_c": F.when(F.size(found) > 0, money.rand(F.element_at(found, -1)))}


def discovery_fields(t: Column) -> dict[str, Column]:
    t = F.regexp_replace(t, "\r", "")
    return {
        "account_number": first_match(t, (DISCOVERY_ACCOUNT,)), "client_name": squeeze(first_match(t, (DISCOVERY_CLIENT,))),
        "opening_c": F.coalesce(money.rand(first_match(t, (DISCOVERY_OPENING,))), F.lit(0)), "closing_c": F.coalesce(money.rand(first_match(t, (DISCOVERY_CLOSING,))), F.lit(0)),
    }


def standard_fields(t: Column) -> dict[str, Column]:
    t = F.regexp_replace(t, "\r", "")
    return {"account_number": blank_to_null(F.regexp_replace(F.regexp_extract(t, STANDARD_ACCOUNT, 1), r"\s", "")), "client_name": F.upper(squeeze(first_match(t, (STANDARD_CLIENT,))))}


#: By the names that classify.dispatch_bank gives.
BANK_FIELDS = {"ABSA": absa_fields, "Capitec": capitec_fields, "FNB": fnb_fields, "Nedbank": nedbank_statement, "Discovery": discovery_fields}
#: All fields of any bank.
HEADER = {
    "account_number": "string", "client_name": "string", "statement_id": "string", "statement_date": "string", "period_start": "string", "period_end": "string", "opening_c": "long", "closing_c": "long", "total_vat_c": "long",
}


def header_fields(bank: str, names: Sequence[str] | None = None, text: str = "text") -> dict[str, Column]:
    """HEADER's fields by the rules of each document's own bank (one of names; all by default); null where that bank prints none."""
    names = tuple(names or BANK_FIELDS)
    own = {name: BANK_FIELDS[name](F.col(text)) for name in names}

    def field(name: str, kind: str) -> Column:
        if len(names) == 1:
            return own[names[0]].get(name, F.lit(None).cast(kind))
        out = F.lit(None).cast(kind)
        for b, fields in own.items():
            if name in fields:
                out = F.when(F.col(bank) == b, fields[name]).otherwise(out)
        return out

    return {name: field(name, kind) for name, kind in HEADER.items()}


def fnb_year(text: Column) -> Column:
    return first_match(text, (FNB_YEAR,)).cast("int")


def bank_headers(docs: DataFrame, bank: str, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, bank, the columns named in keep and header_fields. One narrow step."""
    return docs.select("doc_id", bank, *keep, *(c.alias(name) for name, c in header_fields(bank).items()))


def _header(docs: DataFrame, bank: str, fields: dict[str, Column]) -> DataFrame:
    return docs.select("doc_id", F.lit(bank).alias("bank_name"), *(c.alias(name) for name, c in fields.items()))


def absa(docs: DataFrame) -> DataFrame:
    return _header(docs, "ABSA", absa_fields(F.col("text")))


def capitec(docs: DataFrame) -> DataFrame:
    return _header(docs, "Capitec", capitec_fields(F.col("text")))


def fnb(docs: DataFrame) -> DataFrame:
    return _header(docs, "First National Bank", fnb_fields(F.col("text")))


def nedbank(docs: DataFrame) -> DataFrame:
    return _header(docs, "Nedbank", nedbank_fields(F.col("text")))


def discovery(docs: DataFrame) -> DataFrame:
    return _header(docs, "Discovery", discovery_fields(F.col("text")))


def standard_bank(docs: DataFrame) -> DataFrame:
    return _header(docs, "Standard Bank", standard_fields(F.col("text")))


def account_by_label(lines: DataFrame, first_lines: int = 50) -> DataFrame:
    """doc_id, account_number: ten digits on a line with the label, or alone on the next; the earliest of the first lines."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    here = blank_to_null(F.regexp_extract("line", r"(\d{10})", 1))
    ahead = F.lead("line").over(w)
    found = lines.withColumn("nth", F.row_number().over(w)).withColumn("found", F.coalesce(here, F.when(ahead.rlike(r"^\d{10}\z"), ahead)))
    return found.where((F.col("nth") <= first_lines) & F.col("line").rlike(r"(?i)Account\s*number") & F.col("found").isNotNull()).groupBy("doc_id").agg(F.min_by("found", "line_no").alias("account_number"))


def absa_client(text: Column) -> Column:
    """The name between a heading and a formatted account number."""
    return F.trim(first_match(text, (ABSA_HEADED_CLIENT,)))


def strict_header(docs: DataFrame, bank: str) -> DataFrame:
    """Header-only extraction with an error code for the first required field that is missing: doc_id, full_name, account_number, period_from, period_to (ISO), opening_c, closing_c, error_code.

    bank: capitec (English dates) or fnb (Afrikaans ones).
    """
    t = F.col("text")
    full = F.when(t.rlike(STRICT_NAME), F.concat_ws(" ", F.regexp_extract(t, STRICT_NAME, 1), F.regexp_extract(t, STRICT_NAME, 2)))
    if bank == "capitec":
        account = first_match(t, CAPITEC_STRICT_ACCOUNT)
        start, end = (dates.slashed(first_match(t, (p,))) for p in CAPITEC_STRICT_DATES)
        opening, closing = (money.plain(first_match(t, (p,))) for p in CAPITEC_STRICT_BALANCES)
    elif bank == "fnb":
        account = first_match(t, FNB_STRICT_ACCOUNT)
        start, end = (dates.worded(first_match(t, (FNB_STRICT_PERIOD,), k)) for k in (1, 2))
        opening = closing = F.lit(None).cast("long")
    else:
        raise ValueError(bank)
    error = F.when(full.isNull(), "METADATA_NAME_NOT_FOUND").when(account.isNull(), "METADATA_ACCOUNT_NOT_FOUND").when(start.isNull() | end.isNull(), "METADATA_PERIOD_NOT_FOUND")
    return docs.select(
        "doc_id", full.alias("full_name"), account.alias("account_number"), start.cast("string").alias("period_from"), end.cast("string").alias("period_to"), opening.alias("opening_c"), closing.alias("closing_c"), error.alias("error_code")
    )


def summary_header(docs: DataFrame, bank: str) -> DataFrame:
    """Header-only extraction without required fields, for absa, nedbank and standard_bank layouts."""
    t = squeeze(F.col("text"))
    none, amount = F.lit(None).cast("string"), F.lit(None).cast("long")
    one = lambda p, k=1: first_match(t, (p,), k)
    if bank == "absa":
        parts = (F.regexp_replace(one(ABSA_SHORT_ACCOUNT), "-", ""), F.trim(one(ABSA_SHORT_CLIENT)), none, none, none, amount, amount)
    elif bank == "nedbank":
        balances = (F.coalesce(money.plain(one(p)), F.lit(0)) for p in NEDBANK_SHORT_BALANCES)
        parts = (one(NEDBANK_SHORT_ACCOUNT), F.trim(one(NEDBANK_SHORT_CLIENT)), one(NEDBANK_SHORT_DATE), one(NEDBANK_SHORT_PERIOD), one(NEDBANK_SHORT_PERIOD, 2), *balances)
    elif bank == "standard_bank":
        balances = (F.coalesce(money.trailing_sign(one(p)), F.lit(0)) for p in STANDARD_SHORT_BALANCES)
        parts = (F.regexp_replace(one(STANDARD_SHORT_ACCOUNT), r"\s", ""), F.trim(one(STANDARD_SHORT_CLIENT)), one(STANDARD_SHORT_DATE), one(STANDARD_SHORT_PERIOD), one(STANDARD_SHORT_PERIOD, 2), *balances)
    else:
        raise ValueError(bank)
    names = ("account_number", "client_name", "statement_date", "period_start", "period_end", "opening_c", "closing_c")
    return docs.select("doc_id", *(c.alias(n) for c, n in zip(parts, names, strict=True)))
