"""What a document is: bank, kind, structure; and what happens to it. All rules are case expressions, first match first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bind, contains_any, squeeze

# Phrases by which documents are told apart, in lower case, in order of precedence.
UNSUPPORTED_PHRASES = ("standard bank of south africa", "transact@standardbank.co.za", "0860 123 000")
BANK_PHRASES = (
    ("Discovery", ("discovery gold transaction account", "discovery bank limited")),
    ("Nedbank", ("nedbank ltd", "see money differently")),
    ("Capitec", ("unique document no", "capitec bank limited", "client care centre")),
)
ABSA_PHRASES = ("cheque account", "absa bank")
FNB_PHRASES = ("first national bank", "fnb.co.za")
BRANDS = (
    ("absa_statement", "ABSA", ("absa",)),
    ("fnb_statement", "FNB", ("fnb", "first national bank")),
    ("nedbank_statement", "Nedbank", ("nedbank",)),
    ("capitec_statement", "Capitec", ("capitec",)),
    ("discovery_statement", "Discovery", ("discovery",)),
    ("standard_bank_statement", "Standard Bank", ("standard bank", "stanbic", "blue wallet", "mymo")),
)
SIGNALS = {
    "opening": ("opening balance", "balance brought forward", "bal brought forward"),
    "closing": ("closing balance", "final balance", "current balance"),
    "dates": ("transaction date", "date description", "date details"),
    "debit": ("debit",),
    "credit": ("credit",),
    "balance": ("balance",),
}
INVOICE_WORDS = ("invoice", "vat")
DELIVERY_WORDS = ("delivery note", "proof of delivery", "waybill")
PIPELINE = "bank_statement_v2"
# End of fixed values.


def dispatch_bank(text: Column) -> Column:
    """The bank whose layout a text has, UNSUPPORTED_BANK or UNKNOWN_BANK. The text is squeezed once for all phrases."""

    def bank(t: Column) -> Column:
        out = F.when(contains_any(t, UNSUPPORTED_PHRASES), "UNSUPPORTED_BANK")
        for name, phrases in BANK_PHRASES:
            out = out.when(contains_any(t, phrases), name)
        return out.when(t.contains("absa") & contains_any(t, ABSA_PHRASES), "ABSA").when(contains_any(t, FNB_PHRASES), "FNB").otherwise("UNKNOWN_BANK")

    return bind(F.lower(squeeze(text)), bank)


def brand_in_capitals(text: Column) -> Column:
    """Capitec or FNB by names as they are spelt; null otherwise."""
    return F.when(text.contains("CAPITEC"), "Capitec").when(contains_any(text, ("First National Bank", "FNB")), "FNB")


def signals(text: Column) -> dict[str, Column]:
    """Which structural marks of a statement a text has. They overlap: a closing balance is a balance too."""
    t = F.lower(text)
    return {name: contains_any(t, phrases) for name, phrases in SIGNALS.items()}


def votes(text: Column) -> Column:
    """How many structural marks a text has."""
    out = F.lit(0)
    for c in signals(text).values():
        out = out + c.cast("int")
    return out


def classification(text: Column) -> Column:
    """document_type, document_subtype, confidence, supported, reasons, pipeline as one struct."""
    text = F.coalesce(text, F.lit(""))
    t, n = F.lower(text), votes(text)

    def kind(type_: str, subtype: str, confidence: float, supported: bool, *reasons: str) -> Column:
        return F.struct(
            F.lit(type_).alias("document_type"), F.lit(subtype).alias("document_subtype"), F.lit(confidence).alias("confidence"), F.lit(supported).alias("supported"),
            F.array(*map(F.lit, reasons)).alias("reasons"), F.lit(PIPELINE if supported else None).cast("string").alias("pipeline"),
        )

    out = None
    for subtype, name, words in BRANDS:
        rule = (contains_any(t, words) & (n >= 2), kind("bank_statement", subtype, 0.98, True, f"Found {name} branding", "Found multiple bank statement signals"))
        out = F.when(*rule) if out is None else out.when(*rule)
    return (
        out.when(n >= 3, kind("bank_statement", "unknown", 0.85, True, "Found strong generic bank statement structure"))
        .when(contains_any(t, INVOICE_WORDS), kind("invoice", "generic_invoice", 0.7, False, "Found invoice-related terms"))
        .when(contains_any(t, DELIVERY_WORDS), kind("delivery_note", "generic_delivery_note", 0.7, False, "Found logistics document terms"))
        .otherwise(kind("unknown", "unknown", 0.2, False, "No strong document signals found"))
    )


def classify(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the fields of classification as columns. One pass, no shuffle."""
    return docs.withColumn("_c", classification(F.col(text_col))).select("*", "_c.*").drop("_c")


def bank_name(subtype: Column) -> Column:
    t = F.lower(subtype)
    return F.when(t.contains("absa"), "ABSA").when(t.contains("standard_bank"), "Standard Bank").otherwise("unknown")


# The schema registry.
SCHEMAS = (
    ("bank_statement.v1", "bank_statement", "bank_statement.generic.v2", True),
    ("invoice.v1", "invoice", "invoice.generic.v2", False),
    ("delivery_note.v1", "delivery_note", "delivery_note.generic.v2", False),
)
PARSERS = ("bank_statement.generic.v2",)


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCHEMAS, "schema_key string, document_type string, parser_key string, active boolean")


def job_status(classified: DataFrame) -> DataFrame:
    """classified with schema_key, parser_key and status: unsupported, failed (no parser), or completed so far.

    The registry has a handful of rows, whatever the data: it is broadcast. A type has one active schema at most.
    """
    active = F.broadcast(registry(classified.sparkSession).where("active").drop("active"))
    joined = classified.join(active, "document_type", "left")
    status = F.when(~F.col("supported") | F.col("schema_key").isNull(), "unsupported").when(~F.col("parser_key").isin(*PARSERS), "failed").otherwise("completed")
    return joined.withColumn("status", status)


def handles(document_type: Column) -> Column:
    """Whether the statement parser takes a document."""
    return document_type == "bank_statement"


def file_kind(path: Column, mime: Column | None = None) -> Column:
    """pdf, text or unknown, by type or suffix."""
    p, m = F.lower(F.coalesce(path, F.lit(""))), F.coalesce(mime if mime is not None else F.lit(None).cast("string"), F.lit(""))
    return F.when((m == "application/pdf") | p.endswith(".pdf"), "pdf").when(m.startswith("text/") | p.endswith(".txt"), "text").otherwise("unknown")


def convert_kind(path: Column) -> Column:
    """Which converter takes a file; null: none does."""
    p = F.lower(path)
    return F.when(p.endswith(".pdf"), "pdf").when(p.endswith(".xls") | p.endswith(".xlsx"), "excel")


def convert_error(path: Column, n_rows: Column) -> Column:
    """Why a file is not converted; null if it is. Without a path there is no file."""
    return F.when(path.isNull(), "NO_FILE").when(convert_kind(path).isNull(), "UNSUPPORTED_FILE_TYPE").when(F.coalesce(n_rows, F.lit(0)) == 0, "NO_TRANSACTIONS")


def request_error(n_files: Column, bank: Column, n_transactions: Column) -> Column:
    """Why a request is turned down; null if it isn't."""
    return F.when(F.coalesce(n_files, F.lit(0)) == 0, "NO_FILES").otherwise(bind(bank, lambda b: F.when(b.isin("UNSUPPORTED_BANK", "UNKNOWN_BANK"), b).when(F.coalesce(n_transactions, F.lit(0)) == 0, "NO_TRANSACTIONS")))


# Lines that belong to no transaction.
NOISE_LINES = (
    r"authorised financial services provider", r"registration number", r"vat registration number", r"tax invoice", r"general enquiries", r"absa bank ltd", r"absa bank limited",
    r"your transactions(?:\(continued\))?", r"date\s*transaction\s*description", r"account summary", r"return address", r"our privacy notice", r"credit interest rate",
    r"updating its fees and charges", r"detailed information or visit", r"charge:\s+a\s*=\s*administration", r"page\s+\d+\s+of\s+\d+", r"estamp", r"statement no:", r"client vat reg no:", r"overdraft limit",
)
HEADER_LINES = ("details", "service", "fee", "debitscredits", "datebalance", "balance brought forward", "month-end balance")
HEADER_PARTS = (
    "customer care centre", "statement / invoice", "bank statement / tax invoice", "account number", "standard bank", "the ombudsman for banking services", "registered credit provider",
    "please verify all transactions", "please visit our website", "vat reg no", "monthly email", "achieva current account",
)
REFERENCE_LINE = r"\b\d{6}\b|(?i:\bROL\d{6}\b|\bSBSA\b|\bVODACOM\b|\bLENDPLUS\b|\bAUTOPAY\b|\bMBD\b|\bSF\d+\b)"
REVERSAL = "RTD-NOT PROVIDED FOR"
SUMMARY_PHRASES = ("VAT SUMMARY", "ACCOUNT SUMMARY", "DETAILS OF AGREEMENT", "THIS DOCUMENT CONSTITUTES A CREDIT NOTE", "TOTAL VAT")
FEE_FOLLOWUPS = ("FEE-UNPAID ITEM", "UNPAID FEE DEBICHECK D/O")
FOOTERS = (
    "Our Privacy Notice", "Page 1", "Page 2", "ABSA Bank Limited", "Tax Invoice", "Authorised Financial Services", "Registration Number", "Vat Registration", "Cheque account statement", "Return address",
    "General Enquiries", "eStamp", "ABSA BUSINESS BANKING", "YOUR PRICING PLAN", "CHARGE: A = ADMINISTRATION", "* = VAT", "PLEASE CONTACT YOUR RELATIONSHIP EXECUTIVE", "VISIT ABSA.CO.ZA",
)
OTHER_TEXT = ("CHEQUE ACCOUNT STATEMENT", "RETURN ADDRESS", "PRIVATE BAG", "POSTNET", "GENERAL ENQUIRIES", "PLEASE CONTACT YOUR RELATIONSHIP EXECUTIVE")
# End of fixed values.


def noise_line(line: Column) -> Column:
    """Page furniture: empty lines and those that match one of NOISE_LINES."""
    t = squeeze(line)
    return (t == "") | t.rlike("(?i)(" + "|".join(NOISE_LINES) + ")")


def header_line(line: Column, tidy=squeeze) -> Column:
    """tidy, here and below: what brings white space in order; for lines that are in order already, nothing."""
    t = F.lower(tidy(line))
    return (t == "") | t.isin(*HEADER_LINES) | t.startswith("page ") | contains_any(t, HEADER_PARTS)


def marker_line(line: Column) -> Column:
    return squeeze(line) == "##"


def reversal_line(line: Column, tidy=squeeze) -> Column:
    return F.upper(tidy(line)).contains(REVERSAL)


def reference_line(line: Column, tidy=squeeze) -> Column:
    return tidy(line).rlike(REFERENCE_LINE)


def skipped_block(description: Column, reference: Column, tidy=squeeze) -> Column:
    d, r = F.lower(tidy(description)), tidy(reference)
    return (d == "") | (d == "##") | d.contains("these fees include vat") | (r == "##")


def strip_footer(text: Column) -> Column:
    """What stands before the earliest footer phrase."""
    return F.regexp_replace(text, "(?is)(?:" + "|".join(rf"\Q{phrase}\E" for phrase in FOOTERS) + r").*\z", "")


def other_text(description: Column) -> Column:
    """Whether a description is no transaction's."""
    return F.coalesce((description == "") | (F.length(description) > 140) | contains_any(F.upper(description), OTHER_TEXT), F.lit(True))
