"""One plan per layout: docs (doc_id, text) to rows doc_id, row_idx, date (dd/MM/yyyy), description, amount_c, balance_c.

Where printed rows are ambiguous the sensible reading is taken, not an accident of one pattern: amounts never run
together across a blank, a balance label may have an R before its digits, a year that no date gives comes from the
period or a parameter, never from the clock.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, money
from ..functions.text import bind, clean, contains_any, replace_first, squeeze, title_case
from ..operators import classify as K
from ..operators import ledger as L
from ..operators import metadata as M
from ..operators import segment as S
from .stages import compiled

COLUMNS = ("doc_id", "row_idx", "date", "description", "amount_c", "balance_c")
# How rows are led, where a section lies, what a description is not.
DATED = r"^\d{2}/\d{2}/\d{4}"
CAPITEC_SECTION = ("Transaction History", "* Includes VAT")
ABSA_DATE = r"^(\d{1,2})/(\d{2})/(\d{4})"
ABSA_AMOUNT = r"-?(?:\d{1,3}(?: \d{3})+|\d+)[.,]\d{2}-?"
ABSA_FORWARD = r"(?i)bal(?:ance)?\s+brought\s+forward"
ABSA_WORDS = ((r"(?i)\bProof Of Pmt\b", "Proof Of Pmt"), (r"(?i)\bImdte\b", "Imdte"), (r"(?i)\bNotific\b", "Notific"))
FNB_BLOCK = r"(?is)(Transactions in RAND.*?Closing Balance)"
FNB_FURNITURE = ((r"(?i)Page \d+ of \d+", " "), (r"(?is)Branch Number.*?FN", " "), (r"(?is)Delivery Method.*?AA", " "), (r"(?i)Transactions in RAND", " "))
FNB_DATE = r"(?i)(\d{1,2})\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
NEDBANK_OTHER_LINE = "(?i)Account|Page|Balance"
NEDBANK_OPENING, NEDBANK_CLOSING = r"(?i)Opening\s*balance", r"(?i)Closing\s*balance"
DISCOVERY_DATE = r"(?i)^\s*(\d{1,2})\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+(20\d{2})"
DISCOVERY_AMOUNT = r"(-?\s?R[\d\s,.]+\.\d{2})"
_BOILERPLATE = r"(?i)POS Purchase|RPP|Online|EFT|Fee|Interest|Reward|Declined Int Card Purch|Transfer|Details|Amount|Type"
# End of fixed values.


def _without(text: Column, parts: Column) -> Column:
    """text with the first occurrence of each part taken out."""
    return F.aggregate(parts, text, lambda acc, p: replace_first(acc, p))


def _final(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return rows.select("doc_id", F.col("row_idx").cast("long").alias("row_idx"), "date", "description", F.col("amount_c").cast("long").alias("amount_c"), F.col("balance_c").cast("long").alias("balance_c"), *keep)


def _or_else(words: Column, other: str) -> Column:
    return F.coalesce(F.nullif(words, F.lit("")), F.lit(other))


@dataclass(frozen=True)
class Layout:
    """How a bank's texts become rows, in three narrow steps over columns.

    parts: text to array<string>, a part for each row that may be one. cut: a part (column text) to body, the text that is
    read, and found, the strings in it that matter. row: columns text, body, found, opening_c and year to those of FIELDS.
    """

    parts: Callable[[Column], Column]
    cut: Callable[[Column], tuple[Column, Column]]
    row: Callable[[], dict[str, Column]]


#: What a row has before its ledger is known. keep: whether it is one; opening, closing: a marked line; rejected: without effect.
FIELDS = {
    "keep": "boolean", "date": "string", "description": "string", "amount_c": "long", "balance_c": "long", "tokens": "array<bigint>", "opening": "boolean", "closing": "boolean", "rejected": "boolean",
}


def _capitec_cut(text: Column) -> tuple[Column, Column]:
    body = F.trim(F.replace(F.substr(text, F.lit(11)), F.lit("\n"), F.lit(" ")))
    return body, money.tokens(body)


def _capitec_row() -> dict[str, Column]:
    found = F.col("found")
    return {
        "keep": F.size(found) > 0, "date": F.substring("text", 1, 10), "description": _or_else(squeeze(_without(F.col("body"), found)), "Transaction"),
        "amount_c": F.when(F.size(found) > 1, money.leading_sign(F.element_at(found, -2))).otherwise(0), "balance_c": money.leading_sign(F.element_at(found, -1)),
    }


def _absa_cut(text: Column) -> tuple[Column, Column]:
    body = F.trim(K.strip_footer(squeeze(F.regexp_replace(text, ABSA_DATE, ""))))
    return body, money.tokens(body, ABSA_AMOUNT)


def _absa_row() -> dict[str, Column]:
    body = F.col("body")
    day = dates.from_parts(*(F.regexp_extract("text", ABSA_DATE, k) for k in (1, 2, 3)))
    forward = body.rlike(ABSA_FORWARD)
    words = _or_else(title_case(clean(squeeze(F.regexp_replace(body, ABSA_AMOUNT, " ")), ABSA_WORDS)), "Transaction")
    return {
        "keep": day.isNotNull() & (body != ""), "date": dates.printed(day), "description": F.when(forward, "Bal Brought Forward").otherwise(words),
        "tokens": F.transform("found", money.either_separator), "opening": forward, "rejected": bind(words, K.other_text) & ~forward,
    }


def _fnb_parts(text: Column) -> Column:
    return S.pair_parts(squeeze(clean(F.regexp_extract(text, FNB_BLOCK, 1), FNB_FURNITURE)))


def _fnb_cut(text: Column) -> tuple[Column, Column]:
    part = S.pair_fields(text)
    return part["before"], F.array(part["balance"], F.coalesce(part["balance_side"], F.lit("")), F.regexp_extract(part["before"], FNB_DATE, 0))


def _fnb_row() -> dict[str, Column]:
    body, balance, side, date = F.col("body"), F.get("found", F.lit(0)), F.get("found", F.lit(1)), F.get("found", F.lit(2))
    size = money.plain(balance)
    day = dates.from_parts(F.regexp_extract(date, FNB_DATE, 1), dates.month_number(F.regexp_extract(date, FNB_DATE, 2)), F.col("year"))
    return {
        "keep": (F.length(body) >= 3) & (date != ""), "date": dates.printed(day), "description": _or_else(F.trim(replace_first(body, date)), "Transaction"),
        "balance_c": F.when(F.lower(side) == "dr", -size).otherwise(size),
    }


def _nedbank_cut(text: Column) -> tuple[Column, Column]:
    """The dated line with the line after it, and the amounts of the first."""
    return F.substring_index(text, "\n", 2), money.tokens(F.substring_index(text, "\n", 1))


def _nedbank_row() -> dict[str, Column]:
    found, line = F.col("found"), F.substring_index("body", "\n", 1)
    wrapped = F.substr("body", F.length(line) + 2)
    taken = ~wrapped.rlike(money.AMOUNT) & ~wrapped.rlike(NEDBANK_OTHER_LINE)
    text = clean(_without(F.regexp_replace(line, DATED, ""), found), ((r"[*R,]", ""), (r"^\d{6}", "")))
    words = F.trim(F.concat_ws(" ", F.trim(text), F.when((wrapped != "") & taken, wrapped)))
    return {
        "date": F.substring("text", 1, 10), "description": bind(words, lambda w: F.when(w.rlike(NEDBANK_OPENING), "OPENING BALANCE").otherwise(F.upper(w))),
        "balance_c": F.when(F.size(found) > 0, money.rand(F.element_at(found, -1))), "opening": words.rlike(NEDBANK_OPENING), "closing": words.rlike(NEDBANK_CLOSING),
    }


def _discovery_cut(text: Column) -> tuple[Column, Column]:
    return text, F.array(F.when(text.rlike(DISCOVERY_DATE), F.regexp_extract(text, DISCOVERY_AMOUNT, 1)).otherwise(""))


def _discovery_row() -> dict[str, Column]:
    body, amount = F.col("body"), F.get("found", F.lit(0))
    day = dates.from_parts(F.regexp_extract(body, DISCOVERY_DATE, 1), dates.month_number(F.regexp_extract(body, DISCOVERY_DATE, 2)), F.regexp_extract(body, DISCOVERY_DATE, 3))
    words = F.upper(squeeze(clean(replace_first(F.regexp_replace(body, DISCOVERY_DATE, ""), amount), ((r"\*\*\*\d{4}", ""), (_BOILERPLATE, ""), (",", " ")))))
    return {"keep": amount != "", "date": dates.printed(day), "description": _or_else(words, "UNKNOWN"), "amount_c": money.rand(amount)}


LAYOUTS = {
    "ABSA": Layout(S.dated_parts, _absa_cut, _absa_row),
    "Capitec": Layout(lambda t: S.led_parts(S.between(t, *CAPITEC_SECTION), DATED), _capitec_cut, _capitec_row),
    "FNB": Layout(_fnb_parts, _fnb_cut, _fnb_row),
    "Nedbank": Layout(lambda t: S.led_parts(t, DATED), _nedbank_cut, _nedbank_row),
    "Discovery": Layout(S.record_parts, _discovery_cut, _discovery_row),
}


def _by_bank(names: Sequence[str], of: Callable[[str], Column]) -> Column:
    """of(name) for the document's bank; without a choice where there is one bank only."""
    if len(names) == 1:
        return of(names[0])
    return F.coalesce(*(F.when(F.col("bank_name") == name, of(name)) for name in names))


def tagged_lines(docs: DataFrame, names: Sequence[str] = tuple(LAYOUTS), default_year: int | None = None) -> DataFrame:
    """doc_id, bank_name, row_idx, FIELDS, opening_c, and source_file and header on row 0: a line for each document's header and its rows. One narrow step over docs."""
    compiled(docs.sparkSession)
    t = F.col("text")
    header = F.struct(*(f.alias(name) for name, f in M.header_fields("bank_name", names).items()))
    year = _by_bank(names, lambda n: F.coalesce(M.fnb_year(t), F.lit(default_year).cast("int")) if n == "FNB" else F.lit(None).cast("int"))
    parts = _by_bank(names, lambda n: LAYOUTS[n].parts(t))
    own = docs.select("doc_id", "bank_name", "source_file", header.alias("header"), F.lit(0).alias("wanted") if "FNB" not in names else year.alias("year"), F.concat(F.array(F.lit(None).cast("string")), F.coalesce(parts, F.array().cast("array<string>"))).alias("parts"))
    if "FNB" not in names:
        own = own.withColumn("year", F.lit(None).cast("int")).drop("wanted")
    lines = own.select("doc_id", "bank_name", "source_file", "header", F.col("header.opening_c").alias("opening_c"), "year", F.posexplode("parts").alias("row_idx", "text"))
    lines = lines.withColumns({"row_idx": F.col("row_idx").cast("long"), "source_file": F.when(F.col("row_idx") == 0, F.col("source_file")), "header": F.when(F.col("row_idx") == 0, F.col("header"))})
    if "Discovery" in names:
        # A record of several lines is as many rows.
        texts = F.when((F.col("bank_name") == "Discovery") & (F.col("row_idx") > 0), S.record_rows(F.col("text"))).otherwise(F.array("text"))
        lines = lines.withColumn("texts", texts).select(*(c for c in lines.columns if c not in ("row_idx", "text")), "row_idx", F.posexplode("texts").alias("k", "text"))
        lines = lines.withColumn("row_idx", F.shiftleft("row_idx", 31) + F.col("k")).drop("k")
    lines = lines.withColumn("cut", _by_bank(names, lambda n: F.struct(*(c.alias(a) for c, a in zip(LAYOUTS[n].cut(F.col("text")), ("body", "found"), strict=True)))))
    lines = lines.withColumns({"body": F.col("cut.body"), "found": F.col("cut.found")}).drop("cut")
    rows = {n: LAYOUTS[n].row() for n in names}
    default = {"keep": F.lit(True), "opening": F.lit(False), "closing": F.lit(False), "rejected": F.lit(False)}
    fields = {c: _by_bank(names, lambda n, c=c, kind=kind: F.coalesce(rows[n][c], default[c]) if c in default and c in rows[n] else rows[n].get(c, default.get(c, F.lit(None))).cast(kind)) for c, kind in FIELDS.items()}
    return lines.withColumns(fields).where((F.col("row_idx") == 0) | F.col("keep")).drop("keep", "text", "body", "found", "year")


def ledgers(lines: DataFrame, names: Sequence[str] = tuple(LAYOUTS)) -> DataFrame:
    """doc_id, bank_name, source_file, header, rows (row_idx, amount_c, balance_c, date, description): a row for each document, from tagged_lines.

    One exchange by doc_id: the windows of all banks and the gathering of a document's rows share it. Capitec and FNB
    print balances, so amounts are differences; Discovery prints amounts, so balances are sums; Nedbank counts from marked
    opening lines; ABSA's rows go through a fold. A document's rows are one array, as its text was one.
    """
    is_ = lambda name: F.col("bank_name") == name if name in names else F.lit(False)
    top = F.col("row_idx") == 0
    if "Nedbank" in names:
        lines = L.opening_segments(lines, is_("Nedbank"), top)
    else:
        lines = lines.withColumn("segment", F.when(top, -1).otherwise(1))
    inside = Window.partitionBy("doc_id", "segment").orderBy("row_idx")
    step = F.col("balance_c") - F.lag("balance_c").over(inside)
    begins = F.row_number().over(inside) == 1
    sums = F.sum("amount_c").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    zero = F.coalesce("opening_c", F.lit(0))
    amount = F.when(is_("Discovery"), F.col("amount_c")).when(is_("Nedbank"), F.when(F.col("opening"), 0).otherwise(step)).when(~begins, step).when(is_("FNB"), F.col("balance_c") - zero).otherwise(F.col("amount_c"))
    moved = lines.select(
        "doc_id", "bank_name", "source_file", "header", "row_idx", "date", "description", amount.alias("amount_c"), F.when(is_("Discovery"), sums + zero).otherwise(F.col("balance_c")).alias("balance_c"), "tokens", F.col("opening").alias("forward"), "rejected",
    )
    folds = "ABSA" in names
    moved = L.pair_columns(moved) if folds else moved
    kept = ("row_idx", "amount_c", "balance_c", "date", "description")
    row = F.struct(*kept, *(L.PAIR_FIELDS if folds else ()))
    packed = moved.groupBy("doc_id").agg(
        *(F.first(c, ignorenulls=True).alias(c) for c in ("bank_name", "source_file", "header")), F.array_sort(F.collect_list(F.when(F.col("row_idx") > 0, row))).alias("rows"),
    )
    plain = F.transform("rows", lambda r: F.struct(*(r[c].alias(c) for c in kept)))
    if folds:
        plain = F.when(F.col("bank_name") == "ABSA", L.folded_pairs(F.col("rows"), F.coalesce("header.opening_c", F.lit(0)), ("date", "description"))).otherwise(plain)
    return packed.withColumn("rows", plain)


def _one_layout(name: str, docs: DataFrame, default_year: int | None = None) -> DataFrame:
    own = docs.select("doc_id", "text", F.lit(name).alias("bank_name"), F.lit(None).cast("string").alias("source_file"))
    out = ledgers(tagged_lines(own, (name,), default_year), (name,))
    return _final(out.select("doc_id", F.explode("rows").alias("r")).select("doc_id", "r.*"))


def capitec(docs: DataFrame) -> DataFrame:
    """Rows between two marks, each led by a date and perhaps wrapped; the last amount is the balance, amounts are differences."""
    return _one_layout("Capitec", docs)


def absa(docs: DataFrame) -> DataFrame:
    """Flowing text cut at dates; the balance is found by what adds up, rejected rows leave it alone."""
    return _one_layout("ABSA", docs)


def fnb(docs: DataFrame, default_year: int | None = None) -> DataFrame:
    """Pairs of amount and balance with the text before them; Dr balances are owed, amounts are differences."""
    return _one_layout("FNB", docs, default_year)


def nedbank(docs: DataFrame) -> DataFrame:
    """Dated lines, perhaps with one more line of description; an opening line sets the balance, a closing one ends it."""
    return _one_layout("Nedbank", docs)


def discovery(docs: DataFrame) -> DataFrame:
    """Comma-separated text whose cells hold several lines; rows have a date first and an amount in rand; balances are sums."""
    return _one_layout("Discovery", docs)


_TWO_DECIMALS = r"\d\.\d{2}"
_PAIR_AMOUNT, _PAIR_BALANCE = r"^\D*(\d[\d,]*\.\d{2}-?)", r"(?:\d{1,3}(?:[ ,]\d{3})+|\d+)\.\d{2}-?"


def money_pair(line: Column, tidy=squeeze) -> Column:
    """struct(amount, balance) of a line: its first and last number; both null unless both can be read and are of credible size. Lines without a dot are not looked at further."""

    def read(t: Column) -> Column:
        last = F.element_at(F.regexp_extract_all(t, F.lit(_PAIR_BALANCE), F.lit(0)), -1)
        return F.struct(money.strict(F.nullif(F.regexp_extract(t, _PAIR_AMOUNT, 1), F.lit(""))).alias("amount"), bind(last, money.repaired_balance).alias("balance"))

    def credible(p: Column) -> Column:
        return F.when((F.abs(p["amount"]) <= 100_000_000) & (F.abs(p["balance"]) <= 10_000_000_000), p)

    return F.when(line.rlike(_TWO_DECIMALS), bind(bind(tidy(line), read), credible))


def period_edges(text: Column) -> tuple[Column, Column]:
    """The dates on which a text's statement period starts and ends; each is read once."""
    return bind(M.period_edge(text, 1), dates.period_date), bind(M.period_edge(text, 2), dates.period_date)


def standard_bank(docs: DataFrame) -> DataFrame:
    """Lines of amount and balance between a description and a reference line; balances are summed anew from nothing."""
    edges = (c.alias(n) for c, n in zip(period_edges(F.col("text")), ("start", "end"), strict=True))
    return standard_rows(S.lines(docs.select("doc_id", "text", *edges), keep=["start", "end"]))


def standard_rows(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """standard_bank's rows from lines (doc_id, line_no, line, and the period's start and end), with the columns named in keep."""
    compiled(lines.sparkSession)
    w = S.by_line()
    rows = lines.withColumn("line", squeeze(F.col("line"))).where("line <> ''")
    line, plain = F.col("line"), lambda c: c
    rows = rows.withColumn("pair", money_pair(line, plain))
    rows = rows.withColumns({"amount_c": F.col("pair.amount"), "printed_c": F.col("pair.balance"), "gone": K.reversal_line(line, plain), "ref": K.reference_line(line, plain)})
    said = ~K.header_line(line, plain) & F.col("amount_c").isNull() & ~F.col("gone")
    rows = rows.withColumn("own", F.struct("line", said.alias("said"), (line == "##").alias("mark"), "ref", "gone", F.col("amount_c").isNotNull().alias("money")))
    around = {"p1": F.lag("own", 1).over(w), "p2": F.lag("own", 2).over(w), "n1": F.lead("own", 1).over(w), "n2": F.lead("own", 2).over(w), "back": F.collect_list(F.when(F.col("ref") & ~F.col("gone"), line)).over(w.rowsBetween(-6, -1))}
    rows = rows.withColumns(around).where("amount_c is not null")
    lit, no = F.lit(""), F.lit(False)
    words = F.coalesce(F.when(F.col("p1.mark"), F.when(F.col("p2.said"), F.col("p2.line"))).otherwise(F.when(F.col("p1.said"), F.col("p1.line"))), lit)
    following = F.when(F.col("n1.ref") & ~F.col("n1.money"), F.col("n1.line"))
    rows = rows.withColumn("words", words)
    rows = rows.withColumn("reference", F.coalesce(following, F.when(F.upper("words").isin(*K.FEE_FOLLOWUPS), F.element_at(F.concat(F.array(lit), "back"), -1)), lit))
    undone = F.coalesce("n1.gone", no) | (F.coalesce("n1.ref", no) & F.coalesce("n2.gone", no))
    rows = rows.where(~K.skipped_block(F.col("words"), F.col("reference"), plain) & ~undone).withColumn("description", F.trim(F.concat_ws(" ", "words", "reference")))
    upper = F.upper("description")
    rows = rows.where(~contains_any(upper, (K.REVERSAL, *K.SUMMARY_PHRASES)) & ~upper.isin(*K.FEE_FOLLOWUPS)).where((F.abs("amount_c") <= 500_000_000) & (F.abs("printed_c") <= 10_000_000_000))
    rows = rows.withColumn("day", F.coalesce(*(dates.best_date(F.col(c), F.col("start"), F.col("end"), plain) for c in ("description", "reference", "words")))).withColumnRenamed("line_no", "row_idx")
    return _final(L.carry_dates(L.running(rows), "day").withColumn("date", dates.printed(F.col("day"))), keep)


# Amounts and row starts of this layout, where its statements end, what is no part of a description, and rows that are dropped.
_V2_TOKEN, _V2_START = r"\d{1,3}(?:[ ,]\d{3})*[.,]\d{2}-?", r"^\s*(\d{1,2}/\d{1,2}/\d{4})"
_V2_WORDS = ((r"(?i)\b(Settlement|Headoffice)\b", ""), (r"\b[ACTMS]\b(?=\s*\d|$)", ""), (r"\b\d+\.\d{2}A\b", ""), (r"(?i)SERVICE FEE:.*$", ""), (r"(?i)CREDIT INTEREST RATE.*$", ""))
_SINGLE = r"(?i)([A-Z\s\-]+)\s+([\d,]+\.\d{2}-?)\s+(\d{2})\s+(\d{2})\s+([\d,]+\.\d{2}-?)"
_ENDS = [r"SERVICE FEE:", r"CREDIT\s+INTEREST\s+RATE", r"ABSA BUSINESS BANKING WILL BE UPDATING"]
_DROPPED = r"(?i)^bal brought forward$|^proof of pmt email$|^notific fee sms"


def blocks_v2(docs: DataFrame) -> DataFrame:
    """Dated blocks without page furniture; the last amount is the balance, the one before it the amount, its sign by what adds up."""
    return block_rows(S.lines(docs.select("doc_id", block_text(F.col("text")).alias("text"))))


def block_text(text: Column) -> Column:
    """What of a text blocks_v2 reads."""
    return S.until_any(F.translate(text, "\xa0", " "), _ENDS)


def block_rows(lines: DataFrame) -> DataFrame:
    """blocks_v2's rows from lines (doc_id, line_no, line) of block_text."""
    compiled(lines.sparkSession)
    lines = lines.select("doc_id", "line_no", squeeze(F.col("line")).alias("line")).where(~K.noise_line(F.col("line")))
    start = _V2_START
    rows = S.blocks(lines, F.col("line").rlike(start))
    found = F.regexp_extract_all(F.regexp_replace("text", start, ""), F.lit(_V2_TOKEN), F.lit(0))
    rows = rows.withColumn("found", found).where(F.size("found") > 0)
    printed = F.when(F.size("found") > 1, F.element_at("found", -2))
    ends = F.instr(F.col("text"), F.coalesce(printed, F.element_at("found", -1)))
    words = clean(F.regexp_replace(F.substr("text", F.lit(1), ends - 1), start, ""), _V2_WORDS)
    rows = rows.withColumns({"date": F.lpad(F.regexp_extract("text", start, 1), 10, "0"), "description": squeeze(words), "balance_c": money.token(F.element_at("found", -1)), "printed_c": money.token(printed), "opening_c": F.lit(None).cast("long")})
    rows = rows.withColumn("rejected", (F.col("description") == "") | F.col("description").rlike(_DROPPED))
    return _final(L.signed_fold(rows, carry=["date", "description"]))


def standard_bank_single(docs: DataFrame, default_year: int | None = None) -> DataFrame:
    """The old single-row reading of a Standard Bank text: description, amount, month, day and balance, at most once."""
    p = _SINGLE
    part = lambda k: F.regexp_extract("text", p, k)
    year = F.coalesce(F.nullif(F.regexp_extract("text", r"\b(20\d{2})\b", 1), F.lit("")), F.lit(str(default_year) if default_year else None))
    day = dates.from_parts(part(4), part(3), year)
    return _final(docs.where(F.col("text").rlike(p)).select("doc_id", F.lit(0).alias("row_idx"), dates.printed(day).alias("date"), F.trim(part(1)).alias("description"), money.rand_trailing(part(2)).alias("amount_c"), money.rand_trailing(part(5)).alias("balance_c")))


def _banked(docs: DataFrame) -> DataFrame:
    return docs if "bank_name" in docs.columns else docs.withColumn("bank_name", K.dispatch_bank(F.col("text")))


def route(docs: DataFrame, folder: str) -> DataFrame:
    """docs with bank_name, written by bank under a new folder that all executors reach, and read again.

    For texts that are parsed more than once, or by bank: telling them apart is then done, and one bank's are read alone.
    """
    banked = _banked(docs)
    banked.write.mode("errorifexists").partitionBy("bank_name").parquet(folder)
    return docs.sparkSession.read.schema(banked.schema).parquet(folder)


#: What rows take from their statement's header.
ROW_FIELDS = ("account_number", "client_name", "statement_id")


def parse_documents(docs: DataFrame, default_year: int | None = None) -> DataFrame:
    """doc_id, bank_name, source_file, header, rows: every document once, rows empty where its bank is unknown, unsupported or has none.

    docs: doc_id, source_file, text, and bank_name if they come from route(). The texts are scanned once, cut into lines
    that carry their document's number and bank, and dealt by document once.
    """
    return ledgers(tagged_lines(_banked(docs), default_year=default_year))


def parse_statements(docs: DataFrame, default_year: int | None = None) -> DataFrame:
    """Rows of mixed statements with account_number, client_name, statement_id, bank_name and source_file: each document goes by the layout of its bank.

    Documents of unsupported and unknown banks have no rows here; see statements. One scan and one exchange, as parse_documents.
    """
    return rows_of(parse_documents(docs, default_year))


def rows_of(parsed: DataFrame) -> DataFrame:
    """The rows of parse_documents' result, as parse_statements gives them."""
    rows = parsed.select("doc_id", *(F.col(f"header.{c}").alias(c) for c in ROW_FIELDS), "source_file", "bank_name", F.explode("rows").alias("r"))
    return rows.select(*COLUMNS[:1], *(F.col(f"r.{c}").alias(c) for c in COLUMNS[1:]), *ROW_FIELDS, "source_file", "bank_name")


def statements(docs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row per document: its bank and header, the totals of its rows, whether they reconcile, and why it has none.

    opening_c and closing_c are printed ones where the layout prints them, else those of the rows: ABSA prints no closing
    balance, Nedbank's opening balance is a row, Capitec prints neither. reconciled is null without rows or without a balance.
    Without rows, which are those of docs then, this is one scan and one exchange; with rows from elsewhere (a table that
    parse_statements was written to) their totals meet the headers by doc_id.
    """
    if rows is None:
        return statements_of(parse_documents(docs))
    heads = M.bank_headers(_banked(docs), "bank_name", keep=["source_file"])
    return _told(heads.join(L.totals(rows).withColumnsRenamed({"opening_c": "first_c", "closing_c": "last_c"}), "doc_id", "left"))


def statements_of(parsed: DataFrame) -> DataFrame:
    """The statements of parse_documents' result, as statements gives them."""
    each = parsed.select("doc_id", "bank_name", "source_file", "header", F.explode_outer("rows").alias("r")).select("doc_id", "bank_name", "source_file", "header", "r.*")
    sums = L.totals(each, ("bank_name", "source_file", "header")).withColumnsRenamed({"opening_c": "first_c", "closing_c": "last_c"})
    none = F.col("n_transactions") == 0
    out = sums.select("doc_id", "bank_name", "source_file", "header.*", "n_transactions", "credits_c", "debits_c", "first_c", "last_c")
    return _told(out.withColumns({c: F.when(~none, F.col(c)) for c in ("credits_c", "debits_c")}))


def _told(out: DataFrame) -> DataFrame:
    out = out.withColumns({"n_transactions": F.coalesce("n_transactions", F.lit(0)), "opening_c": F.coalesce("opening_c", "first_c"), "closing_c": F.coalesce("closing_c", "last_c")})
    return out.drop("first_c", "last_c").withColumns({
        "reconciled": L.reconciled(F.col("opening_c"), F.col("credits_c"), F.col("debits_c"), F.col("closing_c")),
        "error_code": K.request_error(F.lit(1), F.col("bank_name"), F.col("n_transactions")),
    })


def statement_status(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, bank_name, n_rows, error_code: every document, with why it has no rows."""
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"))
    out = _banked(docs).select("doc_id", "bank_name").join(counts, "doc_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return out.withColumn("error_code", K.request_error(F.lit(1), F.col("bank_name"), F.col("n_rows")))
