"""From text to candidate rows. Order is data: rows carry (doc_id, line_no) or (doc_id, row_idx)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import AMOUNT
from ..functions.text import bind, blank_to_null

def by_line():
    return Window.partitionBy("doc_id").orderBy("line_no")


def text_lines(text: Column) -> Column:
    """array<string>: the lines as printed."""
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def lines(docs: DataFrame, keep_empty: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, line_no (from 0, as printed), line (trimmed), and the columns named in keep. A narrow step: no shuffle."""
    out = docs.select("doc_id", *keep, F.posexplode(text_lines(F.col("text"))).alias("line_no", "line")).withColumn("line", F.trim("line"))
    return out if keep_empty else out.where("line <> ''")


def blocks(rows: DataFrame, starts: Column, keep_head: bool = False) -> DataFrame:
    """doc_id, row_idx, text: a line that starts a row with the lines that follow it, joined by blanks.

    One shuffle by doc_id. Lines before the first start are left out unless keep_head (row 0).
    """
    numbered = rows.withColumn("row_idx", F.sum(starts.cast("int")).over(by_line().rowsBetween(Window.unboundedPreceding, 0)))
    if not keep_head:
        numbered = numbered.where("row_idx > 0")
    joined = numbered.groupBy("doc_id", "row_idx").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("parts"))
    return joined.select("doc_id", "row_idx", F.array_join("parts.line", " ").alias("text"))


def between(text: Column, start: str, end: str) -> Column:
    """From the first `start` to before the next `end` (or to the end); null without a start."""
    at = F.instr(text, F.lit(start))
    tail = F.substr(text, at)
    stop = F.instr(tail, F.lit(end))
    return F.when(at > 0, F.when(stop > 0, F.substr(tail, F.lit(1), stop - 1)).otherwise(tail))


def until_any(text: Column, patterns: list[str]) -> Column:
    """What stands before the earliest match of any pattern."""
    return F.regexp_replace(text, "(?is)(?:" + "|".join(patterns) + r").*\z", "")


def led_parts(text: Column, starts: str) -> Column:
    """array<string>: the text's lines (trimmed, empty ones left out) cut before each that matches `starts` (a pattern from ^ on); what stands before the first is left out."""
    # A run of blanks is looked at from its first one only, so that long runs take linear time.
    tidy = F.btrim(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "(?<! ) *(?:\n *)+", "\n"), F.lit(" \n"))
    return F.filter(F.split(tidy, rf"\n(?={starts.removeprefix('^')})"), lambda part: part.rlike(starts))


def dated_parts(text: Column) -> Column:
    """array<string>: the text cut before each d/mm/yyyy, letters and digits parted, white space squeezed."""
    text = F.regexp_replace(F.translate(text, "\r •·", "\n   "), r"([A-Za-z])(\d)", r"$1 $2")
    text = F.regexp_replace(F.regexp_replace(text, r"(\d)([A-Za-z])", r"$1 $2"), r"(\.\d{2})(\d)", r"$1 $2")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.filter(F.split(text, r"(?=\b\d{1,2}/\d{2}/\d{4}\b)"), lambda part: part.rlike(r"^\d{1,2}/\d{2}/\d{4}\b"))


#: An amount and the balance after it, each perhaps with Cr or Dr.
PAIR = rf"({AMOUNT})\s*(?:(?i)(Cr|Dr))?\s+({AMOUNT})\s*(?:(?i)(Cr|Dr))?"


_BEFORE_PAIR = "(?s)(.*?)" + PAIR


def pair_parts(text: Column) -> Column:
    """array<string>: the text cut behind each pair of amounts; what stands behind the last is left out."""
    return F.regexp_extract_all(text, F.lit(_BEFORE_PAIR), F.lit(0))


def pair_fields(part: Column, reach: int = 300) -> dict[str, Column]:
    """before (at most `reach` characters), amount, amount_side, balance, balance_side of one of pair_parts."""
    names = ("before", "amount", "amount_side", "balance", "balance_side")
    out = {n: F.regexp_extract(part, _BEFORE_PAIR, k + 1) for k, n in enumerate(names)}
    return out | {"before": F.trim(F.right(out["before"], F.lit(reach))), "amount_side": blank_to_null(out["amount_side"]), "balance_side": blank_to_null(out["balance_side"])}


def amount_balance_pairs(docs: DataFrame, text_col: str = "text", reach: int = 300, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, row_idx, before, amount, balance, amount_side, balance_side, and the columns named in keep: each pair of amounts with at most `reach` characters before it."""
    text = F.col(text_col)
    found = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(PAIR), F.lit(k)).alias(n) for k, n in ((1, "amount"), (2, "amount_side"), (3, "balance"), (4, "balance_side"))), F.split(text, PAIR).alias("before"))
    rows = docs.select("doc_id", *keep, F.posexplode(found).alias("row_idx", "p")).select("doc_id", *keep, "row_idx", "p.*").where("amount is not null")
    return rows.withColumn("before", F.trim(F.right("before", F.lit(reach)))).withColumn("amount_side", blank_to_null(F.col("amount_side"))).withColumn("balance_side", blank_to_null(F.col("balance_side")))


def with_wrapped_line(rows: DataFrame, dated: Column, taken: Column) -> DataFrame:
    """Dated lines, each with the line after it as `wrapped` if that one is undated and `taken` (a condition on column next)."""
    ahead = rows.withColumn("next", F.lead("line").over(by_line())).withColumn("_dated", dated)
    return ahead.withColumn("wrapped", F.when(~F.lead("_dated").over(by_line()) & taken, F.col("next"))).where("_dated").drop("_dated", "next")


def csv_cells(text: str) -> list[list[str]]:
    """What lex_csv gives, sign by sign: for texts outside Spark and for tests."""
    rows: list[list[str]] = []
    row: list[str] = []
    cell: list[str] = []
    quoted, i, n = False, 0, len(text)
    while i < n:
        c = text[i]
        if quoted and c == '"' and text[i + 1 : i + 2] == '"':
            cell.append(c)
            i += 1
        elif c == '"':
            quoted = not quoted
        elif quoted or c not in ",\n":
            cell.append(c)
        else:
            row.append("".join(cell))
            cell = []
            if c == "\n":
                rows.append(row)
                row = []
        i += 1
    if cell or row:
        rows.append([*row, "".join(cell)])
    return rows


# Separators of records and of cells once quotes are gone, and what stands for those signs where a text has them itself.
_RECORD, _CELL, _ESCAPE = "\x1e", "\x1f", "\x1b"
_HIDDEN = ((_ESCAPE, _ESCAPE + "0"), (_RECORD, _ESCAPE + "1"), (_CELL, _ESCAPE + "2"))


def _restored(cell: Column) -> Column:
    out = cell
    for sign, hidden in reversed(_HIDDEN):
        out = F.replace(out, F.lit(hidden), F.lit(sign))
    return F.when(cell.contains(_ESCAPE), out).otherwise(cell)


def record_parts(text: Column) -> Column:
    """array<string>: the records of comma-separated text, cells parted by a sign (see record_cells).

    Cut at quotes, pieces are in turn outside and inside quotes, as each quote changes sides. A quote inside quotes is
    printed twice: it leaves an empty piece outside, between two inside, which becomes that quote. Commas and line ends
    of pieces outside are separators. JVM only, in time linear in the text.
    """
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit(""))
    for sign, hidden in _HIDDEN:
        plain = F.replace(plain, F.lit(sign), F.lit(hidden))

    def marked(pieces: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            between = (p == "") & (i > 0) & (i < F.size(pieces) - 1)
            return F.when(i % 2 == 1, p).when(between, '"').otherwise(F.replace(F.replace(p, F.lit(","), F.lit(_CELL)), F.lit("\n"), F.lit(_RECORD)))

        return F.array_join(F.transform(pieces, piece), "")

    records = F.split(bind(F.split(plain, '"'), marked), _RECORD)
    # After the last line end there is no record unless something is there.
    return bind(records, lambda r: F.when(F.element_at(r, -1) == "", F.slice(r, 1, F.size(r) - 1)).otherwise(r))


def record_cells(record: Column) -> Column:
    """array<string>: the cells of one of record_parts."""
    return F.transform(F.split(record, _CELL), _restored)


def lex_csv(c: Column | str) -> Column:
    """Comma-separated text as rows of cells. Quotes may open anywhere in a cell; inside them "" is a quote and line ends are text."""
    return F.transform(record_parts(F.col(c) if isinstance(c, str) else c), record_cells)


def record_rows(record: Column) -> Column:
    """array<string>: cells of several lines as parallel rows, each row's cells joined by blanks; empty rows left out. A date's month may stand first."""
    months = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
    cells = bind(record_cells(record), lambda c: F.concat(F.array(F.regexp_replace(F.get(c, 0), rf"(?i){months}\s+(20\d{{2}})\s+(\d{{1,2}})", "$3 $1 $2")), F.slice(c, 2, F.size(c))))
    parts = F.transform(cells, lambda c: F.transform(F.split(c, "\n"), lambda x: F.trim(x)))

    def rows(parts: Column) -> Column:
        deepest = F.array_max(F.transform(parts, lambda p: F.size(p)))
        row = lambda k: F.transform(parts, lambda p: F.coalesce(F.get(p, k), F.lit("")))
        return F.filter(F.transform(F.sequence(F.lit(0), deepest - 1), lambda k: F.trim(F.array_join(row(k), " "))), lambda x: x != "")

    return bind(parts, rows)


def unzipped_cells(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, row_idx, text, and the columns named in keep: record_rows of all records.

    row_idx orders the rows: the record's number, then the line's inside it (31 bits).
    """
    records = docs.select("doc_id", *keep, F.posexplode(record_parts(F.col("text"))).alias("record", "text"))
    rows = records.select("doc_id", *keep, "record", F.posexplode(record_rows(F.col("text"))).alias("k", "text"))
    return rows.select("doc_id", *keep, (F.shiftleft(F.col("record").cast("long"), 31) + F.col("k")).alias("row_idx"), "text")


#: One printed row: date, text, amount, balance.
ROW = r"(\d{2}/\d{2}/\d{4})\s+(.+?)\s+(-?\d+\.\d{2})\s+(-?\d+\.\d{2})"


def pattern_rows(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, date, description, amount, balance (text) of lines that hold a whole row."""
    part = lambda k: F.regexp_extract("line", ROW, k)
    return lines(docs).where(F.col("line").rlike(ROW)).select("doc_id", "line_no", part(1).alias("date"), F.trim(part(2)).alias("description"), part(3).alias("amount"), part(4).alias("balance"))


def merged_rows(docs: DataFrame) -> DataFrame:
    """doc_id, row_idx, text: the lines of a section as rows, each led by a day; printed headings left out. What stands before the first day is row 0."""
    return blocks(lines(docs).where(~F.col("line").rlike(r"(?i)^Date\s+Description")), F.col("line").rlike(r"^\d{1,2}[/\s-]"), keep_head=True)


def section_errors(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, error_code of documents whose section has no rows."""
    return docs.select("doc_id").join(rows.select("doc_id"), "doc_id", "left_anti").withColumn("error_code", F.lit("TRANSACTION_SECTION_EMPTY"))
