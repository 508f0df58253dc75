"""Money as text to exact integer cents (long). Nothing here passes through a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze

#: One amount with two decimals; thousands in groups, all by commas or all by blanks. Neighbouring amounts stay apart.
AMOUNT = r"(?<!\d)-?(?:\d{1,3}(?: \d{3})+|\d{1,3}(?:,\d{3})+|\d+)\.\d{2}"


def cents(number: Column) -> Column:
    """Cents of a plain decimal text (digits, dot, sign), rounded half up; null if it is none."""
    return (number.try_cast("decimal(20,2)") * 100).cast("long")


#: Blanks of a printed number, and its comma.
_BLANKS = " \t\n\x0b\f\r,"


def _bare(c: Column, more: str = "") -> Column:
    """c without blanks, commas and the signs of more; sign by sign, which costs less than a pattern."""
    return F.translate(c, more + _BLANKS, "")


def _unsigned(t: Column) -> Column:
    """t, which ends with a sign, without it."""
    return F.left(t, F.length(t) - 1)


def _printed(c: Column, whole) -> Column:
    """Sign, whole(units) and two decimals of cents, in integer arithmetic."""
    size = F.abs(c.cast("long"))
    return F.concat(F.when(c < 0, "-").otherwise(""), whole(F.call_function("div", size, F.lit(100))), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))


def as_text(c: Column, thousands: str = ",") -> Column:
    """Cents as 1,234.56."""
    mark = thousands[:1]

    def grouped(units: Column) -> Column:
        last = F.concat(F.lit(mark), F.lpad((units % 1000).cast("string"), 3, "0"))
        many = F.format_number(units, 0)
        return F.when(units < 1000, units.cast("string")).when(units < 1_000_000, F.concat(F.call_function("div", units, F.lit(1000)).cast("string"), last)).otherwise(many if mark == "," else F.translate(many, ",", mark))

    return _printed(c, grouped)


def plain_text(c: Column) -> Column:
    """Cents as 1234.56."""
    return _printed(c, lambda units: units.cast("string"))


def _signed(negative: Column, size: Column) -> Column:
    return F.when(negative, -F.abs(size)).otherwise(size)


def either_separator(c: Column) -> Column:
    """1 382,23- and 1,382.23 DR alike: a comma is the decimal sign unless there is a dot. 0 if not a number."""
    t = F.trim(c)
    negative = t.endswith("-") | t.startswith("-") | t.rlike(r"(?i)\bDR\b")
    kept = F.regexp_replace(t, r"[^0-9,.]", "")
    number = F.when(kept.contains(","), F.when(kept.contains("."), F.regexp_replace(kept, ",", "")).otherwise(F.regexp_replace(kept, r"^([^,]*),", r"$1."))).otherwise(kept)
    return F.coalesce(_signed(negative, cents(number)), F.lit(0).cast("long"))


def leading_sign(c: Column) -> Column:
    """-1 234.56 or 1,234.56; 0 if not a number."""
    t = _bare(c)
    return F.coalesce(_signed(t.startswith("-"), cents(F.regexp_replace(t, r"[^0-9.]", ""))), F.lit(0).cast("long"))


def rand(c: Column) -> Column:
    """R1,234.56, with a sign before it or none."""
    return cents(_bare(c, "R"))


def rand_trailing(c: Column) -> Column:
    """R1,234.56-: the sign may stand behind. 0 if not a number."""
    t = _bare(c, "R")
    return F.coalesce(F.when(t.endswith("-"), -F.abs(cents(_unsigned(t)))).otherwise(cents(t)), F.lit(0).cast("long"))


def plain(c: Column) -> Column:
    """1 234,567.89: blanks and commas are left out; null if not a number."""
    return cents(_bare(c))


def trailing_sign(c: Column) -> Column:
    """As plain, with a sign behind."""
    t = F.trim(c)
    return F.when(t.endswith("-"), -F.abs(plain(_unsigned(t)))).otherwise(plain(t))


def strict(c: Column) -> Column:
    """Digits, with two decimals or none and a sign behind or none; everything else is null."""
    t = F.regexp_extract(_bare(c), r"^\d+(\.\d{2})?-?\z", 0)
    return F.when(t.endswith("-"), -cents(_unsigned(t))).otherwise(cents(t))


def repaired_balance(c: Column) -> Column:
    """A balance with a piece of a date before it (one or two digits and a blank), or, from seven whole digits on, with a stray third digit."""
    t = _bare(F.regexp_replace(squeeze(c), r"^\d{1,2}\s+", ""))
    return strict(F.regexp_replace(t, r"^(\d\d)\d(?=\d{4})", "$1"))


def loose(c: Column) -> Column:
    """Comma and dot: commas are thousands; comma alone: the decimal sign; a sign behind. Null without digits."""
    t = F.trim(c)
    s = F.translate(F.regexp_replace(t, r"-\z", ""), _BLANKS[:-1], "")
    number = F.when(s.contains(",") & s.contains("."), F.regexp_replace(s, ",", "")).when(s.contains(","), F.regexp_replace(s, r"^([^,]*),", r"$1.")).otherwise(s)
    return _signed(t.endswith("-"), cents(number))


def token(c: Column) -> Column:
    """One amount token: as loose, but a comma beside a dot is a thousands sign too."""
    return loose(c)


def tokens(c: Column, pattern: str = AMOUNT) -> Column:
    """All amounts of a text, as text, in order."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def last_two(c: Column) -> tuple[Column, Column]:
    """(second-last, last) amounts of a text, as text; null where there are too few."""
    all_ = tokens(c)
    return F.try_element_at(all_, F.lit(-2)), F.try_element_at(all_, F.lit(-1))


def normal_text(c: Column) -> Column:
    """An amount as text with two decimals; null if it is none."""
    return F.regexp_extract(c, r"^\s*([+-]?\d*\.?\d+)", 1).try_cast("decimal(20,2)").cast("string")
