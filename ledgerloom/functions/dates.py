"""Dates as statements print them. Results are dates (never half-checked texts); what is no date is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, squeeze

#: Month names in English and Afrikaans, short and long, as they may appear.
MONTHS = {
    "jan": 1, "january": 1, "januarie": 1, "feb": 2, "february": 2, "februarie": 2, "mar": 3, "march": 3, "maart": 3,
    "apr": 4, "april": 4, "may": 5, "mei": 5, "jun": 6, "june": 6, "junie": 6, "jul": 7, "july": 7, "julie": 7,
    "aug": 8, "august": 8, "augustus": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "oktober": 10,
    "nov": 11, "november": 11, "dec": 12, "december": 12, "des": 12, "desember": 12,
}
#: Years that a statement may be from.
FIRST_YEAR, LAST_YEAR = 2000, 2100


def month_number(name: Column) -> Column:
    names, numbers = (F.array(*map(F.lit, x)) for x in (MONTHS.keys(), MONTHS.values()))
    return F.get(numbers, F.array_position(names, F.lower(name)).cast("int") - 1)


def from_parts(day: Column, month: Column, year: Column) -> Column:
    """A calendar date of the years allowed; null for 31/02 and the like. Parts may be text."""

    def read(p: Column) -> Column:
        d, m, y = p["d"], p["m"], p["y"]
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        longest = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
        return F.when(y.between(FIRST_YEAR, LAST_YEAR) & m.between(1, 12) & (d >= 1) & (d <= longest), F.make_date(y, m, d))

    return bind(F.struct(day.try_cast("int").alias("d"), month.try_cast("int").alias("m"), year.try_cast("int").alias("y")), read)


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def slashed(c: Column) -> Column:
    """d/m/yyyy, also with dashes."""
    p = r"^\s*(\d{1,2})[/-](\d{1,2})[/-](\d{4})"
    return from_parts(_part(c, p, 1), _part(c, p, 2), _part(c, p, 3))


def worded(c: Column) -> Column:
    """1 December 2025, in English or Afrikaans."""
    p = r"^\s*(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})"
    return from_parts(_part(c, p, 1), month_number(_part(c, p, 2)), _part(c, p, 3))


def period_date(c: Column) -> Column:
    """An edge of a statement period: digits or words, nothing else around."""
    t = squeeze(c)
    return F.when(t.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{4}\z"), slashed(t)).when(t.rlike(r"^\d{1,2} [A-Za-z]+ \d{4}\z"), worded(t))


def with_period_year(c: Column, period_start: Column) -> Column:
    """dd/mm/yyyy, `1 Des 2025`, or `01 Dec` in the year in which the period starts."""
    t = squeeze(c)
    p = r"^(\d{1,2}) ([A-Za-z]+)\z"
    return (
        F.when(t.rlike(r"^\d{2}/\d{2}/\d{4}\z"), slashed(t))
        .when(t.rlike(r"^\d{1,2} [A-Za-z]+ \d{4}\z"), worded(t))
        .when(t.rlike(p), from_parts(_part(t, p, 1), month_number(_part(t, p, 2)), F.year(period_start)))
    )


def date_error(c: Column) -> Column:
    """What is wrong with a text that with_period_year can't read: an unknown month or no known form; null if nothing."""
    t = squeeze(c)
    name = _part(t, r"^\d{1,2} ([A-Za-z]+)(?: \d{4})?\z", 1)
    return F.when(t.rlike(r"^\d{2}/\d{2}/\d{4}\z"), F.lit(None).cast("string")).when(name.isNull(), "UNSUPPORTED_DATE_FORMAT").when(month_number(name).isNull(), "INVALID_MONTH")


def pivot_year(yy: Column) -> Column:
    """Two digits: up to 49 in this century, else in the last."""
    y = yy.try_cast("int")
    return F.when(y <= 49, y + 2000).otherwise(y + 1900)


def normal_token(c: Column) -> Column:
    """ROLddmmyy, ddmmyy or d/m/y anywhere in a text, as dd/MM/yyyy text; the first form that is there. Not calendar-checked."""
    t = squeeze(c)

    def read(p: str) -> Column:
        y = _part(t, p, 3)
        year = F.when(F.length(y) == 2, pivot_year(y).cast("string")).otherwise(y)
        return F.concat(F.lpad(_part(t, p, 1), 2, "0"), F.lit("/"), F.lpad(_part(t, p, 2), 2, "0"), F.lit("/"), year)

    return F.coalesce(*map(read, (r"(?i)\bROL(\d{2})(\d{2})(\d{2})\b", r"\b(\d{2})(\d{2})(\d{2})\b", r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\b")))


def best_date(c: Column, start: Column, end: Column, tidy=squeeze) -> Column:
    """The date that six-digit tokens of a text most likely mean.

    Each token may be yymmdd or ddmmyy. A reading inside the period [start, end] scores 1000, one outside loses a
    point for each day to the nearer edge; yymmdd gets 10. The best score wins, of equal ones the first. Without a
    period only the 10 counts.
    """
    t = tidy(c)
    found = F.array_distinct(F.filter(
        F.concat(F.array(F.regexp_extract(t, r"(?i)ROL(\d{6})", 1), F.regexp_extract(t, r"(\d{6})\z", 1)), F.regexp_extract_all(t, F.lit(r"\b(\d{6})\b"), F.lit(1))),
        lambda x: x != "",
    ))

    def readings(x: Column, i: Column) -> Column:
        def of(n: Column) -> Column:
            a, b, d = F.floor(n / 10000).cast("int"), F.floor(n / 100).cast("int") % 100, n % 100
            return F.array(F.struct(from_parts(d, b, a + 2000).alias("date"), F.lit(10).alias("bonus"), (-2 * i).alias("place")), F.struct(from_parts(a, b, d + 2000).alias("date"), F.lit(0).alias("bonus"), (-2 * i - 1).alias("place")))

        return bind(x.cast("int"), of)

    def scored(r: Column) -> Column:
        date = r["date"]
        away = F.least(F.abs(F.datediff(date, start)), F.abs(F.datediff(date, end)))
        score = F.when(start.isNull() | end.isNull(), 0).when(date.between(start, end), 1000).otherwise(-away) + r["bonus"]
        return F.struct(score.alias("score"), r["place"].alias("place"), date.alias("date"))

    real = F.filter(F.flatten(F.transform(found, readings)), lambda r: r["date"].isNotNull())
    # Most texts have no six digits: they need only one look.
    return F.when(t.rlike(r"\d{6}"), F.array_max(F.transform(real, scored))["date"])


def resolved_year(yy: Column, end_year: Column) -> Column:
    """The year of two digits near a statement's last year: from two before to one after, else the year before it."""
    y = yy.try_cast("int") + 2000
    return F.when(y.between(end_year - 2, end_year + 1), y).otherwise(end_year - 1)


def end_year(period_end: Column, default: int) -> Column:
    """The year in a period's end as text: four digits at its end, else anywhere; else default."""
    t = F.trim(period_end)
    return F.coalesce(F.coalesce(_part(t, r"(\d{4})\z", 1), _part(t, r"\b(\d{4})\b", 1)).try_cast("int"), F.lit(default))


def from_description(c: Column, last_year: Column) -> Column:
    """dd/MM/yyyy text from ROLddmmyy, six digits at the end or six digits anywhere; days to 31 and months to 12 only."""
    t = F.trim(c)

    def read(p: str, checked: bool) -> Column:
        x = _part(t, p, 1)
        d, m, y = (F.substring(x, n, 2) for n in (1, 3, 5))
        out = F.concat(d, F.lit("/"), m, F.lit("/"), resolved_year(y, last_year).cast("string"))
        return F.when(x.isNotNull() & (d.cast("int").between(1, 31) & m.cast("int").between(1, 12) if checked else F.lit(True)), out)

    return F.coalesce(read(r"(?i)ROL(\d{6})", False), read(r"(\d{6})\z", True), read(r"\b(\d{6})\b", True))


def printed(c: Column) -> Column:
    """A date as dd/MM/yyyy."""
    return F.date_format(c, "dd/MM/yyyy")


def plausible(c: Column) -> Column:
    """Whether a text is dd/mm/yyyy with a day to 31, a month to 12 and a year allowed (31/02 is)."""
    p = r"^(\d{2})/(\d{2})/(\d{4})\z"
    return F.coalesce(_part(c, p, 1).cast("int").between(1, 31) & _part(c, p, 2).cast("int").between(1, 12) & _part(c, p, 3).cast("int").between(FIRST_YEAR, LAST_YEAR), F.lit(False))
