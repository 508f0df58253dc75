"""Text: white space, case, first matching patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of any Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def squeeze_blanks(c: Column) -> Column:
    """As squeeze, for blanks, tabs and no-break spaces only: lines stay lines."""
    return F.trim(F.regexp_replace(F.translate(c, " ", " "), r"[ \t]+", " "))


def bind(value: Column, use) -> Column:
    """use(value) with value computed once, however often it is used there; lambdas would compute it anew for each use."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), 0)


def title_case(c: Column) -> Column:
    """Lower case with a capital wherever a word begins (also after / and -), and bank acronyms in capitals."""
    # Cut where a word begins with a letter: by words, not by letters. What stands before the first one may begin with any sign.
    cased = F.transform(F.split(F.lower(c), "(?<![a-z0-9_])(?=[a-z])"), lambda x: F.when(x.rlike("^[a-z]"), F.concat(F.upper(F.left(x, F.lit(1))), F.substr(x, F.lit(2)))).otherwise(x))
    return F.regexp_replace(F.regexp_replace(F.array_join(cased, ""), r"\bAbsa\b", "ABSA"), r"\bFnb\b", "FNB")


def first_match(c: Column, patterns: Sequence[str], group: int = 1) -> Column:
    """The group of the first pattern that matches with something in it; null if none does."""
    return F.coalesce(*(blank_to_null(F.regexp_extract(c, p, group)) for p in patterns))


def contains_any(c: Column, phrases: Sequence[str]) -> Column:
    """Whether c holds one of the phrases (c and phrases in the same case)."""
    out = F.lit(False)
    for p in phrases:
        out = out | c.contains(p)
    return out


def replace_first(c: Column, part: Column) -> Column:
    """c with the first occurrence of part taken out; unchanged where part is null, empty or absent."""
    at = F.instr(c, part)
    return F.when(part.isNull() | (part == "") | (at == 0), c).otherwise(F.concat(F.substr(c, F.lit(1), at - 1), F.substr(c, at + F.length(part))))


def clean(c: Column, steps: Sequence[tuple[str, str]]) -> Column:
    """Pattern replacements, one after the other."""
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return c
