"""Scalar rules by example."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, references, text


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("rule", "printed", "cents"), [
    (money.either_separator, "1 382,23-", -138223), (money.either_separator, "1,382.23 DR", -138223), (money.either_separator, "x", 0), (money.leading_sign, "-1 234.56", -123456), (money.rand, "-R1,234.56", -123456),
    (money.rand_trailing, "R10.00-", -1000), (money.trailing_sign, "10.00-", -1000), (money.strict, "1,000.50-", -100050), (money.strict, "12x", None), (money.repaired_balance, "12 345.67", 34567), (money.repaired_balance, "1234567.89", 12456789),
    (money.loose, "1.234", 123), (money.loose, "1,5", 150), (money.loose, "", None), (money.plain, "1 234,567.89", 123456789),
])
def test_money(spark, rule, printed, cents):
    assert value(spark, rule(F.lit(printed))) == cents


def test_amounts_stay_apart(spark):
    assert value(spark, money.tokens(F.lit("Card -50.00 1 000.00 12 345,678.90"))) == ["-50.00", "1 000.00", "345,678.90"]
    assert value(spark, money.normal_text(F.lit("29.5"))) == "29.50"
    assert value(spark, money.normal_text(F.lit("x"))) is None


def test_ambiguous_dates(spark):
    start, end = F.lit("2003-01-01").cast("date"), F.lit("2003-03-31").cast("date")
    none = F.lit(None).cast("date")
    assert value(spark, dates.best_date(F.lit("010203"), start, end)) == datetime.date(2003, 2, 1)
    assert value(spark, dates.best_date(F.lit("010203"), none, none)) == datetime.date(2001, 2, 3)
    assert value(spark, dates.best_date(F.lit("x ROL310299 y"), none, none)) is None
    assert value(spark, dates.best_date(F.lit("no digits"), none, none)) is None


def test_dates(spark):
    assert value(spark, dates.slashed(F.lit("31/02/2025"))) is None
    assert value(spark, dates.worded(F.lit("5 Desember 2025"))) == datetime.date(2025, 12, 5)
    assert value(spark, dates.with_period_year(F.lit("01 Mei"), F.lit("2024-02-01").cast("date"))) == datetime.date(2024, 5, 1)
    assert value(spark, dates.date_error(F.lit("01 Foo"))) == "INVALID_MONTH"
    assert value(spark, dates.normal_token(F.lit("5/6/49"))) == "05/06/2049"
    assert value(spark, dates.normal_token(F.lit("ROL050650"))) == "05/06/1950"
    assert value(spark, dates.from_description(F.lit("PAY 310225"), F.lit(2025))) == "31/02/2025"
    assert value(spark, dates.plausible(F.lit("32/01/2025"))) is False


def test_text(spark):
    assert value(spark, text.title_case(F.lit("debit/CREDIT-x absa FNB"))) == "Debit/Credit-X ABSA FNB"
    assert value(spark, text.squeeze(F.lit(" a  \t b\n"))) == "a b"
    assert value(spark, text.replace_first(F.lit("a.b a.b"), F.lit("a.b"))) == " a.b"


def test_references(spark):
    assert value(spark, references.reference_plan(F.lit("12_PAYG_10_170"))) == "PAYG_10"
    assert value(spark, references.reference_user(F.lit("12_170"))) is None
    assert value(spark, references.form_fields(F.lit("a=1&b=x%20y"))) == {"a": "1", "b": "x y"}
    lower, plain = (value(spark, references.payload_hash([F.lit("AB"), F.lit(None)], F.lit("K"), low)) for low in (True, False))
    assert lower != plain and len(plain) == 128
