"""Statements of many rows: no overflow, and time in proportion to the rows."""

import time

from pyspark.sql import functions as F

from ledgerloom import streaming
from ledgerloom.operators import ledger, metadata, segment
from ledgerloom.plans import layouts as P


def test_many_records_of_cells(spark):
    text = "\n".join(f'{1 + k % 28} Jan 2020,"Card {k}","R{k}.00"' for k in range(5000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert segment.unzipped_cells(docs).select("row_idx").distinct().count() == 5000
    rows = P.discovery(docs).orderBy("row_idx").collect()
    assert [r.amount_c for r in rows] == [100 * k for k in range(5000)]
    assert rows[-1].balance_c == 100 * sum(range(5000))


def test_folds_are_linear(spark):
    def fold(n):
        rows = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("row_idx"), F.lit(100).alias("printed_c"), (100 * (F.col("id") + 1)).alias("balance_c"), F.lit(False).alias("rejected"), F.lit(0).alias("opening_c"))
        began = time.time()
        got = ledger.signed_fold(rows, most_balance=10**12).agg(F.count("*").alias("n"), F.sum("amount_c").alias("s"), F.max("balance_c").alias("b")).first()
        assert (got.n, got.s, got.b) == (n, 100 * n, 100 * n)
        return time.time() - began

    fold(1000)
    assert fold(100_000) < 60


def test_once_keeps_the_first(spark):
    rows = spark.createDataFrame([("a", 5, 2, "x"), ("a", 5, 1, "y"), ("b", 9, 3, "z"), ("a", 7, 0, "w"), (None, 1, 9, "v"), (None, 0, 8, "u")], "ref string, ts long, event_id long, what string")
    got = {r.ref: r.what for r in streaming.once(rows, "ref", order=("ts", "event_id")).collect()}
    assert got == {"a": "y", "b": "z", None: "u"}


def test_a_line_that_ends_in_a_balance(spark):
    d = spark.createDataFrame([(1, "Balance 99.10\nend"), (2, "Closing balance 5.00\nBalance 99.10"), (3, "Balance brought forward 7.00")], "doc_id long, text string")
    assert [r.c for r in d.orderBy("doc_id").select(metadata.closing_balance(F.col("text")).alias("c")).collect()] == [9910, 500, None]
