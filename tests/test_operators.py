"""Operators and plans on small texts, with their edge cases."""

import datetime
import sys
import types

import pandas as pd
from pyspark.sql import functions as F

from ledgerloom import sinks, sources, streaming
from ledgerloom.operators import classify, entitle, ledger, metadata, segment, validate
from ledgerloom.plans import layouts
from ledgerloom.plans.job import run_parse_job


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_empty_and_headless_documents(spark):
    d = docs(spark, "", "Transaction History", "nothing", "Transaction History\nDate Description\n01/02/2025 A 5.00 10.00\nwrapped\n02/02/2025 B 7.00\n* Includes VAT\n03/02/2025 C 1.00")
    assert rows(layouts.capitec(d), "doc_id", "date", "description", "amount_c", "balance_c") == [(3, "01/02/2025", "A wrapped", 500, 1000), (3, "02/02/2025", "B", -300, 700)]
    for plan in (layouts.absa, layouts.fnb, layouts.nedbank, layouts.discovery, layouts.standard_bank, layouts.blocks_v2):
        assert plan(docs(spark, "", "x")).count() == 0


def test_rejected_rows_leave_the_balance_alone(spark):
    text = "01/01/2025 Bal Brought Forward 100,00 02/01/2025 Shop 10,00 110,00 03/01/2025 Private Bag 5,00 500,00 04/01/2025 Shop 1,00- 109,00"
    assert rows(layouts.absa(docs(spark, text)), "date", "amount_c", "balance_c") == [("01/01/2025", 0, 10000), ("02/01/2025", 1000, 11000), ("04/01/2025", -100, 10900)]


def test_nedbank_before_opening(spark):
    text = "01/01/2025 Early 5.00\n02/01/2025 Opening balance 10.00\n03/01/2025 Shop 8.00\n04/01/2025 Closing balance 8.00\n05/01/2025 Shop 9.00"
    assert rows(layouts.nedbank(docs(spark, text)), "date", "amount_c", "balance_c") == [("02/01/2025", 0, 1000), ("03/01/2025", -200, 800), ("05/01/2025", 100, 900)]


def test_reversals_and_carried_dates(spark):
    text = "Statement from 1 January 2025 to 31 March 2025\nCARD\n10.00 1,000.00\nREF 010225\nSHOP\n5.00- 900.00\nRTD-NOT PROVIDED FOR\nLOOSE\n1.00- 899.00\nend"
    assert rows(layouts.standard_bank(docs(spark, text)), "date", "description", "amount_c", "balance_c") == [("01/02/2025", "CARD REF 010225", 1000, 1000), ("01/02/2025", "LOOSE", -100, 900)]


def test_csv_cells():
    assert segment.csv_cells('a,"b ""c"" \nd"\n,x') == [["a", 'b "c" \nd'], ["", "x"]]
    assert segment.csv_cells("") == []


def test_classify(spark):
    d = docs(spark, "ABSA opening balance", "closing balance debit", "private", "waybill", "", None)
    got = {r.doc_id: r for r in classify.classify(d).collect()}
    assert [got[i].document_type for i in range(6)] == ["bank_statement", "bank_statement", "invoice", "delivery_note", "unknown", "unknown"]
    assert got[0].document_subtype == "absa_statement" and got[1].document_subtype == "unknown"


def test_header(spark):
    d = docs(spark, "Account number: 12 34\nAcc no 1234567890\nBalance brought forward: 1 234,50-\nPeriod: 01/02/2025 - 28/02/2025", "")
    got = metadata.statement_header(d).orderBy("doc_id").collect()
    assert (got[0].account_number, got[0].opening_c, got[0].period_end) == ("1234567890", -123450, "28/02/2025")
    assert got[1].account_number is None and got[1].opening_c is None
    assert metadata.summary_header(docs(spark, "Account number 12345678 Opening balance R1,000.00"), "nedbank").first().opening_c == 100000
    assert metadata.account_by_label(segment.lines(docs(spark, "Account number\n1234567890"))).first().account_number == "1234567890"


def test_no_transactions(spark):
    heads = spark.createDataFrame([(1, None, None, None, None, None, None)], "doc_id long, account_number string, client_name string, period_start string, period_end string, opening_c long, closing_c long")
    none = spark.createDataFrame([], "doc_id long, row_idx long, date string, description string, amount_c long, balance_c long")
    found = validate.issues(heads, none)
    assert rows(found, "issue_type") == [("no_transactions",)]
    assert validate.summary(heads, found).first().score == 0


def test_job(spark):
    d = docs(spark, "a private letter", "absa opening balance 1.00 debit\n01/01/2025 Shop 5.00 10.00\n02/01/2025 Shop 4.00 6.00").withColumn("source_file", F.lit("x"))
    job = run_parse_job(d)
    assert rows(job.jobs, "doc_id", "status") == [(0, "unsupported"), (1, "completed")]
    assert rows(job.transactions, "amount_c", "balance_c") == [(-400, 600), (500, 1000)]
    assert run_parse_job(d).jobs.first().job_id == job.jobs.first().job_id


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo".encode())
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    got = {r.source_file: r for r in sources.read_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "héllo" and got["a.txt"].error_code is None
    assert got["b.pdf"].kind == "pdf"
    t = spark.createDataFrame([(1, 1, "d", 'say "x"', None, 1250)], "doc_id long, row_idx long, date string, description string, amount_c long, balance_c long")
    out = dict(sinks.csv_documents(t, docs(spark, "", "")).collect())
    assert out == {0: "Date,Description,Amount,Balance", 1: 'Date,Description,Amount,Balance\nd,"say ""x""",0,12.5'}
    sinks.append(t, str(tmp_path / "log"))
    sinks.append(t, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    assert sources.either_column(t, "Date", "date", "d").first().d == "d"


def test_balances_and_reconciliation(spark):
    t = ledger.totals(spark.createDataFrame([(1, 1, 10, 110), (1, 2, -5, 105)], "doc_id long, row_idx long, amount_c long, balance_c long")).first()
    assert (t.opening_c, t.closing_c, t.credits_c, t.debits_c) == (100, 105, 10, 5)


def test_stream_limits(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    events = [(i, "a", at + datetime.timedelta(minutes=m)) for i, m in enumerate((0, 5, 10, 16, 40))]
    batch = spark.createDataFrame(events, "event_id long, client string, ts timestamp")
    assert rows(streaming.first_hit_windows(batch, "client", 2), "event_id", "refused") == [(0, False), (1, False), (2, True), (3, False), (4, False)]
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for name, df in (("limited", streaming.limited_stream(source(), "client", 2)), ("once", streaming.once(source(), "client", "1 hour")), ("counted", streaming.rate_windows(source(), "client", 2, "1 hour"))):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("limited").where("refused").count() == 1
    assert spark.table("once").count() == 1


def test_plan_effects(spark):
    p = spark.createDataFrame([(1, "PAYG_10", 1, 1), (1, "MONTHLY_25", 2, 2), (1, "PAYG_10", 3, 3), (2, "PRO_YEAR_UNLIMITED", 1, 4)], "user_id long, plan_code string, t long, event_id long").withColumn("ts", F.timestamp_seconds("t"))
    assert rows(entitle.plan_effects(p), "user_id", "plan_code", "credits_remaining") == [(1, "PAYG_10", 35), (2, "PRO_YEAR_UNLIMITED", None)]


def test_statements_with_headers(spark, tmp_path):
    capitec = "Capitec Bank Limited\nUnique Document No.: ab-1\nAccount\n1234567890\nMain Account Statement\nMR A B\n\nTransaction History\n01/02/2025 A 5.00 10.00\n02/02/2025 B 7.00\n* Includes VAT"
    nedbank = "Nedbank Ltd\nAccount number 1234567890\n01/01/2025 Opening balance R10.00\n02/01/2025 Shop 8.00\n03/01/2025 Closing balance R8.00"
    d = docs(spark, capitec, nedbank, "Standard Bank of South Africa", "", None).withColumn("source_file", F.concat(F.lit("f"), "doc_id"))
    routed = layouts.route(d, str(tmp_path / "routed"))
    for source in (d, routed):
        found = layouts.parse_statements(source)
        assert rows(found, "doc_id", "amount_c", "account_number", "source_file") == [(0, -300, "1234567890", "f0"), (0, 500, "1234567890", "f0"), (1, -200, "1234567890", "f1"), (1, 0, "1234567890", "f1")]
        got = {r.doc_id: r for r in layouts.statements(source, found).collect()}
        assert (got[0].statement_id, got[0].client_name, got[0].opening_c, got[0].closing_c, got[0].reconciled) == ("ab-1", "MR A B", 500, 700, True)
        assert (got[1].opening_c, got[1].closing_c, got[1].debits_c, got[1].reconciled) == (1000, 800, 200, True)
        assert [got[k].error_code for k in range(5)] == [None, None, "UNSUPPORTED_BANK", "UNKNOWN_BANK", "UNKNOWN_BANK"]
        assert got[3].reconciled is None and got[3].n_transactions == 0


def test_errors_on_empty_input(spark):
    d = docs(spark, "Date Description\n01 Jan Shop\nmore\n2/1 Shop", "Date Description Amount", "")
    merged = segment.merged_rows(d)
    assert rows(merged, "doc_id", "text") == [(0, "01 Jan Shop more"), (0, "2/1 Shop")]
    assert rows(segment.section_errors(d, merged), "doc_id", "error_code") == [(1, "TRANSACTION_SECTION_EMPTY"), (2, "TRANSACTION_SECTION_EMPTY")]
    t = spark.createDataFrame([(0, 1, "a", None, None, None, 1000), (0, 2, "b", None, 100, 1, 890)], "doc_id long, row_idx long, date string, credit_c long, debit_c long, fee_c long, balance_c long")
    got = rows(ledger.ledger_check(d, t), "doc_id", "valid", "warnings", "error_code")
    assert got == [(0, False, ["Balance mismatch on b: expected 8.99, got 8.90"], None), (1, None, None, "LEDGER_EMPTY"), (2, None, None, "LEDGER_EMPTY")]
    files = spark.createDataFrame([("a.pdf", 1), ("a.xlsx", 0), ("a.doc", 1), (None, 1)], "path string, n int")
    assert [r[0] for r in files.select(classify.convert_error(F.col("path"), F.col("n"))).collect()] == [None, "NO_TRANSACTIONS", "UNSUPPORTED_FILE_TYPE", "NO_FILE"]


def test_files_by_mime_type(spark):
    files = spark.createDataFrame([("a", "text/csv", bytearray(b"x")), ("b", "application/pdf", None), ("c.txt", None, bytearray(b"y"))], "path string, mime string, content binary")
    assert rows(sources.decoded(files), "source_file", "kind", "pages", "text", "error_code") == [("a", "text", 1, "x", None), ("b", "pdf", None, None, "NO_FILE_BUFFER"), ("c.txt", "text", 1, "y", None)]


def test_pdf_pages(monkeypatch):
    class Page:
        def extract_text(self):
            return "line"

    class Reader:
        def __init__(self, stream):
            if stream.read() == b"bad":
                raise ValueError("damaged")
            self.pages, self.metadata = [Page(), Page()], {"/Title": "T"}

    monkeypatch.setitem(sys.modules, "pypdf", types.SimpleNamespace(PdfReader=Reader))
    got = sources._pages(pd.Series([b"good", b"bad", None]))
    assert got["text"].tolist() == ["line\nline", None, None] and got["info"].tolist() == [{"Title": "T"}, None, None]
    assert got["pages"].isna().tolist() == [False, True, True] and got["pages"][0] == 2


def test_issue_messages(spark):
    heads = spark.createDataFrame([(1, "1", "x", None, "b", 100, 5)], "doc_id long, account_number string, client_name string, period_start string, period_end string, opening_c long, closing_c long")
    t = spark.createDataFrame([(1, 1, "d", "x", 10, 110), (1, 2, "d", "x", 10, 140)], "doc_id long, row_idx long, date string, description string, amount_c long, balance_c long")
    got = {r.issue_type: r for r in validate.issues(heads, t).collect()}
    assert set(got) == {"missing_statement_period", "balance_continuity_mismatch", "closing_balance_mismatch"}
    assert got["balance_continuity_mismatch"].metadata == {"date": "d", "description": "x", "amount_c": "10", "balance_c": "140", "previous_balance_c": "110", "expected_delta_c": "30"}
    assert got["closing_balance_mismatch"].metadata == {"closing_c": "5", "last_balance_c": "140"} and got["missing_statement_period"].metadata == {"period_end": "b"}
    assert got["missing_statement_period"].message == "Statement period could not be extracted fully."
