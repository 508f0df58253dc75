"""The parse of mixed statements in one pass, the lexer without Python, and folds of long documents in spans."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import entitle, ledger, segment
from ledgerloom.plans import layouts


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts") / "docs")
    spark.createDataFrame([(1, "a.txt", "x")], "doc_id long, source_file string, text string").write.parquet(path)
    return path


def test_rows_of_all_banks_take_one_scan_and_one_exchange(spark, folder):
    plan = plan_of(layouts.parse_statements(spark.read.parquet(folder)))
    assert len(re.findall("FileScan", plan)) == 1 and len(re.findall("Exchange hashpartitioning", plan)) == 1
    assert "Join" not in plan and "Python" not in plan and "Union" not in plan


def test_statements_take_one_scan_and_one_exchange(spark, folder):
    plan = plan_of(layouts.statements(spark.read.parquet(folder)))
    assert len(re.findall("FileScan", plan)) == 1 and len(re.findall("Exchange hashpartitioning", plan)) == 1 and "Join" not in plan


CAPITEC = "Capitec Bank Limited\nUnique Document No.: ab-1\nAccount\n1234567890\nMain Account Statement\nMR A B\n\nTransaction History\n   01/02/2025 A 5.00 10.00\n\n  wrapped   \r\n02/02/2025 B 7.00\n* Includes VAT\n03/02/2025 C 1.00"
ABSA = "Absa Cheque Account 01/01/2025 Bal Brought Forward 100,00 02/01/2025 Shop 10,00 110,00 03/01/2025 Private Bag 5,00 500,00 04/01/2025 Shop 1,00- 109,00"
NEDBANK = "Nedbank Ltd\nAccount number 1234567890\n01/01/2025 Early 5.00\n02/01/2025 Opening balance R10.00\n03/01/2025 Shop 8.00\nmore words\nand more\n04/01/2025 Shop 7.00\nPage 2\n05/01/2025 Closing balance R7.00"
FNB = "First National Bank\n2025/01/31\nOpening Balance 5.00 Dr\nTransactions in RAND\n01 Jan Shop 2.00 7.00 Dr 02 Feb Pay 10.00Cr 3.00Cr x\nClosing Balance 3.00 Cr"
DISCOVERY = 'Discovery Bank Limited\n"Opening balance","R10.00"\n1 Feb 2025,"Card, ""x""",-R2.50\n"2 Feb 2025\nx","Shop\nBar","R1.00\nR2.00"\n'


def test_each_bank_by_its_layout(spark):
    texts = [CAPITEC, ABSA, NEDBANK, FNB, DISCOVERY, "Standard Bank of South Africa", "", None]
    docs = spark.createDataFrame([(k, f"f{k}", t) for k, t in enumerate(texts)], "doc_id long, source_file string, text string")
    got = [tuple(r) for r in layouts.parse_statements(docs).orderBy("doc_id", "row_idx").select("doc_id", "date", "description", "amount_c", "balance_c").collect()]
    assert got == [
        (0, "01/02/2025", "A wrapped", 500, 1000), (0, "02/02/2025", "B", -300, 700),
        (1, "01/01/2025", "Bal Brought Forward", 0, 10000), (1, "02/01/2025", "Shop", 1000, 11000), (1, "04/01/2025", "Shop", -100, 10900),
        (2, "02/01/2025", "OPENING BALANCE", 0, 1000), (2, "03/01/2025", "SHOP MORE WORDS", -200, 800), (2, "04/01/2025", "SHOP", -100, 700),
        (3, "01/01/2025", "Shop", -200, -700), (3, "02/02/2025", "Pay", 1000, 300),
        (4, "01/02/2025", 'CARD "X"', -250, 750), (4, "02/02/2025", "SHOP", 100, 850),
    ]
    heads = {r.doc_id: r for r in layouts.statements(docs).collect()}
    assert [heads[k].n_transactions for k in range(8)] == [2, 3, 3, 2, 2, 0, 0, 0]
    assert [heads[k].reconciled for k in range(8)] == [True, True, True, True, False, None, None, None]
    assert (heads[0].statement_id, heads[0].source_file, heads[3].opening_c, heads[4].closing_c) == ("ab-1", "f0", -500, 0)
    both = {r.doc_id: r for r in layouts.statements(docs, layouts.parse_statements(docs)).collect()}
    assert all(both[k][c] == heads[k][c] for k in range(8) for c in both[k].__fields__)
    for k, plan in enumerate((layouts.capitec, layouts.absa, layouts.nedbank, layouts.fnb, layouts.discovery)):
        own = plan(docs.where(F.col("doc_id") == k)).orderBy("row_idx").select("doc_id", "date", "description", "amount_c", "balance_c").collect()
        assert [tuple(r) for r in own] == [g for g in got if g[0] == k]


def test_repeated_document_ids_do_not_fail(spark):
    docs = spark.createDataFrame([(1, "a", CAPITEC), (1, "b", CAPITEC)], "doc_id long, source_file string, text string")
    assert layouts.parse_statements(docs).count() == 4


def test_lexer_on_random_text(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices('ab ",\n\r\x1b\x1e\x1f012é', weights=[3, 3, 2, 6, 5, 4, 1, 1, 1, 1, 1, 1, 1, 1], k=rng.randrange(40))) for _ in range(1500)]
    texts += ['""', '"', '"""', '""""', 'a""b', '"a""b"', ",", "\n", "\n\n", "a\n", '"\n"', '"a"b"c', None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", segment.lex_csv("text").alias("rows"))
    assert "Python" not in plan_of(df)
    got = dict(map(tuple, df.collect()))
    for k, t in enumerate(texts):
        assert got[k] == segment.csv_cells((t or "").replace("\r", "")), repr(t)


def test_lexer_is_linear(spark):
    text = '"1 Feb 2025","x, ""y""",R1.00\n' * 40_000
    assert spark.createDataFrame([(text,)], "text string").select(F.size(segment.lex_csv("text"))).first()[0] == 40_000


def pair_plain(rows, opening, tolerance=5):
    state, out = opening, []
    for idx, tokens, forward, rejected in rows:
        if forward:
            state = opening
            out.append((idx, 0, opening))
        elif tokens and not rejected:
            hit = next(((tokens[i], tokens[j]) for i in range(len(tokens) - 1, 0, -1) for j in range(i - 1, -1, -1) if abs(state + tokens[j] - tokens[i]) < tolerance), None)
            balance, amount = hit or (tokens[-1], tokens[-1] - state)
            out.append((idx, amount, balance))
            state = balance
    return out


def signed_plain(rows, opening, most_amount, most_balance):
    state, out = opening, []
    for idx, printed, balance, rejected in rows:
        if balance is None:
            continue
        if state is None:
            amount = printed
        elif printed is None:
            amount = balance - state
        elif balance == state - abs(printed):
            amount = -abs(printed)
        elif balance == state + abs(printed):
            amount = abs(printed)
        else:
            amount = balance - state
        if not rejected and amount and balance and abs(amount) <= most_amount and abs(balance) <= most_balance:
            out.append((idx, amount, balance))
            state = balance
    return out


@pytest.mark.parametrize("seed", range(4))
def test_folds_in_spans(spark, monkeypatch, seed):
    monkeypatch.setattr(ledger, "SPAN", 3)
    rng = random.Random(seed)
    few = range(-8, 9)
    pairs, signs, want_pairs, want_signs = [], [], [], []
    for doc in range(60):
        n, opening = rng.randrange(1, 40), rng.choice([None, *few])
        idx = sorted(rng.sample(range(60), n))
        p = [(i, [rng.choice(few) for _ in range(rng.choice([0, 1, 2, 2, 3]))], rng.random() < 0.05, rng.random() < 0.2) for i in idx]
        s = [(i, rng.choice([None, *few]), rng.choice([None, *few, 30, 60]), rng.random() < 0.2) for i in idx]
        pairs += [(doc, opening or 0, *x) for x in p]
        signs += [(doc, opening, *x) for x in s]
        want_pairs += [(doc, *x) for x in pair_plain(p, opening or 0)]
        want_signs += [(doc, *x) for x in signed_plain(s, opening, 4, 50)]
    df = spark.createDataFrame(pairs, "doc_id int, opening_c long, row_idx long, tokens array<long>, forward boolean, rejected boolean")
    assert sorted(map(tuple, ledger.pair_fold(df).select("doc_id", "row_idx", "amount_c", "balance_c").collect())) == want_pairs
    df = spark.createDataFrame(signs, "doc_id int, opening_c long, row_idx long, printed_c long, balance_c long, rejected boolean")
    assert sorted(map(tuple, ledger.signed_fold(df, 4, 50).select("doc_id", "row_idx", "amount_c", "balance_c").collect())) == want_signs


def test_long_document_is_many_tasks(spark):
    rows = spark.range(200_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("row_idx"), F.array(F.lit(100), 100 * (F.col("id") + 1)).cast("array<long>").alias("tokens"), F.lit(0).cast("long").alias("opening_c"), F.lit(False).alias("forward"), F.lit(False).alias("rejected"))
    out = ledger.pair_fold(rows).withColumn("task", F.spark_partition_id())
    n, good, tasks = out.agg(F.count("*"), F.count_if((F.col("amount_c") == 100) & (F.col("balance_c") == 100 * (F.col("row_idx") + 1))), F.count_distinct("task")).first()
    assert n == good == 200_000 and tasks > 1


def test_deductions_day_by_day(spark):
    rng = random.Random(9)
    users = [(u, rng.choice(["FREE", "PAYG_10", "MONTHLY_25", "PRO_YEAR_UNLIMITED", "OTHER"]), rng.choice([None, -2, 0, 3, 40]), rng.choice([None, 0, 14, 20])) for u in range(80)]
    at = datetime.datetime(2024, 1, 1)
    uses = [(u, at + datetime.timedelta(minutes=rng.randrange(6000)), k, rng.random() < 0.03, rng.random() < 0.7) for u in range(80) for k in range(rng.randrange(1, 150))]
    u = spark.createDataFrame(users, "user_id int, plan_code string, credits_remaining int, lifetime_parses_used int")
    e = spark.createDataFrame(uses, "user_id int, ts timestamp, event_id int, cycle_over boolean, live boolean")
    want = []
    for user, plan, credits, used in users:
        credits, used, ok, n = credits or 0, used or 0, 0, 0
        for _, _, _, over, live in sorted((x for x in uses if x[0] == user), key=lambda x: (x[1], x[2])):
            if plan == "MONTHLY_25" and over:
                credits = 25
            good = {"FREE": used < 15, "PAYG_10": credits > 0, "MONTHLY_25": credits > 0, "PRO_YEAR_UNLIMITED": live}.get(plan, False)
            credits -= good and plan in ("PAYG_10", "MONTHLY_25")
            used += good and plan == "FREE"
            ok, n = ok + good, n + 1
        want.append((user, ok, n - ok, credits, used))
    assert sorted(map(tuple, entitle.deductions(e, u).select("user_id", "n_ok", "n_refused", "credits", "used").collect())) == want
