"""Steps that larger tables broke or slowed down, against plain versions."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ledger

DATA = "/root/testdata/sf0.001"


def pair_plain(rows, opening, tolerance=5):
    """pair_fold with numbers of any size; an amount that is no 64-bit number is null."""
    state, out = opening, []
    for idx, tokens, rejected in rows:
        if tokens and not rejected:
            hit = next(((tokens[i], tokens[j]) for i in range(len(tokens) - 1, 0, -1) for j in range(i - 1, -1, -1) if abs(state + tokens[j] - tokens[i]) < tolerance), None)
            balance, amount = hit or (tokens[-1], tokens[-1] - state)
            out.append((idx, amount if -(2**63) <= amount < 2**63 else None, balance))
            state = balance
    return out


def test_pair_fold_of_numbers_near_the_edges(spark, monkeypatch):
    monkeypatch.setattr(ledger, "SPAN", 3)
    rng = random.Random(1)
    some = [x + d for x in (-(2**63), -(2**62), 0, 2**62, 2**63 - 1) for d in range(-6, 7) if -(2**63) <= x + d < 2**63]
    rows, want = [], []
    for doc in range(150):
        opening = rng.choice(some)
        own = [(i, [rng.choice(some) for _ in range(rng.choice([1, 2, 3, 3]))], rng.random() < 0.2) for i in range(12)]
        rows += [(doc, opening, i, t, False, r) for i, t, r in own]
        want += [(doc, *x) for x in pair_plain(own, opening)]
    df = spark.createDataFrame(rows, "doc_id int, opening_c long, row_idx long, tokens array<long>, forward boolean, rejected boolean")
    got = sorted((tuple(r) for r in ledger.pair_fold(df).select("doc_id", "row_idx", "amount_c", "balance_c").collect()), key=lambda r: r[:2])
    assert got == want


def test_texts_of_many_layouts_are_rendered_in_one_pass(spark):
    from ledgerloom.queries import layouts

    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    for docs in (layouts._mixed(spark, DATA), layouts._all_banks(spark, DATA)):
        plan = docs._jdf.queryExecution().executedPlan().toString()
        assert "Union" not in plan and len(re.findall("FileScan", plan)) == 1


def test_stages_whose_method_is_too_long_to_be_compiled_go_without_it(spark):
    from ledgerloom.plans import layouts, stages

    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    try:
        spark.conf.unset(name)
        layouts.standard_bank(docs)
        assert spark.conf.get(name) == str(stages.COMPILED)
        spark.conf.set(name, "20000")
        layouts.blocks_v2(docs)
        assert spark.conf.get(name) == "20000"
    finally:
        spark.conf.set(name, before)


def test_a_busy_key_is_many_tasks(spark):
    from ledgerloom import streaming

    n = 6000
    df = spark.range(n).select(F.col("id").alias("event_id"), F.lit("a").alias("client"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7).alias("ts"))
    out = streaming.first_hit_windows(df, "client", 100)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # The hits themselves never meet by key alone.
    assert not re.search(r"Window [^\n]*\[_key#\d+\], \[at", plan)
    got = [tuple(r) for r in out.select("event_id", F.unix_seconds("window_start"), "refused").orderBy("event_id").collect()]
    each = 129
    assert got == [(i, 1_700_000_000 + i // each * each * 7, i % each >= 100) for i in range(n)]


def test_first_hits_without_a_key_are_one_key(spark):
    from ledgerloom import streaming

    df = spark.sql("SELECT id AS event_id, CAST(NULL AS STRING) AS client, timestamp_seconds(id * 400 - 2000) AS ts FROM range(8)")
    got = [(r.event_id, r.refused) for r in streaming.first_hit_windows(df, "client", 2).orderBy("event_id").collect()]
    assert got == [(i, i % 3 == 2) for i in range(8)]


def test_squeeze_and_title_case_of_odd_text(spark):
    from ledgerloom.functions import text

    rng = random.Random(6)
    signs = "aBz09_ -/\t\n\x0b\x0c\r\x1c\x85\xa0 ᠎ ​   　éÉİ😀."
    texts = ["".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(800)] + ["absa/fnb-x absab", "", " ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.squeeze(F.col("t")), F.trim(F.regexp_replace("t", r"(?U)\s+", " ")), text.title_case(F.col("t")), F.lower("t"))
    for t, squeezed, want, title, low in df.collect():
        assert squeezed == want, repr(t)
        if t is not None:
            cased = "".join(x.upper() if re.match("[a-z0-9_]", x) and not (i and re.match("[a-z0-9_]", low[i - 1])) else x for i, x in enumerate(low))
            assert re.sub(r"\bFnb\b", "FNB", re.sub(r"\bAbsa\b", "ABSA", title, flags=re.A), flags=re.A) == re.sub(r"\bFnb\b", "FNB", re.sub(r"\bAbsa\b", "ABSA", cased, flags=re.A), flags=re.A), repr(t)


def test_a_text_is_squeezed_once_to_tell_its_bank(spark):
    from ledgerloom.operators import classify

    docs = spark.range(1).select(F.col("id").cast("string").alias("t"))
    plan = docs.select(classify.request_error(F.lit(1), classify.dispatch_bank(F.col("t")), F.lit(1)).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("regexp_replace", plan)) == 1
