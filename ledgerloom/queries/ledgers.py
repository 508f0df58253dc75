"""Ledger reconstruction, aggregation and segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, money
from ..functions.money import as_text
from ..operators import classify as K
from ..operators import ledger as L
from ..operators import normalize as N
from ..operators import segment as S
from .base import LEDGER_SQL, OPENING_C, ledger, printed, rendered, table


def ledger_roundtrip(spark, d) -> DataFrame:
    """Render each ledger as wrapped text, segment it again, read dates and balances and take differences."""
    text = rendered(ledger(spark, d), F.concat(printed(F.col("day")), F.lit(" Order\nno "), F.col("o_orderkey").cast("string"), F.lit(": "), as_text(F.col("balance_c"))), "Date Description Balance\n")
    rows = S.blocks(S.lines(text).where(~F.col("line").rlike(r"(?i)^Date\s+Description")), F.col("line").rlike(r"^\d{1,2}[/\s-]"))
    rows = rows.select("doc_id", "row_idx", dates.slashed(F.col("text")).alias("day"), money.leading_sign(money.last_two(F.col("text"))[1]).alias("balance_c"))
    return L.deltas(rows, opening=F.lit(OPENING_C)).select("doc_id", F.col("row_idx").cast("long").alias("row_idx"), F.col("day").cast("string").alias("day"), "amount_c", "balance_c")


def ledger_running_balance(spark, d) -> DataFrame:
    opening = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.round(F.col("c_acctbal").cast("decimal(18,2)") * 100).cast("long").alias("opening_c"))
    rows = ledger(spark, d).drop("balance_c").join(opening, "doc_id")
    return L.running(rows, F.col("opening_c")).select("doc_id", "row_idx", "amount_c", "balance_c")


def ledger_balance_delta(spark, d) -> DataFrame:
    return L.deltas(ledger(spark, d).drop("amount_c"), opening=F.lit(OPENING_C)).select("doc_id", "row_idx", "amount_c")


def _marked_events(spark, d) -> DataFrame:
    """Users' events as ledger lines: a signup opens, an error closes, values are balances; every ninth opening has none."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("row_idx", F.row_number().over(w))
    balance = F.floor(F.col("value") * 100).cast("long")
    return e.select(F.col("user_id").alias("doc_id"), "row_idx", "event_type", F.when((F.col("event_type") == "signup") & (F.col("event_id") % 9 == 0), None).otherwise(balance).alias("balance_c"))


def ledger_seed_segments(spark, d) -> DataFrame:
    rows = L.from_opening_rows(_marked_events(spark, d), F.col("event_type") == "signup", F.col("event_type") == "error")
    return rows.select("doc_id", F.col("row_idx").cast("long").alias("row_idx"), F.col("amount_c").cast("long").alias("amount_c"), "balance_c")


def ledger_pair_fold(spark, d) -> DataFrame:
    """Each row has a stray number, its amount and its balance, in one of three orders; every seventh row is rejected.

    Stray numbers are order numbers times 10^12; those of orders whose product would be no 64-bit number begin anew.
    """
    b, a, s = F.col("balance_c"), F.col("amount_c"), F.col("o_orderkey") % (L.GREATEST // 1_000_000_000_000) * 1_000_000_000_000
    tokens = F.when(F.col("o_orderkey") % 3 == 0, F.array(s, a, b)).when(F.col("o_orderkey") % 3 == 1, F.array(a, s, b)).otherwise(F.array(a, b, s))
    rows = ledger(spark, d).select("doc_id", "row_idx", tokens.alias("tokens"), F.lit(False).alias("forward"), (F.col("o_orderkey") % 7 == 0).alias("rejected"), F.lit(OPENING_C).cast("long").alias("opening_c"))
    return L.pair_fold(rows)


def ledger_signed_fold(spark, d) -> DataFrame:
    """Printed amounts without signs; every fifth row has none, every eleventh a balance too large, which is dropped."""
    k = F.col("o_orderkey")
    rows = ledger(spark, d).select(
        "doc_id", "row_idx", F.when(k % 5 == 0, None).otherwise(F.abs("amount_c")).alias("printed_c"), F.when(k % 11 == 0, F.col("balance_c") + 2_000_000_000).otherwise(F.col("balance_c")).alias("balance_c"),
        (k % 13 == 0).alias("rejected"), F.lit(OPENING_C).cast("long").alias("opening_c"),
    )
    return L.signed_fold(rows)


def date_carry_forward(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), "event_id", F.row_number().over(w).alias("row_idx"), F.when(F.col("event_type").isin("click", "signup"), F.col("ts").cast("date")).alias("date"))
    return L.carry_dates(e).select("doc_id", "event_id", F.col("date").cast("string").alias("date"))


def reversal_exclusion(spark, d) -> DataFrame:
    """Purchases that an error follows, at once or after a click, don't count."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumns({"n1": F.lead("event_type", 1).over(w), "n2": F.lead("event_type", 2).over(w)})
    gone = L.reversed_rows(F.col("n1"), F.col("n2"), lambda c: c == "click", lambda c: c == "error")
    return e.where((F.col("event_type") == "purchase") & ~gone).select("user_id", "event_id")


def magnitude_guard(spark, d) -> DataFrame:
    return L.within(ledger(spark, d), 300_000, 12_000_000).select("doc_id", "row_idx", "amount_c")


def line_blocks(spark, d) -> DataFrame:
    """Documents' lines in blocks that begin with a line of an upper-case T, E or D."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = S.blocks(S.lines(docs), F.col("line").rlike("^[TED]"))
    return rows.select("doc_id", F.col("row_idx").cast("long").alias("row_idx"), F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.encode("text", "UTF-8")).alias("md5"))


def pair_scan(spark, d) -> DataFrame:
    side = F.when(F.col("balance_c") < 0, "Dr").otherwise("Cr")
    text = rendered(ledger(spark, d), F.concat_ws(" ", F.date_format("day", "dd"), F.lit("Order"), as_text(F.abs("amount_c")), as_text(F.abs("balance_c")), side))
    rows = S.amount_balance_pairs(text)
    return rows.select("doc_id", (F.col("row_idx") + 1).cast("long").alias("row_idx"), money.plain(F.col("amount")).alias("size_c"), money.plain(F.col("balance")).alias("balance_c"), F.col("balance_side").alias("side"))


def neighbour_context(spark, d) -> DataFrame:
    """Each line with the length of the line before and after it."""
    rows = S.lines(table(spark, d, "documents").select("doc_id", "text"), keep_empty=True)
    w = S.by_line()
    rows = rows.withColumns({"before": F.octet_length(F.lag("line").over(w)), "after": F.octet_length(F.lead("line").over(w))})
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.coalesce("before", F.lit(-1)).cast("long").alias("before"), F.coalesce("after", F.lit(-1)).cast("long").alias("after"))


def cell_unzip(spark, d) -> DataFrame:
    """Orders as one record of two cells of many lines per customer, unzipped into rows."""
    rows = ledger(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", "o_orderkey", "amount_c"))).alias("l"))
    text = F.concat(F.lit('"'), F.array_join(F.transform("l", lambda x: x["o_orderkey"].cast("string")), "\n"), F.lit('","'), F.array_join(F.transform("l", lambda x: x["amount_c"].cast("string")), "\n"), F.lit('"\n'))
    out = S.unzipped_cells(rows.select("doc_id", text.alias("text")))
    return out.select("doc_id", (F.col("row_idx") + 1).cast("long").alias("row_idx"), F.get(F.split("text", " "), 0).cast("long").alias("o_orderkey"), F.get(F.split("text", " "), 1).cast("long").alias("amount_c"))


def line_regex_rows(spark, d) -> DataFrame:
    text = rendered(ledger(spark, d), F.concat_ws("  ", printed(F.col("day")), F.lit("Order"), money.plain_text(F.col("amount_c")), money.plain_text(F.col("balance_c"))), "Heading\n")
    rows = S.pattern_rows(text)
    return rows.select("doc_id", F.col("line_no").cast("long").alias("row_idx"), dates.slashed(F.col("date")).cast("string").alias("day"), money.leading_sign(F.col("amount")).alias("amount_c"), money.leading_sign(F.col("balance")).alias("balance_c"))


def doc_totals(spark, d) -> DataFrame:
    t = L.totals(ledger(spark, d))
    return t.withColumn("reconciled", L.reconciled(F.col("opening_c"), F.col("credits_c"), F.col("debits_c"), F.col("closing_c")))


def balance_precedence(spark, d) -> DataFrame:
    """Printed closings of every other document are missing; every third takes both balances from its rows."""
    t = L.totals(ledger(spark, d))
    o, c = L.balances(F.lit(1).cast("long"), F.when(F.col("doc_id") % 2 == 0, F.lit(2)).cast("long"), F.col("opening_c"), F.col("closing_c"), F.col("doc_id") % 3 == 0)
    return t.select("doc_id", o.alias("opening_c"), c.alias("closing_c"))


def ledger_continuity_fee(spark, d) -> DataFrame:
    """Ledgers with fees of 1.00 every fourth row that every eighth balance forgets."""
    k = F.col("o_orderkey")
    rows = N.debit_credit(ledger(spark, d)).withColumn("fee_c", F.when(k % 4 == 0, 100))
    w = L.so_far()
    rows = rows.withColumn("balance_c", F.col("balance_c") - F.sum(F.when((k % 4 == 0) & (k % 8 != 0), 100).otherwise(0)).over(w))
    return L.fee_continuity(rows).select("doc_id", "row_idx", "expected_c", "continuous")


def ledger_check(spark, d) -> DataFrame:
    """The ledgers of ledger_continuity_fee by customer; customers without orders have no ledger."""
    k = F.col("o_orderkey")
    rows = N.debit_credit(ledger(spark, d)).withColumns({"fee_c": F.when(k % 4 == 0, 100), "date": printed(F.col("day"))})
    rows = rows.withColumn("balance_c", F.col("balance_c") - F.sum(F.when((k % 4 == 0) & (k % 8 != 0), 100).otherwise(0)).over(L.so_far()))
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))
    return L.ledger_check(docs, rows).withColumn("warnings", F.array_join("warnings", "\n"))


def section_rows(spark, d) -> DataFrame:
    """Wrapped rows put together; the sections of every fifth customer hold headings only."""
    some = F.col("doc_id") % 5 != 0
    line = F.when(some, F.concat(printed(F.col("day")), F.lit(" Order\nno "), F.col("o_orderkey").cast("string"))).otherwise("Date Description")
    docs = rendered(ledger(spark, d), line, "Date Description Balance\n")
    rows = S.merged_rows(docs)
    return rows.unionByName(S.section_errors(docs, rows).select("doc_id", F.lit(-1).alias("row_idx"), F.col("error_code").alias("text")))


def normalise_rows(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, "Total VAT").when(k % 5 == 1, " Credit transfer ").when(k % 5 == 2, F.concat(F.lit("Cash "), F.date_format("day", "ddMMyy"))).otherwise("Debit credit")
    rows = ledger(spark, d).select("doc_id", "row_idx", F.when(k % 2 == 0, printed(F.col("day"))).otherwise("99/99/1999").alias("date"), text.alias("description"), "amount_c", "balance_c")
    return N.standard_rows(rows, F.lit("31 December 2011")).select("doc_id", "row_idx", "date", "description", "amount_c")


def noise_filter(spark, d) -> DataFrame:
    """Lines of documents, every third one turned into page furniture, that are none."""
    rows = S.lines(table(spark, d, "documents").select("doc_id", "text"))
    rows = rows.withColumn("line", F.when(F.col("line_no") % 3 == 1, F.concat(F.lit("Page "), F.col("line_no"), F.lit(" of 9 "), F.col("line"))).when(F.col("line_no") % 3 == 2, F.concat(F.lit("TAX INVOICE "), F.col("line"))).otherwise(F.col("line")))
    return rows.where(~K.noise_line(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


QUERIES = {f.__name__: f for f in (
    ledger_roundtrip, ledger_running_balance, ledger_balance_delta, ledger_seed_segments, ledger_pair_fold, ledger_signed_fold, date_carry_forward, reversal_exclusion, magnitude_guard, line_blocks, pair_scan,
    neighbour_context, cell_unzip, line_regex_rows, doc_totals, balance_precedence, ledger_continuity_fee, ledger_check, section_rows, normalise_rows, noise_filter,
)}

_MARKED = """
marked AS (
  SELECT user_id AS doc_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row_idx,
    CASE WHEN event_type = 'signup' AND event_id % 9 = 0 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS balance_c FROM events
)"""
_LINES = "SELECT doc_id, r.i - 1 AS line_no, trim(ls[r.i]) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS r(i)"

ORACLES = {
    "ledger_roundtrip": f"WITH {LEDGER_SQL} SELECT doc_id, row_idx, CAST(day AS VARCHAR) AS day, amount_c, balance_c FROM ledger",
    "ledger_running_balance": f"""WITH {LEDGER_SQL} SELECT doc_id, row_idx, amount_c,
        CAST(CAST(round(CAST(c_acctbal AS DECIMAL(18,2)) * 100) AS BIGINT) + sum(amount_c) OVER (PARTITION BY doc_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance_c
        FROM ledger JOIN customer ON c_custkey = doc_id""",
    "ledger_balance_delta": f"WITH {LEDGER_SQL} SELECT doc_id, row_idx, amount_c FROM ledger",
    "ledger_seed_segments": f"""WITH {_MARKED}, seg AS (
          SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS s FROM marked
        ), used AS (SELECT * FROM seg WHERE s > 0 AND (event_type = 'signup' OR (balance_c IS NOT NULL AND event_type <> 'error'))),
        seeds AS (SELECT doc_id, s, max(CASE WHEN event_type = 'signup' THEN balance_c END) AS seed FROM used GROUP BY doc_id, s)
        SELECT doc_id, row_idx, CASE WHEN event_type = 'signup' THEN 0 ELSE balance_c - lag(balance_c) OVER (PARTITION BY doc_id, s ORDER BY row_idx) END AS amount_c, balance_c
        FROM used JOIN seeds USING (doc_id, s) WHERE event_type = 'signup' OR seed IS NOT NULL""",
    # Amount and balance always add up unless the row before was rejected; then the last token is the balance.
    "ledger_pair_fold": f"""WITH RECURSIVE {LEDGER_SQL}, t AS (
          SELECT doc_id, row_idx, o_orderkey % 7 = 0 AS rejected, amount_c AS a, balance_c AS b, o_orderkey * 1000000000000 AS s, o_orderkey % 3 AS k,
            CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey * 1000000000000 ELSE balance_c END AS last FROM ledger
        ), pairs AS (
          SELECT doc_id, row_idx, n, bal, amt FROM t, LATERAL (VALUES
            (1, CASE k WHEN 2 THEN s ELSE b END, CASE k WHEN 0 THEN a WHEN 1 THEN s ELSE b END),
            (2, CASE k WHEN 2 THEN s ELSE b END, CASE k WHEN 0 THEN s WHEN 1 THEN a ELSE a END),
            (3, CASE k WHEN 0 THEN a WHEN 1 THEN s ELSE b END, CASE k WHEN 0 THEN s WHEN 1 THEN a ELSE a END)) AS p(n, bal, amt)
        ), fold AS (
          SELECT doc_id, CAST(0 AS BIGINT) AS row_idx, CAST({OPENING_C} AS BIGINT) AS state, CAST(NULL AS BIGINT) AS amount_c, false AS kept FROM (SELECT DISTINCT doc_id FROM ledger)
          UNION ALL
          SELECT f.doc_id, t.row_idx, CASE WHEN t.rejected THEN f.state ELSE coalesce((SELECT arg_min(bal, n) FROM pairs p WHERE p.doc_id = t.doc_id AND p.row_idx = t.row_idx AND abs(f.state + amt - bal) < 5), t.last) END,
            coalesce((SELECT arg_min(amt, n) FROM pairs p WHERE p.doc_id = t.doc_id AND p.row_idx = t.row_idx AND abs(f.state + amt - bal) < 5), t.last - f.state), NOT t.rejected
          FROM fold f JOIN t ON t.doc_id = f.doc_id AND t.row_idx = f.row_idx + 1
        ) SELECT doc_id, row_idx, amount_c, state AS balance_c FROM fold WHERE kept""",
    "ledger_signed_fold": f"""WITH RECURSIVE {LEDGER_SQL}, t AS (
          SELECT doc_id, row_idx, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE abs(amount_c) END AS p, CASE WHEN o_orderkey % 11 = 0 THEN balance_c + 2000000000 ELSE balance_c END AS b, o_orderkey % 13 = 0 AS rejected FROM ledger
        ), fold AS (
          SELECT doc_id, CAST(0 AS BIGINT) AS row_idx, CAST({OPENING_C} AS BIGINT) AS state, CAST(NULL AS BIGINT) AS amount_c, false AS kept FROM (SELECT DISTINCT doc_id FROM ledger)
          UNION ALL
          SELECT doc_id, row_idx, CASE WHEN ok THEN b ELSE state END, a, ok FROM (
            SELECT *, coalesce(NOT rejected AND a <> 0 AND b <> 0 AND abs(a) <= 10000000 AND abs(b) <= 1000000000, false) AS ok FROM (
              SELECT t.doc_id, t.row_idx, f.state, t.b, t.rejected, CASE WHEN p IS NULL THEN b - state WHEN abs(b - (state - p)) < 1 THEN -p WHEN abs(b - (state + p)) < 1 THEN p ELSE b - state END AS a
              FROM fold f JOIN t ON t.doc_id = f.doc_id AND t.row_idx = f.row_idx + 1))
        ) SELECT doc_id, row_idx, amount_c, state AS balance_c FROM fold WHERE kept""",
    "date_carry_forward": """SELECT user_id AS doc_id, event_id, CAST(last_value(CASE WHEN event_type IN ('click', 'signup') THEN CAST(ts AS DATE) END IGNORE NULLS)
        OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS date FROM events""",
    "reversal_exclusion": """SELECT user_id, event_id FROM (SELECT *, lead(event_type, 1) OVER w AS n1, lead(event_type, 2) OVER w AS n2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        WHERE event_type = 'purchase' AND NOT coalesce(n1 = 'error', false) AND NOT (coalesce(n1 = 'click', false) AND coalesce(n2 = 'error', false))""",
    "magnitude_guard": f"WITH {LEDGER_SQL} SELECT doc_id, row_idx, amount_c FROM ledger WHERE abs(amount_c) <= 300000 AND abs(balance_c) <= 12000000",
    "line_blocks": f"""WITH l AS (SELECT * FROM ({_LINES}) WHERE line <> ''), b AS (
          SELECT *, sum(CASE WHEN regexp_matches(line, '^[TED]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS row_idx FROM l
        ), j AS (SELECT doc_id, CAST(row_idx AS BIGINT) AS row_idx, string_agg(line, ' ' ORDER BY line_no) AS t FROM b WHERE row_idx > 0 GROUP BY ALL)
        SELECT doc_id, row_idx, CAST(strlen(t) AS BIGINT) AS n_bytes, md5(t) AS md5 FROM j""",
    "pair_scan": f"WITH {LEDGER_SQL} SELECT doc_id, row_idx, abs(amount_c) AS size_c, abs(balance_c) AS balance_c, CASE WHEN balance_c < 0 THEN 'Dr' ELSE 'Cr' END AS side FROM ledger",
    "neighbour_context": f"""WITH l AS ({_LINES}) SELECT doc_id, line_no, before, after FROM (
          SELECT doc_id, line_no, CAST(coalesce(lag(strlen(line)) OVER w, -1) AS BIGINT) AS before, CAST(coalesce(lead(strlen(line)) OVER w, -1) AS BIGINT) AS after FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))""",
    "cell_unzip": f"WITH {LEDGER_SQL} SELECT doc_id, row_idx, o_orderkey, amount_c FROM ledger",
    "line_regex_rows": f"WITH {LEDGER_SQL} SELECT doc_id, row_idx, CAST(day AS VARCHAR) AS day, amount_c, balance_c FROM ledger",
    "doc_totals": f"""WITH {LEDGER_SQL} SELECT doc_id, count(*) AS n_transactions, CAST(coalesce(sum(amount_c) FILTER (WHERE amount_c > 0), 0) AS BIGINT) AS credits_c, CAST(coalesce(-sum(amount_c) FILTER (WHERE amount_c <= 0), 0) AS BIGINT) AS debits_c,
        CAST({OPENING_C} AS BIGINT) AS opening_c, arg_max(balance_c, row_idx) AS closing_c, true AS reconciled FROM ledger GROUP BY doc_id""",
    "balance_precedence": f"""WITH {LEDGER_SQL}, t AS (SELECT doc_id, CAST({OPENING_C} AS BIGINT) AS o, arg_max(balance_c, row_idx) AS c FROM ledger GROUP BY doc_id)
        SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN o ELSE 1 END AS opening_c, CASE WHEN doc_id % 3 = 0 OR doc_id % 2 <> 0 THEN c ELSE 2 END AS closing_c FROM t""",
    "ledger_continuity_fee": f"""WITH {LEDGER_SQL}, f AS (
          SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN 100 ELSE 0 END AS fee, balance_c - CAST(sum(CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 8 <> 0 THEN 100 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS b FROM ledger
        ) SELECT doc_id, row_idx, expected_c, CASE WHEN expected_c IS NULL THEN NULL ELSE abs(expected_c - b) <= 1 END AS continuous FROM (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY row_idx) + amount_c - fee AS expected_c FROM f)""",
    "ledger_check": f"""WITH {LEDGER_SQL}, f AS (
          SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN 100 ELSE 0 END AS fee, balance_c - CAST(sum(CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 8 <> 0 THEN 100 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS b FROM ledger
        ), e AS (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY row_idx) + amount_c - fee AS expected_c FROM f), w AS (
          SELECT doc_id, coalesce(string_agg('Balance mismatch on ' || strftime(day, '%d/%m/%Y') || ': expected ' || CAST(CAST(expected_c AS DECIMAL(20,2)) / 100 AS DECIMAL(20,2)) || ', got ' || CAST(CAST(b AS DECIMAL(20,2)) / 100 AS DECIMAL(20,2)), chr(10) ORDER BY row_idx) FILTER (WHERE abs(expected_c - b) > 1), '') AS warnings FROM e GROUP BY doc_id
        ) SELECT c_custkey AS doc_id, warnings = '' AS valid, warnings, CASE WHEN warnings IS NULL THEN 'LEDGER_EMPTY' END AS error_code FROM customer LEFT JOIN w ON doc_id = c_custkey""",
    "section_rows": f"""WITH {LEDGER_SQL} SELECT doc_id, row_idx, strftime(day, '%d/%m/%Y') || ' Order no ' || o_orderkey AS text FROM ledger WHERE doc_id % 5 <> 0
        UNION ALL SELECT DISTINCT doc_id, -1, 'TRANSACTION_SECTION_EMPTY' FROM ledger WHERE doc_id % 5 = 0""",
    "normalise_rows": f"""WITH {LEDGER_SQL}, t AS (SELECT *, o_orderkey % 5 AS k, strftime(day, '%d/%m/%Y') AS p FROM ledger)
        SELECT doc_id, row_idx, CASE WHEN o_orderkey % 2 = 0 THEN p WHEN k = 2 THEN strftime(day, '%d/%m/') || CAST(CASE WHEN year(day) BETWEEN 2009 AND 2012 THEN year(day) ELSE 2010 END AS VARCHAR) END AS date,
          CASE k WHEN 1 THEN 'Credit transfer' WHEN 2 THEN 'Cash ' || strftime(day, '%d%m%y') ELSE 'Debit credit' END AS description, CASE WHEN k = 1 THEN abs(amount_c) ELSE amount_c END AS amount_c FROM t WHERE k <> 0""",
    "noise_filter": f"SELECT doc_id, count(*) AS n_lines FROM ({_LINES}) WHERE line <> '' AND line_no % 3 = 0 GROUP BY doc_id",
}
