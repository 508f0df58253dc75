"""Classification, scalar parsing and header extraction on documents, pages and rendered texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources
from ..functions import dates, money, references, text as X
from ..functions.money import as_text
from ..operators import classify as K
from ..operators import metadata as M
from .base import printed, table

#: Phrases planted by document number, as plain prose has none.
_PLANTED = ("absa bank opening balance debit", "FNB.co.za closing balance", "Nedbank Ltd debit credit", "capitec bank limited transaction date credit", "discovery bank limited", "Standard Bank of South Africa opening balance credit", "private vat number", "delivery note", "closing balance debit credit", "nothing")


def _planted(spark, d) -> DataFrame:
    phrase = F.element_at(F.array(*map(F.lit, _PLANTED)), (F.col("doc_id") % len(_PLANTED) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat_ws(" ", "text", phrase).alias("text"))


_PLANTED_SQL = "docs AS (SELECT doc_id, lower(text || ' ' || CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PLANTED)) + " END) AS t FROM documents)"


def classify_document(spark, d) -> DataFrame:
    return K.classify(_planted(spark, d)).select("doc_id", "document_type", "document_subtype", "confidence", "supported", F.size("reasons").alias("n_reasons"))


def signal_votes(spark, d) -> DataFrame:
    return _planted(spark, d).select("doc_id", K.votes(F.col("text")).alias("votes"))


def dispatch_bank(spark, d) -> DataFrame:
    return _planted(spark, d).select("doc_id", K.dispatch_bank(F.col("text")).alias("bank"))


def registry_lookup(spark, d) -> DataFrame:
    return K.job_status(K.classify(_planted(spark, d))).select("doc_id", "schema_key", "status")


def bank_name_map(spark, d) -> DataFrame:
    return K.classify(_planted(spark, d)).select("doc_id", K.bank_name(F.col("document_subtype")).alias("bank_name"), K.brand_in_capitals(F.col("text")).alias("brand"), K.handles(F.col("document_type")).alias("handled"))


def request_guards(spark, d) -> DataFrame:
    return _planted(spark, d).select("doc_id", K.request_error(F.col("doc_id") % 4, K.dispatch_bank(F.col("text")), F.col("doc_id") % 3).alias("error_code"))


def file_dispatch(spark, d) -> DataFrame:
    path = F.concat("url", F.element_at(F.array(*map(F.lit, (".PDF", ".txt", ".xlsx", ".xls", ""))), (F.col("page_id") % 5 + 1).cast("int")))
    return table(spark, d, "pages").select("page_id", K.file_kind(path).alias("kind"), K.convert_kind(path).alias("converter"))


def convert_guards(spark, d) -> DataFrame:
    k = F.col("page_id")
    path = F.when(k % 7 != 0, F.concat("url", F.element_at(F.array(*map(F.lit, (".PDF", ".txt", ".xlsx", ".xls", ""))), (k % 5 + 1).cast("int"))))
    return table(spark, d, "pages").select("page_id", K.convert_error(path, k % 3).alias("error_code"))


def money_parse(spark, d) -> DataFrame:
    """Prices rendered in six formats and read again."""
    c = F.floor("l_extendedprice").cast("long")
    plain, comma, blank = money.plain_text(c), as_text(c), as_text(c, " ")
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", c.alias("cents"),
        money.either_separator(F.concat(F.replace(blank, F.lit("."), F.lit(",")), F.lit("-"))).alias("either"), money.leading_sign(F.concat(F.lit("-"), comma)).alias("leading"), money.rand(F.concat(F.lit("R"), comma)).alias("rand"),
        money.trailing_sign(F.concat(comma, F.lit("-"))).alias("trailing"), money.strict(F.concat(plain, F.lit("-"))).alias("strict"), money.loose(F.concat(F.replace(plain, F.lit("."), F.lit(",")), F.lit("-"))).alias("loose"),
        money.plain(money.last_two(F.concat(F.lit("x "), blank, F.lit(" "), comma))[0]).alias("second_last"), money.normal_text(plain).alias("normal"),
        money.repaired_balance(F.concat(F.lit("12 "), plain)).alias("repaired"),
    )
    return rows.groupBy("l_orderkey").agg(*(F.sum(x).alias(x) for x in ("cents", "either", "leading", "rand", "trailing", "strict", "loose", "second_last", "repaired")), F.max("normal").alias("normal"))


def date_disambiguate(spark, d) -> DataFrame:
    """All order dates, ten years later as in ledger(), as ddmmyy, with the period 2011; and as yymmdd without a period."""
    o = table(spark, d, "orders").withColumn("day", F.add_months(F.col("o_orderdate").cast("date"), 120))
    found = dates.best_date(F.concat(F.lit("CARD ROL"), F.date_format("day", "ddMMyy")), F.lit("2011-01-01").cast("date"), F.lit("2011-12-31").cast("date"))
    return o.select("o_orderkey", found.cast("string").alias("found"), dates.best_date(F.date_format("day", "yyMMdd"), F.lit(None).cast("date"), F.lit(None).cast("date")).cast("string").alias("free"))


def date_validity(spark, d) -> DataFrame:
    """Days and months of orders put together anew, many of which are no dates."""
    k = F.col("o_orderkey")
    text = F.format_string("%02d/%02d/%04d", (k % 33).cast("int"), (k % 14).cast("int"), (F.lit(1995) + k % 8).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", dates.slashed(text).cast("string").alias("day"), dates.plausible(text).alias("plausible"), dates.normal_token(F.concat(F.lit("x "), text)).alias("token"))


def year_resolve(spark, d) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    words = F.date_format(day, "d MMMM yyyy")
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey", dates.from_description(F.concat(F.lit("PAY "), F.date_format(day, "ddMMyy")), F.lit(2000)).alias("described"), dates.period_date(words).cast("string").alias("worded"),
        dates.with_period_year(F.date_format(day, "d MMM"), day).cast("string").alias("short"), dates.end_year(words, 1900).alias("end_year"), dates.date_error(F.date_format(day, "d MMM.")).alias("error"),
    )


def text_normalise(spark, d) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(F.encode(X.squeeze(t), "UTF-8")).alias("squeezed"), F.md5(F.encode(X.title_case(t), "UTF-8")).alias("title"), F.md5(F.encode(X.clean(t, (("[aeiou]+", "v"), (r"\d", ""))), "UTF-8")).alias("cleaned"))


def reference_split(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    ref = references.new_reference(F.col("user_id"), F.concat(F.upper("event_type"), F.lit("_10")), F.col("event_id") + 1_700_000_000_000)
    return e.select("event_id", references.reference_user(ref).alias("user"), references.reference_plan(ref).alias("plan"), references.reference_user(F.lit("a_b")).alias("none"), references.bank_reference(F.col("event_id") + 1_700_000_000_000, "LL-").alias("bank"), references.price_text(F.col("event_id")).alias("price"))


def token_digest(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", references.token_digest(F.concat_ws("-", "event_type", "event_id")).alias("digest"))


def payload_hash(spark, d) -> DataFrame:
    """SHA-512, which the other engine lacks: rows only."""
    parts = (F.col("user_id"), F.upper("event_type"), F.lit(None))
    return table(spark, d, "events").select("event_id", references.payload_hash(parts, F.lit("secret"), True).alias("request"), references.payload_hash(parts, F.lit("secret"), False).alias("notice"))


def payload_parse(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    # Bodies with transactions, an empty one, a broken one, and one with more than was asked for.
    rows = F.element_at(F.array(*map(F.lit, ('{"transactions":[{"date":"x","amount":1},{"date":"y","balance":2.5}]}', "", '{"transactions":[{"date":', '{"transactions":[{"date":"x","amount":1.5,"more":{"a":[1,2]}}]}'))), (F.col("event_id") % 4 + 1).cast("int"))
    form = sources.form(F.concat(F.lit("Status="), F.col("event_type"), F.lit("&Name=A%20b&Id="), F.col("event_id").cast("string")))
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), form["Status"].alias("status"), form["Name"].alias("name"), form["Id"].cast("long").alias("id"), F.size(sources.json_transactions(F.get_json_object(rows, "$.transactions"))).alias("n"))


def text_bytes(spark, d) -> DataFrame:
    """Documents as files whose bytes are not all UTF-8: a lone Latin-1 letter, a sequence cut short, a byte that never stands in text."""
    files = table(spark, d, "documents").select(
        F.concat(F.lit("dbfs:/in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.concat(F.unhex(F.lit("636166E920")), F.encode("text", "UTF-8"), F.unhex(F.lit("20E282FF"))).alias("content"),
    )
    return sources.decoded(files).select("source_file", F.length("text").alias("length"), F.md5("text").alias("text_md5"), "error_code")


def meta_first_match(spark, d) -> DataFrame:
    """Headers rendered from customers in three spellings."""
    c = table(spark, d, "customer")
    k, cents = F.col("c_custkey"), F.abs(F.round(F.col("c_acctbal").cast("decimal(18,2)") * 100)).cast("long")
    account = F.lpad(k.cast("string"), 10, "7")
    head = F.when(k % 3 == 0, F.concat(F.lit("Account Number: "), account)).when(k % 3 == 1, F.concat(F.lit("Cheque account: "), F.substring(account, 1, 2), F.lit("-"), F.substring(account, 3, 4), F.lit("-"), F.substring(account, 7, 4))).otherwise(F.concat(F.lit("No. 1\n"), account))
    body = F.concat(head, F.lit("\nAccount holder: Jane Doe\n\n1\nOpening Balance R"), as_text(cents), F.lit("\nclosing balance: "), F.replace(money.plain_text(cents), F.lit("."), F.lit(",")), F.lit("-\nStatement period: 01/02/2001 to 28/02/2001\n"))
    return M.statement_header(c.select(k.alias("doc_id"), body.alias("text")))


def header_only_meta(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    body = F.concat(F.when(k % 4 == 0, "").otherwise("MR JOHN SMITH\n"), F.when(k % 4 == 1, "").otherwise(F.concat(F.lit("Account "), F.lpad(k.cast("string"), 8, "5"), F.lit("\n"))), F.when(k % 4 == 2, "").otherwise("From Date: 01/02/2001\nTo Date: 28/02/2001\n"), F.lit("Opening Balance: R1,234.50\n"))
    return M.strict_header(c.select(k.alias("doc_id"), body.alias("text")), "capitec")


QUERIES = {f.__name__: f for f in (
    classify_document, signal_votes, dispatch_bank, registry_lookup, bank_name_map, request_guards, file_dispatch, convert_guards, money_parse, date_disambiguate, date_validity, year_resolve, text_normalise, reference_split,
    token_digest, payload_hash, payload_parse, text_bytes, meta_first_match, header_only_meta,
)}

_VOTES = """(CAST(contains(t, 'opening balance') OR contains(t, 'balance brought forward') OR contains(t, 'bal brought forward') AS INT) + CAST(contains(t, 'closing balance') OR contains(t, 'final balance') OR contains(t, 'current balance') AS INT)
    + CAST(contains(t, 'transaction date') OR contains(t, 'date description') OR contains(t, 'date details') AS INT) + CAST(contains(t, 'debit') AS INT) + CAST(contains(t, 'credit') AS INT) + CAST(contains(t, 'balance') AS INT))"""
_KIND = f"""kinds AS (SELECT doc_id, t, CASE
    WHEN n >= 2 AND contains(t, 'absa') THEN 'absa_statement' WHEN n >= 2 AND (contains(t, 'fnb') OR contains(t, 'first national bank')) THEN 'fnb_statement' WHEN n >= 2 AND contains(t, 'nedbank') THEN 'nedbank_statement'
    WHEN n >= 2 AND contains(t, 'capitec') THEN 'capitec_statement' WHEN n >= 2 AND contains(t, 'discovery') THEN 'discovery_statement'
    WHEN n >= 2 AND (contains(t, 'standard bank') OR contains(t, 'stanbic') OR contains(t, 'blue wallet') OR contains(t, 'mymo')) THEN 'standard_bank_statement'
    WHEN n >= 3 THEN 'generic' WHEN contains(t, 'invoice') OR contains(t, 'vat') THEN 'generic_invoice'
    WHEN contains(t, 'delivery note') OR contains(t, 'proof of delivery') OR contains(t, 'waybill') THEN 'generic_delivery_note' ELSE 'unknown' END AS kind
  FROM (SELECT *, {_VOTES} AS n FROM docs))"""
_BANK = """CASE WHEN contains(q, 'standard bank of south africa') OR contains(q, 'transact@standardbank.co.za') OR contains(q, '0860 123 000') THEN 'UNSUPPORTED_BANK'
    WHEN contains(q, 'discovery gold transaction account') OR contains(q, 'discovery bank limited') THEN 'Discovery' WHEN contains(q, 'nedbank ltd') OR contains(q, 'see money differently') THEN 'Nedbank'
    WHEN contains(q, 'unique document no') OR contains(q, 'capitec bank limited') OR contains(q, 'client care centre') THEN 'Capitec' WHEN contains(q, 'absa') AND (contains(q, 'cheque account') OR contains(q, 'absa bank')) THEN 'ABSA'
    WHEN contains(q, 'first national bank') OR contains(q, 'fnb.co.za') THEN 'FNB' ELSE 'UNKNOWN_BANK' END"""
_BANKS = f"banks AS (SELECT doc_id, {_BANK} AS bank FROM (SELECT doc_id, regexp_replace(t, '\\s+', ' ', 'g') AS q FROM docs))"
_STATEMENT = "kind LIKE '%statement' OR kind = 'generic'"

ORACLES = {
    "classify_document": f"""WITH {_PLANTED_SQL}, {_KIND} SELECT doc_id, CASE WHEN {_STATEMENT} THEN 'bank_statement' WHEN kind = 'generic_invoice' THEN 'invoice' WHEN kind = 'generic_delivery_note' THEN 'delivery_note' ELSE 'unknown' END AS document_type,
        CASE WHEN kind = 'generic' THEN 'unknown' ELSE kind END AS document_subtype, CAST(CASE WHEN kind LIKE '%statement' THEN 0.98 WHEN kind = 'generic' THEN 0.85 WHEN kind = 'unknown' THEN 0.2 ELSE 0.7 END AS DOUBLE) AS confidence,
        {_STATEMENT} AS supported, CASE WHEN kind LIKE '%statement' THEN 2 ELSE 1 END AS n_reasons FROM kinds""",
    "signal_votes": f"WITH {_PLANTED_SQL} SELECT doc_id, {_VOTES} AS votes FROM docs",
    "dispatch_bank": f"WITH {_PLANTED_SQL}, {_BANKS} SELECT doc_id, bank FROM banks",
    "registry_lookup": f"WITH {_PLANTED_SQL}, {_KIND} SELECT doc_id, CASE WHEN {_STATEMENT} THEN 'bank_statement.v1' END AS schema_key, CASE WHEN {_STATEMENT} THEN 'completed' ELSE 'unsupported' END AS status FROM kinds",
    "bank_name_map": f"""WITH {_PLANTED_SQL}, {_KIND} SELECT k.doc_id, CASE WHEN contains(kind, 'absa') THEN 'ABSA' WHEN contains(kind, 'standard_bank') THEN 'Standard Bank' ELSE 'unknown' END AS bank_name,
        CASE WHEN contains(d.text, 'CAPITEC') THEN 'Capitec' WHEN contains(d.text, 'First National Bank') OR contains(d.text, 'FNB') OR d.doc_id % 10 = 1 THEN 'FNB' END AS brand, {_STATEMENT} AS handled FROM kinds k JOIN documents d USING (doc_id)""",
    "request_guards": f"WITH {_PLANTED_SQL}, {_BANKS} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'NO_FILES' WHEN bank IN ('UNSUPPORTED_BANK', 'UNKNOWN_BANK') THEN bank WHEN doc_id % 3 = 0 THEN 'NO_TRANSACTIONS' END AS error_code FROM banks",
    "file_dispatch": """SELECT page_id, CASE WHEN page_id % 5 = 0 OR lower(url) LIKE '%.pdf' AND page_id % 5 = 4 THEN 'pdf' WHEN page_id % 5 = 1 OR lower(url) LIKE '%.txt' AND page_id % 5 = 4 THEN 'text' ELSE 'unknown' END AS kind,
        CASE WHEN page_id % 5 = 0 OR lower(url) LIKE '%.pdf' AND page_id % 5 = 4 THEN 'pdf' WHEN page_id % 5 IN (2, 3) OR (lower(url) LIKE '%.xls' OR lower(url) LIKE '%.xlsx') AND page_id % 5 = 4 THEN 'excel' END AS converter FROM pages""",
    "convert_guards": """SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'NO_FILE' WHEN page_id % 5 = 1 OR page_id % 5 = 4 AND NOT (lower(url) LIKE '%.pdf' OR lower(url) LIKE '%.xls' OR lower(url) LIKE '%.xlsx') THEN 'UNSUPPORTED_FILE_TYPE' WHEN page_id % 3 = 0 THEN 'NO_TRANSACTIONS' END AS error_code FROM pages""",
    "money_parse": """WITH t AS (SELECT l_orderkey, CAST(floor(l_extendedprice) AS BIGINT) AS c FROM lineitem)
        SELECT l_orderkey, CAST(sum(c) AS BIGINT) AS cents, CAST(-sum(c) AS BIGINT) AS "either", CAST(-sum(c) AS BIGINT) AS leading, CAST(sum(c) AS BIGINT) AS rand, CAST(-sum(c) AS BIGINT) AS trailing, CAST(-sum(c) AS BIGINT) AS strict, CAST(-sum(c) AS BIGINT) AS loose,
          CAST(sum(c) AS BIGINT) AS second_last, CAST(sum(c) AS BIGINT) AS repaired, max(CAST(CAST(c AS DECIMAL(20,2)) / 100 AS DECIMAL(20,2))::VARCHAR) AS normal FROM t GROUP BY l_orderkey""",
    "date_disambiguate": """WITH o AS (SELECT o_orderkey, CAST(o_orderdate + INTERVAL 10 YEAR AS DATE) AS d FROM orders),
        two AS (SELECT o_orderkey, d, CAST(try_strptime('20' || strftime(d, '%d') || '-' || strftime(d, '%m') || '-' || strftime(d, '%y'), '%Y-%m-%d') AS DATE) AS x FROM o),
        s AS (SELECT *, CASE WHEN year(d) = 2011 THEN 1000 ELSE -least(abs(date_diff('day', DATE '2011-01-01', d)), abs(date_diff('day', DATE '2011-12-31', d))) END AS sd,
          CASE WHEN year(x) = 2011 THEN 1010 ELSE 10 - least(abs(date_diff('day', DATE '2011-01-01', x)), abs(date_diff('day', DATE '2011-12-31', x))) END AS sx FROM two)
        SELECT o_orderkey, CAST(CASE WHEN x IS NOT NULL AND sx >= sd THEN x ELSE d END AS VARCHAR) AS found, CAST(d AS VARCHAR) AS free FROM s""",
    "date_validity": """WITH t AS (SELECT o_orderkey, o_orderkey % 33 AS d, o_orderkey % 14 AS m, 1995 + o_orderkey % 8 AS y FROM orders)
        SELECT o_orderkey, CASE WHEN y >= 2000 THEN CAST(CAST(try_strptime(printf('%02d/%02d/%04d', d, m, y), '%d/%m/%Y') AS DATE) AS VARCHAR) END AS day, d BETWEEN 1 AND 31 AND m BETWEEN 1 AND 12 AND y >= 2000 AS plausible,
          printf('%02d/%02d/%04d', d, m, y) AS token FROM t""",
    "year_resolve": """SELECT o_orderkey, strftime(o_orderdate, '%d/%m/') || CASE WHEN 2000 + year(o_orderdate) % 100 BETWEEN 1998 AND 2001 THEN 2000 + year(o_orderdate) % 100 ELSE 1999 END AS described,
        CASE WHEN year(o_orderdate) >= 2000 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS worded, CASE WHEN year(o_orderdate) >= 2000 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS short, CAST(year(o_orderdate) AS INT) AS end_year, 'UNSUPPORTED_DATE_FORMAT' AS error FROM orders""",
    "text_normalise": """WITH c AS (SELECT doc_id, text, string_split(lower(text), '') AS l FROM documents)
        SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS squeezed, md5(regexp_replace(regexp_replace(text, '[aeiou]+', 'v', 'g'), '\\d', '', 'g')) AS cleaned,
          md5(regexp_replace(regexp_replace(array_to_string(list_transform(l, lambda x, i: CASE WHEN regexp_matches(x, '^[a-z0-9_]$') AND (i = 1 OR NOT regexp_matches(l[i - 1], '^[a-z0-9_]$')) THEN upper(x) ELSE x END), ''), '\\bAbsa\\b', 'ABSA', 'g'), '\\bFnb\\b', 'FNB', 'g')) AS title FROM c""",
    "reference_split": """SELECT event_id, CAST(user_id AS VARCHAR) AS "user", upper(event_type) || '_10' AS plan, CAST(NULL AS VARCHAR) AS "none", 'LL-' || right(CAST(event_id + 1700000000000 AS VARCHAR), 10) AS bank, CAST(CAST(CAST(event_id AS DECIMAL(20,2)) / 100 AS DECIMAL(20,2)) AS VARCHAR) AS price FROM events""",
    "token_digest": "SELECT event_id, sha256(event_type || '-' || event_id) AS digest FROM events",
    "payload_parse": "SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS status, 'A b' AS name, event_id AS id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 3 THEN 1 END AS n FROM events",
    "text_bytes": "SELECT doc_id || '.txt' AS source_file, length(t) AS length, md5(t) AS text_md5, CASE WHEN t IS NULL THEN 'NO_FILE_BUFFER' END AS error_code FROM (SELECT doc_id, 'caf' || chr(65533) || ' ' || text || ' ' || chr(65533) || chr(65533) AS t FROM documents)",
    "meta_first_match": """WITH c AS (SELECT c_custkey AS doc_id, lpad(CAST(c_custkey AS VARCHAR), 10, '7') AS a, CAST(abs(round(CAST(c_acctbal AS DECIMAL(18,2)) * 100)) AS BIGINT) AS b FROM customer)
        SELECT doc_id, a AS account_number, 'Jane Doe' AS client_name, '01/02/2001' AS period_start, '28/02/2001' AS period_end, b AS opening_c, -b AS closing_c FROM c""",
    "header_only_meta": """SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 <> 0 THEN 'JOHN SMITH' END AS full_name, CASE WHEN c_custkey % 4 <> 1 THEN lpad(CAST(c_custkey AS VARCHAR), 8, '5') END AS account_number, CASE WHEN c_custkey % 4 <> 2 THEN '2001-02-01' END AS period_from,
        CASE WHEN c_custkey % 4 <> 2 THEN '2001-02-28' END AS period_to, CAST(123450 AS BIGINT) AS opening_c, CAST(NULL AS BIGINT) AS closing_c,
        CASE c_custkey % 4 WHEN 0 THEN 'METADATA_NAME_NOT_FOUND' WHEN 1 THEN 'METADATA_ACCOUNT_NOT_FOUND' WHEN 2 THEN 'METADATA_PERIOD_NOT_FOUND' END AS error_code FROM customer""",
}
