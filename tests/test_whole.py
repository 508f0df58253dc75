"""Queries that read and return all of their table, against plain versions."""

import datetime
import hashlib
import os
import re

import pyarrow.parquet as pq
import pytest

from ledgerloom import queries as engine
from ledgerloom.plans import layouts as P

DATA = "/root/testdata/sf0.001"

tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def rows_of(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def got(spark, name, *columns):
    return sorted(map(tuple, engine.queries()[name](spark, DATA).select(*columns).collect()))


@tables
def test_neighbour_context_has_every_line(spark):
    want = []
    for r in rows_of("documents"):
        sizes = [len(x.strip(" ").encode()) for x in re.split("\r\n?|\n", r["text"])] if r["text"] is not None else []
        want += [(r["doc_id"], i, sizes[i - 1] if i else -1, sizes[i + 1] if i + 1 < len(sizes) else -1) for i in range(len(sizes))]
    assert got(spark, "neighbour_context", "doc_id", "line_no", "before", "after") == sorted(want)


def title_cased(text):
    low, word = text.lower(), re.compile("[a-z0-9_]")
    out = "".join(x.upper() if word.match(x) and not (i and word.match(low[i - 1])) else x for i, x in enumerate(low))
    return re.sub(r"\bFnb\b", "FNB", re.sub(r"\bAbsa\b", "ABSA", out))


@tables
def test_text_normalise_title_cases_whole_texts(spark):
    want = sorted((r["doc_id"], hashlib.md5(title_cased(r["text"]).encode()).hexdigest()) for r in rows_of("documents"))
    assert got(spark, "text_normalise", "doc_id", "title") == want


def real_date(*parts):
    try:
        return datetime.date(*parts)
    except ValueError:
        return None


@tables
def test_date_disambiguate_reads_every_order(spark):
    start, end = datetime.date(2011, 1, 1), datetime.date(2011, 12, 31)
    want = []
    for r in rows_of("orders"):
        # 29 February is the 28th ten years later.
        day = real_date((o := r["o_orderdate"]).year + 10, o.month, o.day) or datetime.date(o.year + 10, 2, 28)
        readings = ((real_date(2000 + day.day, day.month, day.year % 100), 10), (day, 0))
        score = lambda x, bonus: bonus + (1000 if start <= x <= end else -min(abs((x - start).days), abs((x - end).days)))
        found = max((x for x in readings if x[0]), key=lambda x: score(*x))[0]
        want.append((r["o_orderkey"], str(found), str(day)))
    assert got(spark, "date_disambiguate", "o_orderkey", "found", "free") == sorted(want)


def test_capitec_reads_long_rows_to_their_end(spark):
    words = "\n".join(["word " * 20] * 1100)
    text = f"Transaction History\n01/02/2020 Shop 1.00\n{words}\nlast 20.00 300.00\n02/02/2020 Shop 5.00 305.00\n* Includes VAT"
    rows = P.capitec(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("row_idx").collect()
    assert [(r["amount_c"], r["balance_c"]) for r in rows] == [(2000, 30000), (500, 30500)]
    assert rows[0]["description"].endswith("word last")
