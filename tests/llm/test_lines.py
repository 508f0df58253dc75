"""Line dedup against a plain version, on rows that are odd in some way."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from ledgerloom.llm import lines

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs, min_chars):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    order = lambda d: (d is not None, d or 0)
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(order(doc))
    out = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        kept = [x for x in parts if len(held.get(key(x), ())) < min_docs or max(held[key(x)]) == order(doc)]
        out.append((doc, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=str)


def agrees(spark, rows, min_docs=3, min_chars=20):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, lines.drop_repeated_lines(docs, min_docs, min_chars).collect()), key=str)
    assert got == plain(rows, min_docs, min_chars)


LINE = "This line stands in many documents"


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, "\n"), (4, f"{LINE}\nown\n{LINE}"), (5, f"  {LINE.upper()}\t\r\nmore"), (6, f"{LINE}\n\n{LINE}\nx"), (7, f"{LINE}\n{LINE}"), (7, f"{LINE}\n{LINE}"), (7, f"start\n{LINE}"), (None, f"{LINE}\nno id"),
        (8, "É" * 20 + "\nÉcole supérieure de Paris"), (9, "É" * 20 + "\nécole supérieure de paris"), (10, "É" * 20 + "\nÉCOLE SUPÉRIEURE DE PARIS"), (11, "é" * 20), (12, "x" * 19 + "\n" + "y" * 20), (13, "x" * 19 + "\n" + "y" * 20), (14, "x" * 19 + "\n" + "y" * 20),
        (15, "\xa0" + "n" * 19), (16, "\xa0" + "n" * 19), (17, "\xa0" + "N" * 19), (18, "\x0b\x0c" + "\U0001f600" * 20), (19, "\U0001f600" * 20 + "\x0c"), (20, "\U0001f600" * 20),
    ]
    agrees(spark, rows)
    agrees(spark, rows, 2, 1)
    agrees(spark, rows, 4, 0)


def test_lines_often_in_two_documents_only(spark):
    agrees(spark, [(1, "\n".join([LINE] * 50)), (2, LINE), (1, LINE)])


def test_random_lines(spark):
    rng = random.Random(5)
    pool = [f"line number {k} of the pool, twenty signs" for k in range(40)] + ["short", "", "  "]
    agrees(spark, [(rng.randrange(-30, 60), "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 30)))) for _ in range(120)])


def test_very_long_text(spark):
    long = "\n".join(f"a line of the very long text {k}" for k in range(60_000))
    docs = spark.createDataFrame([(k, long) for k in (1, 2, 3)], "doc_id long, text string")
    got = {r.doc_id: r for r in lines.drop_repeated_lines(docs).collect()}
    assert [got[k].n_dropped for k in (1, 2, 3)] == [60_000, 60_000, 0] and got[1].text == "" and got[3].text == long


def test_empty_table_other_columns_and_ids(spark):
    assert lines.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(str(k), LINE, 1, 2, 3) for k in range(3)], "name string, body string, doc int, h1 int, lost int")
    got = lines.drop_repeated_lines(docs, id_col="name", text_col="body").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [("0", "", 1, 1), ("1", "", 1, 1), ("2", LINE, 1, 0)]


def test_no_python_worker(spark):
    docs = spark.createDataFrame([(1, LINE)], "doc_id long, text string")
    assert "Python" not in lines.drop_repeated_lines(docs)._jdf.queryExecution().toString()


def test_key_takes_both_ways(spark):
    df = spark.createDataFrame([(" ABC def\t",), ("\x0bÀBC É İ ı",)], "line string")
    assert [r[0] for r in df.select(lines.line_key(F.col("line"))).collect()] == ["abc def", "Àbc É İ ı"]
