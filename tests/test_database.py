"""Reads from a database, against one that runs inside the JVM; and bytes that are not UTF-8."""

import hashlib
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerloom import queries as engine
from ledgerloom import sources

DATA = "/root/testdata/sf0.001"
URL, PROPERTIES = "jdbc:derby:memory:ledgerloom;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@pytest.fixture(scope="module")
def users(spark):
    rows = [(k, f"u{k}", k % 5 if k % 7 else None) for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, name string, grade int")
    df.write.jdbc(URL, "users", mode="overwrite", properties=PROPERTIES)
    return rows


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_row_by_key_is_the_databases_work(spark, users):
    df = sources.by_key(spark, URL, "users", "id", 7, PROPERTIES)
    assert [tuple(r) for r in df.collect()] == [(7, "u7", None)]
    assert "PushedFilters: [*IsNotNull(id), *EqualTo(id,7)]" in executed(df)
    assert sources.by_key(spark, URL, "users", "id", -1, PROPERTIES).count() == 0


def test_a_table_by_several_connections(spark, users):
    df = sources.database(spark, URL, "users", PROPERTIES, spread="grade", parts=4, where=F.col("id") >= 100)
    assert df.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, df.collect()), key=str) == sorted((r for r in users if r[0] >= 100), key=str)  # rows without a grade too
    plan = executed(df.select("name"))
    assert "numPartitions=4" in plan and "GreaterThanOrEqual(id,100)" in plan and "ReadSchema: struct<name:string>" in plan
    spark.createDataFrame([], "id long").write.jdbc(URL, "empty", mode="overwrite", properties=PROPERTIES)
    assert sources.database(spark, URL, "empty", PROPERTIES, spread="id").count() == 0


BYTES = [b"caf\xe9 au lait", b"\xef\xbb\xbfwith a mark", b"\xe2\x82", b"\xff\xfe", b"\xf0\x9f\x98\x80 \xf0\x9f\x98", b"\xc0\xaf \xed\xa0\x80", b"", "plain é".encode(), None]


def test_bytes_that_are_not_utf8(spark, tmp_path):
    files = spark.createDataFrame([(f"{k}.txt", None if b is None else bytearray(b)) for k, b in enumerate(BYTES)], "path string, content binary")
    got = {r.source_file: r for r in sources.decoded(files).collect()}
    for k, b in enumerate(BYTES):
        r = got[f"{k}.txt"]
        assert (r.text, r.error_code) == ((None, "NO_FILE_BUFFER") if b is None else (b.decode("utf8", "replace"), None))
    for k, b in enumerate(BYTES[:8]):
        (tmp_path / f"{k}.txt").write_bytes(b)
    read = {r.source_file: r.text for r in sources.read_files(spark, str(tmp_path)).collect()}
    assert read == {f"{k}.txt": b.decode("utf8", "replace") for k, b in enumerate(BYTES[:8]) if b}  # the source passes over empty files


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_payload_hash_of_every_row(spark):
    got = {r.event_id: (r.request, r.notice) for r in engine.queries()["payload_hash"](spark, DATA).collect()}
    digest = lambda text: hashlib.sha512(text.encode()).hexdigest()
    want = {}
    for r in pq.read_table(f"{DATA}/events.parquet").to_pylist():
        whole = f"{r['user_id']}{r['event_type'].upper()}secret"
        want[r["event_id"]] = (digest(whole.lower()), digest(whole))
    assert got == want
