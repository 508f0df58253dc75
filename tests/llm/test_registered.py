"""The registered queries on the smallest tables: against their SQL where it exists, else their columns and rows."""

import os

import duckdb
import pytest

from ledgerloom.llm import queries as corpus

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "benchmark", "labels")
COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted",
    "op2_token_records": "doc_id start n_tokens ids_crc32",
    "op6_quality": "doc_id held_out score predicted",
    "op7_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op9_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op13_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = corpus.queries()[name](spark, DATA)
    columns = ", ".join(sorted(got.columns))
    want = con.sql(f"SELECT {columns} FROM ({corpus.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*sorted(got.columns)).collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_rows(spark, name):
    rows = corpus.queries()[name](spark, DATA)
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect())
    got = rows.select(*COLUMNS[name].split()).collect()
    assert sorted(r.doc_id for r in got) == ids
    if "score" in rows.columns:
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_pieces_cover_documents(spark):
    got = corpus.queries()["op8_packing"](spark, DATA).collect()
    held = {}
    for r in got:
        held[r.doc_id] = held.get(r.doc_id, 0) + r.length
        assert r.offset + r.length <= 1024
    assert all(held[r.doc_id] == r.doc_tokens for r in got) and len(held) == spark.read.parquet(f"{DATA}/documents.parquet").count()
