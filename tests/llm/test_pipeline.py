"""The pipeline against a plain version of each stage, on the smallest tables."""

import os
import zlib

import duckdb
import numpy as np
import pytest
import test_dedup as plain
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import quality
from ledgerloom.llm.common import tokenizer_path

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def read(name):
    return duckdb.sql(f"SELECT * FROM '{DATA}/{name}.parquet' ORDER BY 1").fetchall()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returns, written and read again as the tool does."""
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_columns(spark, stages):
    want = spark.read.parquet(f"{DATA}/documents.parquet").dtypes
    assert all(df.dtypes == want for df in stages[:-1])
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())


def test_quality(stages):
    docs = {r[0]: r[1] for r in read("documents")}
    rows = [(docs[d], q) for d, q, _ in read("labels") if d in docs and q is not None and zlib.crc32(str(d).encode()) % 3 != 1]
    x, y = np.array([quality.features(t) for t, _ in rows]), np.array([q for _, q in rows], float)
    order = np.lexsort((*x.T, y))
    model = quality.fit(x[order], y[order])
    keep = model.scores(np.array([quality.features(t) for t in docs.values()])) >= corpus_pipeline.LEAST_QUALITY
    assert pairs(stages[0]) == sorted(x for x, k in zip(docs.items(), keep, strict=True) if k)


def test_near_duplicates(stages):
    rows = pairs(stages[0])
    want = plain.brute_components(rows, 5)
    assert pairs(stages[1]) == [r for r in rows if want[r[0]] == r[0]]


def test_repeats(stages):
    want = {i: ws for i, _, _, ws in plain.brute_repeats(pairs(stages[1]), corpus_pipeline.REPEAT_WORDS)}
    assert {i: t.split() for i, t in pairs(stages[2])} == want


def test_benchmark(stages, monkeypatch):
    monkeypatch.setattr(plain, "BENCH", read("benchmark"))
    for (i, before), (j, after) in zip(pairs(stages[2]), pairs(stages[3]), strict=True):
        assert i == j
        n, hit, *_ = plain.brute_hits(before)
        assert plain.brute_hits(after)[0] == n - hit
        assert after == before if not hit else len(after) < len(before)


def test_packing(stages):
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    whole = {}
    for r in sorted(stages[4].collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.start * 4 == len(whole.get(r.doc_id, b"")) and len(r.ids) == 4 * r.length
        whole[r.doc_id] = whole.get(r.doc_id, b"") + bytes(r.ids)
    assert whole == {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for i, t in pairs(stages[3])}


def test_run_gives_the_same(spark, stages):
    columns = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).select(columns).collect())) == sorted(map(tuple, stages[4].select(columns).collect()))
