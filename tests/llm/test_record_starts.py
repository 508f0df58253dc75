"""op2's start against a plain running sum over all documents, in files of several partitions."""

import os
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import records
from ledgerloom.llm.common import tokenizer_path

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_start_counts_all_ids_before(spark):
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want, start = [], 0
    for doc_id, text in duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = records.op2_token_records(spark, DATA).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
    assert len({r.part for r in got}) > 1
