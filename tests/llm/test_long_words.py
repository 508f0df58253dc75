"""Token counts of long words and odd rows, against the library."""

import resource
import time

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from ledgerloom.llm import prefix_counts  # noqa: E402
from ledgerloom.llm.common import tokenizer_path  # noqa: E402

TEXTS = [None, "", "  ", "it's they're 'r we'll!! 'tis", "a<|endoftext|>b it's<|startoftext|>", "<|endoftext", "ÀÉ naïve Ⅷ 12three", "éé 각", "ß İstanbul ΣΑΣ", "\x1c\x1d a\x1eb", "日本語のテキスト" * 40, "!!??'re'''s" * 9]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_a_million_letters(library):
    r = np.random.default_rng(1)
    text = "".join(r.choice(list("etaoinshrdlucmfwyp"), 1_000_000))
    before, started = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    n = prefix_counts.PrefixCounter("word_bpe_49k.json").count(text)
    assert n == library(text)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000 and time.time() - started < 120


def test_table_of_a_long_word(library):
    r = np.random.default_rng(2)
    text = "".join(r.choice(list("etaoinshrdlu"), 3000))
    table = prefix_counts.PrefixCounter("word_bpe_49k.json").table(text)
    assert all(table[k] == library(text[:k]) for k in (*range(1, 100), *range(100, 3001, 97), 3000))


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_tables_of_odd_texts(library, text):
    count = prefix_counts.PrefixCounter("word_bpe_49k.json")
    assert count.count(text) == library(text)
    assert count.table(text).tolist() == [library(text[:k]) for k in range(len(text) + 1)]


def test_counts_in_spark(spark, library):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (3, TEXTS[3]), (None, "x y"), (90, "word " * 3000)]
    docs = spark.createDataFrame([(i, t, 7, "n", 0) for i, t in rows], "doc_id long, text string, n_tokens int, table string, over_limit int").repartition(3)
    got = prefix_counts.token_counts(docs, with_table=True).collect()
    key = lambda x: tuple((v is None, v if v is not None else 0) for v in x)
    assert sorted((key((r.doc_id, r.n_bytes, r.n_tokens)) for r in got)) == sorted(key((i, len((t or "").encode()), library(t or ""))) for i, t in rows)
    long = next(r for r in got if r.doc_id == 90)
    text = dict(rows)[90]
    assert library(text[: long.cut_chars]) <= 2048 < library(text[: long.cut_chars + 5])
    for r in got:
        assert np.frombuffer(r.table, "<u4")[-1] == r.n_tokens
    assert prefix_counts.token_counts(docs.limit(0)).count() == 0
