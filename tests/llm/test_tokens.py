"""Encoding, records, prefix counts, packing and sharding against plain versions, with their edge cases."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from ledgerloom.llm import common, packing, prefix_counts, records, sharding  # noqa: E402

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
NASTY = ["", " ", "\n", "a  b", "a \n b", " x", "x\n\ny", "'s 's\n's", "x<|endoftext|> y\nz", "é  é\n", "word, word.\nNext one", "a\x1c b", "日本 語", "a b c", "x \ty", "A1 b2! \n", "\nlead", "1,234 5"]


@pytest.fixture(scope="module")
def library():
    return {name: Tokenizer.from_file(public.path(name)) for name in (BYTES, WORDS)}


@pytest.fixture(scope="module")
def chunked():
    return common.ChunkEncoder(BYTES, most=50)


def ids(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(text=st.one_of(st.sampled_from(NASTY), st.text(alphabet=" \n\tab'é.,1S<|", max_size=30), st.text(max_size=20)))
def test_chunks_give_the_library_s_ids(library, chunked, text):
    for _ in range(2):  # fresh and remembered
        assert np.frombuffer(chunked([text])[0], "<u4").tolist() == ids(library[BYTES], text)


@settings(max_examples=60, deadline=None)
@given(text=st.one_of(st.sampled_from(NASTY), st.text(alphabet=" \naAbé.'s1ll<|", max_size=24), st.text(max_size=12)))
def test_prefix_counts(library, text):
    table = prefix_counts.counter(WORDS).table(text)
    assert table[-1] == prefix_counts.counter(WORDS).count(text) == len(ids(library[WORDS], text))
    for p in range(len(text) + 1):
        assert table[p] == len(ids(library[WORDS], text[:p])), (text, p)


def test_budget_cut(library):
    text = "internationalisation of tokenisers, and more"
    at = prefix_counts.counter(WORDS).cut(text, 4)
    assert len(ids(library[WORDS], text[:at])) <= 4 < len(ids(library[WORDS], text[: at + 1]))


def table(spark, rows):
    """doc_id, text, and columns with names that operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, tie string, shard int")


ROWS = [(3, "hello world"), (1, None), (2, ""), (None, "no id"), (5, "word " * 5000), (3, "hello world"), (3, "hello world"), (9, "é " * 40)]


def test_records_round_trip(spark, library, tmp_path):
    manifest = records.write_records(table(spark, ROWS).repartition(3), f"file://{tmp_path}/out", BYTES, end_id=2)
    got = sorted(((r.part, r.at, r.doc_id, r.n_tokens, bytes(r.ids), r.ids_crc32) for r in records.read_records(manifest).collect()), key=lambda r: r[:2])
    order = [-1 if r[2] is None else r[2] for r in got]
    assert order == sorted(order) and len(got) == len(ROWS)
    want = sorted((i if i is not None else -1, np.array([*ids(library[BYTES], t or ""), 2], "<u4").tobytes()) for i, t in ROWS)
    assert sorted((-1 if r[2] is None else r[2], r[4]) for r in got) == want
    assert all(r[5] == zlib.crc32(r[4]) and r[3] * 4 == len(r[4]) for r in got)
    path = manifest.orderBy("part").first().path
    first = got[0]
    assert records.read_record(path, 0)[0] == first[2] and records.read_record(path, 0)[1].astype("<u4").tobytes() == first[4]
    assert records.write_records(table(spark, []), f"file://{tmp_path}/none").count() == 0


def test_corruption_is_seen():
    good = records.frame(7, np.array([1, 2], "<u4").tobytes(), True)
    assert records.unframe(good)[0] == 7
    for at in range(len(good)):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad))


def check_pieces(pieces, want):
    """Each document's pieces, in order, are its ids; sequences have no gaps and are a power of two long."""
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, own in by_doc.items():
        own.sort(key=lambda r: r.start)
        copies = sum(i == doc_id for i, _ in want)
        whole = b"".join(bytes(r.ids) for r in own)
        assert len(whole) == sum(4 * len(x) for i, x in want if i == doc_id)
        if copies == 1:
            assert whole == np.array(next(x for i, x in want if i == doc_id), "<u4").tobytes()
            assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
        n = sum(r.length for r in own)
        assert n == own[0].tier <= 1024 and n & (n - 1) == 0
    assert set(by_doc) == {i for i, _ in want}


def test_packing(spark, library):
    rows = [*ROWS, *((100 + k, "token " * (37 * k % 900)) for k in range(40))]
    want = [(i, [*ids(library[BYTES], t or ""), 0]) for i, t in rows]
    check_pieces(packing.pack_documents(table(spark, rows).repartition(3), buffer=2000, with_ids=True).collect(), want)
    assert packing.pack_documents(table(spark, [])).count() == 0


def test_sharding(spark):
    rows = [*ROWS, *((200 + k, "x" * (k * 53 % 700)) for k in range(200))]
    got = sharding.shard_by_bytes(table(spark, rows).repartition(5), 7).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start_byte)
    sizes = [len((t or "").encode()) + 16 for _, t in rows]
    assert sorted(r["size"] for r in got) == sorted(sizes) and [r.start_byte for r in got] == np.cumsum([0, *(r["size"] for r in got[:-1])]).tolist()
    assert [r.shard for r in got] == sorted(r.shard for r in got)
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    for shard in {r.shard for r in got}:
        own = [r for r in got if r.shard == shard]
        assert [r.slot for r in own] == list(range(len(own)))
    total = sum(sizes)
    for r in got:
        assert r.shard == min(6, (2 * r.start_byte + r["size"]) * 7 // (2 * total))
    assert {r.text_crc32 for r in got if r.doc_id == 1} == {0}
    assert sharding.shard_by_bytes(table(spark, [])).count() == 0
