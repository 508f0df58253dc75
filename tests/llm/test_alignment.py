"""Alignment against a plain version: token spans in loops, overlaps by comparing ranges."""

import hashlib
import json
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerloom.llm import alignment

SIGNS = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b): b for b in SIGNS} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in SIGNS)}


def plain(rows):
    """(doc_id, text) rows to the query's columns, and counts of pairs."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    held, counts = [], Counter()
    for _, text in rows:
        spans, links, groups = [], [], []
        if text:
            whole = (" " + text).encode()
            ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
            size = [lambda i: bytes(BYTE_OF[c] for c in a.id_to_token(i)), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()]
            spans = []
            for own, of in zip(ids, size, strict=True):
                parts, at, out = [of(i) for i in own], 0, []
                for i, p in zip(own, parts, strict=True):
                    out.append((at, at + len(p), i))
                    at += len(p)
                if b"".join(parts) != whole:
                    spans = []
                    break
                spans.append(out)
        if len(spans) == 2:
            k = 0
            for s, e, i in spans[0]:
                while k and spans[1][k][0] > s:
                    k -= 1
                j = k
                while j < len(spans[1]) and spans[1][j][0] < e:
                    if spans[1][j][1] > s:
                        links.append((i, spans[1][j][2]))
                        k = j
                    j += 1
            cuts, start = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]}), 0
            for cut in cuts:
                groups.append("|".join(",".join(str(i) for s, e, i in side if start <= s and e <= cut) for side in spans) if len(spans[0]) < 600 else None)
                start = cut
        else:
            spans = [[], []]
        counts.update(links)
        held.append((spans, groups, links))
    best = {}
    for (x, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for (doc_id, _), (spans, groups, links) in zip(rows, held, strict=True):
        digest = "" if not groups else None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc_id, len(spans[0]), len(spans[1]), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return out, counts


def agrees(spark, rows, **settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, pairs = alignment.align_documents(docs, **settings)
    want, counts = plain(rows)
    got = sorted(map(tuple, got.collect()), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[:7] == w[:7] and w[7] in (None, g[7]), (g, w)
    assert {(r.a, r.b): r.n for r in pairs.collect()} == dict(counts)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a"), (4, "a"), (None, "A text without an id."), (5, "  two  spaces, and at the end  "), (6, "one▁two"), (7, "x <|endoftext|> y <s>z</s> <0x41>"), (8, "\n\nline\r\n\tends\n"),
    (9, "né́e ﬁx ① 日本語 \U0001f600‍ \xa0 x"), (10, "\x00\x01 nul"), (11, "Word" * 3000), (12, "the cat sat on the mat. " * 50), (13, "12345 67,890.12 %$#@!"), (14, "﻿start"), (15, "▁"),
]


def test_odd_rows(spark):
    agrees(spark, ODD)


def test_few_counts_in_tasks_and_short_stretches(spark):
    agrees(spark, ODD, head_pairs=10, stretch=16)
    agrees(spark, ODD, head_pairs=0)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    agrees(spark, [(r.doc_id, r.text[:6000]) for r in docs.collect()], head_pairs=3000, stretch=500)


def test_empty_table_and_other_columns(spark):
    empty, pairs = alignment.align_documents(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and pairs.count() == 0
    docs = spark.createDataFrame([(1, "some words", 7, 8, "x")], "doc_id long, text string, row int, pair int, a string")
    assert alignment.align_documents(docs)[0].columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_pieces_by_chunks_are_those_of_whole_texts():
    pieces = alignment.PieceEncoder("piece_bpe_32k.model", most=20)
    texts = [t for _, t in ODD if t and "▁" not in t]
    for _ in range(3):
        assert [x for t in texts for x in memoryview(pieces([" " + t])[0]).cast("I")] == [x for t in texts for x in pieces.model.encode(t)]


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_stretches_give_the_text_back(most):
    text = " a bb\n cc  dd e " * 20
    parts = alignment.stretches(text, most)
    assert "".join(parts) == text and all(p[0] == " " for p in parts)


def test_byte_table():
    vocabulary = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))["model"]["vocab"]
    a, _ = alignment.sides("byte_bpe_50k.json", "piece_bpe_32k.model")
    tokens = a.tokens.to_pylist()
    assert all(tokens[i] == bytes(BYTE_OF[c] for c in t) for t, i in vocabulary.items())
