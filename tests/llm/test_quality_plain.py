"""The quality score of each document by a plain walk over printed tables, and features counted sign by sign."""

import math
import os
import random
import re
from bisect import bisect_right
from collections import Counter

import pytest

from ledgerloom.llm import quality

DATA = "/root/testdata/sf0.001"


def plain_features(text):
    raw = list((text or "").encode("utf-8", "surrogatepass"))
    if not raw:
        return [0.0] * len(quality.FEATURES)
    n = len(raw)
    words = [w for w in re.split(rb"[ \t\n\r\x0b\x0c]", bytes(raw)) if w]
    m = len(words) or 1
    lines = bytes(raw).split(b"\n")
    share = lambda test: sum(map(test, raw)) / n
    symbols = set(b"#$%&*+/<=>@[\\]^_`{|}~")
    return [
        math.log(1 + n),
        math.log(1 + len(words)),
        sum(len(w) for w in words) / m,
        len(set(words)) / m,
        (Counter(words).most_common(1)[0][1] if words else 0) / m,
        sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / m,
        share(lambda b: 65 <= b <= 90),
        share(lambda b: 48 <= b <= 57),
        share(lambda b: b in symbols or b in b".,;:'\"()-!?"),
        share(lambda b: b in b"!?"),
        share(lambda b: b in symbols),
        share(lambda b: b > 127),
        n / len(lines),
        len(set(lines)) / len(lines),
        sum(len(w) > 18 for w in words) / m,
        len(set(raw)) / 256,
        m / (1 + raw.count(46)),
        sum(len(w) < 3 for w in words) / m,
        (len(re.findall(rb"http", bytes(raw))) + len(re.findall(rb"www\.", bytes(raw)))) / m,
    ]


def plain_score(model, x):
    total = model.intercept
    for edges, table, value in zip(model.edges, model.tables, x, strict=True):
        total += table[bisect_right(list(edges), value)]
    for i, j, edges_i, edges_j, table in model.pairs:
        total += table[bisect_right(list(edges_i), x[i])][bisect_right(list(edges_j), x[j])]
    return 1 / (1 + math.exp(-max(-30, min(30, total))))


def test_features_are_what_they_say():
    r = random.Random(5)
    some = [None, "", " ", "\n\n", "A b! http://www.x.org 12", "é日本 \ud800", "so so SO.", "x" * 40 + " y"]
    some += ["".join(r.choice("aB1 .\n!#é") for _ in range(r.randint(1, 300))) for _ in range(200)]
    for text in some:
        assert quality.features(text) == pytest.approx(plain_features(text), abs=1e-12), text


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_query_is_the_plain_walk(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    want = {r.doc_id: plain_score(model, plain_features(r.text)) for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in quality.op6_quality(spark, DATA).collect()}
    assert got.keys() == want.keys() and len(model.pairs) > 0
    for k, r in got.items():
        assert r.score == pytest.approx(want[k], abs=1e-9) and r.predicted == (r.score >= 0.5)
