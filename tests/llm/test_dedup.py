"""Near-duplicates, repeated passages and contamination against brute force, with their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from ledgerloom.llm import components, contamination, embeddings, minhash, substrings

SOME = [(-1, None), (-2, ""), (-3, " \n "), (None, "a row without an id"), (None, "a row without an id"), (-4, "two words"), (-5, "Two  WORDS"), (-5, "Two  WORDS")]


def corpus(seed=1):
    """Documents with copies, near copies that are alike only through others, shared passages, and SOME."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    draw = lambda n: [r.choice(vocabulary) for _ in range(n)]
    out, shared = [], draw(60)
    for k in range(60):
        ws = draw(r.randint(1, 90))
        if k % 7 == 0:
            ws[len(ws) // 2 : len(ws) // 2] = shared[: r.randint(10, 60)]
        out.append(ws)
        if k % 5 == 0:
            out.append(list(ws))
    base = draw(200)
    for _ in range(40):
        ws = list(base)
        for _ in range(r.randint(1, 9)):
            ws[r.randrange(len(ws))] = r.choice(vocabulary)
        out.append(ws)
    r.shuffle(out)
    return [*((k, " ".join(ws)) for k, ws in enumerate(out)), *SOME]


def stored(spark, rows, path, files=3):
    """As a table of several files, with columns whose names operators use inside."""
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, row string, component int").repartition(files).write.parquet(str(path))
    return spark.read.parquet(str(path))


def groups(nodes, links):
    """The smallest node that each reaches."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    return {n: root(n) for n in nodes}


def shingle_set(text, k):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def brute_components(rows, k):
    """As the operator: rows of an id are one node with all their texts."""
    known = [(i, s) for i, t in rows if i is not None and (s := shingle_set(t, k))]
    links = [(a, b) for x, (a, s) in enumerate(known) for b, t in known[:x] if a != b and 100 * len(s & t) >= 80 * len(s | t)]
    return groups({i for i, _ in rows if i is not None}, links)


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, tmp_path, k):
    rows = corpus(k)
    docs = stored(spark, rows, tmp_path / "d")
    want = brute_components(rows, k)
    got = minhash.near_duplicates(docs, k, 80).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
            assert r.n_shingles == len(shingle_set(dict(rows)[r.doc_id], k))
    kept = minhash.drop_near_duplicates(docs, k, 80)
    assert set(kept.columns) == set(docs.columns)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, _ in rows if i is not None and want[i] == i)


def test_near_duplicates_of_nothing(spark, tmp_path):
    assert minhash.near_duplicates(stored(spark, [], tmp_path / "d", 1)).count() == 0


def test_likelihood_keeps_what_is_alike():
    r = np.random.default_rng(3)
    for j, keep in ((0.85, True), (0.8, True), (0.3, False)):
        n = 2000
        both = int(2 * n * j / (1 + j))
        kept = 0
        for _ in range(20):
            x = r.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            a, b = minhash.registers([x[:n]])[0], minhash.registers([x[-n:]])[0]
            kept += bool(minhash.likely(np.array([(a > b).sum()]), np.array([(a < b).sum()]), np.array([float(n)]), np.array([float(n)]), 0.8)[0])
        assert kept == 20 * keep


def test_sketches_merge():
    x = np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64)
    a, b, whole = (minhash.registers([s])[0] for s in (x[:300], x[200:], x))
    assert (np.maximum(a, b) == whole).all()


def brute_repeats(rows, width):
    first = {}
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, ws in words:
        if i is not None:
            for p in range(len(ws) - width + 1):
                w = tuple(ws[p : p + width])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, ws in words:
        gone = set()
        if i is not None:
            for p in range(len(ws) - width + 1):
                if first[tuple(ws[p : p + width])] < i:
                    gone |= set(range(p, p + width))
        out.append((i, len(ws), len(gone), [w for p, w in enumerate(ws) if p not in gone]))
    return out


@pytest.mark.parametrize("width", [1, 13])
def test_repeats(spark, tmp_path, width):
    rows = corpus(9)
    docs = stored(spark, rows, tmp_path / "d", 4)
    key = lambda r: (-99 if r[0] is None else r[0], *r[1:])
    want = sorted((key((i, n, m, hashlib.sha256(" ".join(ws).encode()).hexdigest())) for i, n, m, ws in brute_repeats(rows, width)))
    got = sorted(key(tuple(r)) for r in substrings.remove_repeats(docs, width, digest=True).collect())
    assert got == want
    cut = substrings.remove_repeats(docs, width)
    assert cut.columns == docs.columns
    assert sorted(((-99 if r.doc_id is None else r.doc_id), (r.text or "").split()) for r in cut.collect()) == sorted((-99 if i is None else i, ws) for i, _, _, ws in brute_repeats(rows, width))


def test_repeats_of_nothing(spark, tmp_path):
    assert substrings.remove_repeats(stored(spark, [], tmp_path / "d", 1), 13, digest=True).count() == 0


def test_cut_words_keeps_the_rest():
    gone = np.array([False, True, True, False, True])
    assert substrings.cut_words("a  b\tc\n d e ", gone) == "a  d  "
    assert substrings.intervals(gone) == [(1, 3), (4, 5)]


BENCH = [(1, "w1 W2, w3 w4 w5 w6 w7 w8 w9 w10 w11"), (2, "short-item"), (3, ""), (4, None), (None, "w1 w2"), (5, "short item"), (30, "zzz")]


def brute_hits(text, width=10):
    word = lambda t: [w for w in re.split(r"[^0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    ws, hit, items = word(text), set(), set()
    for item, t in BENCH:
        b = word(t)
        if item is None or not b:
            continue
        for p in range(max(1, len(b) - width + 1)):
            x = b[p : p + width]
            for at in range(len(ws) - len(x) + 1):
                if ws[at : at + len(x)] == x:
                    hit |= set(range(at, at + len(x)))
                    items.add(item)
    return len(ws), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit)


def test_contamination(spark, tmp_path):
    texts = ["x w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 y", "w2 w3 w4 w5 w6 w7 w8 w9 w10 w11", "w1 w2 w3", "A SHORT item. short; item ZZZ", "zzz" * 3, "é zzz é", " ".join(["w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"] * 50), None, ""]
    rows = [*enumerate(texts), *SOME, (3, texts[3])]
    docs = stored(spark, rows, tmp_path / "d")
    bench = spark.createDataFrame(BENCH, "item_id long, text string").repartition(2)
    key = lambda i: -99 if i is None else i
    got = sorted((key(r[0]), *r[1:]) for r in contamination.contamination(docs, bench, 10).collect())
    assert got == sorted((key(i), *brute_hits(t)) for i, t in rows)
    clean = {r.doc_id: r.text for r in contamination.decontaminate(docs, bench, 10).collect()}
    assert clean[0] == "x y" and clean[5] == "é é" and clean[7] is None and clean[2] == texts[2]
    none = contamination.contamination(docs, bench.limit(0), 10)
    assert none.where("contaminated").count() == 0 and none.count() == len(rows)


def test_index_finds_all_places():
    r = np.random.default_rng(5)
    text = r.integers(0, 4, 3000)
    text[-1] = 0
    index = contamination.FMIndex(text, 3)
    phrases = np.array([[1, 2, 3], [2, 2, 0], [3, 0, 0], [1, 1, 1]])
    lengths = np.array([3, 2, 1, 3])
    which, low, high = index.search(phrases, lengths)
    for p, a, b in zip(which, low, high, strict=True):
        want = [i for i in range(len(text)) if text[i : i + lengths[p]].tolist() == phrases[p, : lengths[p]].tolist()]
        assert sorted(index.locate(np.arange(a, b))) == want


def test_embeddings(spark):
    r = np.random.default_rng(2)
    rows, at = [], 0
    for size, spread in ((1, 0), (1, 0), (30, 0.02), (20, 0.05), (25, 0.08), (6, 0.0)):
        center = r.standard_normal(16)
        for _ in range(size):
            rows.append((at, (center + spread * r.standard_normal(16)).astype(np.float32).tolist()))
            at += 1
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [1.0, None] * 8), (505, [float("inf")] * 16), (506, rows[0][1][:8]), (None, rows[0][1]), (507, (np.array(rows[0][1], np.float32) * 2).tolist()), (507, rows[0][1])]
    got = embeddings.near_vectors(spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, key string, class int").repartition(3), 0.95).collect()
    assert len(got) == len(rows)
    fine = [(k, i, np.array(v, float)) for k, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {k: v / np.linalg.norm(v) for k, _, v in fine}
    links = [(a, b) for a, i, v in fine for b, j, w in fine if a < b and len(v) == len(w) and unit[a] @ unit[b] >= 0.95]
    n = dict.fromkeys(range(len(rows)), 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    comp = groups(range(len(rows)), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[comp[k]] = min(i, least.get(comp[k], i))
    want = sorted((-1 if i is None else i, n[k], -1 if i is None else least[comp[k]]) for k, (i, _) in enumerate(rows))
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id or r.vec_id is None) for r in got)


def test_embeddings_of_nothing(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_estimates_are_unbiased():
    r = np.random.default_rng(0)
    v, w = embeddings.units(r.standard_normal((400, 64))), embeddings.units(r.standard_normal((300, 64)))
    about, error = embeddings.estimates(v, w)
    off = about - v @ w.T
    assert abs(off.mean()) < 0.002 and (np.abs(off) < embeddings.EPSILON * error[:, None]).all()


def test_components(spark):
    links = [(k + 1, k) for k in range(300)] + [(1000, 1001), (1001, 1001), (1002, 1000), (1000, 1001)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys((1000, 1001, 1002), 1000)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
