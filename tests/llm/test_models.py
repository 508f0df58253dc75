"""The two classifiers: gradients, what they learn, held-out rows, edge cases."""

import random
import zlib

import numpy as np

from ledgerloom.llm import quality, toxicity
from ledgerloom.llm.labelled import held_out


def test_additive_model_learns_steps_and_pairs():
    r = np.random.default_rng(0)
    x = r.random((4000, 4))
    y = ((x[:, 0] > 0.7) ^ ((x[:, 1] > 0.5) & (x[:, 2] > 0.5))).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.scores(x[3000:]) >= 0.5) == (y[3000:] == 1)).mean() > 0.9
    assert (1, 2) in {(i, j) for i, j, *_ in model.pairs}
    alone = quality.fit(x[:3000], y[:3000], n_pairs=0)
    assert ((alone.scores(x[3000:]) >= 0.5) == (y[3000:] == 1)).mean() < ((model.scores(x[3000:]) >= 0.5) == (y[3000:] == 1)).mean()


def test_additive_model_without_rows():
    none = quality.fit(np.zeros((0, 2)), np.zeros(0))
    assert none.scores(np.ones((3, 2))).tolist() == [0.5] * 3
    assert (quality.fit(np.ones((5, 2)), np.ones(5)).scores(np.zeros((2, 2))) > 0.5).all()


def test_features_of_odd_texts():
    for text in (None, "", " ", "\n", "a", "é" * 50_000, "\ud800"):
        assert len(quality.features(text)) == len(quality.FEATURES) and np.isfinite(quality.features(text)).all()


def test_gradients():
    r = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.new_parameters().items()}
    x = r.standard_normal((3, toxicity.WINDOW, toxicity.INPUTS))
    mask = np.ones(x.shape[:2], bool)
    mask[1, 20:] = False
    y = np.array([1.0, 0, 1])
    _, g, _ = toxicity.gradients(p, x, mask, y)
    for k in ("into", "bias", "back", "look", "care", "out"):
        at = max(np.ndindex(p[k].shape), key=lambda i: abs(g[k][i]))
        kept = p[k][at]
        loss = []
        for e in (1e-2, -1e-2):
            p[k][at] = kept + e
            loss.append(toxicity.gradients(p, x, mask, y)[0])
        p[k][at] = kept
        assert abs((loss[0] - loss[1]) / 2e-2 - g[k][at]) < 0.1 * abs(g[k][at]) + 1e-4


def test_both_directions_at_once():
    r = np.random.default_rng(1)
    p = toxicity.new_parameters()
    t = r.standard_normal((2, 50, 3 * toxicity.HIDDEN)).astype(np.float32)
    rows = r.integers(0, 50, (9, toxicity.WINDOW))
    mask = np.ones(rows.shape, bool)
    mask[3, 5:] = False
    a, b = toxicity._run(p, t[:, rows], mask), toxicity._run_both(toxicity._both(p), t, rows, mask)
    assert np.allclose(a, b, atol=1e-5)


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 48, 100):
        s = toxicity.starts(n)
        assert set(range(n)) <= {w for a in s for w in range(a, a + toxicity.WINDOW)} and (n <= toxicity.WINDOW or s[-1] + toxicity.WINDOW == n)


def texts(n, seed):
    r = random.Random(seed)
    out, y = [], []
    for k in range(n):
        ws = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(r.randint(0, 150))]
        bad = k % 4 == 0
        if bad:
            for _ in range(3):
                ws.insert(r.randint(0, len(ws)), r.choice(["zork", "zorkish", "unzork"]))
        out.append(" ".join(ws))
        y.append(int(bad))
    return out, np.array(y)


def test_network_learns_words_by_their_letters():
    model = toxicity.fit(*texts(500, 1))
    t, y = texts(200, 2)
    t = [x.replace("unzork", "zorkful") for x in t]
    p = model.scores(t) >= 0.5
    assert (p == y).mean() > 0.93
    assert 0 <= model.scores([None])[0] <= 1 and model.scores([None])[0] == model.scores([" "])[0]
    assert toxicity.fit([], np.zeros(0)).scores(["x", None]).tolist() == [0.5, 0.5]
    assert toxicity.fit(["a", "b"], np.ones(2)).scores(["x"]).tolist() == [1.0]


def test_scores_in_spark(spark):
    t, y = texts(120, 3)
    docs = spark.createDataFrame([*((i, x, "s") for i, x in enumerate(t)), (None, None, "s"), (3, "", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([*((i, int(v), int(v)) for i, v in enumerate(y)), (7, None, None), (None, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    for module, remainder, of in ((toxicity, 0, 5), (quality, 1, 3)):
        got = module.score(docs, module.train(docs, labels, remainder=remainder, of=of, most=200))
        assert got.columns == ["doc_id", "text", "score"] and got.count() == len(t) + 2
        assert got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
        assert module.score(docs.limit(0), module.train(docs.limit(0), labels)).count() == 0
    assert {r.doc_id for r in docs.where(held_out(0, 5)).collect()} == {i for i in range(len(t)) if zlib.crc32(str(i).encode()) % 5 == 0}
    kept = quality.keep_good(docs, labels, 0.0)
    assert kept.columns == docs.columns and kept.count() == len(t) + 2
