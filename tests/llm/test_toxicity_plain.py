"""Scores against a plain walk over windows, and the network against the words of the labels alone."""

import numpy as np

from ledgerloom.llm import toxicity

from test_models import texts


def plain_score(model, text):
    """The highest window's score, one window and one word at a time, from the parameters."""
    p, ws, best = model.p, toxicity.words(text), -np.inf
    for low in toxicity.starts(len(ws)):
        own = ws[low : low + toxicity.WINDOW]
        x = [model.inputs([w])[0].astype(float) for w in own]
        states = np.zeros((len(own), 2 * toxicity.HIDDEN))
        for side, order in ((0, range(len(own))), (1, range(len(own) - 1, -1, -1))):
            h = np.zeros(toxicity.HIDDEN)
            for t in order:
                a, g = x[t] @ p["into"][side] + p["bias"][side], h @ p["back"][side]
                z, r = (1 / (1 + np.exp(-(a[k : k + toxicity.HIDDEN] + g[k : k + toxicity.HIDDEN]))) for k in (0, toxicity.HIDDEN))
                c = np.tanh(a[2 * toxicity.HIDDEN :] + r * g[2 * toxicity.HIDDEN :])
                h = z * h + (1 - z) * c
                states[t, side * toxicity.HIDDEN : (side + 1) * toxicity.HIDDEN] = h
        pooled = np.zeros(2 * toxicity.HIDDEN)
        if own:
            e = np.exp(np.tanh(states @ p["look"] + p["look0"]) @ p["care"])
            pooled = (e / e.sum()) @ states
        best = max(best, float(pooled @ p["out"] + p["out0"][0]))
    return 1 / (1 + np.exp(-best))


def test_scores_are_those_of_the_highest_window():
    t, y = texts(120, 5)
    model = toxicity.fit(t, y, rounds=2, least_steps=40)
    some = [*t[:25], None, "", "one", " ".join(t)]
    assert np.allclose(model.scores(some), [plain_score(model, x) for x in some], atol=1e-4)


def test_network_beats_the_words_of_the_labels():
    """Words that no training text holds are known by their letters; a list of words is not enough."""
    model, (t, y) = toxicity.fit(*texts(500, 1)), texts(200, 2)
    t = [x.replace("zorkish", "zorkful").replace("unzork", "rezork") for x in t]
    own, label = texts(500, 1)
    ones, zeros = ({w for x, v in zip(own, label, strict=True) if v == k for w in x.split()} for k in (1, 0))
    listed = np.array([bool(set(x.split()) & (ones - zeros)) for x in t])
    assert ((model.scores(t) >= 0.5) == y).mean() > max(0.9, (listed == y).mean())


def test_training_is_the_same_each_time():
    a, b = (toxicity.fit(*texts(80, 3), rounds=2, least_steps=20) for _ in range(2))
    assert all((a.p[k] == b.p[k]).all() for k in a.p)
