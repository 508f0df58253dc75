"""Toxicity: a bidirectional gated recurrent network with attention pooling, over word and character inputs.

A word enters as an embedding of itself (one shared by all words that few training texts hold) and the mean of hashed
embeddings of its character grams (3 to 5 bytes, with its edges); all are learnt with the network, and nothing else is
known of a word. A window of WINDOW words runs through a gated recurrent unit in each direction; attention weighs the
states, and their mean gives the window's logit. A text's score is that of its highest window; windows start every STEP
words and the last one ends with the text, so each word is in one and nearly all are in two.

Trained in numpy with one label for a text of many windows: first on random windows of all training texts, then, round
by round, on each text's highest window by the network so far, and on random ones of texts of label 0. Adam, a loss in
which both labels weigh the same, and words hidden at random. A word's input projections are remembered by worker, so a
batch of windows costs two small products a step.

Training is bounded: at most MOST labelled rows, the first by a hash of the id, a very long text by PIECES
pieces drawn from all its places (the sample that is fitted, never what is scored). A share CHECK of them is not fitted but sets the threshold, that of
the highest F-beta (beta 0.5); scores are shifted so that it lies at 0.5.

Defined results: null, empty and wordless texts have one empty window and its score; a very long text is scored whole,
all its windows in memory a thousand at a time; a null id is not held out; repeated rows are scored each; without rows
of both labels every score is the share of label 1 (0.5 without any); extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, small_batches
from .labelled import held_out, training_rows

WINDOW, STEP = 32, 16
#: Largest number of labelled rows that a model is fitted on.
MOST = 3_000
#: A training text of more characters than PIECE * PIECES is represented by so many pieces of it, drawn from all its places
#: alike; 3,000 such texts are 96 MB on the driver where letters are ASCII, four times that at most.
PIECE, PIECES = 4_000, 8
CHECK = 0.2
#: Words of at least so many training texts have embeddings of their own.
TEXTS = 4
HIDDEN, WIDTH, ATTENTION = 8, 16, 8
GRAMS = 1 << 13
INPUTS = 2 * WIDTH
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def grams(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character grams of words, and the place of each word's first one. Each word has one at least."""
    raw = np.frombuffer(b"".join(b"<" + w + b">" for w in some), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, some), np.int64, len(some)) + 2
    ends = np.repeat(np.cumsum(sizes), sizes)
    place, word, out, of = np.arange(len(raw)), np.repeat(np.arange(len(some)), sizes), [], []
    for n in (3, 4, 5):
        m = max(0, len(raw) - n + 1)
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + raw[i : i + m] + np.uint64(1)
        ok = place[:m] + n <= ends[:m]
        out.append((h ^ h >> np.uint64(29))[ok] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40))
        of.append(word[:m][ok])
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return np.concatenate(out)[order].astype(np.int64), np.searchsorted(of[order], np.arange(len(some)))


def hashes(some: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, some), np.uint64, len(some))


def _tanh(x: np.ndarray) -> np.ndarray:
    return np.tanh(x)


def _gate(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def new_parameters(seed: int = 7, n_words: int = 1) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    at = lambda *s, scale=0.3: (r.standard_normal(s) * scale).astype(np.float32)
    zero = lambda *s: np.zeros(s, np.float32)
    return {
        "word": at(n_words, WIDTH, scale=0.1), "gram": at(GRAMS, WIDTH, scale=0.1), "into": at(2, INPUTS, 3 * HIDDEN), "bias": zero(2, 3 * HIDDEN),
        "back": at(2, HIDDEN, 3 * HIDDEN), "look": at(2 * HIDDEN, ATTENTION), "look0": zero(ATTENTION), "care": at(ATTENTION), "out": at(2 * HIDDEN), "out0": zero(1),
    }


def _run(p: dict, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (windows, WINDOW, 2 * HIDDEN) for projected inputs x (2, windows, WINDOW, 3 * HIDDEN). keep: gets what the way back needs."""
    n, h3 = x.shape[1], HIDDEN
    states = np.empty((n, WINDOW, 2 * h3), np.float32)
    full = bool(mask.all())
    for side in range(2):
        h, u = np.zeros((n, h3), np.float32), p["back"][side]
        for t in range(WINDOW) if side == 0 else range(WINDOW - 1, -1, -1):
            a, g = x[side, :, t], h @ u
            zr = _gate(a[:, : 2 * h3] + g[:, : 2 * h3])
            z, r = zr[:, :h3], zr[:, h3:]
            c = _tanh(a[:, 2 * h3 :] + r * g[:, 2 * h3 :])
            new = c + z * (h - c)
            if not full:
                new = np.where(mask[:, t, None], new, h)
            if keep is not None:
                keep.append((side, t, h, z, r, c, g[:, 2 * h3 :]))
            states[:, t, side * h3 : (side + 1) * h3] = h = new
    return states


def _both(p: dict) -> np.ndarray:
    """Recurrent weights of both directions as one block matrix; columns by gate, then direction."""
    out = np.zeros((2, HIDDEN, 3, 2, HIDDEN), np.float32)
    for side in range(2):
        out[side, :, :, side] = p["back"][side].reshape(HIDDEN, 3, HIDDEN)
    return out.reshape(2 * HIDDEN, 6 * HIDDEN)


def _run_both(u: np.ndarray, table: np.ndarray, rows: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """As _run, both directions at once, taking projected inputs (2, words, 3 * HIDDEN) by rows (windows, WINDOW)."""
    n, w = len(rows), 2 * HIDDEN
    states = np.empty((n, WINDOW, w), np.float32)
    h, a, full = np.zeros((n, w), np.float32), np.empty((n, 3, 2, HIDDEN), np.float32), bool(mask.all())
    flat = a.reshape(n, 6 * HIDDEN)
    for t in range(WINDOW):
        ends = (t, WINDOW - 1 - t)
        for side in range(2):
            a[:, :, side] = table[side].take(rows[:, ends[side]], 0).reshape(n, 3, HIDDEN)
        g = h @ u
        zr = flat[:, : 2 * w] + g[:, : 2 * w]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        c = g[:, 2 * w :]
        c *= zr[:, w:]
        c += flat[:, 2 * w :]
        np.tanh(c, out=c)
        new = h - c
        new *= zr[:, :w]
        new += c
        if not full:
            for side in range(2):
                part = slice(side * HIDDEN, (side + 1) * HIDDEN)
                new[:, part] = np.where(mask[:, ends[side], None], new[:, part], h[:, part])
        h = new
        states[:, ends[0], :HIDDEN] = h[:, :HIDDEN]
        states[:, ends[1], HIDDEN:] = h[:, HIDDEN:]
    return states


def _pool(p: dict, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
    seen = _tanh(states @ p["look"] + p["look0"])
    e = np.where(mask, seen @ p["care"], -1e9)
    e = np.exp(e - e.max(1, keepdims=True)) * mask
    weight = e / np.maximum(e.sum(1, keepdims=True), 1e-9)
    pooled = (weight[:, :, None] * states).sum(1)
    return seen, weight, pooled, pooled @ p["out"] + p["out0"][0]


def starts(n: int) -> list[int]:
    """First words of the windows of a text of n words."""
    return [*range(0, n - WINDOW, STEP), n - WINDOW] if n > WINDOW else [0]


def _windows(sizes: list[int], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (windows, WINDOW) in the words of all texts in a row, pad after short ones; and the first window of each text."""
    rows, firsts, low = [], [], 0
    for n in sizes:
        firsts.append(sum(map(len, rows)) if not rows else firsts[-1] + len(rows[-1]))
        at = np.array(starts(n))[:, None] + np.arange(WINDOW)
        rows.append(np.where(at < n, at + low, pad))
        low += n
    return np.concatenate(rows), np.array(firsts)


class Model:
    """Parameters, the hashes of words that have embeddings (ascending), and remembered input projections."""

    def __init__(self, parameters: dict, vocabulary: np.ndarray, constant: float | None = None):
        self.p, self.vocabulary, self.constant = parameters, vocabulary, constant
        self.forget()

    def __getstate__(self):
        return {"p": self.p, "vocabulary": self.vocabulary, "constant": self.constant}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((2, 1024, 3 * HIDDEN), np.float32)  # place 0 is padding

    def slots(self, some: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word row (0 if it has none), gram rows and first gram of words."""
        h = hashes(some)
        at = np.searchsorted(self.vocabulary, h)
        own = at < len(self.vocabulary)
        own[own] = self.vocabulary[at[own]] == h[own]
        g, first = grams(some)
        return np.where(own, at + 1, 0), g & (GRAMS - 1), first

    def inputs(self, some: list[bytes]) -> np.ndarray:
        word, g, first = self.slots(some)
        counts = np.diff(np.append(first, len(g)))
        return np.concatenate([self.p["word"][word], np.add.reduceat(self.p["gram"][g], first) / counts[:, None]], 1).astype(np.float32)

    def places(self, texts: list[list[bytes]]) -> np.ndarray:
        """Rows of the table for all words of texts; new words are projected."""
        if len(self.known) > 200_000:
            self.forget()
        every = [w for ws in texts for w in ws]
        known = self.known
        if new := [w for w in dict.fromkeys(every) if w not in known]:  # in order, so that training is the same each time
            low = len(known) + 1
            while self.table.shape[1] < low + len(new):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)], 1)
            for at in range(0, len(new), 20_000):
                x = self.inputs(new[at : at + 20_000])
                for side in range(2):
                    self.table[side, low + at : low + at + len(x)] = x @ self.p["into"][side] + self.p["bias"][side]
            known.update(zip(new, range(low, low + len(new)), strict=True))
        return np.append(np.fromiter(map(known.__getitem__, every), np.int64, len(every)), 0)

    def logits(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The logit of every window of texts, and the first window of each."""
        rows = self.places(texts)
        at, firsts = _windows(list(map(len, texts)), len(rows) - 1)
        out, u = np.empty(len(at), np.float32), _both(self.p)
        for low in range(0, len(at), 1024):
            some = at[low : low + 1024]
            mask = some < len(rows) - 1
            out[low : low + 1024] = _pool(self.p, _run_both(u, self.table, rows[some], mask), mask)[3]
        return out, firsts

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        logits, firsts = self.logits([words(t) for t in texts])
        top = np.maximum.reduceat(logits, firsts).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(top, -30, 30)))


def _summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by their place among n."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    order = np.argsort(at, kind="stable")
    places = at[order]
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    out[places[first]] = np.add.reduceat(rows[order], first)
    return out


def gradients(p: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight_of: np.ndarray | float = 1.0) -> tuple[float, dict, np.ndarray]:
    """Mean weighted logistic loss of windows with inputs x (windows, WINDOW, INPUTS), its gradient by parameter and by x."""
    n, h3 = len(x), HIDDEN
    projected = np.stack([x @ p["into"][s] + p["bias"][s] for s in range(2)])
    kept: list = []
    states = _run(p, projected, mask, kept)
    seen, weight, pooled, logit = _pool(p, states, mask)
    prob = 1 / (1 + np.exp(-logit))
    loss = float(np.mean(weight_of * (np.logaddexp(0, logit) - y * logit)))
    d = (weight_of * (prob - y) / n).astype(np.float32)
    g = {"out": pooled.T @ d, "out0": d.sum(keepdims=True)}
    d_pooled = d[:, None] * p["out"]
    d_weight = (states * d_pooled[:, None]).sum(2)
    d_e = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
    d_seen = d_e[:, :, None] * p["care"] * (1 - seen**2)
    g["care"] = np.einsum("nt,nta->a", d_e, seen)
    g["look"], g["look0"] = states.reshape(-1, 2 * h3).T @ d_seen.reshape(-1, ATTENTION), d_seen.sum((0, 1))
    d_states = weight[:, :, None] * d_pooled[:, None] + d_seen @ p["look"].T
    d_projected, g["back"] = np.zeros_like(projected), np.zeros_like(p["back"])
    carry = np.zeros((n, h3), np.float32)
    for k in range(len(kept) - 1, -1, -1):
        side, t, h, z, r, c, gn = kept[k]
        if k == 2 * WINDOW - 1 or k == WINDOW - 1:
            carry = np.zeros((n, h3), np.float32)
        carry = carry + d_states[:, t, side * h3 : (side + 1) * h3]
        live = mask[:, t, None]
        dh = carry * live
        dc = dh * (1 - z) * (1 - c**2)
        dz = dh * (h - c) * z * (1 - z)
        dr = dc * gn * r * (1 - r)
        d_projected[side, :, t] = np.concatenate([dz, dr, dc], 1)
        d_g = np.concatenate([dz, dr, dc * r], 1)
        g["back"][side] += h.T @ d_g
        carry = dh * z + d_g @ p["back"][side].T + carry * ~live
    g["into"] = np.stack([x.reshape(-1, INPUTS).T @ d_projected[s].reshape(-1, 3 * h3) for s in range(2)])
    g["bias"] = d_projected.sum((1, 2))
    return loss, g, sum(d_projected[s] @ p["into"][s].T for s in range(2))


def fit(texts: list[str | None], y: np.ndarray, check: float = CHECK, **how) -> Model:
    """A model of texts with labels y in {0, 1}; a share `check` of each label's texts only sets the threshold."""
    y = np.asarray(y, np.float64)
    apart = np.zeros(len(y), bool)
    for label in (0, 1):
        apart[np.flatnonzero(y == label)[:: max(2, round(1 / check))][1:]] = True  # never a label's first one
    model = _fit([t for t, x in zip(texts, apart, strict=True) if not x], y[~apart], **how)
    if model.constant is None and 0 < y[apart].sum() < apart.sum():
        logits, firsts = model.logits([words(t) for t, x in zip(texts, apart, strict=True) if x])
        model.p["out0"] -= np.float32(_threshold(np.maximum.reduceat(logits, firsts), y[apart]))
    return model


def _threshold(logits: np.ndarray, y: np.ndarray, beta: float = 0.5) -> float:
    """The logit above which F-beta is highest (precision weighs more than recall); the middle of the widest such gap."""
    order = np.argsort(logits, kind="stable")
    x, one = logits[order].astype(float), y[order]
    caught = one.sum() - np.concatenate([[0], np.cumsum(one)])  # above each gap
    f = (1 + beta**2) * caught / (beta**2 * one.sum() + len(x) - np.arange(len(x) + 1))
    gaps = np.diff(np.concatenate([[x[0]], x, [x[-1]]]))
    best = np.flatnonzero(f >= f.max() - 1e-9)
    k = int(best[np.argmax(gaps[best])])
    return float((x[max(k - 1, 0)] + x[min(k, len(x) - 1)]) / 2)


def _vocabulary(cut: list[list[bytes]]) -> np.ndarray:
    """Ascending hashes of the words of at least TEXTS texts."""
    each = [np.unique(hashes(list(set(ws)))) for ws in cut if ws]
    found, count = np.unique(np.concatenate([*each, np.zeros(0, np.uint64)]), return_counts=True)
    return found[count >= TEXTS]


def _chosen(model: Model, cut: list[list[bytes]], y: np.ndarray, turn: int, r: np.random.Generator) -> tuple[list[list[bytes]], np.ndarray]:
    """Windows to learn from, with their texts' labels: random ones first, later each text's highest one, and for label 0 a random one too."""
    picked, labels = [], []
    for low in range(0, len(cut), 256):
        some = cut[low : low + 256]
        logits, firsts = model.logits(some) if turn else (None, None)
        for k, (ws, label) in enumerate(zip(some, y[low : low + 256], strict=True)):
            first = starts(len(ws))
            at = r.integers(len(first), size=1 if turn else 3 if label else 2)
            if turn:
                top = int(np.argmax(logits[firsts[k] : firsts[k] + len(first)]))
                at = [top] if label or len(first) == 1 else {top, int(at[0])}
            for i in sorted(set(map(int, at))):
                picked.append(ws[first[i] : first[i] + WINDOW])
                labels.append(float(label))
    return picked, np.array(labels)


def _fit(texts: list[str | None], y: np.ndarray, rounds: int = 4, passes: int = 3, least_steps: int = 150, batch: int = 64, rate: float = 0.01, hide: float = 0.1, soft: float = 0.03, seed: int = 7) -> Model:
    y = np.asarray(y, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(new_parameters(), np.zeros(0, np.uint64), float(y.mean()) if len(y) else 0.5)
    cut = [words(t) for t in texts]
    vocabulary = _vocabulary(cut)
    model = Model(new_parameters(seed, len(vocabulary) + 1), vocabulary)
    p, r = model.p, np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for turn in range(rounds):
        model.forget()
        chosen, labels = _chosen(model, cut, y, turn, r)
        every = {w: i for i, w in enumerate(dict.fromkeys(w for ws in chosen for w in ws))}
        if not every:
            break
        share = labels.mean()
        weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        word, g_of, first_of = model.slots(list(every))
        counts = np.diff(np.append(first_of, len(g_of)))
        at = np.full((len(chosen), WINDOW), -1)
        for i, ws in enumerate(chosen):
            at[i, : len(ws)] = [every[w] for w in ws]
        # Small samples are gone through more often, so that each round takes least_steps steps.
        for _ in range(max(passes, -(-least_steps * batch // len(chosen)))):
            order = r.permutation(len(chosen))
            for low in range(0, len(order), batch):
                some = order[low : low + batch]
                rows = np.where(r.random((len(some), WINDOW)) < hide, -1, at[some])
                mask = at[some] >= 0
                seen = rows >= 0  # a hidden word is there, with inputs of zero
                used, back = np.unique(rows[seen], return_inverse=True)
                if not len(used):
                    continue
                sizes = counts[used]
                edge = np.cumsum(sizes) - sizes
                g_rows = g_of[np.arange(int(sizes.sum())) + np.repeat(first_of[used] - edge, sizes)]
                vectors = np.concatenate([p["word"][word[used]], np.add.reduceat(p["gram"][g_rows], edge) / sizes[:, None]], 1).astype(np.float32)
                x = np.zeros((*rows.shape, INPUTS), np.float32)
                x[seen] = vectors[back]
                target = labels[some] * (1 - 2 * soft) + soft
                _, g, dx = gradients(p, x, mask, target.astype(np.float32), weights[some].astype(np.float32))
                d = _summed(back, dx[seen], len(used))
                g["word"] = _summed(word[used], d[:, :WIDTH], len(p["word"]))
                g["gram"] = _summed(g_rows, np.repeat(d[:, WIDTH:] / sizes[:, None], sizes, 0), GRAMS)
                step += 1
                for k, (m, v) in moments.items():
                    m *= 0.9
                    m += 0.1 * g[k]
                    v *= 0.999
                    v += 0.001 * g[k] ** 2
                    p[k] -= (rate * 0.6**turn) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.forget()
    return model


def _drawn(text: Column, id_: Column) -> Column:
    """text, or PIECES of its pieces in order, those with the smallest hashes of id and place."""
    n = F.ceil(F.char_length(text) / PIECE).cast("int")
    places = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.xxhash64(id_, k).alias("h"), k.alias("k")))
    drawn = F.array_sort(F.transform(F.slice(F.array_sort(places), 1, PIECES), lambda x: x["k"]))
    return F.when(n > PIECES, F.array_join(F.transform(drawn, lambda k: F.substr(text, k * PIECE + 1, F.lit(PIECE))), " ")).otherwise(text)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", remainder: int = 0, of: int = 5, most: int = MOST) -> Model:
    rows = training_rows(docs, labels, label, remainder, of, most).select("doc_id", "y", _drawn(F.col("text"), F.col("doc_id")).alias("text")).toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")  # the order of collected rows is not fixed
    texts, y = rows.column("text").to_pylist(), rows.column("y").to_numpy()
    return fit([texts[i] for i in order], y[order])


_MODELS: dict[bytes, Model] = {}


def _model(raw: bytes) -> Model:
    """One model per worker process, with what it remembers."""
    if (name := xxhash.xxh3_128_digest(raw)) not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = pickle.loads(raw)
    return _MODELS[name]


def score(docs: DataFrame, model: Model, score_col: str = "score", text_col: str = "text") -> DataFrame:
    """docs with a score from 0 to 1: how likely label 1 is. The model (about 1 MB, whatever the data) goes by broadcast. A column that has the score's name is replaced."""
    docs = docs.drop(score_col)
    small_batches(docs.sparkSession)
    raw = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(raw.value)
        for batch in batches:
            for _, part in slices(batch, 1_000_000, text_col):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(m.scores(part.column(text_col).to_pylist()))], [*part.schema.names, score_col])

    return docs.mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(0, 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
