"""Quality classifier: a generalised additive model with pairwise interactions.

Features are plain figures of a text (FEATURES). Each is cut into bins by quantiles of the training rows. Boosting goes
round the features in turn, again and again: a shallow tree over one feature's bins fits the gradient and is added to
that feature's lookup table. Then the pairs of features that explain most of what is left get tables of their own,
boosted in the same way by quadrant trees. A score is an intercept and one table entry per feature and pair, so a
batch is scored by a few vectorised additions, and each entry can be read.

Training takes a bounded sample of labelled rows (MOST, first by a hash of the id); only their features reach the
driver. All texts are scored whole.

Defined results: null and empty texts have features of zero and a score like any; a null id is not held out; repeated
rows are scored each; without labelled rows every score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, small_batches, tidied
from .labelled import held_out, training_rows

FEATURES = ("log_bytes", "log_words", "word_length", "distinct_words", "top_word", "doubled_words", "upper", "digits", "marks", "stress", "symbols", "beyond_ascii", "line_length", "distinct_lines", "long_words", "distinct_bytes", "sentence_words", "short_words", "links")
#: Largest number of labelled rows that a model is fitted on.
MOST = 20_000

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_STRESS = b"!?"
_SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"
_MARKS = b".,;:'\"()-!?" + _SYMBOLS
_HIGH = bytes(range(128, 256))


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    without = lambda some: n - len(raw.translate(None, some))
    words = raw.split()
    m = max(1, len(words))
    counts = Counter(words)
    lines = raw.split(b"\n")
    lengths = list(map(len, words))
    return [
        np.log1p(n), np.log1p(len(words)), sum(lengths) / m, len(counts) / m, max(counts.values(), default=0) / m,
        sum(map(bytes.__eq__, words, words[1:])) / m, without(_UPPER) / n, without(_DIGITS) / n, without(_MARKS) / n, without(_STRESS) / n,
        without(_SYMBOLS) / n, without(_HIGH) / n, n / len(lines), len(set(lines)) / len(lines), sum(x > 18 for x in lengths) / m,
        len(set(raw)) / 256, m / (1 + raw.count(b".")), sum(x < 3 for x in lengths) / m, (raw.count(b"http") + raw.count(b"www.")) / m,
    ]


@dataclass
class Additive:
    """Bin edges and lookup tables; pairs hold (feature, feature, coarse edges of each, table)."""

    intercept: float = 0.0
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, j], "right")]
        for i, j, ei, ej, table in self.pairs:
            out += table[np.searchsorted(ei, x[:, i], "right"), np.searchsorted(ej, x[:, j], "right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _leaf(g: float, h: float, ridge: float) -> float:
    return g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Values of a tree over ordered bins, given each bin's sums of gradient and curvature."""
    out = np.full(len(g), _leaf(g.sum(), h.sum(), ridge))
    if depth == 0 or len(g) < 2:
        return out
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = left_g**2 / (left_h + ridge) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + ridge)
    k = int(np.argmax(gain)) + 1
    if gain[k - 1] <= g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
        return out
    return np.concatenate([_tree(g[:k], h[:k], depth - 1, ridge), _tree(g[k:], h[k:], depth - 1, ridge)])


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best tree of one cut on each axis over a grid, and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts_g = [cg[:-1, :-1], cg[:-1, -1:] - cg[:-1, :-1], cg[-1:, :-1] - cg[:-1, :-1]]
    parts_h = [ch[:-1, :-1], ch[:-1, -1:] - ch[:-1, :-1], ch[-1:, :-1] - ch[:-1, :-1]]
    parts_g.append(cg[-1, -1] - sum(parts_g))
    parts_h.append(ch[-1, -1] - sum(parts_h))
    gain = sum(a**2 / (b + ridge) for a, b in zip(parts_g, parts_h, strict=True))
    if not gain.size:
        return np.zeros_like(g), 0.0
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = [_leaf(a[i, j], b[i, j], ridge) for a, b in zip(parts_g, parts_h, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse: int = 12, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 8, rate: float = 0.15, depth: int = 2, ridge: float = 4.0) -> Additive:
    """A model for y in {0, 1}. With no rows, or one class only, it is its intercept."""
    model = Additive()
    n, d = x.shape
    if not n:
        model.edges, model.tables = [np.zeros(0)] * d, [np.zeros(1)] * d
        return model
    share = (y.sum() + 0.5) / (n + 1)
    model.intercept = float(np.log(share / (1 - share)))
    model.edges = [_edges(x[:, j], bins) for j in range(d)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    f = np.full(n, model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(d):
            g, h = slopes()
            size = len(model.tables[j])
            step = rate * np.clip(_tree(np.bincount(at[j], g, size), np.bincount(at[j], h, size), depth, ridge), -4, 4)
            model.tables[j] += step
            f += step[at[j]]
    rough = [_edges(x[:, j], coarse) for j in range(d)]
    places = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(rough)]

    def grid(i: int, j: int, z: np.ndarray) -> np.ndarray:
        shape = (len(rough[i]) + 1, len(rough[j]) + 1)
        return np.bincount(places[i] * shape[1] + places[j], z, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = sorted(((_quadrants(grid(i, j, g), grid(i, j, h), ridge)[1], i, j) for i in range(d) for j in range(i + 1, d)), reverse=True)
    model.pairs = [(i, j, rough[i], rough[j], np.zeros((len(rough[i]) + 1, len(rough[j]) + 1))) for gain, i, j in gains[:n_pairs] if gain > 0]
    for _ in range(pair_rounds):
        for i, j, _, _, table in model.pairs:
            g, h = slopes()
            step = rate * np.clip(_quadrants(grid(i, j, g), grid(i, j, h), ridge)[0], -4, 4)
            table += step
            f += step[places[i], places[j]]
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, rows in slices(batch):
            yield pa.RecordBatch.from_arrays([rows.column("y"), pa.array(map(features, rows.column("text").to_pylist()), pa.list_(pa.float64()))], ["y", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", remainder: int = 1, of: int = 3, most: int = MOST) -> Additive:
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, label, remainder, of, most).select("y", "text").mapInArrow(lambda b: tidied(_featured(b)), "y int, x array<double>").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(rows.column("y").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # the order of collected rows is not fixed, sums of floats should be
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Additive, score_col: str = "score", text_col: str = "text") -> DataFrame:
    """docs with a score from 0 to 1: how likely label 1 is. A column that has the score's name is replaced."""
    docs = docs.drop(score_col)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices(batch, column=text_col):
                x = np.array(list(map(features, part.column(text_col).to_pylist())), float)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(x))], [*part.schema.names, score_col])

    return docs.mapInArrow(lambda b: tidied(run(b)), T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), T.StructField(score_col, T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **training) -> DataFrame:
    """The rows of docs whose score is at least `least`, with the columns of docs."""
    model = train(docs, labels, **training)
    name = max(docs.columns, key=len) + "_"  # longer than any column's, so that none is it
    return score(docs, model, name).where(F.col(name) >= least).drop(name)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(1, 3).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
