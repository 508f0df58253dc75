"""Near vectors planted in the width of the driver's table, against exact cosines of all pairs."""

import os

import numpy as np
import pytest
import test_dedup as plain

from ledgerloom.llm import embeddings

DATA = "/root/testdata/sf0.1/embeddings.parquet"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no tables here")


def planted(base, n, seed=4):
    """n vectors: those of base as they are, then ones at cosines of 0.9 to 1 to a base vector, some of them in chains."""
    r = np.random.default_rng(seed)
    out = [*base]
    while len(out) < n:
        v = np.array(out[r.integers(len(out))] if r.random() < 0.2 else base[r.integers(len(base))], float)
        noise = r.standard_normal(len(v))
        noise -= noise @ v / (v @ v) * v
        c = r.uniform(0.9, 1)
        out.append(v / np.linalg.norm(v) * c + noise / np.linalg.norm(noise) * np.sqrt(1 - c * c))
    return np.array(out, np.float32)


def exact(v, threshold):
    """Links of each vector and pairs, by all cosines in blocks."""
    u = embeddings.units(v)
    n, a, b = np.zeros(len(u), int), [], []
    for at in range(0, len(u), 1000):
        x, y = np.nonzero(u[at : at + 1000] @ u.T >= threshold)
        ok = x + at != y
        a.append(x[ok] + at)
        b.append(y[ok])
    a, b = np.concatenate(a), np.concatenate(b)
    np.add.at(n, a, 1)
    return n, list(zip(a.tolist(), b.tolist(), strict=True))


def recall(spark, n, threshold=0.95):
    base = np.array([r.embedding for r in spark.read.parquet(DATA).orderBy("vec_id").collect()])
    v = planted(base, n)
    got = sorted(embeddings.near_vectors(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4), threshold).collect())
    want, links = exact(v, threshold)
    found = np.array([r.n_links for r in got])
    return found, want, [r.component_id for r in got], plain.groups(range(n), links)


def test_planted_vectors(spark):
    found, want, components, groups = recall(spark, 6000)
    assert want.sum() > 2000
    assert (found == want).all()
    assert components == [groups[k] for k in range(len(found))]


def test_keys_have_no_limit():
    bits = [embeddings.tables(10**k, 0.95)[0] for k in (4, 6, 9, 12)]
    assert bits == sorted(set(bits)) and bits[-1] > 30
