"""Clustering against a plain version that compares with every centroid, and the search's steps."""

import hashlib
import math

import numpy as np
import pytest

from ledgerloom.llm import clustering


def plain(rows, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    points = [v for _, v in sorted(kept, key=order)[:k]]

    def nearest(v):
        d = [sum((x - y) ** 2 for x, y in zip(v, p, strict=True)) for p in points]
        return min(range(len(d)), key=lambda c: (d[c], c)), min(d)

    for _ in range(rounds):
        near = [nearest(v)[0] for _, v in kept]
        for c in range(len(points)):
            own = [v for (_, v), n in zip(kept, near, strict=True) if n == c]
            if own:
                points[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, *nearest(v)) for i, v in kept), key=str), points


def agrees(spark, rows, k=5, rounds=3, dims=3, scale=64.0, seed=1):
    got, centroids = clustering.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k, rounds, dims, scale, seed)
    want, points = plain(rows, k, rounds, dims, scale, seed)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert [c["components"] for c in centroids] == points
    assert [(c["size"], c["inertia"]) for c in centroids] == [(sum(w[1] == n for w in want), sum(w[2] for w in want if w[1] == n)) for n in range(len(points))]


def test_random_vectors_with_ties_and_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.integers(0, 150, 200), rng.integers(-2, 3, (200, 3)), strict=True)]
    agrees(spark, rows, k=12, scale=1.0)
    agrees(spark, [*rows, *[(7000 + i, [0.5, 0.25, -0.125]) for i in range(100)]], k=7)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [nan, 0.0, 0.0]), (6, [inf, 0.0, 0.0]), (7, [0.0, 0.0, 0.0]), (8, [-0.01, 0.01, 1.0]), (8, [-0.01, 0.01, 1.0]), (8, [2.0, 2.0, 2.0]), (None, [1.0, 1.0, 1.0]), (9, [0.1, 0.2, 0.3, 0.4])]
    agrees(spark, rows)
    agrees(spark, rows, k=2)
    agrees(spark, rows, k=16, rounds=0)
    agrees(spark, rows[:6])
    agrees(spark, [], k=2)


def test_parts_and_types(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(3000, 16)).astype(np.float32)
    df = spark.createDataFrame([(str(i), v.tolist(), 1, 2) for i, v in enumerate(vectors)], "name string, v array<float>, id int, cluster int").repartition(7)
    got, centroids = clustering.cluster_vectors(df, k=40, rounds=2, dims=16, id_col="name", vector_col="v")
    want, points = plain([(str(i), [float(x) for x in v]) for i, v in enumerate(vectors)], 40, 2, 16, 64.0, 1)
    assert sorted(map(tuple, got.collect()), key=str) == want and [c["components"] for c in centroids] == points


def test_search_stops_early_and_is_exact():
    rng = np.random.default_rng(1)
    points = rng.integers(-2000, 2000, (300, 4))
    c = clustering.Centroids(points)
    x = np.concatenate([points[rng.integers(0, 300, 500)] + rng.integers(-20, 20, (500, 4)), rng.integers(-3000, 3000, (500, 4)), points[:50]])
    d = ((x[:, None].astype(np.int64) - points[None]) ** 2).sum(2)
    near, distance = c.nearest(x)
    assert (near == d.argmin(1)).all() and (distance == d.min(1)).all()


def test_equal_points_go_to_the_smaller_number():
    near, distance = clustering.Centroids(np.array([[5, 5], [1, 1], [5, 5], [1, 1]])).nearest(np.array([[5, 5], [1, 0], [3, 3]]))
    assert near.tolist() == [0, 1, 0] and distance.tolist() == [0, 1, 8]


def test_components_that_do_not_fit(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        clustering.cluster_vectors(df, 2, 1, 3)
    with pytest.raises(ValueError, match="between"):
        clustering.cluster_vectors(df, 0)
