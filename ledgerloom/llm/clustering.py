"""Centroid clustering in exact integers, nearest centroids by Orchard's search.

Vectors are turned into integers floor(scale * x). Each centroid has the others in a list by distance from it. The search
for a vector holds a current centroid and goes down its list; a centroid that is closer (or as close, with a smaller
number) becomes the current one and its list is gone down from the top; centroids once measured are marked and skipped.
It stops at a list entry strictly beyond twice the current distance: all further ones are farther from the vector than
the current one. A batch's vectors go through their lists in step, each at its own place.

Partitions send sums and counts per centroid, Spark adds them up, and only k rows of sums come to the driver, where the
new centroids are exact floors of sum / count. Vectors never move. The centroids and their lists, k * k entries with k of
at most MOST_CENTROIDS, are what tasks are given.

Defined results: vectors that are null, of another length, or hold null or non-finite components have no row; a null id
is a vector like others, but none of the first centroids unless there are too few others; equal ids that could both be
first centroids are taken in the order of their components; with fewer vectors than k there are fewer centroids; a tie
goes to the smaller number; a centroid without vectors stays; repeated rows count each time; an empty table gives no
rows; other columns are ignored. Components so large that a distance would not fit into 64 bits are an error that says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace

MOST_CENTROIDS = 2048
#: Vectors that go through their lists in step.
STEP_ROWS = 8192


class Centroids:
    """Integer points with sorted neighbour lists, and the search for the nearest one."""

    def __init__(self, points: np.ndarray):
        self.points = np.ascontiguousarray(points, dtype=np.int64)
        k = len(self.points)
        self.between = np.stack([((self.points - p) ** 2).sum(1) for p in self.points])
        apart = self.between.astype(np.float64)
        np.fill_diagonal(apart, -1.0)
        self.lists = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        # In the middle of the others: lists from there are short on average.
        self.first = int(apart.sum(1).argmin()) if k else 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of and squared distance to the nearest point of each row of x; a tie goes to the smaller number."""
        current, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for at in range(0, len(x), STEP_ROWS):
            current[at : at + STEP_ROWS], distance[at : at + STEP_ROWS] = self._search(x[at : at + STEP_ROWS])
        return current, distance

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(x), len(self.points)
        current, place = np.full(n, self.first), np.zeros(n, np.int64)
        distance = ((x - self.points[self.first]) ** 2).sum(1)
        seen = np.zeros((n, k), bool)
        seen[:, self.first] = True
        live = np.arange(n)
        while True:
            live = live[place[live] < k - 1]
            if not live.size:
                return current, distance
            other = self.lists[current[live], place[live]]
            within = self.between[current[live], other] <= 4 * distance[live]
            live, other = live[within], other[within]
            place[live] += 1
            new = ~seen[live, other]
            row, other = live[new], other[new]
            seen[row, other] = True
            d = ((x[row] - self.points[other]) ** 2).sum(1)
            closer = (d < distance[row]) | ((d == distance[row]) & (other < current[row]))
            row = row[closer]
            current[row], distance[row], place[row] = other[closer], d[closer], 0


def _integers(batches: Iterator[pa.RecordBatch], dims: int, scale: float) -> Iterator[pa.RecordBatch]:
    """id and integer components of the vectors that can be used."""
    most = int((2.0**61 / dims) ** 0.5 / 2)
    for batch in batches:
        ids, vectors = batch.column(0), batch.column(1)
        fit = pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False)
        ids, vectors = ids.filter(fit), vectors.filter(fit)
        x = pc.list_flatten(vectors).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # null: nan
        good = np.isfinite(x).all(1)
        x = np.floor(scale * x[good])
        if x.size and np.abs(x).max() > most:
            raise ValueError(f"components over {most / scale:.3g}: a squared distance may not fit into 64 bits")
        whole = pa.array(x.astype(np.int64).ravel())
        yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dims), whole)], ["id", "v"])


def _rows(vectors: pa.ListArray, dims: int) -> np.ndarray:
    return pc.list_flatten(vectors).to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(batches: Iterator[pa.RecordBatch], points: np.ndarray) -> Iterator[pa.RecordBatch]:
    """cluster, n, sums of this partition."""
    search, (k, dims) = Centroids(points), points.shape
    counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    for batch in batches:
        x = _rows(batch.column(0), dims)
        near, _ = search.nearest(x)
        order = np.argsort(near, kind="stable")
        found, starts, n = np.unique(near[order], return_index=True, return_counts=True)
        if len(found):
            sums[found] += np.add.reduceat(x[order], starts, axis=0)
            counts[found] += n
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pylist([{"cluster": int(c), "n": int(counts[c]), "sums": sums[c].tolist()} for c in held], pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))


def _assigned(batches: Iterator[pa.RecordBatch], points: np.ndarray) -> Iterator[pa.RecordBatch]:
    search, dims = Centroids(points), points.shape[1]
    for batch in batches:
        near, distance = search.nearest(_rows(batch.column(1), dims))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[dict]]:
    """(vec_id, cluster, distance of each usable vector; number, components, size and inertia of each centroid).

    The first centroids are the k vectors whose ids, after the seed and a colon, have the smallest SHA-256. Each round
    assigns all vectors and moves the centroids; a last one assigns them to the final centroids. The centroids' inertia
    is the squared distance summed over their vectors.
    """
    if not 1 <= k <= MOST_CENTROIDS:
        raise ValueError(f"k must be between 1 and {MOST_CENTROIDS}")
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType
    picked = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    with Workspace(spark) as work:
        whole = work.saved(picked.mapInArrow(lambda b: _integers(b, dims, scale), T.StructType([T.StructField("id", kind), T.StructField("v", T.ArrayType(T.LongType()))])))
        order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
        first = whole.orderBy(F.asc_nulls_last(order), "v").limit(k).collect()  # k rows
        points = np.array([r.v for r in first], np.int64).reshape(-1, dims)
        for _ in range(rounds if len(points) else 0):
            now = points
            parts = whole.select("v").mapInArrow(lambda b, p=now: _sums(b, p), "cluster int, n long, sums array<long>")
            moved = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(j)).cast("decimal(38,0)")).alias(f"s{j}") for j in range(dims))).collect()  # k rows at most
            points = points.copy()
            for r in moved:
                points[r.cluster] = [int(r[f"s{j}"]) // r.n for j in range(dims)]
        final = points if len(points) else np.zeros((1, dims), np.int64)
        out = work.saved(whole.mapInArrow(lambda b: _assigned(b, final), T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])), keep=True)
        held = {r.cluster: r for r in out.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("inertia")).collect()}  # k rows at most
    centroids = [{"cluster": c, "components": p.tolist(), "size": held[c].n if c in held else 0, "inertia": held[c].inertia if c in held else 0} for c, p in enumerate(points)]
    return out.withColumnRenamed("id", "vec_id"), centroids


def op11_clustering(spark, sf_dir: str) -> DataFrame:
    rows, centroids = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16, rounds=3, dims=64, scale=64.0, seed=1)
    total = sum(c["inertia"] for c in centroids)
    told = [(c["cluster"], c["inertia"], total, hashlib.sha256(",".join(map(str, c["components"])).encode()).hexdigest()) for c in centroids]
    few = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row for each centroid
    return rows.join(F.broadcast(few), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _distances(n: int) -> str:
    """Vectors assigned to centroids c{n}, as SQL: ties to the smaller number."""
    return f"""a{n} AS MATERIALIZED (
  SELECT vec_id, any_value(v.e) AS e, arg_min(c, [d, c]) AS cluster, min(d) AS distance
  FROM (SELECT v.vec_id, v.nth, v.e, c.c, list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{n} c) v GROUP BY vec_id, nth
)"""


def _moved(n: int) -> str:
    """Centroids c{n + 1} of the vectors assigned to c{n}: floors of the means, in integers."""
    return f"""m{n} AS (
  SELECT cluster, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM a{n}) GROUP BY cluster, pos
), c{n + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.e, c.e) AS e FROM c{n} c LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS e FROM m{n} GROUP BY cluster) m ON m.cluster = c.c
)"""


ORACLE_SQL = {
    "op11_clustering": f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS nth, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS c, e FROM v QUALIFY c < 16
), {_distances(0)}, {_moved(0)}, {_distances(1)}, {_moved(1)}, {_distances(2)}, {_moved(2)}, {_distances(3)}
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.e, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c3.c = cluster
"""
}
