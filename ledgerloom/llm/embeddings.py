"""Embedding near-dedup: randomised-rotation binary codes with stored correction factors.

A unit vector o is rotated by a random orthogonal matrix. Its code is stored once: the signs of the rotated coordinates,
the factor f = <signs, rotated o> / sqrt(d), and the rotated coordinates in four bits each (rounded at random, so that
they are right on average), as bit planes. For any other q, <signs of o, coordinates of q> / f, which takes bit counts of
five words for each 64 dimensions, is an unbiased estimate of s = <o, q>. What it is off by is the part of q beside o
along a random direction, so its error is about sqrt((1 - s*s) * (1 - f*f) / (f*f * (d - 1))), with that of the rounding.
For s at the threshold or above, this is largest at the threshold; a pair whose estimate is more than EPSILON such errors
under the threshold is dropped.

Vectors meet in tables keyed by signs under further rotations. The number of bits grows with the logarithm of the number
of vectors and the number of tables follows from it: a pair at the threshold meets in none with probability MISS, and is
then not counted. Only codes travel to the tables. Rows with a pair that its bounds leave open come together again with
their full vectors, and such pairs are computed in double precision. A pair is counted in the first table in which it
meets, so links are summed without a list of pairs: a bucket gives one row of link counts per vector and a spanning
forest. Equal vectors are one class with a weight; buckets over TILE classes are compared in tiles, pairs of tile sides.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, are
linked with nothing and kept (component: their id); vectors of different lengths are never linked; repeated rows link
with each other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MULTIPLIER, Workspace, mix, partitions
from .components import components

MISS = 1e-5
EPSILON = 5.0
TILE = 2048
#: Bits of a rotated coordinate in a code.
PLANES = 4
_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def rotation(d: int, k: int) -> np.ndarray:
    """The k-th random orthogonal matrix for d dimensions, the same everywhere."""
    if (d, k) not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng([d, k]).standard_normal((d, d)))
        _ROTATIONS[d, k] = q * np.sign(np.diag(r))
    return _ROTATIONS[d, k]


def tables(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a key and number of tables for n vectors: some 256 vectors to a bucket."""
    bits = max(4, round(math.log2(max(n, 2))) - 8)
    met = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log1p(-min(met, 1 - 1e-9))))


def units(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def keys(v: np.ndarray, bits: int, n_tables: int) -> np.ndarray:
    """The bucket of each unit vector in each table."""
    d = v.shape[1]
    signs = np.concatenate([v @ rotation(d, k + 1).T > 0 for k in range(-(-bits * n_tables // d))], 1)[:, : bits * n_tables]
    part = signs.reshape(len(v), n_tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
    return mix((part.astype(np.uint64) * np.uint64(4096) + np.arange(n_tables, dtype=np.uint64)) * MULTIPLIER + np.uint64(d)).view(np.int64)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    raw = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8))).view(np.uint64)


class Codes:
    """Stored codes of vectors of d dimensions: sign words, words of each bit plane, factors and rounding steps."""

    def __init__(self, d: int, signs: np.ndarray, planes: np.ndarray, factor: np.ndarray, step: np.ndarray):
        self.d, self.signs, self.planes, self.factor, self.step = d, signs, planes, factor, step

    @classmethod
    def of(cls, v: np.ndarray) -> Codes:
        d = v.shape[1]
        z = v @ rotation(d, 0).T
        step = 2 * np.abs(z).max(1) / (2**PLANES - 1)
        dither = np.random.default_rng([d, 999]).random(d)
        level = np.clip(np.floor(z / step[:, None] + (2**PLANES - 1) / 2 + dither), 0, 2**PLANES - 1).astype(np.uint8)
        planes = np.stack([_packed(level >> b & 1) for b in range(PLANES)], 1)
        return cls(d, _packed(z > 0), planes, (np.abs(z).sum(1) / math.sqrt(d)).clip(1e-6, 1).astype(np.float32), step.astype(np.float32))

    def stored(self) -> list[bytes]:
        parts = (np.full((len(self.signs), 1), self.d, "<u4"), self.factor[:, None], self.step[:, None], self.signs, self.planes.reshape(len(self.signs), -1))
        rows = np.concatenate([np.ascontiguousarray(p).view(np.uint8) for p in parts], 1)
        return [r.tobytes() for r in rows]

    @classmethod
    def read(cls, stored: list[bytes]) -> Codes:
        """Of codes of one length."""
        raw = np.frombuffer(b"".join(stored), np.uint8).reshape(len(stored), -1)
        d = int(raw[0, :4].copy().view("<u4")[0])
        words = np.ascontiguousarray(raw[:, 12:]).view(np.uint64)
        n = -(-d // 64)
        factor, step = (np.ascontiguousarray(raw[:, k : k + 4]).view(np.float32)[:, 0] for k in (4, 8))
        return cls(d, words[:, :n], words[:, n:].reshape(len(raw), PLANES, n), factor, step)

    def take(self, at: np.ndarray) -> Codes:
        return Codes(self.d, self.signs[at], self.planes[at], self.factor[at], self.step[at])

    def errors(self, other: Codes, least: float = 0.0) -> np.ndarray:
        """For each of these the error of its estimates with others, where the inner product is at least `least`."""
        f = self.factor.astype(np.float64)
        rounding = float(other.step.max(initial=0)) / 2 / f
        return np.sqrt((1 - least**2) * (1 - f**2).clip(0) / (f**2 * max(1, self.d - 1)) + rounding**2)

    def estimates(self, other: Codes) -> np.ndarray:
        """Estimated inner products of these with others."""
        high = (2**PLANES - 1) / 2
        both = np.zeros((len(self.signs), len(other.signs)), np.float32)
        whole = np.zeros(len(other.signs), np.float32)
        for b in range(PLANES):
            for w in range(self.signs.shape[1]):
                both += np.bitwise_count(self.signs[:, w, None] & other.planes[None, :, b, w]) * np.float32(1 << b)
            whole += np.bitwise_count(other.planes[:, b]).sum(1, dtype=np.float32) * (1 << b)
        ones = np.bitwise_count(self.signs).sum(1, dtype=np.float32)
        # A coordinate is step * (level - high); signs are 2 * bit - 1.
        both *= 2
        both -= (2 * high * ones)[:, None]
        both -= (whole - high * self.d)[None]
        both *= (other.step / math.sqrt(self.d))[None]
        both /= self.factor[:, None]
        return both


def estimates(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of coded unit vectors v with w, and the error of each of v."""
    a, b = Codes.of(v), Codes.of(w)
    return a.estimates(b), a.errors(b)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the vectors of each length, and those vectors."""
    sizes, flat = pc.list_value_length(column).to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, flat[(ends[at] - d)[:, None] + np.arange(d)]


def _coded(batches: Iterator[pa.RecordBatch], bits: int, n_tables: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        code, every = [b""] * batch.num_rows, np.zeros((batch.num_rows, n_tables), np.int64)
        for at, vectors in _matrices(batch.column("embedding")):
            v = units(vectors)
            every[at] = keys(v, bits, n_tables)
            for i, c in zip(at.tolist(), Codes.of(v).stored(), strict=True):
                code[i] = c
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * n_tables, pa.int32()), pa.array(every.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column("class"), lists, pa.array(code, pa.binary())], ["class", "keys", "code"])


def _open_pairs(rows: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one tile's rows that the bounds of their codes leave open."""
    stored, own = rows.column("code").to_pylist(), rows.column("t").to_numpy()
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    left, right = (np.arange(len(own)),) * 2 if i == j else (np.flatnonzero(own == i), np.flatnonzero(own == j))
    if len({c[:4] for c in stored}) > 1:  # of several lengths: those never meet but by chance
        d = np.array([int.from_bytes(c[:4], "little") for c in stored])
        for one in np.unique(d):
            part = np.flatnonzero(d == one)
            for a, b in _open_pairs(rows.take(part), threshold):
                yield part[a], part[b]
        return
    codes = Codes.read(stored)
    second = codes.take(right)
    for at in range(0, len(left), 256):
        x = left[at : at + 256]
        some = codes.take(x)
        least = threshold - EPSILON * some.errors(second, min(1.0, max(0.0, threshold)))
        p, q = np.nonzero(some.estimates(second) >= least[:, None])
        a, b = x[p], right[q]
        ok = a < b if i == j else np.ones(len(a), bool)
        yield a[ok], b[ok]


def _by_tiles(batches: Iterator[pa.RecordBatch], answer: Callable[[list[pa.Table]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """answer(whole tiles of two rows or more) for rows that come sorted by tile."""
    rest = None

    def whole(table: pa.Table, last: bool) -> tuple[list, pa.Table | None]:
        tile = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")], 1)
        starts = np.flatnonzero(np.concatenate([[True], (tile[1:] != tile[:-1]).any(1)])).tolist()
        ends = [*starts[1:], len(tile)]
        n = len(starts) - (not last)
        return [table.slice(s, e - s) for s, e in zip(starts[:n], ends[:n], strict=True) if e - s > 1], None if last else table.slice(starts[n])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        groups, rest = whole(table.combine_chunks(), False)
        yield answer(groups)
    if rest is not None and rest.num_rows:
        yield answer(whole(rest.combine_chunks(), True)[0])


def _open_rows(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """key, i, j, t, table, class of the rows that are in an open pair of their tile."""

    def answer(tiles: list[pa.Table]) -> pa.RecordBatch:
        out = []
        for rows in tiles:
            hit = np.zeros(rows.num_rows, bool)
            for a, b in _open_pairs(rows, threshold):
                hit[a] = hit[b] = True
            if hit.any():
                out.append(rows.drop_columns(["code"]).filter(pa.array(hit)))
        schema = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("t", pa.int32()), ("table", pa.int32()), ("class", pa.int64())])
        return pa.concat_tables([schema.empty_table(), *(x.cast(schema) for x in out)]).combine_chunks().to_batches()[0] if out else pa.RecordBatch.from_pylist([], schema)

    yield from _by_tiles(batches, answer)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := root(x)) != (q := root(y)):
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _links(rows: pa.Table, threshold: float) -> tuple[list, list, list]:
    """(class, class or None, weight of links) of one tile; a second class makes the row a link of the forest."""
    ids, weight = rows.column("class").to_numpy(), rows.column("weight").to_numpy()
    every = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    table = int(rows.column("table")[0].as_py())
    v: list = [None] * rows.num_rows
    for at, vectors in _matrices(rows.column("embedding").combine_chunks()):
        for i, u in zip(at.tolist(), units(vectors), strict=True):
            v[i] = u
    if len({len(u) for u in v}) == 1:
        v = np.array(v)
    found_a, found_b = [], []
    for a, b in _open_pairs(rows, threshold):
        for low in range(0, len(a), 100_000):
            c, e = a[low : low + 100_000], b[low : low + 100_000]
            new = (every[c] == every[e]).argmax(1) == table
            c, e = c[new], e[new]
            x, y = (v[c], v[e]) if isinstance(v, np.ndarray) else (np.array([v[k] for k in c]), np.array([v[k] for k in e]))
            linked = np.einsum("ij,ij->i", x, y) >= threshold if len(c) else np.zeros(0, bool)
            found_a.append(c[linked])
            found_b.append(e[linked])
    if not sum(map(len, found_a)):
        return [], [], []
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    links = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
    has = np.flatnonzero(links)
    forest = _forest(len(ids), a, b)
    return (
        [*ids[has].tolist(), *(int(ids[x]) for x, _ in forest)],
        [*([None] * len(has)), *(int(ids[y]) for _, y in forest)],
        [*links[has].astype(np.int64).tolist(), *([0] * len(forest))],
    )


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    def answer(tiles: list[pa.Table]) -> pa.RecordBatch:
        parts = [_links(rows, threshold) for rows in tiles]
        return pa.RecordBatch.from_arrays([pa.array([x for p in parts for x in p[k]], pa.int64()) for k in range(3)], ["a", "b", "w"])

    yield from _by_tiles(batches, answer)


def _by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of vectors. Linked: cosine of at least threshold."""
    v = F.col("embedding")
    usable = F.coalesce(
        F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0), F.lit(False)
    )
    with Workspace(vectors.sparkSession) as work:
        rows = work.saved(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).withColumn("row", F.monotonically_increasing_id()).withColumn("usable", usable), keep=True)
        # Zeros of either sign are one value here, as in the grouping of floats.
        classes = work.saved(rows.where("usable").groupBy("embedding").agg(F.min("row").alias("class"), F.count("*").alias("weight"), F.min("vec_id").alias("least")), keep=True)
        bits, n_tables = tables(classes.count(), threshold)
        coded = work.saved(classes.select("class", "embedding").mapInArrow(lambda b: _coded(b, bits, n_tables), "class long, keys array<bigint>, code binary"))
        met = coded.select("class", "code", F.posexplode("keys").alias("table", "key"))
        # Buckets of more than a tile are few: a share of 1 / TILE of the rows at most.
        large = work.saved(met.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > TILE).select("key", F.ceil(F.col("size") / TILE).cast("int").alias("tiles")))
        tiles = F.coalesce("tiles", F.lit(1))
        t = F.pmod(F.xxhash64("class"), tiles).cast("int")
        tiled = met.join(large, "key", "left").select("key", t.alias("t"), "table", "class", "code", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
        tiled = _by_tile(tiled.select("key", F.least("t", "other").alias("i"), F.greatest("t", "other").alias("j"), "t", "table", "class", "code"))
        still = work.saved(tiled.mapInArrow(lambda b: _open_rows(b, threshold), "key long, i int, j int, t int, table int, class long"))
        whole = classes.select("class", "weight", "embedding").join(coded, "class").join(still.select("class").distinct(), "class", "left_semi")
        found = work.saved(_by_tile(still.join(whole, "class")).mapInArrow(lambda b: _compare(b, threshold), "a long, b long, w long"))
        links = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("w").alias("links"))
        groups = components(found.where("b is not null").select("a", "b"), work).withColumnRenamed("node", "class")
        grouped = classes.join(groups, "class", "left").withColumn("component", F.coalesce("component", "class"))
        least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
        known = grouped.join(least, "component").join(links, "class", "left")
        # Classes reach rows by the vector itself; the rows of large classes are split by a salt.
        salts = F.ceil(F.col("weight") / TILE).cast("int")
        named = known.select(F.xxhash64("embedding").alias("hash"), "embedding", salts.alias("salts"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
        named = work.saved(named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))), keep=True)
    widths = named.where("salts > 1").select("hash", "salts").distinct()
    wide = rows.withColumn("hash", F.when(F.col("usable"), F.xxhash64("embedding"))).join(widths, "hash", "left").withColumn("salt", F.when(F.col("usable"), F.pmod(F.col("row"), F.coalesce("salts", F.lit(1))).cast("int"))).drop("salts")
    return (
        wide.join(named.drop("salts"), ["hash", "salt", "embedding"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.95)


ORACLE_SQL = {
    "op3_embeddings": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""
}
