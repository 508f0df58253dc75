"""MinHash near-dedup by SetSketch registers.

A document is the set of its word shingles. Register i holds floor(1 - log_b(a * min h_i)) of exponential hashes h_i,
truncated to 16 bits: sketches of parts merge by maximum, and equal registers grow with similarity. Bands of four
registers name the buckets in which documents meet. Two documents' registers, with their exact set sizes, give the
likelihood of each similarity; pairs for which the threshold is far less likely than the best value are dropped, and
the rest are verified on full sets.

Documents of equal sets are one class from the start, so copies are never paired. Then:
  1. each class is verified with one hub, the smallest class of most of its buckets. Links to hubs point to smaller
     classes, so following them twice gives each class a label, and classes of one label are linked;
  2. buckets of one label are done. In every other one, each class outside its largest label is compared with all
     classes of other labels by registers, in tiles of TILE by TILE rows: members of the largest label are never paired
     with each other. Pairs already verified are left out. Rows of likely pairs get their full sets, and each tile
     verifies such pairs, likeliest first, and gives the links that join labels;
  3. labels and those links, a far smaller graph, form the components.
A link inside a component changes nothing, so this finds what comparing all pairs of each bucket would find, without
listing the pairs of a large group, but for what the likelihoods drop. With 32 bands, a pair at similarity 0.8 shares no
bucket with probability 5e-8; one of equal set sizes that shares one is dropped by its likelihood with probability 9e-9.

Texts are scanned twice: for all sketches, and for the full sets of classes that share a bucket with another one
(drop_near_duplicates scans them once more, for its result). A hub's set is copied for each SPOKES of its classes.

Defined results: null, empty and wordless texts have no shingles, are linked with nothing and kept; a text of fewer
words than a shingle is one shingle; a text is in memory whole, with its shingles' hashes, some 16 bytes a word; rows
with a null id are linked with nothing, have no component and are kept; repeated rows are copies of each other; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MULTIPLIER, U64, WORD_HASHES, Workspace, ascii_lower, mix, partitions, slices, small_batches, tidied
from .components import components

REGISTERS, BAND = 128, 4
BASE, RATE, TOP = 1.001, 20.0, 65535
TILE = 256
#: So many pairs are looked at at a time.
PAIRS = 200_000
TILE_BYTES = 32_000_000
#: So many classes are verified with one copy of their hub.
SPOKES = 256
#: A side of at most so many rows is broadcast (some 50 MB as a hash table); a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000
#: A pair is dropped if the likelihood at the threshold is e**-16 of the best or less, and the best lies below.
SLACK = 16.0
_rng = np.random.default_rng(20240601)
_A = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * U64(2) + U64(1)
_B = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)
_HASHES = WORD_HASHES


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's k-word shingles, ascending."""
    words = ascii_lower(text).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = _HASHES.of(words)
    k = min(k, len(words))
    n = len(h) - k + 1
    rolled = np.full(n, k, np.uint64)
    for i in range(k):
        rolled *= MULTIPLIER
        rolled += h[i : i + n]
    return np.unique(mix(rolled))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each non-empty set."""
    whole = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), REGISTERS), np.uint16)
    for i in range(REGISTERS):
        u = (np.minimum.reduceat(whole * _A[i] + _B[i], starts).astype(np.float64) + 1) / 2.0**64
        # -log1p(-u) is exponential with rate 1; divided by RATE it has that rate.
        value = np.floor(1 - np.log(-np.log1p(-np.minimum(u, 1 - 2**-53)) / RATE) / np.log(BASE))
        out[:, i] = np.clip(value, 0, TOP)
    return out


def bands(table: np.ndarray) -> np.ndarray:
    """The buckets of each row of registers."""
    parts = table.reshape(len(table), -1, BAND).astype(np.uint64)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(BAND):
        key = mix(key * MULTIPLIER + parts[:, :, i])
    return key.view(np.int64)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


_GRID = np.linspace(0.0, 1.0, 101)


def likely(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether pairs may be as similar as the threshold, by the joint likelihood of their registers.

    more, less: how many registers of the first are larger or smaller; n_a, n_b: exact set sizes.
    """
    u = n_a / (n_a + n_b)
    v = 1 - u

    def at(j):
        a, b = _p(np.maximum(u - v * j, 1e-12)), _p(np.maximum(v - u * j, 1e-12))
        return more * np.log(a) + less * np.log(b) + (REGISTERS - more - less) * np.log(np.maximum(1 - a - b, 1e-12))

    top = np.minimum(u / v, v / u)
    best = np.full(len(u), -np.inf)
    for j in _GRID[_GRID < threshold]:
        best = np.maximum(best, np.where(j <= top, at(j), -np.inf))
    return (top >= threshold) & (at(np.minimum(threshold, top)) > best - SLACK)


SKETCH = "row long, doc_id long, mark long, n_shingles long, digest binary, registers binary, bands array<bigint>"


def _sketch(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, rows in slices(batch):
            sets = [shingles(t, k) for t in rows.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            digests, raw, keys = ([None] * len(sets) for _ in range(3))
            if full:
                table = registers([sets[i] for i in full])
                for i, r, b in zip(full, table, bands(table).tolist(), strict=True):
                    digests[i], raw[i], keys[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), r.tobytes(), b
            yield pa.RecordBatch.from_arrays(
                [rows.column("row"), rows.column("doc_id"), rows.column("mark"), pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary()), pa.array(raw, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["row", "doc_id", "mark", "n_shingles", "digest", "registers", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, rows in slices(batch):
            sets = [shingles(t, k).tobytes() for t in rows.column("text").to_pylist()]
            same = pa.array([hashlib.blake2b(s, digest_size=16).digest() == d for s, d in zip(sets, rows.column("digest").to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([rows.column("class"), pa.array(sets, pa.binary())], ["class", "set"]).filter(same)


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [_similar(x, y, percent) for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _few(df: DataFrame) -> DataFrame:
    """df (a saved table), to be broadcast if its rows are counted to be few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _full_sets(nodes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """class, set (its shingles, from its text anew) of nodes."""
    wanted = _few(nodes.select("class", "least", "digest"))
    texts = docs.join(wanted, docs["doc_id"] == wanted["least"]).select("class", "digest", "text")
    # Repeated rows of an id would give a class its set twice.
    return texts.mapInArrow(lambda b: tidied(_sets(b, k)), "class long, set binary").groupBy("class").agg(F.first("set").alias("set"))


def _hub_links(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Nodes (a) that are similar enough to their hubs (b). A hub of many nodes is copied, so that no task has them all."""
    spokes = nodes.where("hub is not null").select("class", "hub")
    hubs = spokes.groupBy("hub").agg(F.ceil(F.count("*") / SPOKES).cast("int").alias("copies"))
    spokes = spokes.join(hubs, "hub").select(F.col("class").alias("a"), F.col("hub").alias("b"), F.pmod(F.xxhash64("class"), "copies").cast("int").alias("copy"))
    ends = hubs.select(F.col("hub").alias("b"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    joined = spokes.join(sets.toDF("a", "set_a"), "a").join(ends.join(sets.toDF("b", "set_b"), "b"), ["b", "copy"])
    return joined.select("a", "b", "set_a", "set_b").mapInArrow(lambda b: tidied(_verify(b, percent)), "a long, b long")


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come sorted by tile, in tables of whole tiles."""
    names, rest = ("key", "i", "j"), None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rest = rows if rest is None else pa.concat_tables([rest, rows])
        if rest.num_rows < 2 * TILE and rest.nbytes < TILE_BYTES:
            continue
        last = [rest.column(c)[-1].as_py() for c in names]
        same = np.logical_and.reduce([rest.column(c).to_numpy() == x for c, x in zip(names, last, strict=True)])
        if whole := int(np.argmax(same)):
            yield rest.slice(0, whole).combine_chunks()
            rest = rest.slice(whole)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _likely_pairs(rows: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, equal registers): places of a left and a right row of one tile, of different labels, not verified yet and likely enough."""
    tile = np.stack([rows.column(c).to_numpy() for c in ("key", "i", "j")], 1)
    starts = np.flatnonzero(np.concatenate([[True], (tile[1:] != tile[:-1]).any(1)]))
    ends = np.append(starts[1:], len(tile))
    ids, labels, hubs, n, band, side, apart = (rows.column(c).to_numpy() for c in ("class", "label", "hub", "n_shingles", "band", "on_left", "apart"))
    table = np.frombuffer(b"".join(rows.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)

    def test(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        # Rows outside the largest label are on both sides: their pairs are taken once.
        ok = (labels[a] != labels[b]) & (~apart[a] | (ids[a] < ids[b])) & (hubs[a] != ids[b]) & (hubs[b] != ids[a])
        ok &= np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) - 1e-9
        a, b = a[ok], b[ok]
        for at in range(0, len(a), 20_000):
            x, y = a[at : at + 20_000], b[at : at + 20_000]
            p, q = table[x], table[y]
            # Each pair counts in the first band that it shares, and in no other.
            new = (p == q).reshape(len(x), -1, BAND).all(2).argmax(1) == band[x]
            x, y, p, q = x[new], y[new], p[new], q[new]
            more, less = (p > q).sum(1), (p < q).sum(1)
            good = likely(more, less, n[x].astype(float), n[y].astype(float), threshold)
            yield x[good], y[good], REGISTERS - (more + less)[good]

    left, right, size = [], [], 0
    for low, high in zip(starts.tolist(), ends.tolist(), strict=True):
        here, mine = np.arange(low, high), side[low:high]
        first, second = here[mine], here[~mine]
        step = max(1, PAIRS // max(1, len(second)))
        for at in range(0, len(first), step):
            left.append(np.repeat(first[at : at + step], len(second)))
            right.append(np.tile(second, len(first[at : at + step])))
            size += len(left[-1])
            if size > PAIRS:
                yield from test(np.concatenate(left), np.concatenate(right))
                left, right, size = [], [], 0
    if left:
        yield from test(np.concatenate(left), np.concatenate(right))


def _open_rows(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The rows that are in a likely pair of their tile."""
    for rows in _whole_tiles(batches):
        hit = np.zeros(rows.num_rows, bool)
        for x, y, _ in _likely_pairs(rows, threshold):
            hit[x] = hit[y] = True
        yield from rows.filter(pa.array(hit)).to_batches()


def _tile_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Labels that full sets (column set) link: likeliest pairs first, none within what is joined already."""
    for rows in _whole_tiles(batches):
        labels, sets, parent = rows.column("label").to_numpy(), rows.column("set"), {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        a, b = [], []
        for x, y, equal in _likely_pairs(rows, percent / 100):
            order = np.argsort(-equal, kind="stable")
            for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
                p, q = root(int(labels[i])), root(int(labels[j]))
                if p != q and _similar(sets[i], sets[j], percent):
                    parent[max(p, q)] = min(p, q)
                    a.append(labels[i])
                    b.append(labels[j])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b)], ["a", "b"])


def _similar(x: pa.Scalar, y: pa.Scalar, percent: int) -> bool:
    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")


def _tiles(nodes: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several labels, by tile.

    A row of the bucket's largest label is on the left of as many tiles as the other rows fill; each other row is there
    too, and on the right of as many tiles as all rows fill.
    """
    met = nodes.select("class", "label", "hub", F.inline("met"))
    by_label = met.groupBy("key", "label").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"), F.max_by("hub", "class").alias("high_hub"))
    buckets = by_label.groupBy("key").agg(
        F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels"), F.min("low").alias("low"), F.max_by("high_hub", "high").alias("high_hub")
    )
    # A bucket of two classes of which one is the other's hub is verified already.
    buckets = buckets.where("labels > 1 and not (size = 2 and coalesce(high_hub = low, false))")
    across, down, h = F.ceil((F.col("size") - F.col("most")) / TILE).cast("int"), F.ceil(F.col("size") / TILE).cast("int"), F.xxhash64("class")
    left = F.transform(F.sequence(F.lit(0), across - 1), lambda j: F.struct(F.pmod(h, down).cast("int").alias("i"), j.alias("j"), F.lit(True).alias("on_left")))
    right = F.transform(F.sequence(F.lit(0), down - 1), lambda i: F.struct(i.alias("i"), F.pmod(h, across).cast("int").alias("j"), F.lit(False).alias("on_left")))
    apart = F.col("label") != F.col("main")
    placed = met.join(buckets, "key").select("key", "band", "class", apart.alias("apart"), F.when(apart, F.concat(left, right)).otherwise(left).alias("places"))
    wide = placed.join(nodes.select("class", "label", F.coalesce("hub", F.lit(-1)).alias("hub"), "n_shingles", "registers"), "class")
    return _by_tile(wide.select("key", F.inline("places"), "band", "class", "label", "hub", "apart", "n_shingles", "registers"))


def _mark() -> Column:
    """Names a row by doc_id and text; null without an id."""
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))


def _grouped(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows' doc_id, mark, n_shingles and digest; and digest, component, component_id."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with Workspace(docs.sparkSession) as work:
        sketches = work.saved(docs.withColumns({"row": F.monotonically_increasing_id(), "mark": _mark()}).mapInArrow(lambda b: tidied(_sketch(b, k)), SKETCH), keep=True)
        usable = sketches.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
        # Rows of one digest have the same set, and so the same registers.
        classes = work.saved(usable.groupBy("digest").agg(F.min("row").alias("class"), F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n_shingles", "registers", "bands"))))
        met = classes.select("class", F.posexplode("bands").alias("band", "key"))
        shared = met.groupBy("key").agg(F.count("*").alias("size"), F.min("class").alias("least")).where("size > 1").select("key", "least")
        hub = F.mode(F.when(F.col("least") != F.col("class"), F.col("least")), True)
        meeting = met.join(shared, "key").groupBy("class").agg(hub.alias("hub"), F.collect_list(F.struct("key", "band")).alias("met"))
        nodes = work.saved(classes.drop("bands").join(meeting, "class"))
        sets = work.saved(_full_sets(nodes, docs, k))
        up = work.saved(_hub_links(nodes, sets, percent)).toDF("class", "one")
        labels = work.saved(up.join(up.toDF("one", "two"), "one", "left").select("class", F.coalesce("two", "one").alias("label")))
        labelled = work.saved(nodes.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class")))
        tiles = _tiles(labelled)
        likely_rows = work.saved(tiles.mapInArrow(lambda b: tidied(_open_rows(b, percent / 100)), tiles.schema))
        joining = _by_tile(likely_rows.join(sets, "class")).mapInArrow(lambda b: tidied(_tile_links(b, percent)), "a long, b long")
        # Labels that are linked to a hub themselves.
        chains = up.join(labels.select(F.col("label").alias("class")).distinct(), "class").toDF("a", "b")
        groups = components(joining.union(chains), work).toDF("label", "component")
        grouped = labelled.select("class", "least", "label").join(groups, "label", "left").select("class", "least", F.coalesce("component", "label").alias("component"))
        least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
        named = grouped.join(least, "component").select("class", "component", "component_id")
        found = classes.select("class", "digest", "least").join(named, "class", "left")
        found = work.saved(found.select("digest", F.coalesce("component", "class").alias("component"), F.coalesce("component_id", "least").alias("component_id")), keep=True)
    return sketches.select("doc_id", "mark", "n_shingles", "digest"), found


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs. Linked: Jaccard similarity of at least percent / 100.

    docs need not give its rows in the same order twice. Rows of one id are kept or not by their id.
    """
    sketches, found = _grouped(docs, k, percent, id_col, text_col)
    alone = F.col("doc_id")
    return (
        sketches.join(found, "digest", "left")
        .withColumn("component_id", F.when(alone.isNotNull(), F.coalesce("component_id", "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def _unused(name: str, columns: list[str]) -> str:
    """name, or the first like it that no column has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id") -> DataFrame:
    """One document of each component, with the columns of docs; rows without an id or words stay.

    It is a text of the least id. Where an id has several texts, each stays or goes with its own component; equal rows
    stay or go together. Rows are told apart by a 64-bit hash of id and text. Other columns come along, whatever their names.
    """
    sketches, found = _grouped(docs, k, percent, id_col, "text")
    with Workspace(docs.sparkSession) as work:
        rows = sketches.where("doc_id is not null").join(found, "digest").select("component", "doc_id", "mark").distinct()
        heads = rows.groupBy("component").agg(F.min(F.struct("doc_id", "mark"))["mark"].alias("head"))
        own, other = (_unused(name, docs.columns) for name in ("mark", "gone"))
        gone = _few(work.saved(rows.join(heads, "component").where("mark <> head").select(F.col("mark").alias(other)), keep=True))
    marked = docs.withColumn(own, F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("long"), "text")))
    return marked.join(gone, F.col(own) == F.col(other), "left_anti").drop(own)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 80)


ORACLE_SQL = {
    "op4_minhash": r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM docs, unnest(range(1, greatest(2, len(ws) - 2))) AS r(i) WHERE len(ws) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM docs JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
}
