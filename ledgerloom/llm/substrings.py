"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted across the corpus.

Each window of `width` words has a polynomial hash over its words' 64-bit hashes, all windows of a block of rows at
once. A block sends each distinct hash, with the smallest doc_id that it saw there, to a bucket by hash range, packed
as sorted differences: some nine bytes a window, where a row of a shuffle takes twenty. A bucket finds hashes that
several blocks hold and answers each block that has not the smallest doc_id. In a second scan a block marks the words
covered by windows that start in a document with a smaller doc_id, merges them into maximal intervals and cuts them.

Texts are never shuffled. A window that half the corpus holds is one entry per block, so there are no hot keys. The
number of buckets follows from the bytes of all texts, which a first pass sums up, so that a bucket holds BUCKET_BYTES of
text or so and one fits in memory at any size of the corpus. Answers lie in files of the shared folder, one per block that
got any; each scan task leaves a hash of the ids and texts that it read, and the second scan stops with an error if its
rows differ (write such a table first). Of N windows a share of about N / 2**64 is taken for another by its hash.

Defined results: null and empty texts have no words and stay as they are; a text shorter than a window keeps all; a very
long text is a block of its own, in memory whole with its windows' hashes, some 40 bytes a word;
rows with a null id are left whole and make no other row lose words; rows with one id never make each other lose
words; an empty table gives an empty result; extra columns pass through or are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MULTIPLIER, WORD_HASHES, ascii_words, mix, partitions, saved, shared_dir, small_batches, tidied

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BLOCK_BYTES = 3_000_000
#: Bytes of text whose windows' hashes meet in a bucket; these are about 1.6 times as many bytes.
BUCKET_BYTES = 12_000_000
_HASHES = WORD_HASHES
_NO_ID = np.iinfo(np.int64).max


def _blocks(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a task in runs that end with the row that brings their texts to BLOCK_BYTES, numbered across tasks.

    Where runs end depends on the texts alone, so they are the same in each scan whatever other columns there are.
    """
    number, parts, size = TaskContext.get().partitionId() << 24, [], 0
    for batch in batches:
        ends, start = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text_col)), 0), np.int64)), 0
        while start < batch.num_rows:
            done = int(ends[start - 1]) if start else 0
            stop = int(np.searchsorted(ends, done + BLOCK_BYTES - size)) + 1
            parts.append(batch.slice(start, stop - start))
            size += int(ends[min(stop, batch.num_rows) - 1]) - done
            start = stop
            if size >= BLOCK_BYTES:
                yield number, pa.concat_batches(parts)
                number, parts, size = number + 1, [], 0
    if parts:
        yield number, pa.concat_batches(parts)


class _Windows:
    """All windows of a block: their hashes in ascending order, and whose they are."""

    def __init__(self, ids: list, texts: list, width: int):
        words = [ascii_words(t) if t else [] for t in texts]
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(self.sizes)
        ids = np.array([_NO_ID if i is None else i for i in ids], np.int64)
        hashes = np.concatenate([_HASHES.of(w) for w in words] or [np.zeros(0, np.uint64)])
        n = max(0, len(hashes) - width + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled *= MULTIPLIER
            rolled += hashes[k : k + n]
        of = np.repeat(np.arange(len(words)), self.sizes)[:n]
        self.at = np.flatnonzero((np.arange(n) + width <= self.ends[of]) & (ids[of] != _NO_ID))
        hashes = mix(rolled[self.at])
        order = np.argsort(hashes)
        self.at = self.at[order]
        self.doc = ids[of[self.at]]
        hashes = hashes[order]
        self.first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        self.hashes = hashes[self.first]
        self.least = np.minimum.reduceat(self.doc, self.first) if len(hashes) else np.zeros(0, np.int64)
        self.words, self.n_words = words, len(rolled) + width - 1 if n else int(self.sizes.sum())

    def covered(self, least: np.ndarray, width: int) -> np.ndarray:
        """Which words a window covers that also starts in a document with a smaller id; least: the smallest id for each hash."""
        runs = np.diff(np.append(self.first, len(self.at)))
        hit = self.at[np.repeat(least, runs) < self.doc]
        edges = np.zeros(int(self.sizes.sum()) + 1, np.int32)
        np.add.at(edges, hit, 1)
        np.add.at(edges, hit + width, -1)
        return np.cumsum(edges[:-1]) > 0


def _narrow(x: np.ndarray) -> tuple[int, bytes]:
    """Non-negative 64-bit integers in as many bytes each as the largest needs."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return width, np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(width: int, raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def _mark(ids: list, texts: list) -> int:
    """A hash of a block's ids and texts."""
    h = xxhash.xxh3_64(json.dumps([ids, [None if t is None else len(t) for t in texts]]))
    for t in texts:
        if t:
            h.update(t.encode("utf-8", "surrogatepass"))
    return h.intdigest()


def _store(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def _put(folder: str, name: str, data: bytes) -> None:
    store, root = _store(folder)
    own = f"{root}/_attempt-{TaskContext.get().taskAttemptId()}-{name}"
    with store.open_output_stream(own) as f:
        f.write(data)
    store.move(own, f"{root}/{name}")


PACKED = "bucket int, block long, first long, base long, hash_width int, hashes binary, doc_width int, docs binary"


def _send(batches: Iterator[pa.RecordBatch], width: int, buckets: int, folder: str) -> Iterator[pa.RecordBatch]:
    marks = {}
    for block, rows in _blocks(batches, "id", "text"):
        ids, texts = rows.column("id").to_pylist(), rows.column("text").to_pylist()
        marks[str(block)] = _mark(ids, texts)
        w = _Windows(ids, texts, width)
        if not len(w.hashes):
            continue
        bucket = ((w.hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        base, out = int(w.least.min()), []
        for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True):
            some = w.hashes[low:high]
            hash_width, hashes = _narrow(np.diff(some, prepend=np.uint64(0)))
            doc_width, docs = _narrow(w.least[low:high] - base)
            # The first difference is the whole hash; it alone keeps eight bytes.
            if high - low > 1:
                hash_width, hashes = _narrow(np.diff(some))
                hashes = int(some[0]).to_bytes(8, "little") + hashes
            out.append((int(bucket[low]), block, low, base, hash_width, hashes, doc_width, docs))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary()), strict=True)], [x.split()[0] for x in PACKED.split(", ")])
    _put(folder, f"rows-{TaskContext.get().partitionId()}", json.dumps(marks).encode())


def _meet(table: pa.Table) -> pa.Table:
    """A bucket: for each block, the places of its hashes for which another block has a smaller doc_id, and that id."""
    rows = table.to_pylist()
    hashes, docs = [], []
    for r in rows:
        if len(r["docs"]) > r["doc_width"]:
            first = np.frombuffer(r["hashes"][:8], "<u8")
            hashes.append(np.cumsum(np.concatenate([first, _wide(r["hash_width"], r["hashes"][8:])]), dtype=np.uint64))
        else:
            hashes.append(_wide(r["hash_width"], r["hashes"]))
        docs.append(_wide(r["doc_width"], r["docs"]).astype(np.int64) + r["base"])
    sizes = [len(h) for h in hashes]
    whole, doc = np.concatenate(hashes), np.concatenate(docs)
    order = np.argsort(whole)
    whole = whole[order]
    starts = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
    least = np.empty(len(whole), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc[order], starts), np.diff(np.append(starts, len(whole))))
    told = np.flatnonzero(least < doc)
    ends = np.cumsum(sizes)
    out = {"block": [], "at": [], "least": []}
    for k, (low, high) in enumerate(zip(np.searchsorted(told, ends - sizes), np.searchsorted(told, ends), strict=True)):
        if high > low:
            own = told[low:high]
            out["block"].append(rows[k]["block"])
            out["at"].append((own - (ends[k] - sizes[k]) + rows[k]["first"]).astype("<u4").tobytes())
            out["least"].append(least[own].astype("<i8").tobytes())
    return pa.table({"block": pa.array(out["block"], pa.int64()), "at": pa.array(out["at"], pa.binary()), "least": pa.array(out["least"], pa.binary())})


def _answer(table: pa.Table, folder: str) -> pa.Table:
    """All answers to a block as one file: how many, their places, their ids."""
    block = table.column("block")[0].as_py()
    at, least = b"".join(table.column("at").to_pylist()), b"".join(table.column("least").to_pylist())
    _put(folder, f"block-{block}", len(at).to_bytes(8, "little") + at + least)
    return pa.table({"block": pa.array([block], pa.int64()), "n": pa.array([len(at) // 4], pa.int64())})


def _cut(batches: Iterator[pa.RecordBatch], width: int, folder: str, id_col: str, text_col: str, digest: bool) -> Iterator[pa.RecordBatch]:
    from pyarrow.fs import FileType

    store, root = _store(folder)
    marks = None
    for block, rows in _blocks(batches, id_col, text_col):
        ids, texts = rows.column(id_col).to_pylist(), rows.column(text_col).to_pylist()
        if marks is None:
            with store.open_input_stream(f"{root}/rows-{block >> 24}") as f:
                marks = json.loads(f.read())
        if marks.get(str(block)) != _mark(ids, texts):
            raise RuntimeError("the second scan read other rows than the first; write the table and read it again before this operator")
        w = _Windows(ids, texts, width)
        least = w.least.copy()
        if store.get_file_info(f"{root}/block-{block}").type != FileType.NotFound:
            with store.open_input_stream(f"{root}/block-{block}") as f:
                raw = f.read()
            n = int.from_bytes(raw[:8], "little")
            least[np.frombuffer(raw, "<u4", offset=8, count=n // 4)] = np.frombuffer(raw[8 + n :], "<i8")
        gone = w.covered(least, width)
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[np.concatenate([[0], w.ends])])
        if digest:
            shas = []
            for k, words in enumerate(w.words):
                if removed[k]:
                    own = gone[w.ends[k] - w.sizes[k] : w.ends[k]]
                    words = [x for x, g in zip(words, own.tolist(), strict=True) if not g]
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column(id_col), pa.array(w.sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas)], ["doc_id", "n_words", "n_removed", "kept_sha256"])
        else:
            new = [cut_words(t, gone[w.ends[k] - w.sizes[k] : w.ends[k]]) if removed[k] else t for k, t in enumerate(texts)]
            yield rows.set_column(rows.schema.get_field_index(text_col), text_col, pa.array(new, rows.schema.field(text_col).type))


def intervals(gone: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of marked words as (first, one after the last)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def cut_words(text: str, gone: np.ndarray, word: re.Pattern = WORD) -> str:
    """The text without the marked words and without the white space after each run of them."""
    raw = text.encode("utf-8", "surrogatepass")
    spans, out, at = [m.span() for m in word.finditer(raw)], [], 0
    for low, high in intervals(gone):
        out.append(raw[at : spans[low][0]])
        at = spans[high][0] if high < len(spans) else spans[high - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, width: int = 13, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every repeated passage cut from all documents but the one with the smallest id.

    digest: instead doc_id, n_words, n_removed and kept_sha256 (of the kept words, joined by one space).
    docs must give the same rows in the same partitions twice, as a scan of files does.
    """
    if width < 1:
        raise ValueError("width must be positive")
    spark = docs.sparkSession
    small_batches(spark)
    folder, size = shared_dir(spark) + "/answers", docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(2 * partitions(spark), -(-size // BUCKET_BYTES))
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    sent = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda b: tidied(_send(b, width, buckets, folder)), PACKED)
    # Two buckets a partition, so that their number follows the data too.
    told = sent.repartition(-(-buckets // 2), "bucket").groupBy("bucket").applyInArrow(_meet, "block long, at binary, least binary")
    saved(told.groupBy("block").applyInArrow(lambda t: _answer(t, folder), "block long, n long"))
    if digest:
        return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(lambda b: tidied(_cut(b, width, folder, id_col, text_col, True)), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    return docs.mapInArrow(lambda b: tidied(_cut(b, width, folder, id_col, text_col, False)), schema)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), 13, digest=True)


#: Words and windows by list functions; a word is covered if a repeated window starts at one of the 13 places up to it.
ORACLE_SQL = {
    "op10_substring_dedup": r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS w FROM docs, unnest(range(1, len(ws) - 11)) AS r(i) WHERE len(ws) >= 13
), firsts AS (
  SELECT w, min(doc_id) AS first_doc FROM windows GROUP BY w
), gone AS (
  SELECT DISTINCT doc_id, j FROM (SELECT a.doc_id, unnest(range(a.i, a.i + 13)) AS j FROM windows a JOIN firsts f USING (w) WHERE f.first_doc < a.doc_id)
), marks AS (
  SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN js IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string(list_filter(ws, lambda w, i: NOT list_contains(js, i)), ' ') END) AS kept_sha256
FROM docs d LEFT JOIN marks USING (doc_id)
"""
}
