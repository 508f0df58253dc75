"""Benchmark decontamination: an FM-index per training shard, searched backwards for the benchmark's windows.

Each task cuts its rows into shards of some megabytes and indexes each once: words become symbols by their hashes (words
that no benchmark phrase has, and stretches too short for any phrase, can't be in a match and end a stretch), the
suffixes are sorted, and the Burrows-Wheeler transform is kept as a wavelet matrix with ranks. All phrases are searched
at once, last word first, each step two ranks a phrase. Occurrences are located by walking back to sampled suffix
positions (each eighth, and each stretch's first), and the words that they cover merge into removal spans.

Phrases lie in slices of at most SLICE in the shared folder, an item's windows in as many as they fill; all slices are
searched in one index. A worker keeps slices of up to KEPT_BYTES and the hashes of the benchmark's words (eight bytes for
each distinct one); nothing is broadcast. Only matches leave a task; texts are never shuffled. Words are told apart by
64-bit hashes: of V benchmark words, a word of the corpus is taken for one with probability V / 2**64.

Defined results: a null or empty text has no words and no hits; a very long text is a shard of its own, in memory with
its index, some 100 bytes for each word that the benchmark has; an item without words has no window; one of fewer words
than a window is one window; items with a null id are ignored; ids of items may be of any type and are taken as strings;
repeated items count once by id; repeated rows are judged each; empty tables give no rows, or no hits; extra columns pass
through or are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_HASHES, partitions, saved, shared_dir, slices, small_batches, text_or_empty, tidied
from .substrings import cut_words

SLICE = 100_000
KEPT_BYTES = 128_000_000
SHARD_BYTES = 4_000_000
EVERY = 8
#: What a word is, on bytes; letters are compared in lower case.
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def windows(ws: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    return [tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))] if ws else []


class WaveletMatrix:
    """Ranks of symbols in a sequence: one level of bits, sorted stably by them, for each binary digit."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels, x = [], sequence
        for b in reversed(range(bits)):
            ones = (x >> b & 1).astype(bool)
            count = np.zeros(len(x) + 1, np.int32)
            np.cumsum(ones, out=count[1:])
            self.levels.append((b, count, len(x) - int(count[-1])))
            x = np.concatenate([x[~ones], x[ones]])

    def rank(self, symbols: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol comes among as many first places."""
        low, high = np.zeros_like(upto), upto
        for b, count, zeros in self.levels:
            one = (symbols >> b & 1).astype(bool)
            low_ones, high_ones = count[low], count[high]
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
        return high - low


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in ascending order, by doubling prefixes; 0 ends a stretch and no two zeros are equal."""
    n = len(text)
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + ends.sum())
    h = 1
    order = np.argsort(rank, kind="stable")
    rank = _ranks(rank, order)
    while h < n and rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[: n - h] += rank[h:] + 1
        order = np.argsort(key)
        rank = _ranks(key, order)
        h *= 2
    return order


def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    key = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    return out


class FMIndex:
    def __init__(self, text: np.ndarray, n_symbols: int):
        """text: symbols from 1 to n_symbols, with a 0 after each stretch."""
        order = suffix_order(text)
        before = text[order - 1]  # the last symbol is 0, so the first suffix has 0 before it
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))])
        self.tree = WaveletMatrix(before, max(1, n_symbols.bit_length()))
        self.before = before
        sampled = (order % EVERY == 0) | (before == 0)
        self.sampled = sampled
        self.nth = np.cumsum(sampled) - 1
        self.samples = order[sampled]
        self.n = len(text)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which phrases occur, and the rows [low, high) of each. phrases: a row each, filled up with zeros."""
        live = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(phrases.shape[1] if len(phrases) else 0):
            todo = np.flatnonzero(lengths[live] > step)
            if not len(todo):
                break
            at = live[todo]
            c = phrases[at, lengths[at] - 1 - step]
            low[at] = self.less[c] + self.tree.rank(c, low[at])
            high[at] = self.less[c] + self.tree.rank(c, high[at])
            live = live[low[live] < high[live]]
        return live, low[live], high[live]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows start."""
        out, walked, left = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(left):
            done = self.sampled[rows]
            out[left[done]] = self.samples[self.nth[rows[done]]] + walked
            left, rows = left[~done], rows[~done]
            c = self.before[rows]
            rows = self.less[c] + self.tree.rank(c, rows)
            walked += 1
        return out


def _store(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def _write_slices(batches: Iterator[pa.RecordBatch], folder: str, width: int) -> Iterator[pa.RecordBatch]:
    """Phrases of this task's items, in files of at most SLICE: path, and the distinct word hashes and least length of each."""
    found: dict[tuple, set] = {}
    context, k, out = TaskContext.get(), 0, []
    store, root = _store(folder)

    def put() -> None:
        nonlocal k
        hashes = np.concatenate([WORD_HASHES.of(list(p)) for p in found])
        lengths = np.array([len(p) for p in found], np.int64)
        own, symbols = np.unique(hashes, return_inverse=True)
        table = np.zeros((len(found), int(lengths.max())), np.int32)
        table[np.arange(table.shape[1]) < lengths[:, None]] = symbols + 1
        counts = np.array([len(x) for x in found.values()], np.int64)
        data = {"words": own, "phrases": table, "lengths": lengths, "ends": np.cumsum(counts), "items": [i for x in found.values() for i in sorted(x)]}
        name = f"{context.partitionId():06d}-{k:06d}"
        with store.open_output_stream(f"{root}/_attempt-{context.taskAttemptId()}-{name}") as f:
            f.write(pickle.dumps(data))
        store.move(f"{root}/_attempt-{context.taskAttemptId()}-{name}", f"{root}/{name}")
        out.append({"path": f"{folder}/{name}", "words": own.view(np.int64).tolist(), "least": int(lengths.min())})
        found.clear()
        k += 1

    schema = pa.schema([("path", pa.string()), ("words", pa.list_(pa.int64())), ("least", pa.int64())])
    for batch in batches:
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for p in windows(words(text), width):
                found.setdefault(p, set()).add(item)
                if len(found) >= SLICE:
                    put()
        yield pa.RecordBatch.from_pylist(out, schema)
        out = []
    if found:
        put()
    yield pa.RecordBatch.from_pylist(out, schema)


def _write_words(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """This task's share of the benchmark's distinct word hashes, as a file."""
    store, root = _store(folder)
    context, n = TaskContext.get(), 0
    own, name = f"{root}/_attempt-{context.taskAttemptId()}-words", f"words-{context.partitionId():06d}"
    with store.open_output_stream(own) as f:
        for batch in batches:
            f.write(batch.column("word").to_numpy().tobytes())
            n += batch.num_rows
    store.move(own, f"{root}/{name}")
    yield pa.RecordBatch.from_pydict({"path": pa.array([f"{folder}/{name}"] if n else [], pa.string())})


_KEPT: dict[object, object] = {}


def _keep(key, read):
    """What read() gives, kept by key; as many are kept as KEPT_BYTES allow."""
    if key not in _KEPT:
        new = read()
        if sum(x.nbytes if isinstance(x, np.ndarray) else x["phrases"].nbytes for x in _KEPT.values()) > KEPT_BYTES:
            _KEPT.clear()
        _KEPT[key] = new
    return _KEPT[key]


def _bytes(path: str) -> bytes:
    store, where = _store(path)
    with store.open_input_stream(where) as f:
        return f.read()


def _slice(path: str) -> dict:
    return _keep(path, lambda: pickle.loads(_bytes(path)))


def _vocabulary(paths: tuple[str, ...]) -> np.ndarray:
    """The benchmark's word hashes in ascending order."""
    return _keep(paths, lambda: np.sort(np.concatenate([np.frombuffer(_bytes(p), np.uint64) for p in paths])))


class _Shard:
    """All words of docs in a row, and the index of those that the benchmark has."""

    def __init__(self, docs: list[list[bytes]], vocabulary: np.ndarray, least: int):
        self.sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        self.ends = np.cumsum(self.sizes)
        self.index = None
        hashes = np.concatenate([WORD_HASHES.of(ws) for ws in docs] or [np.zeros(0, np.uint64)])
        known = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        symbols = np.zeros(len(hashes) + len(docs) + 1, np.int64)  # a zero before each document and at the end
        own = np.ones(len(symbols), bool)
        own[np.concatenate([[0], self.ends]) + np.arange(len(docs) + 1)] = False
        symbols[own] = np.where(vocabulary[known] == hashes, known + 1, 0)
        inside = symbols > 0
        edges = np.flatnonzero(np.diff(inside.astype(np.int8)))
        starts, stops = edges[::2] + 1, edges[1::2] + 1
        long = stops - starts >= least
        starts, stops = starts[long], stops[long]
        if len(starts):
            # Stretches one after the other, each with the zero that follows it.
            runs = stops - starts + 1
            self.at = np.arange(int(runs.sum())) + np.repeat(starts - (np.cumsum(runs) - runs), runs)
            used, dense = np.unique(symbols[self.at], return_inverse=True)  # the zero is the first
            self.words = vocabulary[used[1:] - 1]
            self.index = FMIndex(dense, len(used) - 1)

    def match(self, phrases: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Match starts in all words of the docs, lengths, phrase numbers."""
        none = np.zeros(0, np.int64)
        if self.index is None:
            return none, none, none
        # The slice's words as symbols of this index; a phrase with a word that is not here can't match.
        at = np.minimum(np.searchsorted(self.words, phrases["words"]), len(self.words) - 1)
        symbol = np.concatenate([[0], np.where(self.words[at] == phrases["words"], at + 1, -1)])
        here = np.flatnonzero((symbol[phrases["phrases"]] >= 0).all(1))
        table, lengths = symbol[phrases["phrases"][here]], phrases["lengths"][here]
        which, low, high = self.index.search(table, lengths)
        counts = high - low
        rows = np.arange(int(counts.sum())) + np.repeat(low - (np.cumsum(counts) - counts), counts)
        place = self.at[self.index.locate(rows)]
        phrase = np.repeat(here[which], counts)
        word = place - 1 - np.searchsorted(self.ends + np.arange(len(self.ends)) + 1, place, "right")
        return word, phrases["lengths"][phrase], phrase


def _hits(docs: list[list[bytes]], paths: list[str], vocabulary: tuple[str, ...], least: int) -> tuple[np.ndarray, np.ndarray, list[set]]:
    """Which of all words are hit, the ends of the docs, and each doc's items."""
    items, total = [set() for _ in docs], sum(map(len, docs))
    edges = np.zeros(total + 1, np.int32)
    if not paths or not total:
        return np.zeros(total, bool), np.cumsum(np.fromiter(map(len, docs), np.int64, len(docs))), items
    shard = _Shard(docs, _vocabulary(vocabulary), least)
    for path in paths if shard.index is not None else []:
        phrases = _slice(path)
        word, length, phrase = shard.match(phrases)
        np.add.at(edges, word, 1)
        np.add.at(edges, word + length, -1)
        if len(word):
            pairs = np.unique(np.stack([np.searchsorted(shard.ends, word, "right"), phrase], 1), axis=0)
            for d, p in pairs.tolist():
                items[d].update(phrases["items"][(phrases["ends"][p - 1] if p else 0) : phrases["ends"][p]])
    return np.cumsum(edges[:-1]) > 0, shard.ends, items


def _judge(batches: Iterator[pa.RecordBatch], phrases: tuple[list[str], tuple[str, ...], int], text_col: str, digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, rows in slices(batch, SHARD_BYTES, text_col):
            texts = rows.column(text_col).to_pylist()
            docs = [words(t) for t in texts]
            hit, ends, items = _hits(docs, *phrases)
            sizes = np.diff(np.concatenate([[0], ends]))
            n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], ends])])
            if digest:
                shas = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(shas), pa.array(n_hit > 0)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
            else:
                new = [cut_words(t, hit[ends[k] - sizes[k] : ends[k]], WORD) if n_hit[k] else t for k, t in enumerate(texts)]
                yield rows.set_column(rows.schema.get_field_index(text_col), text_col, pa.array(new, rows.schema.field(text_col).type))


def phrase_slices(benchmark: DataFrame, width: int) -> tuple[list[str], tuple[str, ...], int]:
    """The files of the benchmark's windows, those of its words, and the least length of a window."""
    spark = benchmark.sparkSession
    small_batches(spark)
    folder = shared_dir(spark) + "/phrases"
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    # One task takes small benchmarks; each further one takes some 100,000 items.
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), text_or_empty().alias("text"))
    tasks = max(1, min(partitions(spark), items.count() // 100_000))
    written = saved(items.repartition(tasks).mapInArrow(lambda b: tidied(_write_slices(b, folder, width)), "path string, words array<bigint>, least long"))
    found = written.select("path", "least").collect()  # a row for each slice
    if not found:
        return [], (), 0
    vocabulary = written.select(F.explode("words").alias("word")).distinct()
    parts = saved(vocabulary.mapInArrow(lambda b: tidied(_write_words(b, folder)), "path string")).collect()
    return sorted(r.path for r in found), tuple(sorted(r.path for r in parts)), min(r.least for r in found)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a row for each row of docs."""
    phrases = phrase_slices(benchmark, width)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        lambda b: tidied(_judge(b, phrases, "text", True)), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text") -> DataFrame:
    """docs with the benchmark's passages cut from their texts."""
    phrases = phrase_slices(benchmark, width)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    return docs.mapInArrow(lambda b: tidied(_judge(b, phrases, text_col, False)), schema)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)


ORACLE_SQL = {
    "op5_decontamination": r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents
), bench AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark WHERE item_id IS NOT NULL
), phrases AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i:i + 9], ' ') AS p FROM bench, unnest(range(1, greatest(2, len(ws) - 8))) AS r(i) WHERE len(ws) > 0
), kinds AS (
  SELECT DISTINCT k FROM phrases
), spots AS (
  SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS p FROM docs, kinds, unnest(range(1, len(ws) - k + 2)) AS r(i) WHERE len(ws) >= k
), hits AS (
  SELECT doc_id, k, i, item_id FROM spots JOIN phrases USING (k, p)
), covered AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
}
