"""Cross-tokenizer alignment: where the tokens of two tokenisers end together, and which of their tokens overlap.

A text with a space before it is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B). A batch's ids are
two Arrow lists; the flattened ids are looked up in tables of token lengths, and cumulative sums, counted anew in each
text, are where tokens end. The ends of both sides are joined on (text, end) by Acero's hash join, full outer: each
distinct end closes one stretch that lies in exactly one token of A and one of B, and two tokens overlap in no more than
one stretch, so the joined rows, gaps filled backwards, are the links. Ends of both sides close a group. Table.group_by
counts id pairs by task, Spark adds the partial counts up, and a second pass looks each link's count up.

Texts are encoded once: ids, and two bits for each link that tell which side ends there, are written with the first pass
and are what the second pass reads. Of the counts, the most frequent pairs (at most HEAD_PAIRS) are looked up in each
task; links of all other pairs are summed by text and pair and meet the counts in a join. Both ways are exact. Frequent
pairs, which each text has, are never shuffled row by row. Long texts go in stretches cut at single spaces between
other characters, where both sides have an end, so memory is bounded by STRETCH and the longest text without such a place.

Defined results: texts that are null, empty, or whose tokens don't give back the text have no tokens: zeros and an empty
digest; rows of one id are texts of their own and each counts; very long texts are read to their end; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from .common import Workspace, encoder, slices, small_batches, tidied, tokenizer_path

#: Pairs whose counts each task holds: 17 bytes each.
HEAD_PAIRS = 1_000_000
#: Characters of a text that are aligned at once.
STRETCH = 200_000
#: Rows of partial counts in memory before they are added up.
PARTIAL_ROWS = 500_000
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_PIECE = re.compile(r"(?<=[^ ])(?= )")


class PieceEncoder:
    """Ids by a sentencepiece model of texts that begin with the space which the model puts before a text.

    Where no piece holds a space after another sign, texts are encoded by chunks that begin with their spaces, and chunks
    are remembered in two generations of at most `most`.
    """

    def __init__(self, model: str, most: int = 300_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(model))
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_chunk = not any(re.search("[^▁]▁", p) for p in self.pieces) and "".join(self.model.encode("  a b ", out_type=str)) == "▁▁▁a▁b▁"
        # By chunk without its first space. The model takes a space alone, without the one that it puts first, for an empty text.
        self.space = {"": self._ids([self.model.piece_to_id("▁")])}
        self.known: dict[str, bytes] = dict(self.space)
        self.older: dict[str, bytes] = {}
        self.most = most

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def token_bytes(self) -> list[bytes]:
        return [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.pieces)]

    @staticmethod
    def _chunks(text: str) -> list[str]:
        if "  " in text or text[-1] == " ":
            return [c[1:] for c in _PIECE.split(text)]
        return text[1:].split(" ")

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return [self._ids(x) for x in self.model.encode([t[1:] for t in texts], num_threads=1)]
        if len(self.known) > self.most:
            self.older, self.known = self.known, dict(self.space)
        known, older = self.known, self.older
        cut = list(map(self._chunks, texts))
        new = []
        for chunk in set().union(*cut).difference(known):
            if (ids := older.get(chunk)) is None:
                new.append(chunk)
            else:
                known[chunk] = ids
        known.update(zip(new, map(self._ids, self.model.encode(new, num_threads=1)), strict=True))
        return [b"".join(map(known.__getitem__, chunks)) for chunks in cut]


class Side:
    """One vocabulary: its encoder, and the bytes of each token as Arrow tables."""

    def __init__(self, encode, tokens: list[bytes], marks: str):
        self.encode = encode
        self.tokens = pa.array(tokens, pa.large_binary())
        self.sizes = pa.array([len(t) for t in tokens], pa.int64())
        # A token in a group, with more of its side after it, and as the last one.
        self.printed = pa.array([f"{i}{mark}" for mark in marks for i in range(len(tokens))], pa.large_string())

    def lists(self, texts: list[str]) -> pa.LargeListArray:
        """Ids of texts that each begin with a space."""
        raw = self.encode(texts)
        ends = np.cumsum([0, *map(len, raw)]) // 4
        return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<u4")))


def _data(texts: pa.Array) -> memoryview:
    """The characters of an Arrow array of large binaries or strings, one after the other."""
    size = int(pc.sum(pc.binary_length(texts)).as_py() or 0)
    return memoryview(texts.buffers()[2]).cast("B")[:size] if size else memoryview(b"")


_SIDES: dict[tuple[str, str], tuple[Side, Side]] = {}


def sides(a: str, b: str) -> tuple[Side, Side]:
    """Both vocabularies, once per worker process."""
    if (a, b) not in _SIDES:
        chunks = encoder(a, plain=True)
        signs = {chr(sign): bytes([byte]) for byte, sign in chunks.signs.items()} | {chr(x): bytes([x]) for x in range(256) if x not in chunks.signs}
        vocabulary = chunks.tokenizer.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens[i] = b"".join(signs.get(c, c.encode()) for c in token)
        pieces = PieceEncoder(b)

        def encode(texts: list[str]) -> list[bytes]:
            # Behind a dot the first word is a chunk as any other; the dot is one token.
            led = [t[1:2] != "" and not t[1].isspace() for t in texts]
            return [x[4:] if dot else x for x, dot in zip(chunks(["." + t if dot else t for t, dot in zip(texts, led, strict=True)]), led, strict=True)]

        _SIDES[a, b] = Side(encode if chunks.by_chunk else chunks, tokens, ",|"), Side(pieces, pieces.token_bytes(), ",;")
    return _SIDES[a, b]


class Alignment:
    """The alignment of some texts, each beginning with a space: links in order, and by text whether its tokens give it back."""

    def __init__(self, texts: list[str], a: Side, b: Side):
        self.n = len(texts)
        lists = [side.lists(texts) for side in (a, b)]
        flat = [pc.list_flatten(x) for x in lists]
        of = [pc.list_parent_indices(x) for x in lists]
        self.counts = [np.asarray(pc.list_value_length(x)) for x in lists]
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        lengths = np.array([len(r) for r in raw], np.int64)
        self.good = np.ones(self.n, bool)
        ends = []
        for side, ids, parents in zip((a, b), flat, of, strict=True):
            sizes = side.sizes.take(ids)
            sums = pa.table({"text": parents, "size": sizes}).group_by("text", use_threads=False).aggregate([("size", "sum")])
            whole = np.zeros(self.n, np.int64)
            whole[np.asarray(sums["text"])] = np.asarray(sums["size_sum"])
            starts = np.cumsum(whole) - whole
            self._compare(raw, _data(side.tokens.take(ids)), starts, whole, lengths)
            # Counted anew in each text: the sum over all less what stood before the text.
            ends.append(pc.subtract(pc.cumulative_sum(sizes), pa.array(starts).take(parents)))
        if not self.good.all():
            kept = [pa.array(self.good).take(p) for p in of]
            flat, of, ends = ([x.filter(k) for x, k in zip(xs, kept, strict=True)] for xs in (flat, of, ends))
            self.counts = [np.where(self.good, n, 0) for n in self.counts]
        tables = [pa.table({"text": p, "end": e, name: pa.array(np.arange(len(p)))}) for p, e, name in zip(of, ends, "ab", strict=True)]
        joined = tables[0].join(tables[1], ["text", "end"], join_type="full outer", use_threads=False)
        joined = joined.take(pc.sort_indices(joined, [("text", "ascending"), ("end", "ascending")]))
        both = [joined[name].combine_chunks() for name in "ab"]
        self.text = np.asarray(joined["text"].combine_chunks())
        closes = [np.asarray(pc.is_valid(x)) for x in both]
        self.flags = closes[0].astype(np.uint8) | closes[1].astype(np.uint8) << 1
        self.a, self.b = (np.asarray(ids) for ids in flat)
        at = [np.asarray(pc.fill_null_backward(x)) for x in both]
        self.pairs = self.a[at[0]].astype(np.int64) << 32 | self.b[at[1]] if len(self.text) else np.zeros(0, np.int64)
        self.n_links = np.bincount(self.text, minlength=self.n)
        self.n_groups = np.bincount(self.text[self.flags == 3], minlength=self.n)
        self.printed, self.printed_ends = self._print(a, b)

    def _compare(self, raw: list[bytes], got: memoryview, starts: np.ndarray, whole: np.ndarray, lengths: np.ndarray) -> None:
        """Clears good where a text's tokens, one after the other in got, are not the text."""
        if (whole != lengths).any() or got != b"".join(raw):
            for k in np.flatnonzero(self.good):
                self.good[k] = got[starts[k] : starts[k] + whole[k]] == raw[k]

    def _print(self, a: Side, b: Side) -> tuple[memoryview, np.ndarray]:
        """Groups of all texts as printed, each with its end mark, and where each text's end."""
        # Tokens in printing order: those of A of a group, then those of B.
        closing = self.flags == 3
        group = np.cumsum(closing) - closing
        last, code = [], []
        for side, ids, bit in ((a, self.a, 1), (b, self.b, 2)):
            own = (self.flags & bit) > 0
            last.append(group[own])
            code.append((ids.astype(np.int64) + np.where(closing[own], len(side.sizes), 0), np.bincount(group[own], minlength=int(closing.sum()))))
        (code_a, n_a), (code_b, n_b) = code
        place_a = np.arange(len(code_a)) + (np.cumsum(n_b) - n_b)[last[0]]
        place_b = np.arange(len(code_b)) + np.cumsum(n_a)[last[1]]
        order = np.empty(len(code_a) + len(code_b), np.int64)
        order[place_a], order[place_b] = code_a, code_b + len(a.printed)
        printed = pa.chunked_array([a.printed, b.printed]).combine_chunks().take(pa.array(order))
        upto = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(printed)))]).astype(np.int64)
        return _data(printed), upto[np.cumsum(self.counts[0] + self.counts[1])]


def stretches(text: str, most: int) -> list[str]:
    """text, which begins with a space, in parts of about `most` characters that each begin with one and are cut where both sides have an end."""
    out, start = [], 0
    while len(text) - start > most:
        cut = _SAFE.search(text, start + most)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


class PairCounts:
    """Counts of id pairs of a task, added up by Table.group_by whenever there are many rows."""

    def __init__(self):
        self.tables: list[pa.Table] = []
        self.rows = 0
        self.settled = 0

    def add(self, pairs: np.ndarray) -> None:
        counted = pa.table({"pair": pairs}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
        self._put(pa.table({"pair": counted["pair"], "n": counted["count_all"]}))

    def _put(self, table: pa.Table) -> None:
        self.tables.append(table)
        self.rows += len(table)
        if self.rows > 2 * self.settled + PARTIAL_ROWS:
            self.settle()

    def settle(self) -> pa.Table | None:
        if self.tables:
            summed = pa.concat_tables(self.tables).group_by("pair", use_threads=False).aggregate([("n", "sum")])
            self.tables = [pa.table({"pair": summed["pair"], "n": summed["n_sum"]})]
            self.rows = self.settled = len(self.tables[0])
        return self.tables[0] if self.tables else None


_COUNTED = pa.schema([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])
_STORED = pa.schema([*_COUNTED, ("a", pa.binary()), ("b", pa.binary()), ("flags", pa.binary()), ("pair", pa.int64()), ("n", pa.int64())])


def _schema(kind: pa.DataType, rest: pa.Schema) -> pa.Schema:
    return pa.schema([("row", pa.int64()), ("doc_id", kind), *rest])


def _align_rows(texts: list[str | None], a: Side, b: Side, stretch: int) -> Iterator[tuple[dict, list[np.ndarray]]]:
    """A dict of _STORED's columns for each text, and its links' pairs."""
    parts = [(k, s) for k, t in enumerate(texts) if t for s in stretches(" " + t, stretch)]
    done: dict[int, list] = {}
    at = 0
    while at < len(parts):
        stop, size = at + 1, len(parts[at][1])
        while stop < len(parts) and size + len(parts[stop][1]) <= stretch:
            size += len(parts[stop][1])
            stop += 1
        x = Alignment([s for _, s in parts[at:stop]], a, b)
        ends = [np.cumsum(n) for n in (*x.counts, x.n_links)]
        print_starts = np.concatenate([[0], x.printed_ends[:-1]])
        for i in range(x.n):
            (a0, a1), (b0, b1), (l0, l1) = ((int(e[i - 1]) if i else 0, int(e[i])) for e in ends)
            done.setdefault(parts[at + i][0], []).append((bool(x.good[i]), x.a[a0:a1], x.b[b0:b1], x.flags[l0:l1], x.pairs[l0:l1], int(x.n_groups[i]), bytes(x.printed[print_starts[i] : x.printed_ends[i]])))
        at = stop
    for k in range(len(texts)):
        own = done.get(k, [])
        if not own or not all(p[0] for p in own):
            yield dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), 0) | {"groups_sha256": "", "a": b"", "b": b"", "flags": b""}, []
            continue
        digest = hashlib.sha256()
        for p in own[:-1]:
            digest.update(p[6])
        digest.update(own[-1][6][:-1])
        yield {
            "n_a": sum(len(p[1]) for p in own), "n_b": sum(len(p[2]) for p in own), "n_groups": sum(p[5] for p in own), "n_links": sum(len(p[3]) for p in own), "groups_sha256": digest.hexdigest(),
            "a": b"".join(p[1].tobytes() for p in own), "b": b"".join(p[2].tobytes() for p in own), "flags": b"".join(p[3].tobytes() for p in own),
        }, [p[4] for p in own]


def _first_pass(batches: Iterator[pa.RecordBatch], tokenizers: tuple[str, str], stretch: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row for each text, and at the end rows of this task's pair counts."""
    a, b = sides(*tokenizers)
    counts = PairCounts()
    for batch in batches:
        for _, part in slices(batch, 2_000_000):
            rows, found = [], []
            for row, pairs in _align_rows(part.column("text").to_pylist(), a, b, stretch):
                rows.append(row | {"pair": None, "n": None})
                found += pairs
            if found:
                counts.add(np.concatenate(found))
            columns = [part.column("row"), part.column("doc_id"), *(pa.array([r[f.name] for r in rows], f.type) for f in schema if f.name not in ("row", "doc_id"))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
    table = counts.settle()
    if table is not None:
        for batch in table.to_batches(max_chunksize=50_000):
            blank = {f.name: pa.nulls(len(batch), f.type) for f in schema} | {"pair": batch["pair"], "n": batch["n"]}
            yield pa.RecordBatch.from_arrays([blank[f.name] for f in schema], schema=schema)


_HEADS: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _head(folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs in order, their counts, and whether no pair of the same B id has more; one table per worker process."""
    if folder not in _HEADS:
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSystem

        _HEADS.clear()
        store, where = FileSystem.from_uri(folder)
        table = ds.dataset(where, filesystem=store, format="parquet", exclude_invalid_files=False).to_table(columns=["pair", "n", "top"]).sort_by("pair")
        _HEADS[folder] = tuple(np.asarray(table[c].combine_chunks()) for c in ("pair", "n", "top"))
    return _HEADS[folder]


_SUMMED = pa.schema([*_COUNTED, ("n_best", pa.int64()), ("count_sum", pa.int64()), ("pair", pa.int64()), ("times", pa.int64())])


def _second_pass(batches: Iterator[pa.RecordBatch], head: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row for each text with the sums over its links of frequent pairs, and rows (text, pair, times) of all other pairs."""
    _SIDES.clear()
    pairs, counts, tops = _head(head)
    names = [f.name for f in schema]
    for batch in batches:
        for _, part in slices(batch, 4_000_000, "a"):
            links, of = [], []
            for k, (raw_a, raw_b, raw) in enumerate(zip(*(part.column(c).to_pylist() for c in ("a", "b", "flags")), strict=True)):
                flags = np.frombuffer(raw, np.uint8)
                # A link lies in the token that is closed next, by its own flag or a later one.
                ids = [np.frombuffer(x, "<u4")[np.cumsum(flags & bit > 0) - (flags & bit > 0)] for x, bit in ((raw_a, 1), (raw_b, 2))]
                links.append(ids[0].astype(np.int64) << 32 | ids[1])
                of.append(np.full(len(flags), k, np.int64))
            table = pa.table({"of": np.concatenate(of), "pair": np.concatenate(links)}).group_by(["of", "pair"], use_threads=False).aggregate([([], "count_all")])
            text, pair, times = (np.asarray(table[c].combine_chunks()) for c in ("of", "pair", "count_all"))
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            known = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            n_best, count_sum = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            np.add.at(n_best, text[known], np.where(tops[at[known]], times[known], 0))
            np.add.at(count_sum, text[known], counts[at[known]] * times[known])
            whole = {c: part.column(c) for c in names if c in part.schema.names} | {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
            yield pa.RecordBatch.from_arrays([whole[f.name] if f.name in whole else pa.nulls(part.num_rows, f.type) for f in schema], schema=schema)
            rest = np.flatnonzero(~known)
            if len(rest):
                more = {"row": part.column("row").take(pa.array(text[rest])), "pair": pa.array(pair[rest]), "times": pa.array(times[rest].astype(np.int64))}
                yield pa.RecordBatch.from_arrays([more[f.name] if f.name in more else pa.nulls(len(rest), f.type) for f in schema], schema=schema)


def align_documents(docs: DataFrame, tokenizer_a: str = "byte_bpe_50k.json", tokenizer_b: str = "piece_bpe_32k.model", head_pairs: int = HEAD_PAIRS, stretch: int = STRETCH, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(a row per row of docs, a row per id pair).

    By text: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair no other pair of the same B id
    exceeds), count_sum (over its links), groups_sha256. By pair: a, b, n (links), top.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    stored, summed = (_schema(to_arrow_type(kind), s) for s in (_STORED, _SUMMED))
    named = lambda s: T.StructType([T.StructField(f.name, kind if f.name == "doc_id" else f.dataType) for f in from_arrow_schema(s)])
    with Workspace(spark) as work:
        # Row numbers are written as data: a task that runs again cannot change them.
        first = work.saved(source.mapInArrow(lambda x: tidied(_first_pass(x, (tokenizer_a, tokenizer_b), stretch, stored)), named(stored)))
        counts = work.saved(first.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")))
        b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
        # A row for each id of B at most.
        most = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
        ranked = work.saved(counts.withColumn("b", b_id).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("top"), F.floor(F.log2("n") * 16).cast("int").alias("level")), keep=True)
        # Some thousand levels at most.
        levels, held, least = sorted(ranked.groupBy("level").agg(F.count("*").alias("c")).collect(), key=lambda r: -r.level), 0, None
        for r in levels:
            if held + r.c > head_pairs:
                break
            held, least = held + r.c, r.level
        head = work.saved(ranked.where(F.col("level") >= least if least is not None else F.lit(False)).select("pair", "n", "top").coalesce(4))
        folder = f"{work.path}/{work.n}"
        second = work.saved(first.where("pair is null").drop("pair", "n").mapInArrow(lambda x: tidied(_second_pass(x, folder, summed)), named(summed)), keep=True)
    out = second.where("pair is null")
    if held < sum(r.c for r in levels):
        rest = second.where("pair is not null").select("row", "pair", "times").join(ranked, "pair")
        more = rest.groupBy("row").agg(F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
        out = out.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    pairs = ranked.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "n", "top")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), pairs


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    rows, _ = align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows
