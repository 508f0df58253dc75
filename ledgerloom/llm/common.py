"""What the corpus operators share: shared storage, hashing and tokeniser access."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
MULTIPLIER = U64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which every executor can reach.

    Only in local mode, where the session names none, is a temporary folder made and set; a cluster's session must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and base.startswith("/"):
        base = "file://" + base
    return f"{base.rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends there and lost executors cost nothing."""
    path = shared_dir(df.sparkSession) + "/table"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Workspace:
    """The tables that an operator writes on its way; at its end all but the kept ones are removed, if it ended well."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.spare, self.n = spark, shared_dir(spark), [], 0

    def saved(self, df: DataFrame, keep: bool = False) -> DataFrame:
        """As saved(), in the operator's own folder. keep: for tables that its result reads."""
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        if not keep:
            self.spare.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            from pyarrow.fs import FileSystem

            for path in self.spare:
                store, where = FileSystem.from_uri(path)
                store.delete_dir(where)


#: Rows and bytes of an Arrow batch at most: texts and sets may be long, and a batch is in memory on both sides.
BATCH_ROWS, BATCH_BYTES = 1000, 8_000_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to BATCH_ROWS where it is larger or unlimited, and to BATCH_BYTES where it names none.

    No result depends on either. A row of more bytes is a batch of its own.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def tidied(batches: Iterator) -> Iterator:
    """The same batches; after the last one the worker, which Spark keeps, gives memory that it no longer uses back.

    Before the first one it forgets encoders, which operators that come here don't use.
    """
    _ENCODERS.clear()
    yield from batches
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of unsigned 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHashes(dict):
    """64-bit hash of a word (str or bytes), remembered; forgets everything when it holds `most` words."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word):
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h

    def of(self, words: list) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


#: One table per worker process, whichever operators it runs.
WORD_HASHES = WordHashes()


def ascii_words(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text, as UTF-8 (bytes.split splits on exactly those six characters)."""
    return text.encode("utf-8", "surrogatepass").split()


def ascii_lower(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased and every other byte left (bytes.lower works on ASCII alone)."""
    return text.encode("utf-8", "surrogatepass").lower()


def tokenizer_path(name: str) -> str:
    """A name such as byte_bpe_50k.json, looked up among the public tokenisers; a path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_EDGES = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACE = re.compile(r"\s")
_MARKS = ".,;:!?*#&%$-()"


def space_chunks(text: str) -> list[str]:
    """The text cut before single spaces and line ends between two other characters.

    A byte-level pre-tokeniser never forms a piece across such a place, so chunks can be encoded on their own. A chunk
    stands for itself with a space before it, or, if it begins with a line end, for itself; the first one begins with
    a line end that is not in the text.
    """
    text = "\n" + text
    if text[1:2].isspace() or text[-1:].isspace() or _EDGES.search(text):
        return _CUT.split(text)
    return text.replace("\n", " \n").split(" ")[1:]


class ChunkEncoder:
    """Token ids of whole texts by the tokenizers library, remembered by chunk as little-endian 32-bit integers.

    Two generations of at most `most` chunks are kept, so frequent chunks stay while rare ones are forgotten.
    """

    def __init__(self, tokenizer: str, most: int = 300_000, plain: bool = False):
        """plain: strings of special tokens inside texts are plain text."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(tokenizer))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most = most
        self.model, self.tails = self.tokenizer.model, {}
        self.by_chunk = "ByteLevel" in repr(self.tokenizer.pre_tokenizer) and self.tokenizer.normalizer is None
        self.line_end = array("I", self.tokenizer.encode("\n", add_special_tokens=False).ids).tobytes()
        # The sign that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one from 256 on.
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.signs = dict(zip([b for b in range(256) if b not in prints], range(256, 512), strict=False))
        self.space = chr(self.signs[32])

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece of the pre-tokeniser, by the library's model."""
        if piece.isascii():  # letters and marks print, so of these only the space has another sign
            raw = piece.replace(" ", self.space)
        else:
            raw = piece.encode().decode("latin-1").translate(self.signs)
        return array("I", [t.id for t in self.model.tokenize(raw)]).tobytes()

    def _word(self, chunk: str) -> bytes | None:
        """Ids of a chunk made of letters and then perhaps of ASCII marks, which are one piece each; else None."""
        core = chunk.rstrip(_MARKS)
        body = core[1:] if chunk[0] == "\n" else core
        if not body.isalpha():
            return None
        if (ids := self.known.get(core) or self.older.get(core)) is None:
            ids = self.line_end + self._piece(body) if chunk[0] == "\n" else self._piece(" " + body)
            self.known[core] = ids
        if len(core) < len(chunk):
            tail = chunk[len(core) :]
            if tail not in self.tails:
                if len(self.tails) > 10_000:
                    self.tails.clear()
                self.tails[tail] = self._piece(tail)
            ids += self.tails[tail]
        return ids

    def _learn(self, new: set[str]) -> None:
        rest = []
        for chunk in new:
            if (ids := self._word(chunk)) is None:
                rest.append(chunk)
            else:
                self.known[chunk] = ids
        for at in range(0, len(rest), 10_000):
            some = rest[at : at + 10_000]
            self.known.update(zip(some, self._encode([c if c[:1] == "\n" else " " + c for c in some]), strict=True))

    def _first(self, text: str) -> bytes:
        """The first chunk of a text that begins or is strewn with white space, without the line end put before it."""
        return self._encode([text[1:]])[0]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return self._encode(texts)
        if len(self.known) > self.most:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        heads, found, gaps, new = [], [], [], set()
        for text in texts:
            chunks = space_chunks(text)
            head = None
            if _SPACE.search(chunks[0], 1) or chunks[0] == "\n":
                head, chunks = chunks[0], chunks[1:]
            heads.append(head)
            got = list(map(known.get, chunks))
            gap = []
            if None in got:
                for i in [i for i, x in enumerate(got) if x is None]:
                    chunk = chunks[i]
                    if (x := older.get(chunk)) is None:
                        new.add(chunk)
                        gap.append((i, chunk))
                    else:
                        got[i] = known[chunk] = x
            found.append(got)
            gaps.append(gap)
        self._learn(new)
        skip = len(self.line_end)
        out = []
        for got, gap, head in zip(found, gaps, heads, strict=True):
            for i, chunk in gap:
                got[i] = known[chunk]
            raw = b"".join(got)
            out.append(raw[skip:] if head is None else self._first(head) + raw)
        return out


_ENCODERS: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(tokenizer: str, plain: bool = False) -> ChunkEncoder:
    """One encoder per worker process."""
    if (tokenizer, plain) not in _ENCODERS:
        _ENCODERS[tokenizer, plain] = ChunkEncoder(tokenizer, plain=plain)
    return _ENCODERS[tokenizer, plain]


def slices(batch, most_bytes: int = 2_000_000, column: str = "text"):
    """An Arrow batch as runs of rows of about most_bytes of text: (start, rows of the run)."""
    n, sizes = batch.num_rows, np.zeros(0)
    if n:
        import pyarrow.compute as pc

        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    start = 0
    ends = np.cumsum(sizes)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield start, batch.slice(start, stop - start)
        start = stop
