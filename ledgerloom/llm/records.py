"""Token-ID / binary output: length-delimited binary records with masked checksums and a separate offset index.

A data file (.rec) is a run of records, each
    length   unsigned 64 bits, of the payload
    check    unsigned 32 bits, masked CRC-32 of the eight length bytes
    payload  flags (1 byte: 1 if the document has an id; 2 if ids take 16 bits), doc_id (signed 64 bits), token ids
    check    unsigned 32 bits, masked CRC-32 of the payload
all little-endian. A check is masked as ((crc >> 15 | crc << 17) + 0xA282EAD8) mod 2**32, so that a checksum of data
that holds checksums stays strong. Its index (.idx) is the magic b"LLIX0001", the number of records as unsigned 64
bits, then that number plus one of unsigned 64-bit offsets: a reader takes any record by one seek, in any order.

Files are written by attempts under their own names and moved into place when whole, so a lost or repeated task leaves
no half file. Paths go through pyarrow.fs: any store that it and Spark share will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import encoder, partitions, saved, shared_dir, slices, small_batches, text_or_empty

MAGIC = b"LLIX0001"
_LENGTH, _CHECK, _HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<Bq")
_AROUND = _LENGTH.size + 2 * _CHECK.size


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, short: bool) -> bytes:
    """One record. ids: little-endian 32-bit integers; short: they are stored in 16 bits."""
    if short:
        ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    payload = _HEAD.pack((doc_id is not None) | 2 * short, doc_id or 0) + ids
    length = _LENGTH.pack(len(payload))
    return b"".join((length, _CHECK.pack(masked(length)), payload, _CHECK.pack(masked(payload))))


def unframe(record: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of a record; ValueError where a length or check is wrong."""
    (n,) = _LENGTH.unpack_from(record)
    if len(record) != n + _AROUND or _CHECK.unpack_from(record, 8)[0] != masked(record[:8]) or _CHECK.unpack_from(record, 12 + n)[0] != masked(record[12 : 12 + n]):
        raise ValueError("corrupt record")
    flags, doc_id = _HEAD.unpack_from(record, 12)
    ids = np.frombuffer(record, "<u2" if flags & 2 else "<u4", offset=12 + _HEAD.size, count=(n - _HEAD.size) // (2 if flags & 2 else 4))
    return doc_id if flags & 1 else None, ids


def _store(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


MANIFEST = "part int, path string, first_id long, n_docs long, n_tokens long, n_bytes long"


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(tokenizer)
    short = encode.tokenizer.get_vocab_size() <= 65536 and end_id < 65536
    end = np.array([end_id], "<u4").tobytes()
    context = TaskContext.get()
    part, out, offsets, first, n_tokens = context.partitionId(), None, [0], None, 0
    for batch in batches:
        for _, rows in slices(batch):
            ids_of, texts = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
            if out is None:
                store, root = _store(folder)
                store.create_dir(root, recursive=True)
                name = f"{root}/part-{part:06d}"
                own = f"{root}/_attempt-{part:06d}-{context.taskAttemptId()}"
                out, first = store.open_output_stream(f"{own}.rec"), ids_of[0]
            for doc_id, ids in zip(ids_of, encode(texts), strict=True):
                out.write(record := frame(doc_id, ids + end, short))
                offsets.append(offsets[-1] + len(record))
                n_tokens += len(ids) // 4 + 1
    if out is not None:
        out.close()
        with store.open_output_stream(f"{own}.idx") as index:
            index.write(MAGIC + _LENGTH.pack(len(offsets) - 1) + np.array(offsets, "<u8").tobytes())
        for kind in ("rec", "idx"):
            store.move(f"{own}.{kind}", f"{name}.{kind}")
        n = len(offsets) - 1
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/part-{part:06d}"], "first_id": pa.array([first], pa.int64()), "n_docs": [n], "n_tokens": [n_tokens], "n_bytes": [offsets[-1]]})


def write_records(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every document in ascending doc_id order, file after file; returns the manifest, a row for each file.

    A null text is empty: its record holds the end id alone. A null id sorts first and is kept as null. Rows with the
    same id are all written, in the order of reading. An empty table gives no file and an empty manifest.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), F.monotonically_increasing_id().alias("tie"))
        .repartitionByRange(partitions(spark), F.asc_nulls_first("doc_id"), "tie")
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie")
    )

    return saved(ordered.mapInArrow(lambda batches: _write(batches, folder, tokenizer, end_id), MANIFEST))



def _read(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, path in zip(batch.column("part").to_pylist(), batch.column("path").to_pylist(), strict=True):
            store, where = _store(path)
            with store.open_input_stream(f"{where}.idx") as f:
                raw = f.read()
            (count,) = _LENGTH.unpack_from(raw, len(MAGIC))
            if raw[: len(MAGIC)] != MAGIC or len(raw) != len(MAGIC) + 16 + 8 * count:
                raise ValueError(f"corrupt index {path}.idx")
            offsets = np.frombuffer(raw, "<u8", offset=len(MAGIC) + 8)
            at, start = 0, 0
            with store.open_input_file(f"{where}.rec") as f:
                while start < count:
                    stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + np.uint64(4_000_000), "right")) - 1)
                    low = int(offsets[start])
                    block = f.read_at(int(offsets[stop]) - low, low)
                    rows = []
                    for k in range(start, stop):
                        doc_id, ids = unframe(block[int(offsets[k]) - low : int(offsets[k + 1]) - low])
                        rows.append((doc_id, at, len(ids), ids.astype("<u4").tobytes()))
                        at += len(ids)
                    doc_ids, ats, sizes, data = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(rows), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ats, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x) for x in data], pa.int64()), pa.array(data if with_ids else [None] * len(rows), pa.binary())],
                        ["part", "doc_id", "at", "n_tokens", "ids_crc32", "ids"],
                    )
                    start = stop


def read_records(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Every record of the files of a manifest: part, doc_id, at (ids before it in its file), n_tokens, ids_crc32, ids.

    Files are read one after the other in pieces of 4 MB. ids are little-endian unsigned 32-bit integers; left out (null) unless with_ids.
    """
    n = partitions(manifest.sparkSession)

    return manifest.select("part", "path").repartition(n).mapInArrow(lambda batches: _read(batches, with_ids), "part int, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary")


def read_record(path: str, k: int) -> tuple[int | None, np.ndarray]:
    """The k-th record of the file at path (without suffix), by its index: two small reads."""
    store, where = _store(path)
    with store.open_input_file(f"{where}.idx") as f:
        low, high = struct.unpack("<QQ", f.read_at(16, len(MAGIC) + 8 + 8 * k))
    with store.open_input_file(f"{where}.rec") as f:
        return unframe(f.read_at(high - low, low))


def starts(manifest: DataFrame) -> DataFrame:
    """part, tokens_before: exclusive prefix sums over the files (one row a file, at most as many as shuffle partitions)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("tokens_before"))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_records(docs, shared_dir(spark) + "/records", "byte_bpe_50k.json", end_id=2)
    return (
        read_records(manifest, with_ids=False)
        .join(F.broadcast(starts(manifest)), "part")
        .select("doc_id", (F.col("tokens_before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part")
    )
