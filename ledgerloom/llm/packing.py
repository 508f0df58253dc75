"""Packing: hierarchical multi-length packing of tokenised documents.

Each document (its token ids and an end id) is routed by length: whole long windows are cut off, and what is left goes
to the smallest context tier that holds it. Tiers are packed from the longest down: the longest piece opens a window of
its tier, and the gap is filled with the longest pieces of the same or shorter tiers that fit; when none fits, a piece
is cut to the gap and its rest is routed again. So each window is full but the last of a task, which is split into
windows of powers of two.

Windows of one tier form step groups. They are dealt out DEALT groups at a time: the windows whose attention costs most
(the sum of their pieces' squared lengths) first, to and fro over the groups, so that groups have as many windows, one
more or less, and nearly the same cost. A task's last windows of a tier are dealt to as many groups as they need.

Texts are never shuffled: each task packs the rows that it reads, `buffer` tokens at a time, which bounds its memory.
Numbers of sequences and groups hold the task's number, so a task that runs again gives the same ones; which documents
share a sequence depends on how files are split into tasks.

Defined results: a null or empty text is its end id alone; a very long text is cut into whole windows and a rest, its ids
in memory at once; a null id is kept as null; repeated rows are packed each; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encoder, slices, small_batches, text_or_empty

TIERS = (128, 256, 512, 1024)
#: Windows of a task have numbers from task * WINDOWS on.
WINDOWS = 1 << 36
DEALT = 8


class TierPacker:
    """Packs pieces (length, document key, start) and gives windows: (tier, [(document key, start, length), ...])."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        if not tiers or any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
            raise ValueError("tiers must be ascending powers of two")
        self.tiers = tiers
        self.pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
        self.held = dict.fromkeys(tiers, 0)

    @property
    def waiting(self) -> int:
        return sum(self.held.values())

    def tier(self, length: int) -> int:
        return next(t for t in self.tiers if length <= t)

    def _route(self, length: int, key: int, start: int) -> None:
        if length:
            insort(self.pools[t := self.tier(length)], (length, key, start))
            self.held[t] += length

    def add(self, key: int, length: int) -> Iterator[tuple[int, list]]:
        """The whole windows of a document; what is left waits."""
        top, start = self.tiers[-1], 0
        while length - start >= top:
            yield top, [(key, start, top)]
            start += top
        self._route(length - start, key, start)

    def _take(self, most: int, tier: int) -> tuple[int, int, int] | None:
        """The longest waiting piece of at most `most` tokens, of this tier or a shorter one."""
        for t in reversed(self.tiers):
            if t <= tier and (k := bisect_right(self.pools[t], (most, float("inf"), 0))):
                piece = self.pools[t].pop(k - 1)
                self.held[t] -= piece[0]
                return piece
        return None

    def _shortest(self, tier: int) -> tuple[int, int, int] | None:
        for t in self.tiers:
            if t <= tier and self.pools[t]:
                piece = self.pools[t].pop(0)
                self.held[t] -= piece[0]
                return piece
        return None

    def pack(self, last: bool = False) -> Iterator[tuple[int, list]]:
        """Full windows of what waits. Less than a window of each tier may wait on, unless last."""
        for tier in reversed(self.tiers):
            while self.pools[tier] and sum(n for t, n in self.held.items() if t <= tier) >= tier:
                window, used = [], 0
                while used < tier:
                    piece = self._take(tier - used, tier) or self._shortest(tier)
                    length, key, start = piece
                    keep = min(length, tier - used)
                    window.append((key, start, keep))
                    used += keep
                    self._route(length - keep, key, start + keep)
                yield tier, window
        if last:
            pieces = [x for t in reversed(self.tiers) for x in self.pools[t]]
            self.pools, self.held = {t: [] for t in self.tiers}, dict.fromkeys(self.tiers, 0)
            left = sum(x[0] for x in pieces)
            while left:
                size = min(1 << (left.bit_length() - 1), self.tiers[-1])
                window, used = [], 0
                while used < size:
                    length, key, start = pieces.pop(0)
                    keep = min(length, size - used)
                    window.append((key, start, keep))
                    used += keep
                    if keep < length:
                        pieces.insert(0, (length - keep, key, start + keep))
                left -= size
                yield size, window


def deal(costs: list[int], n_groups: int) -> list[int]:
    """A group for each window: dearest first, to and fro over the groups. Their sizes differ by one at most."""
    out = [0] * len(costs)
    for k, window in enumerate(sorted(range(len(costs)), key=lambda i: (-costs[i], i))):
        turn, at = divmod(k, n_groups)
        out[window] = n_groups - 1 - at if turn % 2 else at
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pack_documents(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, tiers: tuple[int, ...] = TIERS, step_tokens: int = 65536, buffer: int = 1 << 19, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence, its tier and step group, and its ids if asked for.

    A sequence's length is its tier; step groups hold up to step_tokens / tier sequences of one tier.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer), TierPacker(tiers)
        end = np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() * WINDOWS
        waiting: dict[int, tuple[int | None, bytes, int]] = {}
        left: dict[int, int] = {}  # tokens of a waiting document that have no place yet
        undealt: dict[int, list[list[tuple]]] = {}  # by tier, windows as lists of pieces
        out: list[tuple] = []
        n_docs = n_windows = n_groups = 0

        def deal_out(tier: int) -> None:
            nonlocal n_groups
            windows = undealt.pop(tier)
            n = -(-len(windows) // max(1, step_tokens // tier))
            for window, group in zip(windows, deal([sum(x[2] ** 2 for x in w) for w in windows], n), strict=True):
                out.extend((*x[:8], base + n_groups + group, *x[8:]) for x in window)
            n_groups += n

        def place(windows) -> None:
            nonlocal n_windows
            for tier, window in windows:
                offset, pieces = 0, []
                for key, start, length in window:
                    doc_id, ids, total = waiting[key]
                    piece = ids[4 * start : 4 * (start + length)]
                    pieces.append((doc_id, start, length, zlib.crc32(piece), total, base + n_windows, offset, tier, *([piece] if with_ids else [])))
                    offset += length
                    left[key] -= length
                    if not left[key]:
                        del waiting[key], left[key]
                n_windows += 1
                undealt.setdefault(tier, []).append(pieces)
                if len(undealt[tier]) >= DEALT * max(1, step_tokens // tier):
                    deal_out(tier)

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()] + [pa.binary()] * with_ids
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids
        for batch in batches:
            for _, part in slices(batch):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist()), strict=True):
                    ids += end
                    total = len(ids) // 4
                    waiting[n_docs], left[n_docs] = (doc_id, ids, total), total
                    place(packer.add(n_docs, total))
                    n_docs += 1
                if packer.waiting >= buffer:
                    place(packer.pack())
                if out:
                    yield flush()
        place(packer.pack(last=True))
        for tier in list(undealt):
            deal_out(tier)
        if out:
            yield flush()

    return rows.mapInArrow(run, SCHEMA + ", ids binary" * with_ids)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, "byte_bpe_50k.json", end_id=0)
