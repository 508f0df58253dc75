"""Decontamination with phrases in many slices, and with ids of items that are not numbers."""

import hashlib

import test_dedup as plain

from ledgerloom.llm import contamination


def test_many_slices(spark, tmp_path, monkeypatch):
    """Slices of ten windows, some of one long item, give what one slice gives."""
    rows = plain.corpus(3)
    docs = plain.stored(spark, rows, tmp_path / "d")
    bench = spark.createDataFrame([(1, rows[0][1]), (2, " ".join(t or "" for _, t in rows[5:25])), (3, rows[30][1]), (4, "w1"), (5, None)], "item_id long, text string")
    whole = sorted(map(str, contamination.contamination(docs, bench, 10).collect()))
    assert sum("contaminated=True" in r for r in whole) > 5
    monkeypatch.setattr(contamination, "SLICE", 10)
    out = _local_slices(bench, tmp_path, monkeypatch)
    assert len(out["paths"]) > 20
    docs_words = [contamination.words(t) for _, t in rows]
    hit, ends, items = contamination._hits(docs_words, out["paths"], out["words"], out["least"])
    starts = [0, *ends[:-1].tolist()]
    got = sorted(
        f"Row(doc_id={i}, n_words={len(w)}, n_hit={int(hit[a:b].sum())}, n_items={len(x)}, items_sha256='{hashlib.sha256(','.join(sorted(x)).encode()).hexdigest()}', contaminated={bool(hit[a:b].any())})"
        for (i, _), w, a, b, x in zip(rows, docs_words, starts, ends.tolist(), items, strict=True)
    )
    assert got == whole


def _local_slices(bench, tmp_path, monkeypatch):
    """The slices written in this process, by the function that tasks run."""
    import numpy as np
    import pyarrow as pa

    class Task:
        partitionId = taskAttemptId = staticmethod(lambda: 0)

    monkeypatch.setattr(contamination.TaskContext, "get", staticmethod(lambda: Task))
    folder = tmp_path / "phrases"
    folder.mkdir()
    rows = [{"item_id": str(r.item_id), "text": r.text} for r in bench.collect()]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("item_id", pa.string()), ("text", pa.string())]))
    written = [r for b in contamination._write_slices(iter([batch]), f"file://{folder}", 10) for r in b.to_pylist()]
    words = np.unique(np.array([w for r in written for w in r["words"]], np.int64).view(np.uint64))
    (part,) = contamination._write_words(iter([pa.RecordBatch.from_pydict({"word": pa.array(words.view(np.int64))})]), f"file://{folder}")
    return {"paths": [r["path"] for r in written], "words": tuple(part.column("path").to_pylist()), "least": min(r["least"] for r in written)}


def test_ids_that_are_not_numbers(spark):
    docs = spark.createDataFrame([(1, "x one two y"), (2, "three"), (3, "one one")], "doc_id long, text string")
    bench = spark.createDataFrame([("item-b", "one two"), ("item-a", "One, two!"), (None, "three"), ("item-c", "three")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in contamination.contamination(docs, bench, 10).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {1: (2, 2, sha("item-a,item-b")), 2: (1, 1, sha("item-c")), 3: (0, 0, sha(""))}
