"""Long training texts are drawn from all their places, short ones are taken whole."""

from pyspark.sql import functions as F

from ledgerloom.llm import toxicity


def test_pieces_come_from_everywhere(spark):
    size = toxicity.PIECE
    long = "".join(f"{k:03}".ljust(size, "x") for k in range(100))
    rows = [(i, long) for i in range(400)] + [(-1, long[: size * toxicity.PIECES]), (-2, ""), (-3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", toxicity._drawn(F.col("text"), F.col("doc_id")).alias("t"))
    got = dict(map(tuple, df.collect()))
    assert got[-1] == long[: size * toxicity.PIECES] and got[-2] == "" and got[-3] is None
    seen = [0] * 100
    for i in range(400):
        pieces = [got[i][k : k + size] for k in range(0, len(got[i]), size + 1)]
        assert len(pieces) == toxicity.PIECES and [p[:3] for p in pieces] == sorted({p[:3] for p in pieces})
        for p in pieces:
            seen[int(p[:3])] += 1
    assert min(seen) > 10 and max(seen) < 60  # 32 on average
