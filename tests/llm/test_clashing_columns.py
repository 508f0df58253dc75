"""Columns with the names that the operator uses itself stay as they are."""

from ledgerloom.llm.minhash import drop_near_duplicates


def test_columns_of_any_name_stay(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "a", "b", 1, 2, 3), (2, text, "c", "d", 4, 5, 6), (3, "words of another text that is long enough", "e", "f", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string, _mark string, gone int, digest int, component int")
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
    shouted = docs.withColumnsRenamed({"mark": "MARK"})
    assert sorted(r.MARK for r in drop_near_duplicates(shouted).collect()) == ["a", "e"]
