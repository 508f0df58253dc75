"""Every pipeline stage on odd tables: nulls anywhere, empty and long texts, repeated rows and ids, columns with names used inside, no rows."""

import pytest

import corpus_pipeline

LONG = " ".join(f"word{k % 977} and{k % 31}" for k in range(30_000))
PASSAGE = " ".join(f"shared{k}" for k in range(60))
GOOD = "The committee met on Monday and agreed that the report should be printed before the end of the year. It was then sent to all members."
ROWS = [
    (1, GOOD, "en", "a"), (1, GOOD, "en", "a"), (2, GOOD, None, None), (3, None, "en", "a"), (4, "", "en", "a"), (5, " \n\t ", "en", "a"), (None, GOOD, "en", "a"), (None, None, None, None),
    (6, LONG, "en", "b"), (7, LONG + " and a little more", "en", "b"), (8, f"Before it all. {PASSAGE} after it.", "en", "b"), (9, f"Quite another beginning here: {PASSAGE}", "en", "b"), (9, "another text of the same id, with words of its own", "en", "b"), (10, "é" * 3000, "fr", "c"),
]
CLASHING = "mark string, gone int, score double, y int, row long, digest string, component long, key long, class int, start long, size long, shard int, tie int, item_id string, text_ string, doc_id_ long, n_chars long"
SCHEMA = "doc_id long, text string, lang string, source string"


def odd_table(spark, rows, clashing):
    extra = [f.split() for f in CLASHING.split(", ")] if clashing else []
    schema = SCHEMA + "".join(f", {n} {t}" for n, t in extra)
    made = [(*r, *((None if k % 3 == 0 else str(k) if t == "string" else float(k) if t == "double" else k) for _, t in extra)) for k, r in enumerate(rows)]
    return spark.createDataFrame(made, schema)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels and benchmark with nulls, repeated rows and columns of other names."""
    where = str(tmp_path_factory.mktemp("tables"))
    labels = [(k, int(k % 2 == 0), k % 2, "x") for k in range(1, 11)] + [(None, 1, 1, "x"), (1, None, None, None), (8, 1, 0, "y")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{where}/labels.parquet")
    items = [("i1", " ".join(f"shared{k}" for k in range(20, 35)), 1), ("i1", " ".join(f"shared{k}" for k in range(20, 35)), 1), ("i2", None, 2), ("i3", "", None), (None, "words of an item that has no id at all but ten words", 3), ("i4", "few words", 4)]
    spark.createDataFrame(items, "item_id string, text string, doc_id long").write.parquet(f"{where}/benchmark.parquet")
    return where


def column(df, name="text"):
    return sorted(("" if r[0] is None else str(r[0]), "" if r[1] is None else str(r[1])) for r in df.select("doc_id", name).collect())


@pytest.mark.parametrize("clashing", [False, True])
@pytest.mark.parametrize("step", range(4))
def test_stage_on_odd_rows(spark, folder, tmp_path, step, clashing):
    odd_table(spark, ROWS, clashing).repartition(3).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    out = corpus_pipeline.STAGES[step][1](spark, docs, folder)
    assert out.dtypes == docs.dtypes
    rows = out.collect()
    if clashing:  # what comes along is not touched, but for n_chars, which follows the text
        known = {(r.mark, r.score, r.key, r.tie) for r in docs.collect()}
        assert {(r.mark, r.score, r.key, r.tie) for r in rows} <= known
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in rows)
    if step == 1:
        assert ids == [-1, -1, 1, 1, 3, 4, 5, 6, 8, 9, 10]  # the row of 9 that shares 56 of 65 shingles with 8 goes
    if step >= 2:
        assert len(rows) == len(ROWS)
        text = {r.doc_id: r.text or "" for r in rows if r.doc_id != 9}
        nine = sorted(len((r.text or "").split()) for r in rows if r.doc_id == 9)
        assert "shared0" in text[8] and text[6] == LONG
        if step == 2:
            assert nine == [4, 11] and len(text[7]) < 100
        else:
            assert "shared25" not in text[8] and "shared40" in text[8] and nine == [11, 49]
    if step != 0:
        assert column(out.where("doc_id in (3, 4, 5, 10)")) == column(docs.where("doc_id in (3, 4, 5, 10)"))


def test_packing_of_odd_rows(spark, folder):
    pieces = corpus_pipeline.STAGES[4][1](spark, odd_table(spark, ROWS, True), folder).collect()
    assert {r.doc_id for r in pieces} == {r[0] for r in ROWS}
    assert sum(r.length for r in pieces if r.start == 0 and r.doc_id in (3, 4)) == 2  # the end id alone


@pytest.mark.parametrize("step", range(5))
def test_stage_on_an_empty_table(spark, folder, step):
    docs = odd_table(spark, [], False)
    out = corpus_pipeline.STAGES[step][1](spark, docs, folder)
    assert out.count() == 0 and (step == 4 or out.dtypes == docs.dtypes)


def test_stages_without_labels_or_items(spark, tmp_path):
    where = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{where}/benchmark.parquet")
    docs = odd_table(spark, ROWS, False)
    for step in (0, 3):  # every score is 0.5, and no item has words
        assert column(corpus_pipeline.STAGES[step][1](spark, docs, where)) == column(docs)
