from ledgerloom.llm import minhash


def test_each_text_of_an_id_goes_with_its_own_component(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, c + " more"), (4, ""), (4, ""), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in minhash.drop_near_duplicates(docs, 5, 80).collect()]
    assert len([r for r in got if r[0] == 3]) == 1
    assert sorted(str(r) for r in got if r[0] != 3) == sorted(map(str, [(1, a), (2, b), (4, ""), (4, ""), (None, a), (None, a)]))
