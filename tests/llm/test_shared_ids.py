"""Different texts under one id."""

from corpusgraph.llm import near_dedup


def test_texts_that_share_an_id_are_judged_one_by_one(spark):
    words = lambda name: " ".join(f"{name}{k}" for k in range(200))
    rows = [(1, words("a")), (5, words("a") + " more"), (5, words("clean")), (7, words("n")), (7, words("n") + " more"), (8, words("z")), (8, words("z")), (9, "")]
    kept = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 5, 7, 8, 9]
    assert [r["text"] for r in kept if r["doc_id"] == 5] == [words("clean")]
