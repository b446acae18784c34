from corpusgraph.functions import text


def test_rows_without_a_title_keep_their_place(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, None), (3, "a-B"), (4, None)], "id int, t string")
    got = {r["id"]: (r["slug"], r["collisions"]) for r in text.assign_slugs(docs, "t", "note").collect()}
    assert got == {1: ("a-b", 2), 2: (None, 2), 3: ("a-b", 2), 4: (None, 2)}
