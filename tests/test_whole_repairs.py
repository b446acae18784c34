"""Repairs over rows of every tier."""

from corpusgraph.operators import reading, repair

EDGE = "seq long, src string, type string, dst string, confidence string"


def test_arrays_from_edges_links_and_nothing(spark):
    slugs = ["concepts/a", "concepts/b", "concepts/c", "concepts/d", "concepts/e", "people/p", "sources/s", "sources/t", "sources/u"]
    n = spark.createDataFrame([(s, s, s.split("/")[1], s.split("/")[0]) for s in slugs], "path string, slug string, basename string, entity_type string")
    f = spark.createDataFrame(
        [("concepts/a", "key_sources", "null", None, None), ("concepts/b", "key_sources", "string", " TODO ", None), ("concepts/c", "key_sources", "string", "", None), ("concepts/d", "key_sources", "string", "mine", None), ("concepts/e", "key_sources", "number", None, 2024.0), ("concepts/a", "related_concepts", "null", None, None), ("people/p", "key_sources", "null", None, None)],
        "path string, key string, kind string, str string, num double",
    )
    e = [("sources/s", "introduces_concept", "concepts/a"), ("concepts/a", "critiqued_in", "sources/t"), ("concepts/a", "used_in", "sources/gone"), ("concepts/a", "related_to", "concepts/a"), ("sources/u", "authored_by", "people/p"), ("sources/u", "uses_concept", "concepts/d")]
    links = spark.createDataFrame([("concepts/b", "sources/t", False), ("concepts/b", "concepts/c", False), ("concepts/b", "sources/u", True), ("concepts/a", "sources/u", False)], "src_path string, resolved string, in_fence boolean")
    got = {(r["path"], r["key"]): r["items"] for r in repair.rebuild_arrays(n, f, spark.createDataFrame([(k, *x, None) for k, x in enumerate(e)], EDGE), links).collect()}
    assert got == {
        ("concepts/a", "key_sources"): ["sources/s", "sources/t"], ("concepts/b", "key_sources"): ["sources/t"], ("concepts/c", "key_sources"): [], ("concepts/d", "key_sources"): ["mine"],
        ("concepts/e", "key_sources"): ["2024"], ("concepts/a", "related_concepts"): [], ("people/p", "key_sources"): ["sources/u"],
    }


def test_renames_rewrite_bare_links(spark):
    n = spark.createDataFrame([("concepts/My_Note", "My_Note", "[[My_Note]]"), ("concepts/b", "b", "see [[My_Note|x]] and [[concepts/My_Note]]")], "path string, basename string, content string")
    links = spark.createDataFrame([("concepts/My_Note", "My_Note"), ("concepts/b", "My_Note"), ("concepts/b", "concepts/My_Note")], "src_path string, raw_target string")
    done = repair.rewrite_links(n, repair.renamed_links(n, repair.rename_slugs(n), links)).collect()
    assert [(r["path"], r["new"]) for r in done] == [("concepts/b", "see [[my-note|x]] and [[concepts/My_Note]]")]


def test_recap_has_plot_beats(spark):
    c = spark.createDataFrame([("k", 1, "chapters/k1"), ("k", 2, "chapters/k2")], "book string, number int, chapter string")
    beats = spark.createDataFrame([("k", 1, "plot/k/ch1-beats"), ("k", 2, "plot/k/ch2-beats"), ("k", None, "plot/k/x")], "book string, up_to_chapter int, beat string")
    got = reading.recap_scope(c, spark.createDataFrame([], EDGE), spark.createDataFrame([("k", 2)], "book string, cursor int"), beats)
    assert sorted(tuple(r) for r in got.collect()) == [("k", "beat", "plot/k/ch1-beats"), ("k", "chapter", "chapters/k1"), ("k", "error", "plot/k/x")]
