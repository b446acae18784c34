"""Trees of path templates: depth, rounds, sets of children."""

from corpusgraph.llm import url_templates


def templates(spark, urls):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(0, "block")], "page_id long, label string").where("page_id < 0")
    return {r["page_id"]: r["template"] for r in url_templates.judge_urls(pages, labels=labels).collect()}


def test_templates_keep_deep_segments(spark):
    deep = "http://h/a/b/c/d/e/f/g/h/"
    pages = spark.createDataFrame([(k, deep + "good/x") for k in range(30)] + [(100 + k, deep + "bad/y") for k in range(30)], "page_id long, url string")
    labels = spark.createDataFrame([(k, "allow") for k in range(20)] + [(100 + k, "block") for k in range(20)], "page_id long, label string")
    got = {r["page_id"]: (r["template"], r["verdict"]) for r in url_templates.judge_urls(pages, labels=labels).collect()}
    assert got[25] == ("/a/b/c/d/e/f/g/h/good/x", "allow") and got[125] == ("/a/b/c/d/e/f/g/h/bad/y", "block")


def test_templates_merge_until_nothing_changes(spark):
    names = [a + b for a in "abcde" for b in "vwxyz"]
    got = templates(spark, [f"http://h/{a}/{b}/{c}/{d}" for k, a in enumerate(names) for b, c, d in [(names[(k * 3) % 25], names[(k * 7) % 25], names[(k * 11) % 25])]])
    assert set(got.values()) == {"/*/*/*/*"}


def test_templates_compare_whole_sets_of_children(spark):
    pages = [(f"http://h/{b}/{c}", label) for b, cs in (("p", "amz"), ("q", "az")) for c, label in (("a", "block"), ("m", None), ("z", "allow")) if c in cs for _ in range(9)]
    own = spark.createDataFrame([(k, url) for k, (url, _) in enumerate(pages)], "page_id long, url string")
    labels = spark.createDataFrame([(k, label) for k, (_, label) in enumerate(pages) if label], "page_id long, label string")
    got = {r["template"] for r in url_templates.judge_urls(own, labels=labels).where("path like '/q/%'").collect()}
    assert got == {"/q/a", "/q/z"}
