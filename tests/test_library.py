"""Cases of the operators, properties of the graph repairs, sources and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import ids, text
from corpusgraph.operators import checks, discovery, graph, notes, repair, verify
from corpusgraph.sources import files
from corpusgraph.streaming import feeds

EDGE = "seq long, src string, type string, dst string, confidence string"
S2 = "0123456789abcdef0123456789abcdef01234567"

# Identifiers and what they normalise to (namespace, raw, id, version).
IDS = [
    ("doi", "10.1109/ABC.2020.123", "10.1109/abc.2020.123", None), ("doi", "https://dx.doi.org/10.1109/ABC", "10.1109/abc", None), ("doi", "doi:10.1109/abc", "10.1109/abc", None),
    ("doi", "not-a-doi", None, None), ("doi", "10.0000/../../etc/passwd", None, None), ("doi", "10.1000%2Fabc", "10.1000/abc", None),
    ("arxiv", "1706.03762v3", "1706.03762", 3), ("arxiv", "https://arxiv.org/pdf/1706.03762.pdf", "1706.03762", None), ("arxiv", "arxiv:1706.03762v2", "1706.03762", 2),
    ("arxiv", "math.GT/0309136", "math.GT/0309136", None), ("arxiv", "garbage", None, None), ("s2", S2.upper(), S2, None), ("s2", "tooshort", None, None),
    ("openalex", "https://api.openalex.org/works/W4392834756", "W4392834756", None), ("openalex", "A1234567", None, None), ("openalex", "w4392834756", None, None),
    ("url", "HTTP://Example.COM/path/?utm_source=x&q=1#frag", "https://example.com/path?q=1", None), ("url", "not a url", None, None), ("url", "ftp://example.com/", None, None),
    ("url", "https://example.com/", "https://example.com/", None), ("url", "http://h:80/b?z=1&a=2&ref=q", "https://h/b?a=2&z=1", None), ("url", "https://é.org/", None, None), ("isbn", "1", None, None), ("doi", None, None, None),
]


def test_identifiers(spark):
    rows = ids.normalize_ids(spark.createDataFrame([(k, ns, raw) for k, (ns, raw, _, _) in enumerate(IDS)], "k int, ns string, raw string"), "ns", "raw").orderBy("k").collect()
    assert [(r["id"], r["version"]) for r in rows] == [(i, v) for _, _, i, v in IDS]
    assert [r["valid"] for r in rows] == [i is not None for _, _, i, _ in IDS]


def test_urls_and_keys(spark):
    urls = spark.createDataFrame([("https://arxiv.org/pdf/1706.03762v3.pdf",), ("https://openalex.org/W12",), ("mailto:x",)], "url string")
    got = [r["ids"] for r in ids.ids_from_urls(urls, "url").collect()]
    assert got == [{"url": "https://arxiv.org/pdf/1706.03762v3.pdf", "arxiv": "1706.03762"}, {"url": "https://openalex.org/W12", "openalex": "W12"}, {}]
    maps = spark.createDataFrame([({"arxiv": "1706.03762"},), ({"doi": "10.48550/arXiv.1706.03762v2"},), ({"doi": "10.1/x", "isbn": "1", "url": ""},)], "ids map<string,string>")
    crossed = [r["ids"] for r in ids.crosswalk_ids(maps).collect()]
    assert crossed == [{"arxiv": "1706.03762", "doi": "10.48550/arxiv.1706.03762"}, {"doi": "10.48550/arXiv.1706.03762v2", "arxiv": "1706.03762v2"}, {"doi": "10.1/x"}]


def edges(spark, seed, n=300):
    rng = random.Random(seed)
    types = ["cites", "cited_by", "uses_concept", "used_in", "related_to", "grounded_in", "features", "appears_in", "unheard_of"]
    spots = [f"sources/s{k}" for k in range(6)] + ["foundations/f", "https://x.org/a", "concepts/c"]
    return spark.createDataFrame([(k, rng.choice(spots), rng.choice(types), rng.choice(spots), rng.choice([None, "high", "low"])) for k in range(n)], EDGE)


def rows(df):
    return sorted(tuple(r) for r in df.select("src", "type", "dst").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_repairs_are_stable(spark, seed):
    e = edges(spark, seed)
    once = graph.dedup_edges(e)
    assert rows(graph.dedup_edges(once)) == rows(once)
    closed = graph.close_reverse(e)
    assert checks.check_missing_reverse(closed).count() == 0
    assert rows(graph.close_reverse(closed)) == rows(closed)
    tidy = graph.canonicalize_symmetric(e)
    assert checks.check_symmetric_duplicates(tidy).count() == 0
    assert rows(graph.canonicalize_symmetric(tidy)) == rows(tidy)
    known = e.where("type <> 'unheard_of'")
    assert rows(graph.add_edges(known, known)) == rows(known)
    shuffled = e.orderBy(F.rand(3))
    assert rows(graph.dedup_edges(shuffled)) == rows(once)


def test_edge_batches_are_refused_whole(spark):
    e = edges(spark, 3).where("type <> 'unheard_of'")
    bad = spark.createDataFrame([(1, "a", "cites", "b", None), (2, "a", "nothing", "b", None)], EDGE)
    with pytest.raises(ValueError, match="unknown type"):
        graph.add_edges(e, bad)
    got = graph.add_edges(e.limit(0), spark.createDataFrame([(1, "sources/a", "cites", "sources/b", "high"), (2, "sources/a", "grounded_in", "foundations/f", None)], EDGE))
    assert sorted(tuple(r)[1:] for r in got.collect()) == [("sources/a", "cites", "sources/b", "high", "forward"), ("sources/a", "grounded_in", "foundations/f", None, "forward"), ("sources/b", "cited_by", "sources/a", "high", "reverse")]


NOTE = """---
id: sources/a
title: "A: paper"
year: 0x10
importance: 3
authors:
  - Ada
  - 'Bo'
external_ids:
  doi: 10.1/x
  arxiv: 2401.00001
tags: []
empty:
---
# Heading
See [[concepts/b|B]] and [[b]].
"one two three four five" (p. 3-2)
```
[[no]] "one two three four five" (p. 9)
~~~
````
[[yes.md]] (tr. 4) “mot hai ba bon nam”
~~~~
[[open]]
"""


def test_note_parsing(spark):
    n = spark.createDataFrame([("sources/a", "sources/a", "a", "sources", NOTE), ("concepts/b", "concepts/b", "b", "concepts", "plain\n# B")], "path string, slug string, basename string, entity_type string, content string")
    got = {r["key"]: (r["kind"], r["str"], r["num"], r["items"], r["entries"]) for r in notes.extract_fields(n).collect()}
    assert got["title"] == ("string", "A: paper", None, None, None) and got["year"][0] == "string" and got["importance"][:3] == ("number", None, 3.0)
    assert got["authors"][3] == ["Ada", "Bo"] and got["external_ids"][4] == {"doi": "10.1/x", "arxiv": "2401.00001"} and got["tags"][3] == [] and got["empty"][0] == "null"
    links = {(r["raw_target"], r["in_fence"]) for r in notes.extract_links(n).collect()}
    assert links == {("concepts/b", False), ("b", False), ("no", True), ("yes.md", False), ("open", True)}
    masked = notes.mask_code_fences(n).where("path = 'sources/a'").first()["content"]
    assert masked.count("\n") == NOTE.count("\n") and "[[no]]" not in masked and "[[yes.md]]" in masked and "[[open]]" not in masked
    found = {r["raw_target"]: (r["resolved"], r["how"]) for r in notes.resolve_links(notes.extract_links(n), n).collect()}
    assert found["concepts/b"] == ("concepts/b", "exact") and found["b"] == ("concepts/b", "basename") and found["open"] == (None, None)
    quotes = {(r["lo"], r["hi"], r["quote"]) for r in verify.extract_quotes(n).collect()}
    assert quotes >= {(2, 3, "one two three four five")}
    assert {r["target"] for r in notes.extract_catalog_refs(spark.createDataFrame([("x [[old]] <!-- catalog --> [[a]] [t](./sources/b.md)",)], "content string")).collect()} == {"a", "sources/b"}
    moved = repair.rewrite_links(n, spark.createDataFrame([("sources/a", "b", "concepts/b"), ("sources/a", "no", "x")], "path string, target string, replacement string")).first()["new"]
    assert "[[concepts/b]]." in moved and "[[no]]" in moved


def test_quote_verdicts(spark):
    pages = spark.createDataFrame([("s", 2, "The “quick” brown-fox jumps"), ("s", 3, "over the lazy\ndog, đã"), ("s", 9, "far away")], "source_id string, page_no int, text string")
    quotes = spark.createDataFrame([(1, "s", 2, 2, "quick brown fox jumps"), (2, "s", 2, 3, "brown fox jumps over"), (3, "s", 3, 3, "Quick Brown Fox Jumps"), (4, "s", 3, 3, "far away"), (5, "t", 1, 1, "x"), (6, "s", 3, 3, "lazy dog da")], "quote_id int, source_id string, lo int, hi int, quote string")
    assert {r["quote_id"]: r["verdict"] for r in verify.verify_quotes(quotes, pages).collect()} == {1: "OK", 2: "OK", 3: "NEAR", 4: "FAIL", 5: "FAIL", 6: "OK"}
    parts = verify.segment_pages(spark.createDataFrame([("s", "lost\n[[page 1]]\na\nb\n[[page 2]]\n[[page 1]]\nagain")], "source_id string, text string"))
    assert {r["page_no"]: r["text"] for r in parts.collect()} == {1: "again", 2: ""}


def test_slugs(spark):
    title = spark.createDataFrame([("Ça va: Über_alles!",)], "t string")
    assert title.select(*(text.slug("t", r).alias(r) for r in ("note", "topic", "rename"))).first().asDict() == {"note": "ca-va-uber-alles", "topic": "ça-va-über-alles", "rename": "a-va-ber-alles"}
    assert spark.createDataFrame([("\\section{A} x % c\n\\emph{b}",)], "t string").select(text.tex_to_text("t")).first()[0].split() == ["x"]


def test_watchlist_takes_items_in_order(spark):
    items = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 1)], "item string, pos int, max_new int")
    cands = spark.createDataFrame([("a", "s", 1, "k1"), ("a", "s", 2, "k2"), ("b", "s", 1, "k1"), ("b", "s", 2, "k2"), ("b", "t", 1, "k3"), ("c", "s", 1, "k9"), ("c", "s", 2, "k8")], "item string, source string, rank int, dedup_key string")
    seen = spark.createDataFrame([("c", "k9")], "item string, dedup_key string")
    got = discovery.run_watchlist(items, cands, seen, spark.createDataFrame([("k3",)], "dedup_key string"))
    assert sorted(map(tuple, got.collect())) == [("a", "k1"), ("b", "k2"), ("c", "k8")]


def test_sources(spark, tmp_path):
    root = tmp_path / "wiki"
    (root / "sources").mkdir(parents=True)
    (root / "sources" / "a b.md").write_text("one\ntwo")
    (root / "index.md").write_text("x")
    got = {r["slug"]: (r["entity_type"], r["basename"], r["content"]) for r in files.scan_notes(spark, str(root)).collect()}
    assert got == {"sources/a b": ("sources", "a b", "one\ntwo"), "index": (None, "index", "x")}
    (tmp_path / "edges.jsonl").write_text('{"from":"a","type":"cites","to":"b"}\nbroken\n{"from":"b","type":"cites","to":"c","confidence":"low"}\n')
    lenient = files.scan_edges(spark, str(tmp_path / "edges.jsonl"))
    assert [tuple(r)[1:] for r in lenient.orderBy("seq").collect()] == [("a", "cites", "b", None), ("b", "cites", "c", "low")]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.scan_edges(spark, str(tmp_path / "edges.jsonl"), "strict").collect()
    files.write_edges(lenient, str(tmp_path / "out"))
    files.write_edges(lenient.where("dst = 'b'"), str(tmp_path / "out"))
    assert [r["dst"] for r in files.read_current_edges(spark, str(tmp_path / "out")).collect()] == ["b"]
    (tmp_path / "log.md").write_text("# Log\n## [2024-05-01] ingest | session:ab12 | did it\n## [2024-05-02] ask | plain\n")
    log = [tuple(map(str, r)) for r in files.scan_activity(spark, str(tmp_path / "log.md")).orderBy("day").collect()]
    assert log == [("2024-05-01", "ingest", "ab12", "did it"), ("2024-05-02", "ask", "None", "plain")]
    (tmp_path / "found").mkdir()
    (tmp_path / "found" / "a.json").write_text(json.dumps({"id": "1", "title": "t"}))
    (tmp_path / "found" / "b.json").write_text("{not json")
    assert [tuple(r) for r in files.scan_discovered(spark, str(tmp_path / "found"), "id string, title string").collect()] == [("1", "t")]
    new = spark.createDataFrame([("2024-01-01", "i", "s", "1", "x"), ("2024-01-01", "i", "s", "2", "y")], "day string, item_id string, source string, id string, title string")
    assert files.write_discovered(new.limit(1), str(tmp_path / "kept")) == 1
    assert files.write_discovered(new.withColumn("title", F.lit("changed")), str(tmp_path / "kept")) == 1
    assert sorted(r["title"] for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == ["changed", "x"]
    docs = spark.createDataFrame([("a.pdf", "x"), ("b.txt", "x"), ("c.md", "yy")], "name string, content string")
    first = files.document_manifest(docs)
    assert first.count() == 2 and files.document_manifest(docs, first).count() == 0


def land(path, number, rows):
    path.mkdir(exist_ok=True)
    (path / f"{number}.json").write_text("\n".join(json.dumps(r) for r in rows))


def test_streams(spark, tmp_path):
    entry = lambda f, k, day: {"feed_id": f, "id": k, "title": "t", "updated": f"2024-01-{day:02d}T00:00:00"}
    land(tmp_path / "in", 1, [entry("f", k, d) for k, d in (("a", 1), ("b", 2), ("c", 3), ("a", 1))] + [{"feed_id": "g", "link": "http://x", "updated": "2024-01-01T00:00:00"}])
    stream = feeds.stream_feed_entries(spark, str(tmp_path / "in"))
    out, back = str(tmp_path / "out"), str(tmp_path / "back")
    run = lambda: feeds.stream_capped(stream, out, back, str(tmp_path / "check"), 2).awaitTermination()
    shown = lambda: sorted(tuple(r) for r in spark.read.parquet(out).select("batch", "feed_id", "entry_key").collect())
    run()
    assert shown() == [(0, "f", "b"), (0, "f", "c"), (0, "g", "link:http://x")]
    land(tmp_path / "in", 2, [entry("f", "c", 3), entry("f", "d", 4)])
    run()
    assert shown()[2:] == [(0, "g", "link:http://x"), (1, "f", "a"), (1, "f", "d")]
    new = feeds.stream_new_entries_capped(stream, most=2).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check2")).option("path", str(tmp_path / "new")).trigger(availableNow=True)
    feeds.start_with_state(spark, new.start).awaitTermination()
    got = sorted((r["feed_id"], r["entry_key"]) for r in spark.read.schema("feed_id string, entry_key string, updated timestamp").parquet(str(tmp_path / "new")).collect())
    assert got == [("f", "a"), ("f", "b"), ("f", "c"), ("f", "d"), ("g", "link:http://x")]


def test_stream_discovery_and_checks(spark, tmp_path):
    schema = "id string, item string, source string, rank int, title string, authors array<string>, year int, url string, doi string, arxiv string"
    land(tmp_path / "c", 1, [{"id": str(k), "item": "i", "source": "s2", "rank": k, "doi": f"10.1/{k % 3}"} for k in range(6)])
    feeds.stream_discovery(spark.readStream.schema(schema).json(str(tmp_path / "c")), str(tmp_path / "found"), str(tmp_path / "c1"), 2).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "found")).count() == 2
    e = spark.createDataFrame([(1, "sources/a", "cites", "sources/b", None), (2, "sources/c", "cites", "sources/d", None)], EDGE)
    n = spark.createDataFrame([(f"sources/{x}",) for x in "abc"], "slug string")
    land(tmp_path / "ch", 1, [{"slug": "sources/c"}])
    feeds.stream_edge_checks(spark.readStream.schema("slug string").json(str(tmp_path / "ch")), e, n, str(tmp_path / "f"), str(tmp_path / "c2")).awaitTermination()
    assert sorted((r["check_id"], r["file"]) for r in spark.read.parquet(str(tmp_path / "f")).collect()) == [("L06", "sources/c"), ("L17", "sources/c")]


def test_listed_targets_and_quotes_lose_only_blanks(spark):
    index = spark.createDataFrame([("[[a0]] [[ b1 ]] [[c2]] [t](d3.md) [t](./e4)",)], "content string")
    assert {r["target"] for r in notes.extract_catalog_refs(index).collect()} == {"a0", "b1", "c2", "d3", "e4"}
    quoted = spark.createDataFrame([("n", '"0 a b c d 0" and "1 a b c d 1" (p. 2)')], "path string, content string")
    assert sorted(r["quote"] for r in verify.extract_quotes(quoted).collect()) == ["0 a b c d 0", "1 a b c d 1"]


def test_wide_page_numbers_and_long_items(spark):
    quotes = verify.extract_quotes(spark.createDataFrame([("n", '"one two three four five" (p. 99999999999999999999) and\n"one two three four six" (pp. 1-2147483647)')], "path string, content string"))
    paged = verify.segment_pages(spark.createDataFrame([("s", "lead\n[[page 99999999999]]\nlast\n[[page 1]]\none two three\n[[page 2]]\nfour six\n[[page 99999999999999999999]]\nno page")], "source_id string, text string"))
    assert {(r["page_no"], r["text"]) for r in paged.collect()} == {(1, "one two three"), (2, "four six"), (99999999999, "last")}
    judged = verify.verify_quotes(quotes.withColumn("source_id", F.lit("s")).withColumn("quote_id", F.col("line")), paged).collect()
    assert {r["quote_id"]: r["verdict"] for r in judged} == {1: "FAIL", 2: "OK"}
    many = "\n".join(f"[[page {k}]]\np{k}" for k in range(1200))
    assert verify.segment_pages(spark.createDataFrame([("s", many)], "source_id string, text string")).count() == 1200
    item = "x" * 150_000
    n = spark.createDataFrame([("a", "a", "a", "sources", f"---\nraw_paths:\n  - {item}\n---\n")], "path string, slug string, basename string, entity_type string, content string")
    assert notes.extract_fields(n).first()["items"] == [item]
