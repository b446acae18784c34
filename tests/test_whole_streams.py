"""Streams keep what a cap leaves."""

import json

from corpusgraph.streaming import feeds

SCHEMA = "id string, item string, source string, rank int, title string, authors array<string>, year int, url string, doi string, arxiv string"


def land(path, number, rows):
    path.mkdir(exist_ok=True)
    (path / f"{number}.json").write_text("\n".join(json.dumps(r) for r in rows))


def test_discovery_keeps_a_backlog_and_the_order_of_items(spark, tmp_path):
    row = lambda item, k: {"id": f"{item}{k}", "item": item, "source": "s2", "rank": k, "doi": f"10.1/{k}"}
    land(tmp_path / "c", 1, [row("a", k) for k in (1, 2, 3)] + [row("b", k) for k in (2, 3, 9)])
    stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "c"))
    run = lambda: feeds.stream_discovery(stream, str(tmp_path / "out"), str(tmp_path / "check"), 1).awaitTermination()
    shown = lambda: sorted((r["batch"], r["id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    run()
    assert shown() == [(0, "a1"), (0, "b2")]
    land(tmp_path / "c", 2, [row("c", 9)])
    run()
    assert shown()[2:] == [(1, "a3"), (1, "b9")]


def test_entries_without_a_time_are_rejected_not_lost(spark, tmp_path):
    land(tmp_path / "in", 1, [{"feed_id": "f", "id": "a", "updated": "2024-01-01T00:00:00"}, {"feed_id": "f", "id": "b"}])
    feeds.stream_rejected(feeds.stream_feed_entries(spark, str(tmp_path / "in")), str(tmp_path / "bad"), str(tmp_path / "check")).awaitTermination()
    assert [r["entry_key"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["b"]
