"""Work that is dealt by pairs of ends, by numbers of files or rows, and not done twice."""

import random

import pandas as pd
from pyspark.sql import functions as F

from corpusgraph.operators import checks, graph
from corpusgraph.plans import note_queries, source_queries
from corpusgraph.sources import files
from corpusgraph.streaming import feeds

EDGE = "seq long, src string, type string, dst string, confidence string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def mixed(seed, n, nulls=True):
    pick = random.Random(seed)
    ends = ["sources/a", "sources/b", "concepts/c", "foundations/f", "http://u", "chapters/d"] + [None] * nulls
    types = ["cites", "cited_by", "uses_concept", "used_in", "related_to", "features", "tagged_with", "appears_in", "grounded_in"] + ["odd", None] * nulls
    return [(k, pick.choice(ends), pick.choice(types), pick.choice(ends), pick.choice([None, "high", "low", "medium"])) for k in range(n)]


def added(old, batch):
    """add_edges by plain loops."""
    back = {r[0]: r[3] for r in graph.edge_type_rows() if r[3] and not r[4] and not r[5]}
    both = {r[0] for r in graph.edge_type_rows() if r[4]}
    key = lambda s, t, d: (d, t, s) if t in both and s > d else (s, t, d)
    exempt = lambda d: d.split("/")[0] in ("foundations", "outputs", "reflections") or "://" in d
    held = {key(s, t, d) for _, s, t, d, _ in old if s and t and d}
    order = sorted(batch, key=lambda e: (e[0], e[4] or ""))
    new = {}
    for seq, s, t, d, c in order:
        if key(s, t, d) not in held:
            new.setdefault(key(s, t, d), (seq, c))
    offers = [(seq, 0, c or "", k, "forward") for k, (seq, c) in new.items()]
    offers += [(seq, 1, c or "", (d, back[t], s), "reverse") for (s, t, d), (seq, c) in new.items() if t in back and not exempt(d) and (d, back[t], s) not in held]
    won = {}
    for seq, _, c, k, source in sorted(offers):
        won.setdefault(k, (seq, *k, c or None, source))
    return sorted(map(repr, won.values()))


def test_added_edges_meet_once_by_pairs(spark):
    for seed in range(6):
        old, batch = mixed(seed, 60), [(k // 2, *r) for k, *r in mixed(seed + 50, 90, nulls=False)]  # some share a turn
        got = graph.add_edges(spark.createDataFrame(old, EDGE), spark.createDataFrame(batch, EDGE))
        assert sorted(repr(tuple(r)) for r in got.where("source <> 'existing'").collect()) == added(old, batch)
        assert got.where("source = 'existing'").count() == 60
    moved = plan(graph._added(spark.createDataFrame(old, EDGE), spark.createDataFrame(batch, EDGE), ["cites"]))
    assert moved.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in moved


def test_added_edges_keep_large_places(spark):
    top = 2**63 - 1  # twice as much is no long
    got = graph.add_edges(spark.createDataFrame([], EDGE), spark.createDataFrame([(top, "sources/a", "cites", "sources/b", "low")], EDGE))
    assert sorted(map(tuple, got.collect())) == [(top, "sources/a", "cites", "sources/b", "low", "forward"), (top, "sources/b", "cited_by", "sources/a", "low", "reverse")]


def test_edges_that_answer_each_other_are_one_row(spark):
    for seed in range(4):
        e = spark.createDataFrame(mixed(seed, 150), EDGE)
        alone, both = checks.check_missing_reverse(e), checks.fused_edge_checks(e, None, {"L06"})
        assert sorted(map(repr, map(tuple, both.select(*checks.FINDING).collect()))) == sorted(map(repr, map(tuple, alone.select(*checks.FINDING).collect())))
    answered = spark.createDataFrame([(1, "sources/a", "cites", "sources/b", None), (2, "sources/b", "cited_by", "sources/a", None)], EDGE).coalesce(1)
    assert checks.fused_edge_checks(answered, None, {"L06"}).count() == 0 and "L06+" in plan(checks.fused_edge_checks(answered, None, {"L06"}))


def test_ends_are_looked_up_once(spark, monkeypatch):
    e = spark.createDataFrame([(1, "a", "cites", "a", None), (1, "a", "cites", "a", None), (2, "b", "cites", None, "low"), (3, "b", "cites", "http://x", None), (4, None, "cites", "c", None)], EDGE)
    n = spark.createDataFrame([("b",), ("b",)], "slug string")
    for few in (5, 0):
        monkeypatch.setattr(graph, "FEW_SLUGS", few)
        found = lambda **how: sorted(repr((r["file"], r["message"])) for r in checks.check_dangling_edges(e, n, **how).collect())
        assert found() == sorted(map(repr, [("a", "dangling a cites")] * 4 + [(None, "dangling c cites")]))
        assert found(distinct=True) == sorted(map(repr, [("a", "dangling a cites")] * 2 + [(None, "dangling c cites")]))  # a loop has two ends
        near = graph.edges_touching(e, spark.createDataFrame([("a",), ("c",), ("a",), (None,)], "slug string"))
        assert sorted(r["seq"] for r in near.collect()) == [1, 1, 4]


def test_equal_rows_near_a_change_count_once(spark, tmp_path):
    e = spark.createDataFrame([(1, "sources/a", "cites", "sources/b", None)] * 2 + [(2, "sources/a", "cites", "sources/b", None)], EDGE)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"slug":"sources/a"}\n{"slug":"sources/b"}')
    changes = spark.readStream.schema("slug string").json(str(tmp_path / "in"))
    feeds.stream_edge_checks(changes, e, spark.createDataFrame([("sources/a",)], "slug string"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("check_id").count().collect()
    assert {r["check_id"]: r["count"] for r in got} == {"L06": 2, "L17": 2}


class Store:
    """What a state is to the update of a feed."""

    exists, get = False, None

    def update(self, row):
        self.exists, self.get = True, row


def test_a_feed_is_one_row_of_the_store(spark, tmp_path):
    poll = feeds.known_entries(1, 2)
    state, day = Store(), 86_400_000_000
    told = lambda *rows: [tuple(r) for out in poll(("f",), iter([pd.DataFrame(rows, columns=["entry_key", "micros"])]), state) for r in out[["entry_key", "micros"]].itertuples(index=False)]
    assert told(("a", 5), ("b", 3), ("a", 1)) == [("a", 1), ("b", 3)] and state.get == (["a", "b"], [5, 3])
    assert told(("a", 9)) == [] and state.get == (["a", "b"], [9, 3])
    assert told(("c", day + 4)) == [("c", day + 4)] and state.get == (["c", "a"], [day + 4, 9])  # b is more than a day older
    assert told(("b", day + 5), ("d", day + 6)) == [("b", day + 5), ("d", day + 6)] and state.get == (["d", "b"], [day + 6, day + 5])
    assert "MapState" not in (feeds.stream_new_entries_capped.__code__.co_names + feeds.known_entries.__code__.co_names)


def test_files_of_notes_are_dealt_to_tasks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(source_queries, "FILES_A_TASK", 1)
    seen = []
    monkeypatch.setattr(files, "scan_notes", lambda spark, path, scan=files.scan_notes: seen.append(path) or scan(spark, path))
    n = source_queries.s01(spark, sf_dir).count()
    parts = {name[0].split("/")[-1].split("-")[1] for name in spark.read.option("recursiveFileLookup", "true").text(seen[0]).select(F.expr("_metadata.file_path")).distinct().collect()}
    assert n > 1 and len(parts) > n // 2  # keys are dealt by hash, few share a task


def test_a_set_is_sorted_in_ranges_that_fit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "SORTED_ROWS", 10)
    e = spark.range(200).select(((F.col("id") * 77) % 200).alias("seq"), F.col("id").cast("string").alias("src"), F.lit("cites").alias("type"), F.lit("x").alias("dst"), F.lit(None).cast("string").alias("confidence"))
    files.write_edges(e, str(tmp_path / "set"))
    assert len(list((tmp_path / "set").glob("v-*/part-*"))) > int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    assert [int(r["src"]) * 77 % 200 for r in files.read_current_edges(spark, str(tmp_path / "set")).orderBy("seq").collect()] == list(range(200))


def test_shares_of_findings_do_not_run_the_checks_again(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(checks, "run_checks", lambda *a, **k: spark.createDataFrame([("L01", "error", True)], "check_id string, severity string, fixable boolean"))
    shown = plan(note_queries.summary(spark, sf_dir))
    assert "ExistingRDD" not in shown and "LocalTableScan" not in shown and shown.count("FileScan parquet") >= 2  # only the written counts are read
