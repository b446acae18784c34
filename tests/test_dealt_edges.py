"""Edges are dealt to as many tasks as their lines need, and only edges that can matter meet keys."""

import pytest

from corpusgraph.operators import graph, repair
from corpusgraph.plans import adapters
from corpusgraph.sources import storage
from corpusgraph.streaming import findings

EDGE = "seq long, src string, type string, dst string, confidence string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_dealt_by_bytes(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(adapters, "PART_BYTES", 8 << 10)
    few = adapters.landed(spark, sf_dir, "edges").where("type = 'cites'")
    assert few.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism  # more bytes, more tasks
    assert "Arguments: hashpartitioning(l_orderkey" in few._jdf.queryExecution().explainString(few.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("few", [5, 0])
def test_few_slugs_go_to_all_tasks(spark, monkeypatch, few):
    e = spark.createDataFrame([(1, "a", "cites", "b", None), (2, "b", "cites", "b", None), (3, "c", "cites", None, "low")], EDGE)
    slugs = spark.createDataFrame([("b",), ("b",), (None,)], "slug string")
    monkeypatch.setattr(graph, "FEW_SLUGS", few)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = graph.edges_of(e, slugs)
        assert ("BroadcastHashJoin" in plan(found)) == (few > 0) and ("SortMergeJoin" in plan(found)) == (few == 0)
        assert sorted((r["seq"], r["direction"]) for r in found.collect()) == [(1, "in"), (2, "in"), (2, "out")]
        assert sorted(map(tuple, graph.neighbors(e, slugs).collect())) == [("b", "a"), ("b", "b")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_arrays_are_gathered_without_sets(spark):
    rows = spark.createDataFrame([("n", "k", "b"), ("n", "k", "a"), ("n", "k", "b"), ("m", "k", "c")], "path string, key string, other string")
    got = repair._gathered(rows, "items")
    assert "collect_set" not in plan(got) and {r["path"]: r["items"] for r in got.collect()} == {"n": ["a", "b"], "m": ["c"]}


def test_only_edges_of_named_types_meet_the_keys(spark, monkeypatch):
    e = spark.createDataFrame([(1, "sources/a", "cites", "sources/b", "low"), (2, "sources/b", "cited_by", "sources/a", None), (3, "x", "related_to", "a", None), (4, "x", None, "a", None), (5, "sources/a", "cites", "sources/b", None)], EDGE)
    specs = spark.createDataFrame([("sources/a", "cites", "sources/b", "surveys", None), ("a", "related_to", "x", "same_problem_as", "high"), ("no", "cites", "one", "surveys", None)], "src string, type string, dst string, new_type string, confidence string")
    want = [(1, "sources/a", "surveys", "sources/b", "low"), (1, "sources/b", "surveyed_by", "sources/a", "low"), (4, "x", None, "a", None)]
    assert sorted(map(repr, map(tuple, graph.replace_edges(e, specs).collect()))) == sorted(map(repr, want))
    assert "type#" in plan(graph.remove_edges(e, specs.select("src", "type", "dst").limit(1))) and graph._types(specs) is not None
    monkeypatch.setattr(graph, "MANY_TYPES", 1)
    assert graph._types(specs) is None and sorted(map(repr, map(tuple, graph.replace_edges(e, specs).collect()))) == sorted(map(repr, want))
    monkeypatch.undo()
    offered = graph.add_edges(e.where("type is not null"), spark.createDataFrame([(9, "sources/c", "cited_by", "sources/a", None), (7, "sources/a", "cites", "sources/c", "high"), (8, "sources/b", "cited_by", "sources/a", None)], EDGE))
    assert sorted(map(repr, map(tuple, offered.where("source <> 'existing'").collect()))) == sorted(map(repr, [(7, "sources/c", "cited_by", "sources/a", "high", "reverse"), (7, "sources/a", "cites", "sources/c", "high", "forward")]))  # the reverse of 7 comes before 9


def test_a_batch_of_findings_leaves_no_scratch(spark, tmp_path, monkeypatch):
    change = lambda op, *edge: ("edge", op, *edge, None)
    held = tmp_path / "scratch"
    held.mkdir()
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{held}")
    write = findings.findings_batch(f"file://{tmp_path}/out")
    for number, rows in enumerate(([change("add", "b", "cites", "a")] * 2, [change("add", "a", "cited_by", "b"), ("note", "add", None, None, None, "a")], [change("remove", "b", "cites", "a")])):
        write(spark.createDataFrame(rows, findings.CHANGE_SCHEMA), number)
        assert not list(held.iterdir())  # the tables between the steps of a batch go with it
    got = {tuple(r) for r in findings.current_findings(spark, f"file://{tmp_path}/out").collect()}
    # one copy of the first is left, and both are answered; b is no note, and both edges name it
    assert got == {("L17", "b", "dangling b cites", 1), ("L17", "a", "dangling b cited_by", 1)}
