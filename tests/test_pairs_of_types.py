"""Edges and the reverses they ask for meet once, under one key for both types."""

import random

import pytest

from corpusgraph.operators import graph, repair
from corpusgraph.plans import adapters

EDGE = "seq long, src string, type string, dst string, confidence string"
BACK = {r[0]: r[3] for r in graph.edge_type_rows() if r[3] and not r[4] and not r[5]}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def planned_whole(spark):
    """The plan as a whole, with what is used again in it."""
    spark.conf.set("spark.sql.adaptive.enabled", False)
    yield
    spark.conf.set("spark.sql.adaptive.enabled", True)


def some_edges(rng, n, types, ends, confidences):
    return [(k, rng.choice(ends), rng.choice(types), rng.choice(ends), rng.choice(confidences)) for k in rng.sample(range(10 * n), n)]


def test_lines_are_dealt_once_for_all_edges(spark, sf_dir, planned_whole):
    e = adapters.landed(spark, sf_dir, "edges")
    for df in (e, e.where("seq % 3 = 0")):
        assert plan(df).count("ReusedExchange") == 1


def test_missing_reverses_are_found_in_one_meeting(spark, planned_whole):
    rng = random.Random(5)
    rows = some_edges(rng, 500, ["cites", "cited_by", "uses_concept", "used_in", "features", "tagged_with", "appears_in", "related_to", "grounded_in", "odd", None], ["a", "b", "c", "foundations/f", "https://x.org", None], ["high", "low", "odd", None])
    made = graph.close_reverse(spark.createDataFrame(rows, EDGE))
    assert plan(made).count("Exchange hashpartitioning") == 1 and "Join LeftAnti" not in plan(made)
    there = {r[1:4] for r in rows if r[1] is not None and r[3] is not None}
    wanted = {}
    for seq, src, kind, dst, confidence in sorted(rows, key=lambda r: r[0]):
        if kind in BACK and dst is not None and not dst.startswith(("foundations/", "https:")) and (dst, BACK[kind], src) not in there:
            wanted.setdefault((dst, BACK[kind], src), (seq, dst, BACK[kind], src, confidence))
    assert wanted and sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, [*rows, *wanted.values()]))


def added_by_loops(held, batch):
    symmetric = {r[0] for r in graph.edge_type_rows() if r[4]}
    key = lambda src, kind, dst: (min(src, dst), kind, max(src, dst)) if kind in symmetric else (src, kind, dst)
    have, offers, seen = {key(*r[1:4]) for r in held if r[1] is not None and r[3] is not None}, [], set()
    for seq, src, kind, dst, confidence in sorted(batch):
        k = key(src, kind, dst)
        if k in have or k in seen:
            continue
        seen.add(k)
        offers.append((seq, 0, *k, confidence, "forward"))
        if kind in BACK and not dst.startswith(("foundations/", "https:")):
            offers.append((seq, 1, dst, BACK[kind], src, confidence, "reverse"))
    out = {}
    for seq, _, src, kind, dst, confidence, source in sorted(offers, key=lambda o: o[:2]):
        if (src, kind, dst) not in have:
            out.setdefault((src, kind, dst), (seq, src, kind, dst, confidence, source))
    return sorted(map(repr, out.values()))


@pytest.mark.parametrize("types", [["cites", "cited_by", "uses_concept", "related_to", "grounded_in"], ["features", "tagged_with", "appears_in", "cites", "cited_by"]])
def test_added_edges_are_decided_in_one_meeting(spark, planned_whole, types):
    rng = random.Random(6)
    ends = [f"n{k}" for k in range(6)] + ["foundations/f", "https://x.org"]
    held, batch = some_edges(rng, 120, types, [*ends, None], ["low", None]), some_edges(rng, 150, types, ends, ["high", "low", None])
    made = graph.add_edges(spark.createDataFrame(held, EDGE), spark.createDataFrame(batch, EDGE))
    assert (plan(made).count("HashAggregate") == 2) == ("features" not in types)  # one sum, in the tasks and where its keys meet
    assert sorted(map(repr, map(tuple, made.where("source <> 'existing'").collect()))) == added_by_loops(held, batch)


def test_arrays_are_filled_from_one_reading_of_the_edges(spark, sf_dir, planned_whole):
    n = spark.createDataFrame([(s, s, s[:2], kind) for s, kind in (("c1", "concepts"), ("c2", "concepts"), ("p1", "people"), ("s1", "sources"))], "path string, slug string, basename string, entity_type string")
    own = spark.createDataFrame([("c1", "key_sources", "null", None, None), ("c1", "related_concepts", "string", "TODO", None), ("p1", "key_sources", "string", " ", None), ("c2", "key_sources", "null", None, None)], "path string, key string, kind string, str string, num double")
    rows = [("s1", "uses_concept", "c1"), ("c1", "used_in", "s1"), ("c1", "used_in", "away"), ("c2", "related_to", "c1"), ("c1", "related_to", "c1"), ("p1", "authored", "s1"), ("s1", "authored", "p1"), ("c2", None, "s1"), (None, "used_in", "s1")]
    made = repair.rebuild_arrays(n, own, spark.createDataFrame([(k, *r, None) for k, r in enumerate(rows)], EDGE), spark.createDataFrame([("c2", "s1", False)], "src_path string, resolved string, in_fence boolean").where("resolved = 's1'"))
    assert "Union" not in plan(made)
    assert {(r["path"], r["key"]): r["items"] for r in made.collect()} == {("c1", "key_sources"): ["s1"], ("c1", "related_concepts"): ["c2"], ("p1", "key_sources"): ["s1"], ("c2", "key_sources"): []}
