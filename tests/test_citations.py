"""Citations come line by line: a query of no other edges moves no lines, and a change to them is one meeting."""

from corpusgraph.operators import graph
from corpusgraph.plans import adapters, registry

ENDS = "src string, dst string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_citations_are_the_edges_of_their_type(spark, sf_dir):
    own, edges = adapters.landed(spark, sf_dir, "citations"), adapters.landed(spark, sf_dir, "edges").where("type = 'cites'")
    got = sorted(map(tuple, own.select("seq", "src", "dst").collect()))
    assert got and got == sorted(map(tuple, edges.select("seq", "src", "dst").collect()))
    assert {f.rsplit("/", 1)[-1] for f in own.inputFiles()} == {"lineitem.parquet"} and "Exchange" not in plan(own)


def test_a_change_moves_pairs_once_and_no_lines(spark, sf_dir):
    moved = [line for line in plan(registry.queries()["g05_citations"](spark, sf_dir)).splitlines() if "Exchange" in line]
    assert len(moved) == 1 and "hashpartitioning(src" in moved[0]


def test_a_change_is_an_addition_and_a_removal(spark):
    held = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), (None, "c"), ("c", None), ("d", "e")], ENDS)
    added = spark.createDataFrame([("a", "b"), ("x", "y"), ("x", "y"), ("x", "z"), (None, None)], ENDS)
    removed = spark.createDataFrame([("d", "e"), ("x", "z"), ("x", "z"), ("no", "such"), (None, "c"), ("c", None), (None, None)], ENDS)
    got = graph.change_citations(held, added, removed)
    want = graph.remove_citations(graph.add_citations(held, added), removed)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [("a", "b"), ("b", "a"), (None, "c"), ("c", None), ("x", "y"), (None, None)]))  # a null end equals none
    assert got.columns == ["src", "dst"] and graph.change_citations(held.limit(0), added.limit(0), removed).count() == 0


def test_a_lookup_of_citations_moves_no_lines(spark, sf_dir):
    text = plan(registry.queries()["f03_citations_of"](spark, sf_dir))
    assert "l_orderkey" in text and "hashpartitioning(l_orderkey" not in text
