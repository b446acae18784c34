"""Plans and shapes: fused checks equal the single ones, bucketed hops, landing in order, commits, heavy chapters."""

import random

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import checks, graph, notes, reading
from corpusgraph.plans import note_queries
from corpusgraph.sources import files

SINGLE = {
    "L01": lambda c: checks.check_required(c["notes"], c["note_fields"]), "L02": lambda c: checks.check_types(c["notes"], c["note_fields"]), "L06": lambda c: checks.check_missing_reverse(c["edges"]),
    "L07": lambda c: checks.check_symmetric_duplicates(c["edges"]), "L08": lambda c: checks.check_edge_confidence(c["edges"], c["needing"]), "L11": lambda c: checks.check_confidence(c["notes"], c["note_fields"]),
    "L13": lambda c: checks.check_id_coverage(c["sources"]), "L14": lambda c: checks.check_id_validity(c["sources"]), "L16": lambda c: checks.check_id_mismatch(c["sources"]),
}


def rows(df):
    return sorted(map(repr, map(tuple, df.select(*checks.FINDING).collect())))


def test_fused_checks_find_what_the_single_ones_find(spark, sf_dir):
    c = note_queries.corpus(spark, sf_dir)
    named = lambda e: e.withColumn("type", F.expr("case when seq % 17 = 0 then 'odd' else type end"))
    e = named(c["edges"].where("seq % 3 <> 1"))
    again = e.where("seq % 5 = 0").withColumn("seq", F.col("seq") + 1)  # repeated edges
    turned = e.where("seq % 7 = 0 and type = 'related_to'").selectExpr("seq + 2 as seq", "dst as src", "type", "src as dst", "confidence")
    loops = e.where("seq % 13 = 0").selectExpr("seq + 3 as seq", "src", "type", "src as dst", "confidence")
    more = spark.createDataFrame([("sources/o1", "date_added", "string", "1999-01-01", None, None), ("sources/o1", "created", "null", None, None, None), ("none", "id", "string", "x", None, None), ("sources/o2", "url", "string", "u", None, ["u"])], "path string, key string, kind string, str string, num double, items array<string>")
    c |= {"edges": e.unionByName(again).unionByName(turned).unionByName(loops), "needing": spark.createDataFrame([("uses_concept",), ("odd",)], "type string"), "note_fields": c["note_fields"].select(more.columns).union(more)}
    whole = checks.run_checks({k: c[k] for k in ("notes", "note_fields", "edges", "sources", "needing")}, list(SINGLE)).cache()
    for check, f in SINGLE.items():
        assert rows(whole.where(F.col("check_id") == check)) == rows(f(c)), check
    assert {r[0] for r in whole.select("check_id").distinct().collect()} == set(SINGLE)
    assert rows(checks.run_checks(c, ["L07", "L14"])) == rows(whole.where("check_id in ('L07', 'L14')"))
    with pytest.raises(ValueError):
        checks.run_checks(c, ["L15"])


def test_a_hop_shuffles_its_notes_and_not_the_edges(spark):
    e = spark.createDataFrame([(k, f"n{k % 50}", "cites", f"n{k * 7 % 90}", None) for k in range(400)], "seq long, src string, type string, dst string, confidence string")
    seeds = spark.createDataFrame([("n1",)], "slug string")
    name = graph.lay_out(e, 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = graph.next_hop(spark.table(name), seeds)._jdf.queryExecution().sparkPlan().toString() + graph.next_hop(spark.table(name), seeds)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    join = plan[plan.index("SortMergeJoin", plan.index("AdaptiveSparkPlan")) :]
    scan = join[: join.index("Bucketed: true")] if "Bucketed: true" in join else join
    assert "Bucketed: true" in join and "Exchange" not in scan  # nothing between the join and the edges
    spark.sql(f"drop table {name}")
    reached = {"n1": 0}
    pairs = {(r["src"], r["dst"]) for r in e.collect()} | {(r["dst"], r["src"]) for r in e.collect()}
    for hop in (1, 2, 3):
        for a in [k for k, v in reached.items() if v == hop - 1]:
            for x, y in pairs:
                if x == a:
                    reached.setdefault(y, hop)
    assert {r["slug"]: r["hops"] for r in graph.expand_subgraph(e, seeds, 3).collect()} == reached


def test_landed_edges_have_the_places_of_their_lines(spark, tmp_path):
    want = []
    for f in range(3):
        lines = [f'{{"from":"f{f}","type":"cites","to":"{k}"}}' if k % 9 else "broken" for k in range(500)]
        (tmp_path / f"{f}.json").write_text("\n".join(lines))
        want += [(f"f{f}", str(k)) for k in range(500) if k % 9]
    for size in ("128m", "4k"):  # packed in other ways
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = files.scan_edges(spark, str(tmp_path)).orderBy("seq").collect()
        assert [(r["src"], r["dst"]) for r in got] == want and [r["seq"] for r in got] == list(range(len(want)))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_of_two_writers_one_is_refused_and_readers_always_find_a_set(spark, tmp_path):
    e = spark.createDataFrame([(1, "a", "cites", "b", None), (2, "b", "cites", "c", None)], "seq long, src string, type string, dst string, confidence string")
    path = str(tmp_path / "set")
    first = files.write_edges(e, path)
    held = files.read_current_edges(spark, path)
    assert files.write_edges(e.where("seq = 2"), path, after=first) == first + 1
    assert held.count() == 2  # a reader that began before goes on with its version
    with pytest.raises(files.Conflict):
        files.write_edges(e, path, after=first)
    assert [tuple(r) for r in files.read_current_edges(spark, path).collect()] == [(0, "b", "cites", "c", None)]
    assert len(list((tmp_path / "set").glob("v-*"))) == 2


def test_heavy_chapters_and_basenames_are_parted(spark):
    rng = random.Random(3)
    pairs = [(f"c{c}", "features", f"p{p}") for c in range(4) for p in rng.sample(range(60), 40 if c < 2 else 5)] + [(f"c{c}", "tagged_with", f"t{t}") for c in range(4) for t in range(c + 1)]
    e = spark.createDataFrame(pairs + pairs[:20], "src string, type string, dst string")
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(reading.cooccurrence(e, heavy=7)) == got(reading.cooccurrence(e, heavy=1000))
    assert got(reading.theme_characters(e, heavy=7)) == got(reading.theme_characters(e, heavy=1000))
    n = spark.createDataFrame([(f"s{k:03}", "x" if k < 90 else f"b{k}") for k in range(100)] + [("s000", "x")], "slug string, basename string")
    found = notes.basename_index(n, most=8).collect()
    assert all(len(r["slugs"]) <= 8 for r in found) and len({(r["basename"], r["part"]) for r in found}) == len(found)
    assert sorted(s for r in found if r["basename"] == "x" for s in r["slugs"]) == [f"s{k:03}" for k in range(90)]
    assert [tuple(r) for r in notes.basename_index(n.where("slug = 's095'")).collect()] == [("b95", 0, ["s095"])]


def test_edge_counts_are_observed(spark):
    from pyspark.sql import Observation

    schema = "seq long, src string, type string, dst string, confidence string"
    e = spark.createDataFrame([(1, "sources/a", "cites", "sources/b", None), (2, "sources/b", "cited_by", "sources/a", None)], schema)
    batch = spark.createDataFrame([(1, "sources/a", "cites", "sources/b", None), (2, "sources/a", "cites", "sources/c", None), (3, "sources/c", "cited_by", "sources/a", None), (4, "sources/a", "cites", "sources/c", "high")], schema)
    counts = Observation()
    assert graph.add_edges(e, batch, counts).count() == 4
    assert counts.get == {"added": 1, "skipped": 3, "reverses": 1}
    gone = Observation()
    assert graph.remove_edges(e, batch.where("seq = 1"), gone).count() == 0
    assert gone.get == {"before": 2, "forward_removed": 1, "reverse_removed": 1, "after": 0}
    none = Observation()
    assert graph.add_edges(e, batch.limit(0), none).count() == 2 and none.get == {"added": 0, "skipped": 0, "reverses": 0}
