"""Cases in which an operator once did less than its whole job."""

from corpusgraph.operators import checks, report
from corpusgraph.plans import note_queries, registry

EDGE = "seq long, src string, type string, dst string, confidence string"


def test_all_checks_run(spark, sf_dir):
    got = {r["check_id"]: r["n"] for r in registry.queries()["l20_run_checks"](spark, sf_dir).collect()}
    assert list(sorted(got)) == sorted(checks.CHECKS)
    own = note_queries.corpus(spark, sf_dir)
    assert got["L07"] == checks.check_symmetric_duplicates(own["edges"]).count() > 0
    assert got["L17"] == checks.check_dangling_edges(own["edges"], own["notes"]).count() > 0


def test_zeros_only_for_checks_that_ran(spark):
    e = spark.createDataFrame([(1, "sources/a", "cites", "sources/b", None)], EDGE)
    ran = ["L06", "L07"]
    assert sorted(tuple(r)[:2] for r in report.findings_summary(checks.run_checks({"edges": e}, ran), ran).collect()) == [("L06", 1), ("L07", 0)]
