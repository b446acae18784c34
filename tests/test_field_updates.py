"""Bulk updates of metadata keep objects, follow their order and refuse what is no value; repairs done twice change nothing more."""

from corpusgraph.operators import repair

SCHEMA = repair.FIELD_SCHEMA
NOTES = [("sources/a", "sources"), ("sources/b", "sources"), ("people/p", "people")]


def frames(spark, updates):
    n = spark.createDataFrame(NOTES, "path string, entity_type string")
    f = spark.createDataFrame(
        [
            ("sources/a", "title", "string", "A", None, None, None), ("sources/a", "external_ids", "object", None, None, None, {"doi": "10.1/a", "odd": "x"}), ("sources/a", "ranking", "object", None, None, None, {"n": "1"}),
            ("sources/b", "external_ids", "object", None, None, None, {"s2": "b", "odd": "kept"}), ("sources/b", "urls", "array", None, None, ["u"], None), ("people/p", "free", "number", None, 2.0, None, None),
        ],
        SCHEMA,
    )
    return n, f, spark.createDataFrame(updates, SCHEMA + ", turn long, op string")


def result(spark, updates):
    after, refused = repair.apply_field_updates(*frames(spark, updates))
    value = lambda r: r["entries"] if r["kind"] == "object" else r["items"] or r["str"] or r["num"]
    return {(r["path"], r["key"]): (r["kind"], value(r)) for r in after.collect()}, sorted((r["path"], r["key"], r["problem"]) for r in refused.collect())


def test_untouched_objects_stay_as_they_are(spark):
    after, refused = result(spark, [("sources/a", "title", "string", "new", None, None, None, 1, None)])
    assert not refused and after[("sources/a", "title")] == ("string", "new")
    assert after[("sources/a", "external_ids")] == ("object", {"doi": "10.1/a", "odd": "x"}) and after[("sources/b", "external_ids")] == ("object", {"s2": "b", "odd": "kept"}) and len(after) == 6


def test_sets_and_merges_follow_their_turns(spark):
    obj = lambda path, key, entries, turn, op: (path, key, "object", None, None, None, entries, turn, op)
    updates = [
        obj("sources/a", "external_ids", {"doi": "10.2/b", "arxiv": "2401.1", "junk": "y", "s2": ""}, 2, "merge"), obj("sources/a", "external_ids", {"arxiv": "2401.2"}, 3, "merge"), obj("sources/a", "external_ids", {"doi": "10.9/early"}, 1, "merge"),
        obj("sources/a", "ranking", {"m": "2"}, 5, "set"), obj("sources/a", "ranking", {"n": "9"}, 4, "merge"), obj("sources/a", "ranking", {"k": "3", "m": None}, 5, "merge"), obj("sources/a", "ranking", {"z": "0"}, 3, "set"),
        obj("people/p", "links", {"x": "1"}, 1, "merge"), ("sources/b", "urls", "null", None, None, None, None, 1, "set"), ("people/p", "free", "string", "one", None, None, None, 1, "set"), ("people/p", "free", "string", "two", None, None, None, 2, "set"),
        ("people/p", "free", "string", "second", None, None, None, 2, "set"),
    ]
    after, refused = result(spark, updates)
    assert not refused
    assert after[("sources/a", "external_ids")] == ("object", {"doi": "10.2/b", "arxiv": "2401.2"})
    assert after[("sources/a", "ranking")] == ("object", {"k": "3"}) and after[("people/p", "links")] == ("object", {"x": "1"})
    assert ("sources/b", "urls") not in after and after[("people/p", "free")] == ("string", "two")
    assert len(after) == 6  # one row for each key


def test_what_is_no_value_is_refused_with_a_reason(spark):
    row = lambda path, key, kind, said=None, entries=None, op="set": (path, key, kind, said, None, None, entries, 1, op)
    updates = [row("none", "title", "string", "x"), row("sources/a", "title", "null"), row("sources/a", "title", "string", " TODO "), row("sources/a", "external_ids", "string", "x"), row("sources/a", "year", "object", entries={"a": "b"}, op="merge"), row("sources/a", "title", "string", "x", op="odd"), row("sources/a", "title", None)]
    after, refused = result(spark, updates)
    assert [p for _, _, p in sorted(refused, key=lambda r: r[2])] == ["no kind", "only objects merge", "placeholder", "required", "unknown note", "unknown operation", "wrong type"]
    assert after == result(spark, [])[0]


def test_updates_done_twice_change_nothing_more(spark):
    updates = [("sources/a", "ranking", "object", None, None, None, {"m": "2"}, 1, "merge"), ("sources/b", "title", "string", "B", None, None, None, 1, "set"), ("sources/b", "urls", "null", None, None, None, None, 1, "set")]
    n, f, u = frames(spark, updates)
    once = repair.apply_field_updates(n, f, u)[0]
    twice = repair.apply_field_updates(n, once, u)[0]
    assert sorted(map(repr, once.collect())) == sorted(map(repr, twice.collect()))
