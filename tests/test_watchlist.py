"""A run of the watch list against a plain loop over items, sources and ranks."""

import random

from corpusgraph.operators import discovery

CANDIDATES = "item string, source string, rank int, dedup_key string"


def plain(items, candidates, seen, existing):
    """The loop: statuses in order, the next seen set."""
    seen, existing, out = set(seen), set(existing), []
    for item, _, most, sources in sorted(items, key=lambda i: i[1]):
        for source in sources:
            n, left = 0, False
            for c in sorted(set(c for c in candidates if c[:2] == (item, source)), key=lambda c: c[2:]):
                key, duplicate = c[3], (item, c[3]) in seen or c[3] in existing
                left = left or (not duplicate and n >= most)
                if not left:
                    seen.add((item, key))
                    if not duplicate:
                        n += 1
                        existing.add(key)
                out.append((*c, "left" if left else "duplicate" if duplicate else "new"))
    return out, seen


def test_statuses_and_seen_are_those_of_the_plain_loop(spark):
    for seed in range(3):
        draw = random.Random(seed)
        items = [(f"i{k}", 10 - k, draw.randint(0, 3), draw.sample(["b", "a", "c"], 3)) for k in range(5)]
        candidates = [(f"i{draw.randrange(5)}", draw.choice("abc"), draw.randrange(8), f"k{draw.randrange(25)}") for _ in range(120)]
        seen, existing = {("i1", "k1"), ("i2", "k2")}, {"k3", "k4"}
        made = spark.createDataFrame
        seen_before = made(sorted(seen), "item string, dedup_key string")
        args = made(items, "item string, pos int, max_new int, sources array<string>"), made(candidates, CANDIDATES), seen_before, made([(k,) for k in sorted(existing)], "dedup_key string")
        found = discovery.watch_statuses(*args)
        rows, after = plain(items, candidates, seen, existing)
        assert sorted(map(tuple, found.collect())) == sorted(rows)
        assert sorted(map(tuple, discovery.watch_seen(seen_before, found).collect())) == sorted(after)
        total = [r for r in discovery.discovery_summary(found).collect() if r["item"] is None][0]
        assert (total["fetched"], total["fresh"], total["duplicates"]) == (len(rows), *(sum(r[-1] == s for r in rows) for s in ("new", "duplicate")))


def test_a_key_that_one_source_leaves_goes_to_the_next(spark):
    items = spark.createDataFrame([("a", 1, 1)], "item string, pos int, max_new int")
    found = spark.createDataFrame([("a", "s", 1, "k1"), ("a", "s", 2, "k2"), ("a", "t", 1, "k1"), ("a", "t", 2, "k2"), ("z", "s", 1, "k9")], CANDIDATES)
    none = found.limit(0)
    assert sorted(map(tuple, discovery.run_watchlist(items, found, none, none).collect())) == [("a", "k1"), ("a", "k2")]
    assert discovery.run_watchlist(items, none, none, none).collect() == []


def test_tangled_turns_take_few_rounds(spark, monkeypatch):
    """A thousand items that offer records of each other: as the plain loop, in far fewer rounds than items."""
    draw = random.Random(5)
    items = [(f"i{k}", k, draw.randint(0, 3), ["a"]) for k in range(1000)]
    offers = {(f"i{k}", "a", r, f"k{(k * 2 + draw.randrange(9)) % 1500}") for k in range(1000) for r in range(7)}
    made = spark.createDataFrame
    args = made(items, "item string, pos int, max_new int, sources array<string>"), made(sorted(offers), CANDIDATES), made([], "item string, dedup_key string"), made([], "dedup_key string")
    rows, _ = plain(items, sorted(offers), set(), set())
    want = sorted((c[0], c[3]) for c in rows if c[-1] == "new")
    rounds = []
    assert sorted(map(tuple, discovery.run_watchlist(*args, rounds=rounds).collect())) == want
    monkeypatch.setattr(discovery, "CHUNK_ROWS", 8000)  # many chunks: what they take is settled in rounds
    assert sorted(map(tuple, discovery.run_watchlist(*args, rounds=rounds).collect())) == want
    assert rounds[0] <= 6 and rounds[1] <= 20


def test_items_that_all_offer_the_same_records(spark, monkeypatch):
    """The longest chain there is: each item takes what all before it left."""
    monkeypatch.setattr(discovery, "CHUNK_ROWS", 300)
    items = [(f"i{k:03}", k, 2, ["a"]) for k in range(60)]
    offers = [(f"i{k:03}", "a", r, f"k{r}") for k in range(60) for r in range(100)]
    made, rounds = spark.createDataFrame, []
    args = made(items, "item string, pos int, max_new int, sources array<string>"), made(offers, CANDIDATES), made([], "item string, dedup_key string"), made([], "dedup_key string")
    got = sorted(map(tuple, discovery.run_watchlist(*args, rounds=rounds).collect()))
    assert got == sorted((f"i{r // 2:03}", f"k{r}") for r in range(100)) and rounds[0] <= 7
