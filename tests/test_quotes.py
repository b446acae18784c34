"""Verdicts against a plain join of pages, for narrow and wide ranges, and for quotes over several borders."""

import random

from corpusgraph.operators import verify


def plain(quotes, pages):
    out = {}
    for quote, source, lo, hi, text in quotes:
        held = sorted((n, t) for s, n, t in pages if s == source and t)
        join = lambda a, b: " ".join(t for n, t in held if a <= n <= b)
        some = lambda a, b: any(a <= n <= b for n, _ in held)
        if lo is None or hi is None or lo > hi:
            out[quote] = "FAIL"
        else:
            out[quote] = "OK" if some(lo, hi) and text in join(lo, hi) else "NEAR" if some(lo - 1, hi + 1) and text in join(lo - 1, hi + 1) else "FAIL"
    return out


def test_verdicts_are_those_of_the_joined_pages(spark):
    rng = random.Random(8)
    words = ["ab", "b", "abc", "ca", "bb"]
    pages = []
    for source in ("s", "t"):
        for n in sorted(rng.sample(range(-3, 9000, 7) if source == "t" else range(1, 60), 40)):
            pages.append((source, n, " ".join(rng.choices(words, k=rng.choice([0, 1, 1, 2, 3, 9])))))
    quotes = []
    for k in range(250):
        source = rng.choice("st")
        held = [p for p in pages if p[0] == source and p[2]]
        at = rng.randrange(len(held) - 6)
        text = " ".join(p[2] for p in held[at : at + rng.randint(1, 6)])
        a = rng.randrange(len(text))
        text = text[a : a + rng.randint(1, 30)].strip() or "b"
        lo = held[at][1] + rng.randint(-2, 2)
        quotes.append((k, source, lo, lo + rng.choice([0, 1, 2, 5, 20, 400, 9000]), text if rng.random() < 0.9 else "none of these words here"))
    quotes += [(900, "s", None, 3, "b"), (901, "s", 5, 3, "b"), (902, "none", 1, 2, "b"), (903, "t", -(2**63), 2**63 - 1, held[0][2]), (904, "s", 2**63 - 1, 2**63 - 1, "b")]
    made = spark.createDataFrame(quotes, "quote_id int, source_id string, lo long, hi long, quote string")
    shown = spark.createDataFrame(pages, "source_id string, page_no long, text string")
    want = plain(quotes, pages)
    assert set(want.values()) == {"OK", "NEAR", "FAIL"}
    for wide in (1, 4, 100_000):
        got = {r["quote_id"]: r["verdict"] for r in verify.verify_quotes(made.where("quote_id <> 903") if wide > 4 else made, shown, wide).collect()}
        assert {(k, v, want[k], quotes[k][1:] if k < 900 else k) for k, v in got.items() if v != want[k]} == set() and len(got) >= len(quotes) - 1


def test_texts_of_narrow_ranges_are_not_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(verify, "materialize", lambda df, own=verify.materialize: written.append(df.columns) or own(df))
    pages = spark.createDataFrame([("s", 1, "One two"), ("s", 2, " -- "), ("s", 3, "three four"), ("s", 4, "five")], "source_id string, page_no long, text string")
    quotes = spark.createDataFrame([(1, "s", 1, 3, "two, three"), (2, "s", 1, 1, "two"), (3, "s", 3, 3, "four five"), (4, "s", 1, 1, "four")], "quote_id int, source_id string, lo long, hi long, quote string")
    assert {r["quote_id"]: r["verdict"] for r in verify.verify_quotes(quotes, pages).collect()} == {1: "OK", 2: "OK", 3: "NEAR", 4: "FAIL"}
    assert written and all(not {"folded", "text"} & set(columns) for columns in written)
