"""Divergence of sources, language identification and ranked search against plain loops."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusgraph.llm import divergence, language_id, ranked_search
from corpusgraph.llm.terms import cutter

SCHEMA = "doc_id long, text string, lang string, source string, digest string, rank string, term string, query string"
LONG = "Word déjà 漢字 " * 20_000


def frame(spark, rows):
    """Rows of doc_id, text, lang, source, beside columns with names that the operators use themselves."""
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def invented(n, seed=0, words=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 4))) for _ in range(words)]
    rows = []
    for k in range(n):
        text = " ".join(vocabulary[min(int(rng.expovariate(0.08)), words - 1)] for _ in range(rng.randint(0, 40)))
        rows.append((k, text.upper() if k % 7 == 0 and text.isascii() else text, rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s2", "s3", "s4", "s5", None])))
    rows += [(k, rows[3][1], "en", rng.choice(["s1", "s2"])) for k in range(n, n + 40)]  # copies
    return rows + [(None, None, "de", "only"), (7, "", "de", "other"), (8, LONG, "en", "s9"), (8, LONG, "en", "s9"), (9, "1 2 3 !", "xx", None)]


def test_terms_are_those_of_the_pattern():
    rng = random.Random(1)
    for digits, pattern in ((False, "[^\x00-\x40\x5b-\x60\x7b-\x7f]+"), (True, "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")):
        for _ in range(300):
            text = "".join(rng.choice("aZÀéß漢\U0001f600\x85\xa0 \x00\x1c 09_-.~\x7f") for _ in range(rng.randint(0, 30)))
            lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            assert [t.decode() for t in cutter(digits)(text.encode())] == re.findall(pattern, lowered)


def plain_audit(rows, least, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = sorted(s for g, s in groups if g == lang)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in own}
        q = shares(sum((counts[lang, s] for s in own), Counter()))
        for s in own:
            pairs = sorted((-sum(abs(p[s][t] - p[u][t]) for t in kept), u.encode()) for u in own if u != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -value, k) for part, found in (("pair", pairs), ("term", terms)) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_audit_equals_a_plain_loop_in_tiles_of_any_size(spark, monkeypatch):
    rows = invented(300)
    docs = frame(spark, rows)
    assert got(divergence.audit(docs, least_docs=10, top=7)) == plain_audit(rows, 10, 7)
    monkeypatch.setattr(divergence, "BLOCK", 2)
    monkeypatch.setattr(divergence, "CHUNK", 5)
    monkeypatch.setattr(divergence, "HELD", 10)
    assert got(divergence.audit(docs, least_docs=10, top=7)) == plain_audit(rows, 10, 7)
    assert got(divergence.audit(docs, least_docs=10**6)) == plain_audit(rows, 10**6, 50)  # no terms: distances 0
    assert got(divergence.audit(frame(spark, []))) == []


def test_shares_are_exact_for_large_counts(spark):
    n, total, v = 3 * 10**12 + 7, 10**13 + 1, 10**9 + 9
    assert spark.createDataFrame([(n, total, v)], "n long, total long, v long").select(divergence.share("n", "total", "v")).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * v)


def plain_search(rows, items, top):
    words = [re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) for r in rows]
    docs = [(r[0], Counter(w), len(w)) for r, w in zip(rows, words) if w]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        asked = re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        scored = []
        for doc, c, n in docs:
            m = 100 - 25 + 25 * n * n_docs // total
            scored.append((-sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if c[t]), doc is None, doc))
        out += [(item, k, doc, -s) for k, (s, _, doc) in enumerate(sorted((x for x in scored if x[0] < 0), key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("leaf, docs_in_segment", [(1, 16_384), (4, 50), (32, 16_384)])
def test_search_equals_a_plain_loop(spark, monkeypatch, leaf, docs_in_segment):
    monkeypatch.setattr(ranked_search, "LEAF", leaf)
    monkeypatch.setattr(ranked_search, "SEGMENT_DOCS", docs_in_segment)
    rows = [r for r in invented(400, seed=5) if r[0] != 8] + [(500, "rare term", "en", "s"), (None, "rare term", "en", "s"), (400, "rare term", "en", "s"), (8, LONG, "en", "s9")]
    rng = random.Random(2)
    items = [(k, " ".join(rng.choices(rows[rng.randrange(300)][1].split() or ["none"], k=rng.randint(1, 30)))) for k in range(25)]
    items += [(3, items[3][1]), (None, "RARE term"), (98, "absent words only"), (99, ""), (100, None), (101, "漢字 déjà word"), (102, " ".join(r[1] or "" for r in rows[:200]))]
    queries = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, doc_id string")
    for size in (ranked_search.BLOCK_BYTES, 1500) if leaf == 4 else (ranked_search.BLOCK_BYTES,):
        found = ranked_search.ranked_search(frame(spark, rows).repartition(3), queries, top=9, block_bytes=size)
        assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_search(rows, items, 9)
    assert ranked_search.ranked_search(frame(spark, []), queries).count() == 0
    assert ranked_search.ranked_search(frame(spark, rows), queries.limit(0)).count() == 0


def test_range_maxima_and_pruning():
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 6, 200)
    terms = np.concatenate([np.sort(rng.choice(9, k, replace=False)) for k in sizes])
    counts, bounds = rng.integers(1, 9, len(terms)), np.concatenate([[0], np.cumsum(sizes)])
    segment = ranked_search.Segment(np.arange(200), np.zeros(200, int), np.full(200, 100), bounds, terms, counts, 9)
    for _ in range(500):
        term = rng.integers(0, 9)
        low, high = np.sort(rng.choice(np.arange(segment.starts[term], segment.starts[term + 1] + 1), 2, replace=False))
        at = int(segment.greatest(np.array([[low]]), np.array([[high]]))[0, 0])
        assert low <= at < high and segment.impact[at] == segment.impact[low:high].max()
    # one document far above the others: the search scores few of the rest
    sizes = np.ones(4096, int)
    counts = np.ones(4096, int)
    counts[1234] = 50
    segment = ranked_search.Segment(np.arange(4096), np.zeros(4096, int), np.full(4096, 100), np.arange(4097), np.zeros(4096, int), counts, 1)
    best, scored = ranked_search.Best(1), []
    plain = segment._score_all
    segment._score_all = lambda *a: (scored.append(len(a[2])), plain(*a))
    segment.search(np.array([0]), np.array([3]), best)
    assert best.rows[0, 2] == 1234 and sum(scored) == 0


def test_network_gradients_and_tables_agree_with_plain_loops():
    rng = np.random.default_rng(0)
    net = language_id.Network.new(["a", "b", "c"], rng)
    net.embedding = net.embedding.astype(np.float64)
    windows, labels = rng.integers(0, language_id.CLASSES, (5, 24)), np.array([0, 1, 2, 1, 0])

    def plain(row):
        hidden = []
        for w, f in net.filters.items():
            values = [np.concatenate([net.embedding[c] for c in row[k : k + w]]) @ f + net.constants[w] for k in range(len(row) - w + 1)]
            hidden.append(np.maximum(np.max(values, axis=0), 0))
        x = np.exp(np.concatenate(hidden) @ net.last + net.last_constant)
        return x / x.sum()

    shown = np.stack([plain(r) for r in windows])
    assert np.allclose(language_id.Applied(net).probabilities(windows.astype(np.uint8)), shown, atol=1e-5)
    loss, grads = language_id.gradients(net, windows, labels)
    assert abs(loss + np.log(shown[np.arange(5), labels]).mean()) < 1e-5
    for p, g in zip(net.parameters(), grads):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in p.shape)
            if p is net.embedding:
                at = (int(rng.choice(windows.ravel())), at[1])
            old, moved = p[at], []
            for step in (1e-3, -1e-3):
                p[at] = old + step
                moved.append(-np.log(np.stack([plain(r) for r in windows])[np.arange(5), labels]).mean())
            p[at] = old
            assert abs((moved[0] - moved[1]) / 2e-3 - g[at]) < 2e-3


def test_windows_hold_whole_rows():
    rows = [b"", b"Ab1\xc3\xa9", bytes(range(256)) * 5, b"z" * language_id.LENGTH, b""]
    windows, bounds = language_id.windows_of(np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    for row, a, b in zip(rows, bounds, bounds[1:]):
        flat = windows[a:b].ravel()
        assert list(flat[: len(row)]) == [language_id.CLASS[x] for x in row] and not flat[len(row) :].any() and len(flat) < len(row) + language_id.LENGTH


def test_languages_of_odd_rows_and_held_out_accuracy(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    result = language_id.op12_language_id(spark, sf_dir)
    assert result.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = result.join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == table.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in rows)
    net = language_id.fit(table)
    odd = frame(spark, [(1, None, "en", "s"), (2, "", "en", "s"), (3, "123 .,!", "en", "s"), (4, LONG, None, "s"), (None, "the and of", None, None), (5, "😀😀", "en", "s"), (5, "é", "en", "s"), (5, "é", "en", "s")])
    found = [tuple(r) for r in language_id.predict(odd, net).collect()]
    assert [(r[0], r[1] == "und") for r in found] == [(1, True), (2, True), (3, True), (4, False), (None, False), (5, True), (5, False), (5, False)]
    assert all((s == 0) == (lang == "und") and 0 <= s <= 1 for _, lang, s in found) and found[-1] == found[-2]
    assert language_id.predict(frame(spark, []), net).count() == 0
    nothing = language_id.fit(frame(spark, []))
    assert nothing is None and {tuple(r)[1:] for r in language_id.predict(odd, nothing).collect()} == {("und", 0.0)}
