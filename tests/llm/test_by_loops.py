"""Quality and toxicity against plain loops: neighbour sums, pooling, training steps, the search for terms."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusgraph.llm import quality, token_counts, toxicity

TEXTS = ["One two two THREE 44 !! the end", "", "a", "word  word word?!", "ÀÉ été 漢字 _x_ don't (so) it. goes"]


def test_neighbour_sums_are_those_of_a_plain_loop():
    index, words = quality.index_vectors(), quality.Words()
    for text in TEXTS:
        buckets = words.of(text)[0]
        got = quality.context_sums(buckets, index)
        for i in range(len(buckets)):
            want = sum((index[buckets[j]] for j in range(max(0, i - quality.WINDOW), min(len(buckets), i + quality.WINDOW + 1)) if j != i), np.zeros(quality.WIDTH))
            assert np.array_equal(got[i], want), (text, i)


def test_context_vectors_add_up_over_tasks(spark):
    index, total = quality.index_vectors(), np.zeros((quality.BUCKETS, quality.WIDTH))
    for text in TEXTS * 3:
        found = [zlib.crc32(w.lower().encode()) % quality.BUCKETS for w in re.findall(r"\w+|[^\w\s]+", text)]
        for i, b in enumerate(found):
            for j in range(max(0, i - quality.WINDOW), min(len(found), i + quality.WINDOW + 1)):
                if i != j:
                    total[b] += index[found[j]]
    want = np.sign(total) * np.sqrt(np.abs(total))
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-6)
    sample = spark.createDataFrame([(t,) for t in TEXTS * 3], "text string").repartition(5)
    assert np.allclose(quality.context_vectors(sample), want, atol=1e-5)


@pytest.mark.parametrize("slice_size", [1, 3, 64_000])
def test_pooled_inputs_are_those_of_a_plain_loop(monkeypatch, slice_size):
    monkeypatch.setattr(quality, "SLICE", slice_size)
    vectors, words = np.random.default_rng(3).normal(size=(quality.BUCKETS, quality.WIDTH)), quality.Words()
    for text in TEXTS:
        found = re.findall(r"\w+|[^\w\s]+", text)
        buckets = [zlib.crc32(w.lower().encode()) % quality.BUCKETS for w in found]
        shapes = [quality.SHAPES - 1 if k and buckets[k] == buckets[k - 1] else quality.shape(w) for k, w in enumerate(found)]
        n = max(len(found), 1)
        mean = sum((vectors[b] for b in buckets), np.zeros(quality.WIDTH)) / n
        share = np.array([shapes.count(s) / n for s in range(quality.SHAPES)])
        want = np.concatenate([mean, share, np.sqrt(share), [np.log1p(len(found)) / 8, len(set(buckets)) / n]])
        assert np.allclose(quality.pooled(words, vectors, text), want), text


def test_training_follows_the_slope_of_the_loss(monkeypatch):
    monkeypatch.setattr(quality, "HIDDEN", 4)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=60) > 0).astype(float)
    held = np.random.default_rng(11).permutation(60) < 10  # as train keeps them
    start = quality.train(x, y, rounds=0)
    weights = [start.first.copy(), start.second.copy()]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]

    def loss(ws):
        total = 0.0
        for row, label in zip(x[~held], y[~held]):
            z = np.clip((row - start.mean) / start.scale, -6, 6)
            logit = np.tanh(z @ ws[0][:-1] + ws[0][-1]) @ ws[1][:-1] + ws[1][-1]
            total += np.log1p(np.exp(-logit if label else logit))
        return total / (~held).sum()

    for t in range(1, 4):
        slopes = []
        for w in weights:
            slope = np.zeros_like(w)
            for at in np.ndindex(w.shape):
                kept = w[at]
                w[at] = kept + 1e-5
                up = loss(weights)
                w[at] = kept - 1e-5
                slope[at] = (up - loss(weights)) / 2e-5
                w[at] = kept
            slopes.append(slope + 1e-3 * w / 10)
        for w, g, (m, v) in zip(weights, slopes, moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        now = quality.train(x, y, rounds=t)
        assert np.allclose(now.first, weights[0], atol=1e-4) and np.allclose(now.second, weights[1], atol=1e-4), t


def test_temperature_is_the_best_of_those_tried():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + rng.normal(size=600) > 0).astype(float)
    net, held = quality.train(x, y), np.random.default_rng(11).permutation(600) < 100
    logits = net.logits(x[held])
    losses = {s: -np.mean([np.log(1 / (1 + np.exp(-l / s))) if label else np.log(1 - 1 / (1 + np.exp(-l / s))) for l, label in zip(logits, y[held])]) for s in np.geomspace(0.25, 8, 61)}
    assert losses[net.temperature] == pytest.approx(min(losses.values()))


def plain_findings(weights, exceptions, folded):
    starts = {k + 1 for k, c in enumerate(folded) if c == " "}
    best = {}
    for s in starts:
        fits = [w for term, w in weights.items() if folded.startswith(term, s)]
        if fits and max(fits) > 0:
            best[s] = max(fits)
    for phrase in exceptions:
        for s in starts:
            if folded.startswith(phrase, s):
                best = {at: w for at, w in best.items() if not s <= at < s + len(phrase)}
    return sum(best.values()), len(folded.split())


def test_search_finds_what_a_loop_over_all_terms_finds():
    rng = random.Random(9)
    some = lambda longest: "".join(rng.choice("abc") for _ in range(rng.randint(1, longest)))
    seen = excused = 0
    for _ in range(300):
        weights = {some(4): rng.choice([0.5, 1.25, 2.0, 4.0]) for _ in range(rng.randint(0, 12))}
        exceptions = tuple({" ".join(some(3) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 4))})
        finder = toxicity.Lexicon(weights | {"zzzz": 1.0}, (0.0, 1.0, 1.0), exceptions).finder()
        for _ in range(5):
            folded = toxicity.fold(" ".join(some(6) for _ in range(rng.randint(0, 14))))
            want = plain_findings(weights, exceptions, folded)
            assert toxicity.findings(finder, folded) == pytest.approx(want), (weights, exceptions, folded)
            seen += want[0] > 0
            excused += want[0] < plain_findings(weights, (), folded)[0]
    assert seen > 300 and excused > 100


def test_tokens_of_all_documents_are_those_of_the_library(spark, sf_dir):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs)
    got = token_counts.op3_token_counts(spark, sf_dir)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_bytes", "n_tokens").collect()) == want
    assert got.where("over_limit <> (n_tokens > 1024)").count() == 0
