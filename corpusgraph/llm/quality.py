"""Text quality by random-indexing word vectors and a small network.

Words and signs are hashed to buckets. Each bucket has a sparse random index vector; its context vector is the sum of
the index vectors of its neighbours in the sample. A document is the mean of its words' context vectors, beside the mean
vector of the shapes it shows (capitals, digits, repeats, runs of signs) and two sizes. A network with one hidden layer
scores it; a temperature fitted on rows that the training did not see calibrates the probability.

Null texts count as empty; an empty text has zero vectors and is scored like any other. Labels are used only for
fitting. Without labelled rows, or with one class only, every score is 0.5. Repeated rows are scored one by one, and equal
texts have equal scores. A null id is scored too; the query's held_out is null for it, as its remainder is, and such a
row is never learnt from. Texts are read whole, SLICE words at a time. An empty table gives an empty result. Columns
beside the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, text_of
from .sampling import id_remainder, labelled_sample

FIT_ROWS = 8_000  # labelled documents to fit on, at most
BUCKETS = 8192
SHAPES = 16
WIDTH = 48
NON_ZERO = 6
WINDOW = 2
HIDDEN = 32
KEPT_WORDS = 300_000
SLICE = 64_000  # words at a time
WORD = re.compile(r"\w+|[^\w\s]+")


def index_vectors() -> np.ndarray:
    """A fixed sparse vector of NON_ZERO signs for each bucket and shape."""
    rng = np.random.default_rng(7)
    out = np.zeros((BUCKETS + SHAPES, WIDTH), np.float32)
    for row in out:
        row[rng.permutation(WIDTH)[:NON_ZERO]] = rng.choice([-1.0, 1.0], NON_ZERO)
    return out


def shape(word: str) -> int:
    """0: plain word; others: capitals, digits, signs by kind and length."""
    if word[0].isalnum() or word[0] == "_":
        return 1 if len(word) > 1 and word.isupper() else 2 if word.isdigit() else 3 if word[0].isupper() else 0
    return 4 + 2 * (sum(map(ord, set(word))) % 5) + (len(word) > 1)


class Words:
    """Buckets and shapes of words; recent words are kept."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known, found = self.known, WORD.findall(text)
        for w in set(found):
            if w not in known:
                known[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % BUCKETS * SHAPES + shape(w)
        both = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
        shapes = both % SHAPES
        buckets = both // SHAPES
        if len(found) > 1:
            shapes[1:][buckets[1:] == buckets[:-1]] = SHAPES - 1  # a repeat
        return buckets, shapes


def context_sums(buckets: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Sums of the neighbours' index vectors, for the words of one text."""
    around = np.zeros((len(buckets), WIDTH), np.float32)
    own = index[buckets]
    for k in range(1, min(WINDOW, len(buckets) - 1) + 1):
        around[k:] += own[:-k]
        around[:-k] += own[k:]
    return around


def context_vectors(sample: DataFrame) -> np.ndarray:
    """Unit context vectors of all buckets. Each task adds up its rows; as many sums as tasks, 8 at most, are gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, index = Words(), index_vectors()
        total = np.zeros((BUCKETS, WIDTH), np.float32)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                buckets = words.of(text)[0]
                for at in range(0, len(buckets), SLICE):
                    part = buckets[at : at + SLICE]
                    order = np.argsort(part, kind="stable")
                    firsts = np.flatnonzero(np.diff(part[order], prepend=-1))
                    total[part[order][firsts]] += np.add.reduceat(context_sums(part, index)[order], firsts, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    total = np.zeros((BUCKETS, WIDTH), np.float32)
    for r in sample.select("text").coalesce(8).mapInArrow(run, "total binary").toLocalIterator():
        total += np.frombuffer(r["total"], np.float32).reshape(BUCKETS, WIDTH)
    total = np.sign(total) * np.sqrt(np.abs(total))
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-6)


def pooled(words: Words, vectors: np.ndarray, text: str) -> np.ndarray:
    """Features of a text: mean context vector, shares of shapes, size, and share of distinct words."""
    buckets, shapes = words.of(text)
    n = len(buckets)
    mean = np.zeros(WIDTH, np.float64)
    for at in range(0, n, SLICE):
        mean += vectors[buckets[at : at + SLICE]].sum(axis=0, dtype=np.float64)
    share = np.bincount(shapes, minlength=SHAPES)[:SHAPES] / max(n, 1)
    return np.concatenate([mean / max(n, 1), share, np.sqrt(share), [np.log1p(n) / 8, len(np.unique(buckets)) / max(n, 1)]])


def pool(docs: DataFrame, vectors: np.ndarray, keep: list[str], text_col: str, finish, schema: T.StructType) -> DataFrame:
    """finish(features of a batch) for each document, beside the columns to keep."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS rows
    slim = docs.select(*keep, text_of(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = Words(), shared.value
        for batch in batches:
            if batch.num_rows:
                found = np.stack([pooled(words, table, x) for x in batch.column("_text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *finish(found)], names=schema.names)

    return slim.mapInArrow(run, schema)


@dataclass
class Network:
    """One hidden layer over standardised features; logits are divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    second: np.ndarray
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        hidden = np.tanh(z @ self.first[:-1] + self.first[-1])
        return hidden @ self.second[:-1] + self.second[-1]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.01, decay: float = 1e-3) -> Network:
    """Fit by Adam on all rows at once; a fixed share of the rows is kept for the temperature."""
    rng = np.random.default_rng(11)
    held = rng.permutation(len(x)) < len(x) // 6
    net = Network(x.mean(axis=0), x.std(axis=0) + 1e-6, rng.normal(0, 0.3 / np.sqrt(x.shape[1]), (x.shape[1] + 1, HIDDEN)), np.zeros(HIDDEN + 1))
    net.second[:-1] = rng.normal(0, 0.3, HIDDEN)
    z = np.clip((x[~held] - net.mean) / net.scale, -6, 6)
    target, n = y[~held], max((~held).sum(), 1)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in (net.first, net.second)]
    for t in range(1, rounds + 1):
        hidden = np.tanh(z @ net.first[:-1] + net.first[-1])
        error = (1 / (1 + np.exp(-np.clip(hidden @ net.second[:-1] + net.second[-1], -30, 30))) - target) / n
        back = np.outer(error, net.second[:-1]) * (1 - hidden**2)
        steps = (np.vstack([z.T @ back, back.sum(axis=0)]), np.append(hidden.T @ error, error.sum()))
        for w, g, (m, v) in zip((net.first, net.second), steps, moments):
            g = g + decay * w / 10
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    if held.any():
        logits, truth = net.logits(x[held]), y[held]
        loss = lambda s: np.mean(np.logaddexp(0, np.where(truth > 0, -logits, logits) / s))
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


@dataclass
class Model:
    vectors: np.ndarray
    network: Network | None


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", use=None, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    sample = labelled_sample(docs, labels, label_col, F.lit(True) if use is None else use, fit_rows, id_col, text_col)
    vectors = context_vectors(sample)
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("x", T.BinaryType())])
    features = pool(sample, vectors, ["key", "label"], "text", lambda found: [pa.array([r.astype(np.float32).tobytes() for r in found], pa.binary())], schema)
    rows = sorted((r["key"], r["label"], r["x"]) for r in features.toLocalIterator())  # a vector for each of fit_rows
    y = np.array([r[1] for r in rows], np.float64)
    if len(set(y)) < 2:
        return Model(vectors, None)
    x = np.stack([np.frombuffer(r[2], np.float32) for r in rows]).astype(np.float64)
    return Model(vectors, train(x, y))


def scored(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns to keep, score (0 to 1, higher: likelier good), predicted (1 from 0.5 on)."""
    schema = T.StructType([docs.select(*keep).schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def finish(found: np.ndarray) -> list[pa.Array]:
        p = model_network.probability(found) if model_network else np.full(len(found), 0.5)
        return [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]

    model_network = model.network
    return pool(docs, model.vectors, keep, text_col, finish, schema)


def drop_poor(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that the model doesn't reject, with all their columns."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_of(text_col).alias("text"))
    return scored(packed, model, ["row"]).where("predicted = 1").select("row.*")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit(docs, labels, use=id_remainder("doc_id", 3) != 1)
    return scored(docs, model, ["doc_id"]).select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
