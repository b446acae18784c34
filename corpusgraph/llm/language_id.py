"""Language of texts by a convolutional network over bytes.

A text's UTF-8 bytes are mapped to classes: the letters A-Z (lower-cased), each byte above 0x7F, and one class for all else.
The whole text is cut into windows of LENGTH classes, the last one filled up. A window passes an embedding, filters of
several widths, the maximum of each filter over the window, and a softmax over the languages learnt. A text's probabilities
are the mean of its windows', weighted by their letters; the likeliest language wins, among equals the first by name.

The network is trained in numpy on the driver, on at most FIT_DOCS labelled documents, as many of each language, with at most
PER_DOC windows of each; a quarter of the windows is cut short, so that short texts are known too. When it is applied,
each filter is a sum of looked-up rows of pairs of classes, which gives the same numbers.

Null texts, and texts without a letter (Unicode), are `und` with score 0; so are all texts if nothing could be learnt.
Texts are read whole, in windows, however long. Repeated rows are judged one by one. Null ids are judged too; they have no
remainder, so held_out is null and they are not learnt from. An empty table gives an empty result. Columns beside the id,
the text and, for learning, the language are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, read_table, slices, text_of
from .sampling import id_remainder

FIT_DOCS = 6_000  # labelled documents to learn from, at most
PER_DOC = 4  # windows of each of them, at most
LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
EMBEDDING = 8
STEPS, BATCH, RATE = 600, 128, 4e-3
PASS = 64  # windows at a time
NO_LANGUAGE = "und"
LETTER = r"\p{L}"

CLASSES = 27 + 128
CLASS = np.zeros(256, np.uint8)
CLASS[0x61:0x7B] = CLASS[0x41:0x5B] = np.arange(1, 27)
CLASS[0x80:] = np.arange(27, CLASSES)


@dataclass
class Network:
    """languages; embedding (CLASSES x EMBEDDING), filters by width (width * EMBEDDING x FILTERS), their constants, and the last layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    constants: dict[int, np.ndarray]
    last: np.ndarray
    last_constant: np.ndarray

    @classmethod
    def new(cls, languages: list[str], rng: np.random.Generator) -> Network:
        draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
        filters = {w: draw(w * EMBEDDING, FILTERS) for w in WIDTHS}
        embedding = rng.normal(0, 0.5, (CLASSES, EMBEDDING)).astype(np.float32)
        return cls(languages, embedding, filters, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, draw(len(WIDTHS) * FILTERS, len(languages)), np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters.values(), *self.constants.values(), self.last, self.last_constant]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(net: Network, windows: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over the windows, and its gradients in the order of parameters()."""
    n, length = windows.shape
    x = net.embedding[windows]
    rows, which = np.arange(n)[:, None], np.arange(FILTERS)
    pooled, kept = [], {}
    for w, f in net.filters.items():
        columns = np.concatenate([x[:, k : length - w + 1 + k] for k in range(w)], axis=2)
        out = (columns.reshape(-1, w * EMBEDDING) @ f).reshape(n, -1, FILTERS)
        at = out.argmax(axis=1)
        top = out[rows, at, which] + net.constants[w]
        pooled.append(np.maximum(top, 0))
        kept[w] = at, top > 0, columns[rows, at]
    hidden = np.concatenate(pooled, axis=1)
    p = softmax(hidden @ net.last + net.last_constant)
    loss = -np.log(p[np.arange(n), labels] + 1e-12).mean()
    d = p
    d[np.arange(n), labels] -= 1
    d /= n
    back = d @ net.last.T
    d_embedding = np.zeros_like(net.embedding)
    d_filters, d_constants = [], []
    for k, (w, f) in enumerate(net.filters.items()):
        at, alive, columns = kept[w]
        g = back[:, k * FILTERS : (k + 1) * FILTERS] * alive
        d_filters.append(np.einsum("nf,nfc->cf", g, columns))
        d_constants.append(g.sum(axis=0))
        for j in range(w):
            np.add.at(d_embedding, windows[rows, at + j], g[:, :, None] * f[j * EMBEDDING : (j + 1) * EMBEDDING].T)
    return float(loss), [d_embedding, *d_filters, *d_constants, hidden.T @ d, d.sum(axis=0)]


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS) -> Network:
    """Adam over batches drawn with each language alike; a quarter of a batch's windows is cut to a length of 6 or more."""
    rng = np.random.default_rng(11)
    net = Network.new(languages, rng)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    chance = 1 / np.bincount(labels)[labels]
    ends = np.cumsum(chance / chance.sum())
    for step in range(1, steps + 1):
        some = np.minimum(np.searchsorted(ends, rng.random(BATCH)), len(ends) - 1)
        batch = windows[some].copy()
        short = rng.random(BATCH) < 0.25
        sizes = np.where(short, np.exp(rng.uniform(np.log(6), np.log(LENGTH), BATCH)).astype(int), LENGTH)
        batch[np.arange(LENGTH) >= sizes[:, None]] = 0
        _, grads = gradients(net, batch, labels[some])
        rate = RATE * (1 - (step - 1) / steps)
        for p, g, m, v in zip(net.parameters(), grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


class Applied:
    """A network as tables: a width's filter at a place is a sum of rows for pairs of classes and, if odd, for the last one."""

    def __init__(self, net: Network):
        self.net, self.tables = net, {}
        for w, f in net.filters.items():
            single = [net.embedding @ f[k * EMBEDDING : (k + 1) * EMBEDDING] for k in range(w)]
            pairs = [(single[k][:, None] + single[k + 1][None]).reshape(-1, FILTERS) for k in range(0, w - 1, 2)]
            self.tables[w] = pairs, single[-1] if w % 2 else None

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Softmax of each window."""
        out = np.empty((len(windows), len(self.net.languages)), np.float32)
        for at in range(0, len(windows), PASS):
            part = windows[at : at + PASS].astype(np.int32)
            pair = part[:, :-1] * CLASSES + part[:, 1:]
            pooled = []
            for w, (pairs, single) in self.tables.items():
                size = part.shape[1] - w + 1
                total = pairs[0][pair[:, :size]]
                for k, table in enumerate(pairs[1:], 1):
                    total += table[pair[:, 2 * k : 2 * k + size]]
                if single is not None:
                    total += single[part[:, w - 1 : w - 1 + size]]
                pooled.append(np.maximum(total.max(axis=1) + self.net.constants[w], 0))
            out[at : at + PASS] = softmax(np.concatenate(pooled, axis=1) @ self.net.last + self.net.last_constant)
        return out


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the rows' bytes, and the bounds of each row among them."""
    lengths = np.diff(offsets)
    bounds = np.concatenate([[0], np.cumsum(-(-lengths // LENGTH))])
    flat = np.zeros(bounds[-1] * LENGTH, np.uint8)
    if len(data):
        flat[np.arange(len(data)) + np.repeat(bounds[:-1] * LENGTH - offsets[:-1], lengths)] = CLASS[data]
    return flat.reshape(-1, LENGTH), bounds


def language_shares(applied: Applied, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each row's mean probabilities; zeros for a row without letters or bytes above 0x7F."""
    windows, bounds = windows_of(data, offsets)
    weight = (windows > 0).sum(axis=1).astype(np.float64)
    some = np.flatnonzero(weight)
    weighed = np.zeros((len(windows) + 1, len(applied.net.languages)))
    weighed[some] = applied.probabilities(windows[some]) * weight[some, None]
    total = np.add.reduceat(weighed, bounds[:-1]) if len(bounds) > 1 else weighed[:0]
    total[np.diff(bounds) == 0] = 0
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-9)


def labelled_windows(docs: DataFrame, use, id_col: str, text_col: str, lang_col: str, fit_docs: int) -> pd.DataFrame:
    """lang, window of at most fit_docs documents, as many of each language, chosen by a hash of the id."""
    known = docs.where(use & F.col(lang_col).isNotNull() & F.col(text_col).rlike(LETTER))
    keys = known.select(F.col(id_col).cast("string").alias("key"), F.col(lang_col).cast("string").alias("lang"))
    languages = keys.agg(F.count_distinct("lang").alias("n")).first()["n"]
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key"))  # cut in each task first
    quota = max(1, fit_docs // max(1, languages))
    chosen = keys.distinct().withColumn("turn", turn).where(F.col("turn") <= quota).orderBy("turn", "lang").limit(fit_docs).drop("turn")
    texts = known.select(F.col(id_col).cast("string").alias("key"), F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, where, found = batch.column("lang").to_pylist(), [], []
            for first, _, data, offsets in slices(batch, "_text"):
                windows, bounds = windows_of(data, offsets)
                for row in range(len(bounds) - 1):
                    own = windows[bounds[row] : bounds[row + 1]]
                    own = own[(own > 0).sum(axis=1) >= 8] if len(own) > 1 else own
                    for k in np.unique(np.linspace(0, len(own) - 1, PER_DOC).astype(int)) if len(own) else ():
                        where.append(langs[first + row])
                        found.append(own[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.string()), pa.array(found, pa.binary())], names=["lang", "window"])

    met = texts.join(F.broadcast(chosen), ["key", "lang"]).select("lang", "_text")  # at most fit_docs keys
    return materialize(met.mapInArrow(run, "lang string, window binary")).limit(fit_docs * PER_DOC).toPandas()


def fit(docs: DataFrame, use=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS) -> Network | None:
    """A network trained on the documents that satisfy use and have a language; None if there are none."""
    rows = labelled_windows(docs, F.lit(True) if use is None else use, id_col, text_col, lang_col, fit_docs)
    if rows.empty:
        return None
    rows = rows.sort_values(["lang", "window"])  # the same order each time
    languages = sorted(rows["lang"].unique())
    windows = np.frombuffer(b"".join(rows["window"]), np.uint8).reshape(-1, LENGTH)
    return train(windows, np.searchsorted(languages, rows["lang"].to_numpy()), languages)


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score."""
    text = F.col(f"`{text_col}`").cast("string")
    slim = docs.select(F.col(f"`{id_col}`"), F.coalesce(text.rlike(LETTER), F.lit(False)).alias("_letters"), text_of(f"`{text_col}`").alias("_text"))
    if net is None:
        return slim.select(slim[0], F.lit(NO_LANGUAGE).alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = T.StructType([slim.schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        applied, names = Applied(net), np.array([*net.languages, NO_LANGUAGE], object)
        for batch in batches:
            best, score = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
            for first, end, data, offsets in slices(batch, "_text"):
                shares = language_shares(applied, data, offsets)
                best[first:end], score[first:end] = shares.argmax(axis=1), shares.max(axis=1)
            none = ~batch.column("_letters").to_numpy(zero_copy_only=False)
            best[none], score[none] = len(names) - 1, 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(np.minimum(score, 1.0))], names=schema.names)

    return slim.mapInArrow(run, schema)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    remainder = id_remainder("doc_id", 4)
    return predict(docs, fit(docs, use=remainder != 2)).select("doc_id", (remainder == 2).alias("held_out"), "lang_pred", "score")
