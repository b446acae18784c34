"""Toxicity by a weighted lexicon.

Texts are folded: compatible forms and accents to plain letters, invisible signs and combining marks away, lower case,
look-alike signs, digits and forms of several signs to the letters they stand for, other signs to blanks. Terms begin where a word begins and need not end with it; one Aho-Corasick automaton finds them all. A word counts with the
largest weight among its terms, unless it lies in an exception phrase. The sum of weights, plain and normalised by the
text's length, gives the score by logistic regression. Weights of terms are log odds learnt from labelled documents;
a short list of insults has a weight from the start.

Null texts count as empty; a text without terms, empty ones too, has the score of no finding. Labels are used only for
fitting. If there are no labelled documents, or only one class, the listed insults alone decide. Repeated rows are
scored one by one, null ids too (the query's held_out is null for them, as their remainder is). Texts are read whole, in time linear in their length. An empty table gives an empty
result. Columns beside the id and the text are not read, whatever their names.

Terms are beginnings of words of SHORTEST to LONGEST letters; the TERMS that differ most from chance are kept. The
coefficients of the score are fitted on sums that each half of the sample has under the terms of the other half.
"""

from __future__ import annotations

import bisect
import itertools
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, text_of
from .sampling import id_remainder, labelled_sample

# Insults with a weight from the start, phrases in which they are none, and look-alike signs.
INSULTS = ("idiot", "moron", "stupid", "scum", "trash", "pathetic", "worthless", "disgusting", "loser", "clown", "imbecile", "retard")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "sore loser board")
LOOK_ALIKES = {
    "a": "4@аαａ", "b": "8ЬｂƄ", "c": "сϲｃ", "d": "ԁｄ", "e": "3еεｅ", "g": "ɡｇ", "h": "һｈ", "i": "1іιｉı", "j": "јｊ",
    "k": "кκｋ", "l": "ⅼｌ", "m": "мｍ", "n": "ոｎ", "o": "0оοｏ", "p": "рρｐ", "r": "гｒ", "s": "5$ѕｓ", "t": "7тτｔ",
    "u": "υսｕ", "v": "ѵνｖ", "w": "ѡωｗ", "x": "хχｘ", "y": "уγｙ", "z": "2ｚ",
}

START_WEIGHT = 4.0
FIT_ROWS = 20_000  # labelled documents to fit on, at most
TERMS = 2_000  # learnt terms, at most
LEAST_DOCS = 8  # toxic documents with a term, at least
LEAST_Z = 5.0  # how far from chance its log odds are, at least
SHORTEST, LONGEST = 4, 12

# Letters written with several signs.
FORMS = {"|-|": "h", "|_|": "u", "|<": "k", "|3": "b", "|)": "d", "/\\": "a", "\\/": "v", "()": "o"}

FOLD = {c: None for c in range(0x10000) if unicodedata.category(chr(c)) in ("Mn", "Cf")}
FOLD |= {ord(c): letter for letter, likes in LOOK_ALIKES.items() for c in likes}
FOLD |= {ord(c): " " for c in "\t\n\r\x0b\x0c!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~«»“”’…–—¿¡"}


def fold(text: str) -> str:
    text = (text if text.isascii() else unicodedata.normalize("NFKD", text)).lower()
    if "|" in text or "\\" in text or "()" in text:
        for form, letter in FORMS.items():
            text = text.replace(form, letter)
    return " " + text.translate(FOLD) + " "


@dataclass
class Lexicon:
    """Weights of terms, and the coefficients of the score: constant, of the sum, of the normalised sum."""

    weights: dict[str, float]
    coefficients: tuple[float, float, float]
    exceptions: tuple[str, ...] = EXCEPTIONS

    def finder(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(" " + term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(" " + fold(phrase).strip(), (len(fold(phrase).strip()), None))
        found.make_automaton()
        return found


def findings(finder, folded: str) -> tuple[float, int]:
    """Sum of the weights of a folded text's words, and the number of its words."""
    best: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (length, weight) in finder.iter(folded):
        start = end - length + 1
        if weight is None:
            excused.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if excused:
        excused.sort()
        starts, ends = [a for a, _ in excused], list(itertools.accumulate((b for _, b in excused), max))
        best = {s: w for s, w in best.items() if not (k := bisect.bisect_right(starts, s)) or ends[k - 1] < s}
    return sum(best.values()), len(folded.split())


def features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(1000 * total / (words + 20))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Coefficients by Newton's method; the ridge keeps them finite."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
    return b


def term_counts(sample: DataFrame) -> DataFrame:
    """term, toxic and clean documents that have a word beginning with it; summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                terms = {w[:k] for w in set(fold(text).split()) for k in range(SHORTEST, min(len(w), LONGEST) + 1)}
                (toxic if label else clean).update(terms)
        terms = list(toxic)  # a term of clean documents alone is no candidate, but counts beside toxic ones elsewhere
        terms += [t for t in clean if t not in toxic]
        for k in range(0, len(terms), 50_000):
            part = terms[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([toxic[t] for t in part], pa.int64()), pa.array([clean[t] for t in part], pa.int64())], names=["term", "toxic", "clean"])

    partial = sample.select("text", "label").mapInArrow(run, "term string, toxic long, clean long")
    return partial.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_terms(sample: DataFrame) -> dict[str, float]:
    """Weights of the TERMS terms whose log odds are furthest from chance."""
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (toxic - F.col("toxic") + 0.5)) - F.log((F.col("clean") + 0.5) / (clean - F.col("clean") + 0.5))
    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    scored = term_counts(sample).where(F.col("toxic") >= LEAST_DOCS).select("term", odds.alias("weight"), (odds / spread).alias("z"))
    best = scored.where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(TERMS).collect()
    return {r["term"]: min(float(r["weight"]), 8.0) for r in best}


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", use=None, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Lexicon:
    """Terms from the sample. The coefficients come from all of it, each half scored with terms that only the other taught."""
    sample = labelled_sample(docs, labels, label_col, F.lit(True) if use is None else use, fit_rows, id_col, text_col)
    half = F.pmod(F.xxhash64("key", F.lit("half")), F.lit(2))
    start = {t: START_WEIGHT for t in INSULTS}
    lexicon = Lexicon(start, (-4.0, 1.0, 1.0))
    parts = [scored_sums(sample.where(half == k), Lexicon(start | learn_terms(sample.where(half != k)), lexicon.coefficients), ["label"], "text") for k in (0, 1)]
    rows = parts[0].union(parts[1]).select("label", "total", "words").toPandas()  # three numbers for each of fit_rows
    if rows["label"].nunique() == 2:
        x = features(rows["total"].to_numpy(float), rows["words"].to_numpy(float))
        lexicon.coefficients = tuple(map(float, logistic(x, rows["label"].to_numpy(float))))
    lexicon.weights = start | learn_terms(sample)
    return lexicon


def scored_sums(docs: DataFrame, lexicon: Lexicon, keep: list[str], text_col: str) -> DataFrame:
    """The columns to keep, total, words."""
    slim = docs.select(*keep, text_of(text_col).alias("_text"))
    schema = T.StructType([slim.schema[c] for c in keep] + [T.StructField("total", T.DoubleType()), T.StructField("words", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = lexicon.finder()
        for batch in batches:
            found = [findings(finder, fold(x)) for x in batch.column("_text").to_pylist()]
            total, words = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(total, pa.float64()), pa.array(words, pa.int64())], names=schema.names)

    return slim.mapInArrow(run, schema)


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1, higher: likelier toxic), predicted (1 from 0.5 on)."""
    return with_score(scored_sums(docs, lexicon, [id_col], text_col), lexicon).drop("total", "words")


def with_score(summed: DataFrame, lexicon: Lexicon) -> DataFrame:
    a, b, c = lexicon.coefficients
    logit = F.lit(a) + b * F.log1p("total") + c * F.log1p(1000 * F.col("total") / (F.col("words") + 20))
    value = 1 / (1 + F.exp(-logit))
    return summed.withColumn("score", value).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The documents that the lexicon doesn't reject, with all their columns."""
    kept = [c for c in docs.columns]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), text_of(text_col).alias("text"))
    return with_score(scored_sums(packed, lexicon, ["row"], "text"), lexicon).where("predicted = 0").select("row.*")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    lexicon = fit(docs, labels, use=id_remainder("doc_id", 5) != 0)
    return score(docs, lexicon).select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
