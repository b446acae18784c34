"""Ranked lexical search: the best documents of each query, by intervals of documents and range maxima.

Queries are taken in blocks of at most BLOCK_BYTES of text, so what goes to all tasks is bounded. For a block, every
document is cut into terms once; the occurrences of the block's terms are written as postings. Tasks read them in segments
of at most SEGMENT_DOCS documents and about SEGMENT_POSTINGS postings. In a segment each term has a posting list in
document order with a sparse table: the place of the greatest impact in any range, from two looked-up places.

A query starts with one interval of all the segment's documents. The sum of its terms' range maxima bounds the score of each
document inside. The intervals of the highest bounds are taken first, several at a time; each is split at the document that
has the greatest single impact: that document is scored exactly, and what lies left and right of it becomes intervals of
its own, bounded again. Intervals below the score of the query's last place so far go (equal bounds stay, for ties).
Intervals of at most LEAF documents are scored document by document. A query's best so far is carried through the
segments of a task; the tasks' best are ranked together at the end. So the result is exact, for any input.

A document is a row: repeated rows are ranked each, null ids last among equal scores. Null and empty texts, of documents or
queries, have no terms: they are no part of the statistics and find nothing. Texts are read whole. Queries with equal or null
ids are ranked each for itself. Empty tables give an empty result. Columns beside ids and texts are not read, whatever
their names. Terms in every document have small weights, never below 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, text_of
from .terms import cutter

TOP = 20
BLOCK_BYTES = 4 << 20
SEGMENT_DOCS = 16_384
SEGMENT_POSTINGS = 1_000_000
LEAF = 32
CELLS = 100_000  # terms times intervals at a time
SCALE, SPREAD = 1_000_000_000, 12  # of the impact: SCALE * tf div (1000 * tf + SPREAD * m)


class Queries:
    """A block of queries: their ids, the block's terms by number, and each query's terms with their repeats."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.terms: dict[bytes, int] = {}
        self.wanted: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, item: int | None, words: list[bytes]) -> None:
        counts = Counter(words)
        numbers = [self.terms.setdefault(w, len(self.terms)) for w in counts]
        self.ids.append(item)
        self.wanted.append((np.array(numbers, np.int64), np.array(list(counts.values()), np.int64)))


def query_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[Queries]:
    """The queries in blocks; the driver holds one block at a time."""
    cut, block, size = cutter(digits=True), Queries(), 0
    for r in items.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(f"`{text_col}`").alias("text")).toLocalIterator():
        data = r["text"].encode("utf-8", "surrogatepass")
        if block.ids and size + len(data) > block_bytes:
            yield block
            block, size = Queries(), 0
        block.add(r["id"], cut(data))
        size += len(data)
    if block.ids:
        yield block


def postings_of(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, counts of each document (doc_id, text) with any term at all; only the given terms are listed."""
    known = docs.sparkSession.sparkContext.broadcast(terms)  # those of a block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, number = cutter(digits=True), known.value
        for batch in batches:
            size, met, counts, kept = [], [], [], []
            for row, text in enumerate(batch.column("text").cast(pa.binary())):
                words = cut(text.as_py())
                if words:
                    found = Counter(map(number.get, words))
                    found.pop(None, None)
                    kept.append(row)
                    size.append(len(words))
                    met.append(list(found))
                    counts.append(list(found.values()))
            ids = batch.column("doc_id").take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(met, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def weights(postings: DataFrame, documents: int, n_terms: int) -> np.ndarray:
    """Each term's weight by the number of documents that hold it; terms are those of a block."""
    held = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * documents + 2) / (2.0 * F.col("df") + 1))).cast("long")
    out = np.zeros(n_terms, np.int64)
    for r in held.select("term", weight.alias("w")).collect():
        out[r["term"]] = r["w"]
    return out


class Best:
    """A query's best documents so far: scores, ids, and which ids are null."""

    def __init__(self, top: int):
        self.top = top
        self.rows = np.zeros((0, 3), np.int64)  # score, null, id
        self.least = 1

    def add(self, scores: np.ndarray, nulls: np.ndarray, ids: np.ndarray) -> None:
        new = scores >= self.least
        if not new.any():
            return
        rows = np.concatenate([self.rows, np.stack([scores[new], nulls[new], ids[new]], axis=1)])
        self.rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))][: self.top]
        if len(self.rows) == self.top:
            self.least = int(self.rows[-1, 0])


class Segment:
    """Posting lists of some documents with sparse tables of range maxima."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, norms: np.ndarray, bounds: np.ndarray, terms: np.ndarray, counts: np.ndarray, n_terms: int):
        self.ids, self.nulls, self.size = ids, nulls, len(ids)
        doc = np.repeat(np.arange(self.size), np.diff(bounds))
        impact = SCALE * counts // (1000 * counts + SPREAD * norms[doc])
        order = np.argsort(terms, kind="stable")  # rows came in document order
        self.doc, self.impact = doc[order], impact[order]
        self.keys = terms[order] * self.size + self.doc
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        longest = int(np.diff(self.starts).max(initial=0))
        self.table = [np.arange(len(terms), dtype=np.int32)]
        while 2 << (len(self.table) - 1) <= longest:
            step, last = 1 << (len(self.table) - 1), self.table[-1]
            level = last.copy()
            a, b = last[:-step], last[step:]
            level[: len(a)] = np.where(self.impact[a] >= self.impact[b], a, b)
            self.table.append(level)
        self.table = np.stack(self.table)
        self.score = np.zeros(self.size, np.int64)

    def places(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """For each term and document, the place of the first posting of that term at or after it."""
        return np.searchsorted(self.keys, terms[:, None] * self.size + docs)

    def greatest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of the greatest impact in each range [low, high); any place where it is empty."""
        level = np.frexp(np.maximum(high - low, 1).astype(np.float64))[1] - 1
        a = self.table[level, np.minimum(low, len(self.impact) - 1)]
        b = self.table[level, np.maximum(high - (1 << level), 0)]
        return np.where(self.impact[a] >= self.impact[b], a, b)

    def maxima(self, low: np.ndarray, high: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each range: the place of its greatest impact, and that impact by weight (0 where it is empty)."""
        at = self.greatest(low, high)
        return at, np.where(low < high, self.impact[at] * weight[:, None], 0)

    def search(self, terms: np.ndarray, weight: np.ndarray, best: Best) -> None:
        """Add this segment's documents to a query's best, as far as they can matter."""
        here = (weight > 0) & (self.starts[terms] < self.starts[terms + 1])
        terms, weight = terms[here], weight[here]
        if not len(terms):
            return
        a, b = np.zeros(1, np.int64), np.full(1, self.size, np.int64)
        bound = self.maxima(self.starts[terms][:, None], self.starts[terms + 1][:, None], weight)[1].sum(axis=0)
        most, turn = max(1, CELLS // len(terms)), 8
        while True:
            open_ = bound >= best.least
            a, b, bound = a[open_], b[open_], bound[open_]
            if not len(a):
                return
            turn = min(2 * turn, most)
            if len(a) > turn:
                order = np.argpartition(-bound, turn - 1)
                first, rest = order[:turn], order[turn:]
            else:
                first, rest = np.arange(len(a)), np.zeros(0, np.int64)
            small = b[first] - a[first] <= LEAF
            self._score_all(terms, weight, a[first[small]], b[first[small]], best)
            x, y, over = self._split(terms, weight, a[first[~small]], b[first[~small]], best)
            a, b, bound = np.concatenate([a[rest], x]), np.concatenate([b[rest], y]), np.concatenate([bound[rest], over])

    def _split(self, terms, weight, a, b, best) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score the document of the greatest impact in each interval [a, b); the intervals beside it with their bounds."""
        if not len(a):
            return a, b, a
        low, high = self.places(terms, a), self.places(terms, b)
        at, value = self.maxima(low, high, weight)
        doc = self.doc[at[value.argmax(axis=0), np.arange(len(a))]]
        cut = self.places(terms, doc)
        there = (cut < high) & (self.doc[np.minimum(cut, len(self.doc) - 1)] == doc)
        scores = np.where(there, self.impact[np.minimum(cut, len(self.doc) - 1)] * weight[:, None], 0).sum(axis=0)
        best.add(scores, self.nulls[doc], self.ids[doc])
        left, right = self.maxima(low, cut, weight)[1].sum(axis=0), self.maxima(cut + there, high, weight)[1].sum(axis=0)
        x, y, over = np.concatenate([a, doc + 1]), np.concatenate([doc, b]), np.concatenate([left, right])
        some = (over > 0) & (over >= best.least)
        return x[some], y[some], over[some]

    def _score_all(self, terms, weight, a, b, best) -> None:
        """Score every document of small intervals."""
        if not len(a):
            return
        low, high = self.places(terms, a), self.places(terms, b)
        sizes = (high - low).ravel()
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(low.ravel() - ends + sizes, sizes)
        docs = self.doc[at]
        np.add.at(self.score, docs, self.impact[at] * np.repeat(np.broadcast_to(weight[:, None], low.shape).ravel(), sizes))
        docs = np.unique(docs)
        best.add(self.score[docs], self.nulls[docs], self.ids[docs])
        self.score[docs] = 0


def search_block(postings: DataFrame, queries: Queries, documents: int, occurrences: int, weight: np.ndarray, first: int, top: int = TOP) -> DataFrame:
    """query, item_id, doc_id, score: each task's best documents of each query; queries are numbered from first."""
    block = postings.sparkSession.sparkContext.broadcast((queries.ids, queries.wanted, weight))  # bounded by BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wanted, weight = block.value
        best = [Best(top) for _ in ids]
        parts: list[pa.RecordBatch] = []

        def search() -> None:
            table = pa.Table.from_batches(parts).combine_chunks()
            bounds = np.concatenate([[0], np.cumsum(table["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False))])
            numbers = lambda c: table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            nulls = table["doc_id"].is_null().to_numpy().astype(np.int64)
            norms = 100 - 25 + 25 * table["n"].to_numpy() * documents // occurrences
            if not bounds[-1]:
                return
            segment = Segment(table["doc_id"].fill_null(0).to_numpy(), nulls, norms, bounds, numbers("terms"), numbers("counts"), len(weight))
            for (terms, repeats), own in zip(wanted, best):
                if len(terms):
                    segment.search(terms, repeats * weight[terms], own)

        held = docs = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                size = len(batch.column("terms").flatten())
                if parts and (docs + batch.num_rows > SEGMENT_DOCS or held + size > SEGMENT_POSTINGS):
                    search()
                    parts, held, docs = [], 0, 0
                parts.append(batch)
                held, docs = held + size, docs + batch.num_rows
        if parts:
            search()
        for k, own in enumerate(best):
            if len(own.rows):
                score, null, doc = own.rows.T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(score), first + k)), pa.array([ids[k]] * len(score), pa.int64()), pa.array(doc, pa.int64(), mask=null.astype(bool)), pa.array(score)],
                    names=["query", "item_id", "doc_id", "score"],
                )

    return postings.mapInArrow(run, "query long, item_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the top documents of each item with a score above 0, equal scores by ascending id."""
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(f"`{text_col}`").alias("text"))
    found, first = None, 0
    for queries in query_blocks(items, item_col, item_text, block_bytes):
        postings = materialize(postings_of(own, queries.terms))
        sizes = postings.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences")).first()
        if not sizes["documents"]:
            break
        weight = weights(postings, sizes["documents"], len(queries.terms))
        part = materialize(search_block(postings, queries, sizes["documents"], sizes["occurrences"], weight, first, top))
        found = part if found is None else found.unionByName(part)
        first += len(queries.ids)
    if found is None:
        found = spark.createDataFrame([], "query long, item_id long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))  # ranks are cut in each task first
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP13_SQL = f"""
with d as (select row_number() over () as r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
q as (select row_number() over () as i, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from benchmark),
qt as (select i, item_id, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from q),
w as (select r, doc_id, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
tf as materialized (select r, doc_id, term, count(*) as tf from w group by all),
size as (select r, cast(sum(tf) as bigint) as n from tf group by r),
st as (select count(*) as nd, cast(sum(n) as bigint) as l from size),
df as (select term, cast(floor(1000 * ln((2.0::double * any_value(nd) + 2) / (2.0::double * count(*) + 1))) as bigint) as weight from tf, st group by term),
scored as (select qt.i, qt.item_id, tf.r, tf.doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l)))) as bigint) as score
  from qt join tf on tf.term = qt.term join df on df.term = qt.term join size on size.r = tf.r, st group by all),
ranked as (select *, row_number() over (partition by i order by score desc, doc_id) as rank from scored where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= {TOP}
"""
