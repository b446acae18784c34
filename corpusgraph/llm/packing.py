"""Best-fit packing of token sequences into sequences of a fixed length.

Bulk-synchronous best fit, longest pieces first. Documents are range-sorted by length, which gives each a rank; pieces of
one length and gaps of one size are alike, so they are kept as runs: lengths with their ranks, gaps with their sequences.
A superstep takes the pieces of one halving of the capacity. Ranges of sizes are swept side by side, each giving the
longest piece the least gap that holds it, conflicts by rank; what the ranges leave over is swept together with the larger
gaps and opens new sequences. The gaps are updated and written, and the next superstep begins. Runs are bounded by the
capacity (a few for each length), never by the number of documents; a document then finds its place from its rank.

Null texts count as empty; an empty text is one piece with the end token alone. A text of any length is read whole and cut
at the capacity. Equal rows are packed one by one; the order among pieces of a length is that of id and piece, null ids
first. An empty table gives an empty result. Columns beside the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import bisect
import itertools
import os
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, read_table, text_of
from .ordering import global_rank
from .token_counts import SPACE

CAPACITY = 4096
END_TOKEN = 1
RANGES = 8  # of sizes that a superstep sweeps side by side
KEPT_PIECES = 300_000
GROUP_BYTES = 4 << 20  # encoded at a time
CHUNK = re.compile(f"[^{SPACE}]+")
LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
WORD_END = "</w>"


class Store:
    """Distinct pieces of text and the bytes of their ids, as Arrow arrays; it starts anew beyond KEPT_PIECES."""

    def __init__(self, learn):
        self.learn = learn
        self.forget()

    def forget(self) -> None:
        self.names, self.ids = pa.array([""], pa.string()), pa.array([b""], pa.binary())

    def of(self, names: pa.Array) -> pa.Array:
        coded = names.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.names)
        if at.null_count and len(self.names) > KEPT_PIECES:
            self.forget()
            at = pc.index_in(coded.dictionary, value_set=self.names)
        if at.null_count:
            missing = np.asarray(pc.is_null(at))
            new = coded.dictionary.filter(pa.array(missing))
            places = np.array(pc.fill_null(at, 0), np.int64)
            places[missing] = len(self.names) + np.arange(len(new))
            self.names, self.ids, at = pa.concat_arrays([self.names, new]), pa.concat_arrays([self.ids, self.learn(new)]), pa.array(places)
        return self.ids.take(at).take(coded.indices)


class Encoder:
    """Token ids as little-endian bytes, found for the distinct chunks of many texts at a time by Arrow's functions.

    White space parts chunks that do not influence each other. Most chunks are Latin letters with signs behind them;
    letters and signs are pieces of their own, alike in any case, and recent pieces are kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.bytes = np.zeros(len(self.ends), np.int64)  # of the text that a token stands for; one letter a byte
        for token, k in vocabulary.items():
            self.ends[k] = token.endswith(WORD_END)
            self.bytes[k] = len(token.removesuffix(WORD_END))
        self.letters, self.signs = Store(self.together), Store(self.alone)

    def forget(self) -> None:
        """A worker outlives its task; what it has kept must not take memory from the next stages."""
        self.letters.forget()
        self.signs.forget()

    def alone(self, chunks: pa.Array) -> pa.Array:
        return pa.array([np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(chunks.to_pylist(), add_special_tokens=False)], pa.binary())

    def together(self, words: pa.Array) -> pa.Array:
        """Ids of words, encoded many at a time side by side. Word ends part the tokens again; each word's tokens must
        spell as many bytes as the word has, else all are encoded one by one."""
        cuts = np.append(np.arange(0, len(words), 512), len(words)).astype(np.int32)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), words), " ").to_pylist()
        ids = np.concatenate([np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
        ends = np.flatnonzero(self.ends[ids]) + 1
        spelt = np.concatenate([[0], np.cumsum(self.bytes[ids])])
        if len(ends) != len(words) or ends[-1] != len(ids) or (spelt[ends] != np.cumsum(np.asarray(pc.binary_length(words)))).any():
            return self.alone(words)
        offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())])

    def lookup(self, chunks: pa.Array) -> pa.Array:
        """Ids of distinct chunks."""
        letters = pc.utf8_rtrim(chunks, characters=SIGNS)
        plain = np.asarray(pc.match_substring_regex(letters, LETTERS))
        kept = pa.array(plain)
        both = pc.binary_join_element_wise(self.letters.of(pc.utf8_lower(letters.filter(kept))), self.signs.of(tails(chunks.filter(kept), letters.filter(kept))), pa.scalar(b"", pa.binary()))
        if plain.all():
            return both
        at = np.where(plain, np.cumsum(plain) - 1, len(both) + np.cumsum(~plain) - 1)
        return pa.concat_arrays([both, self.alone(chunks.filter(pa.array(~plain)))]).take(pa.array(at))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, and their bounds."""
        if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():  # signs that only some libraries take for white space
            lists = pa.array([CHUNK.findall(x) for x in texts.to_pylist()], pa.list_(pa.string()))
        else:
            lists = pc.utf8_split_whitespace(texts)
        bounds = np.asarray(lists.offsets).astype(np.int64)
        coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        if not len(coded):
            return np.zeros(0, "<u4"), bounds - bounds[0]
        found = self.lookup(coded.dictionary).take(coded.indices)
        _, offsets, data = found.buffers()
        ends = np.frombuffer(offsets, np.int32)[found.offset : found.offset + len(found) + 1].astype(np.int64) // 4
        return np.frombuffer(data, "<u4")[ends[0] : ends[-1]], ends[bounds - bounds[0]] - ends[0]


def tails(whole: pa.Array, heads: pa.Array) -> pa.Array:
    """What stands in each string behind its head."""
    ends = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset + 1 : whole.offset + len(whole) + 1].astype(np.int64)
    sizes = np.asarray(pc.binary_length(whole)).astype(np.int64) - np.asarray(pc.binary_length(heads))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(ends - sizes - bounds[:-1], sizes) + np.arange(bounds[-1])
    data = np.frombuffer(whole.buffers()[2], np.uint8)[at] if bounds[-1] else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.string(), len(whole), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_token: int = END_TOKEN, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids, if asked for): each text's tokens and the end token, cut at capacity.

    tokenizer: path of a file of the tokenizers library whose pieces never cross white space, on every executor.
    """
    slim = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    schema = T.StructType([slim.schema[id_col], T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])
    if with_ids:
        schema = schema.add("ids", T.BinaryType())
    end = np.array([end_token], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # of what the worker did before
        own = encoder(tokenizer)
        try:
            yield from cut(batches, own.encode)
        finally:
            own.forget()

    def cut(batches: Iterator[pa.RecordBatch], encode) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(np.asarray(pc.binary_length(batch.column(1))), dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(sizes // GROUP_BYTES)) + 1).tolist(), batch.num_rows]
            for first, last in itertools.pairwise(cuts):
                part = batch.slice(first, last - first)
                rows, pieces, lengths, sums, parts = [], [], [], [], []
                ids, bounds = encode(part.column(1))
                for row, (a, b) in enumerate(itertools.pairwise(bounds.tolist())):
                    whole = ids[a:b].tobytes() + end
                    for piece, at in enumerate(range(0, len(whole), 4 * capacity)):
                        ids_of = whole[at : at + 4 * capacity]
                        rows.append(row)
                        pieces.append(piece)
                        lengths.append(len(ids_of) // 4)
                        sums.append(zlib.crc32(ids_of))
                        if with_ids:
                            parts.append(ids_of)
                columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(np.array(pieces, np.int64) * capacity), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(parts, pa.binary())] if with_ids else []), names=schema.names)

    return slim.mapInArrow(run, schema)


RUN = "kind string, size long, first long, many long, place long, offset long, each long"


def sweep(runs: list[tuple[str, int, int, int]], capacity: int, opened: int | None) -> list[tuple]:
    """Successor sweep over runs (kind, size, first, many): longest pieces first, each to the least gap that holds it.

    Runs of pieces are many of one length with ranks from first on; runs of gaps are many sequences from first on with so
    much room. Pieces that meet at a gap have it by rank. Without a number from which sequences are opened, pieces that
    find no gap stay. Returns what is left, and rows `placed`: many pieces of a length with ranks from first on, each to
    a sequence from place on, at offset.
    """
    gaps = sorted((size, first, many) for kind, size, first, many in runs if kind == "gap")
    out = []

    def leave(size: int, first: int, many: int) -> None:
        if size and many:
            bisect.insort(gaps, (size, first, many))

    for length, rank, left in sorted(((size, first, many) for kind, size, first, many in runs if kind == "piece"), reverse=True):
        while left:
            at = bisect.bisect_left(gaps, (length,))
            if at < len(gaps):
                size, first, many = gaps.pop(at)
            elif opened is None:
                out.append(("piece", length, rank, left, None, None, None))
                break
            else:
                size, first, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            each = size // length
            full, rest = (many, 0) if left >= many * each else divmod(left, each)
            out.append(("placed", length, rank, full * each + rest, first, capacity - size, each))
            leave(size - each * length, first, full)
            leave(size - rest * length, first + full, int(rest > 0))
            leave(size, first + full + (rest > 0), many - full - (rest > 0))
            rank, left = rank + full * each + rest, left - full * each - rest
    return out + [("gap", *g, None, None, None) for g in gaps]


def superstep(runs: DataFrame, low: int, high: int, capacity: int, opened: int) -> DataFrame:
    """Runs after the pieces of lengths from low + 1 to high are placed: gaps, and rows `placed` beside those there were.

    Pieces and the gaps of their sizes are dealt to ranges of sizes, each swept by a task of its own. A piece's least gap
    lies in its range or above; so what the ranges leave over is then swept together, with the larger gaps, and opens
    new sequences. There is at most a run for each length and a few for each gap size, however many documents there are.
    """

    def swept(start: int | None):
        def run(part: pa.Table) -> pa.Table:
            due = np.asarray(part.column("kind").to_pylist()) != "placed"
            due &= np.asarray(part.column("size")) > low
            rows = sweep(list(zip(*(part.filter(pa.array(due)).column(c).to_pylist() for c in ("kind", "size", "first", "many")))), capacity, start)
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), part.schema)] if rows else [pa.array([], f.type) for f in part.schema]
            return pa.concat_tables([part.filter(pa.array(~due)), pa.table(columns, schema=part.schema)])

        return run

    near = F.col("size").between(low + 1, high)
    dealt = runs.where(near).groupBy(F.floor((F.col("size") - low - 1) * RANGES / (high - low))).applyInArrow(swept(None), RUN)
    return dealt.unionByName(runs.where(~near)).groupBy(F.isnull("kind")).applyInArrow(swept(opened), RUN)


def placement_runs(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """first, size, many, place, offset, each: where the ranks from first on go, from lengths (size, first, many).

    Bulk-synchronous best fit: a superstep for each halving of the capacity, longest lengths first; each is written, so
    that the next starts from its updated gaps.
    """
    runs = lengths.select(F.lit("piece").alias("kind"), "size", "first", "many", *(F.lit(None).cast("long").alias(c) for c in ("place", "offset", "each")))
    placed, high, step = [], capacity, 0
    while high:
        runs = materialize(superstep(runs, high // 2, high, capacity, step << 40))  # each superstep numbers its own sequences
        placed.append(runs.where("kind = 'placed'"))
        runs, high, step = runs.where("kind <> 'placed'"), high // 2, step + 1
    return reduce(DataFrame.unionByName, placed).drop("kind")


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. pieces must be a table that reads the same again, with length from 1 to capacity.

    Documents get their rank by a range sort over length and order, and find their place from the run that holds it.
    """
    counts = pieces.groupBy(F.col("length").alias("size")).agg(F.count("*").alias("many"))  # capacity rows at most
    lengths = counts.withColumn("first", F.sum("many").over(Window.orderBy("size")) - F.col("many"))
    runs = placement_runs(materialize(lengths), capacity).orderBy("first").toPandas()  # bounded by the capacity, see superstep
    table = runs[["first", "size", "place", "offset", "each"]].to_numpy(np.int64)
    where = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    shared = pieces.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf(where)
    def place(rank):
        import pandas as pd

        rank = rank.to_numpy()
        at = np.searchsorted(shared.value[:, 0], rank, "right") - 1
        first, length, sequence, offset, each = shared.value[at].T
        return pd.DataFrame({"sequence_id": sequence + (rank - first) // each, "offset": offset + (rank - first) % each * length})

    ranked, _ = global_rank(pieces, ["length", *order], "rank")
    return ranked.withColumn("at", place("rank")).select(*pieces.columns, "at.sequence_id", "at.offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_token: int = END_TOKEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset: all texts in few sequences of at most capacity tokens."""
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_token, id_col, text_col))
    return pack(pieces, [id_col, "piece", "ids_crc32"], capacity)


def packed_sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_token: int = END_TOKEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """sequence_id and its token ids as one little-endian binary, the pieces side by side."""
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_token, id_col, text_col, with_ids=True))
    packed = pack(pieces, [id_col, "piece", "ids_crc32"], capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most capacity pieces
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
