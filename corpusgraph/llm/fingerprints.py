"""Homomorphic multiset fingerprints of texts.

A text is the multiset of its paragraphs (lines). Each paragraph is hashed to a wide vector; a fingerprint is the sum of
these vectors modulo powers of two, 2**32 a lane. So the order of paragraphs does not matter, and inserting or deleting
a paragraph is adding or subtracting its vector. The first lanes are hashed from the paragraph as a whole: they make
fingerprints of different multisets differ. The last lanes are signed sums over the paragraph's word pairs, so that the
difference of two fingerprints also tells how much text differs: the mean square of a lane of the difference is the
number of word pairs by which the texts differ.

Null texts count as empty; the fingerprint of an empty text is that of no paragraphs. Likeness is 1 for equal
fingerprints; it holds for texts of fewer than 2**31 word pairs, as signed lanes wrap beyond. Repeated rows and ids are
treated one by one; among rows of one id the order is that of a hash of their texts, so that a hot id is parted among
tasks. Null ids come last. Texts are read whole. An empty table gives an empty result. Columns beside the id and the text
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, mix, read_table, text_of, word_hashes

WHOLE_LANES = 16
PAIR_LANES = 64
_U = np.uint64


def paragraph_seeds(data: bytes) -> np.ndarray:
    """128 bits for each paragraph that is not blank."""
    digests = [hashlib.blake2b(p, digest_size=16).digest() for p in data.split(b"\n") if p and not p.isspace()]
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def whole_vectors(seeds: np.ndarray) -> np.ndarray:
    """Wide vectors (WHOLE_LANES of 32 bits) from seeds."""
    steps = np.arange(1, WHOLE_LANES // 2 + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    return mix(mix(seeds[:, :1] + steps) ^ seeds[:, 1:]).view(np.uint32)


def pair_sum(data: bytes) -> np.ndarray:
    """Sum of the signs of all word pairs inside paragraphs, in PAIR_LANES lanes; a paragraph's first word pairs with nothing."""
    buffer = np.frombuffer(data, np.uint8)
    words, _ = word_hashes(buffer, np.array([0, len(buffer)]))
    if not len(words):
        return np.zeros(PAIR_LANES, np.int64)
    line_ends = np.append(np.flatnonzero(buffer == 10), len(buffer))
    _, firsts = word_hashes(buffer, np.concatenate([[0], line_ends]))
    before = np.concatenate([[_U(0)], words[:-1]])
    before[firsts[:-1][firsts[:-1] < len(words)]] = 0
    bits = np.unpackbits(mix(words + before * _U(0xD6E8FEB86659FD93)).view(np.uint8).reshape(-1, 8), axis=1)
    return 2 * bits.sum(axis=0, dtype=np.int64) - len(words)


def fingerprint(text: str) -> np.ndarray:
    data = text.encode("utf-8", "surrogatepass")
    whole = whole_vectors(paragraph_seeds(data)).sum(axis=0, dtype=np.uint32)
    return np.concatenate([whole, pair_sum(data).astype(np.uint32)])


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint of the paragraphs of both."""
    return a + b


def remove(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint of the paragraphs of a without those of b."""
    return a - b


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1: one less the share of word pairs (estimated) by which the texts differ; 1 for equal fingerprints."""
    if np.array_equal(a, b):
        return 1.0
    signed = lambda x: x[WHOLE_LANES:].astype(np.uint32).view(np.int32).astype(np.float64)
    both = np.mean(signed(a) ** 2) + np.mean(signed(b) ** 2)
    if both == 0:
        return 0.0
    return float(min(max(1 - np.mean(signed(a - b) ** 2) / both, 0.0), 0.999999))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (binary, little-endian lanes)."""
    slim = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    schema = T.StructType([slim.schema[id_col], T.StructField("fingerprint", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(x).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=schema.names)

    return slim.mapInArrow(run, schema)


def combine(prints: DataFrame, keys: list[str], column: str = "fingerprint") -> DataFrame:
    """Fingerprints of groups, as sums of those of their members: partial sums in each task, then one a key."""
    number = lambda k: F.conv(F.hex(F.concat(*(F.substring(column, k * 4 + b, 1) for b in (4, 3, 2, 1)))), 16, 10).cast("long")
    lanes = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(WHOLE_LANES + PAIR_LANES - 1)), number))
    summed = prints.select(*keys, lanes.alias("lane", "value")).groupBy(*keys, "lane").agg((F.sum("value") % (1 << 32)).alias("value"))
    turned = lambda h: F.concat(*(F.substring(h, b, 2) for b in (7, 5, 3, 1)))
    swapped = F.transform(F.array_sort(F.collect_list(F.struct("lane", "value"))), lambda x: turned(F.lpad(F.hex(x["value"]), 8, "0")))
    return summed.groupBy(*keys).agg(F.unhex(F.array_join(swapped, "")).alias(column))


def with_successor(docs: DataFrame, run, schema: T.StructType, id_col: str, text_col: str) -> DataFrame:
    """run(rows) on rows (part, head, id, text) in descending order of id, each range followed by the first row of the next.

    Ids and hashes of texts alone are sorted first, to cut ranges of like counts. Then each text is shuffled once to its
    range, the first text of each range also to the range before it, and streamed through in order: no task holds more than
    a batch. Ids turn into ascending keys by their bits, so no number passes through a float.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    known = F.col("id").isNotNull()
    placed = placed.select("*", F.struct((~known).cast("long").alias("unknown"), F.bitwise_not(F.coalesce(F.col("id").cast("long"), F.lit(0))).alias("down"), F.xxhash64("text").alias("hash")).alias("key"))
    cuts = materialize(placed.select("key").repartitionByRange(8 * parts, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("first")))
    firsts = np.array(sorted({tuple(r["first"]) for r in cuts.collect()}), np.int64).reshape(-1, 3)  # one for each range

    @F.pandas_udf(T.StructType([T.StructField("part", T.IntegerType()), T.StructField("is_head", T.BooleanType())]))
    def range_of(keys):
        import pandas as pd

        rows = keys[["unknown", "down", "hash"]].to_numpy(np.int64)
        both = np.concatenate([firsts, rows])
        turn = np.lexsort((np.arange(len(both)) >= len(firsts), both[:, 2], both[:, 1], both[:, 0]))
        part = np.empty(len(both), np.int64)
        part[turn] = np.cumsum(turn < len(firsts)) - 1
        part = np.clip(part[len(firsts) :], 0, None)
        return pd.DataFrame({"part": part.astype(np.int32), "is_head": (firsts[part] == rows).all(axis=1) if len(rows) else np.zeros(0, bool)})

    placed = placed.withColumn("at", range_of("key"))
    own = F.struct(F.col("at.part").alias("part"), F.lit(0).alias("head"))
    before = F.when(F.col("at.part") > 0, F.col("at.part") - 1).otherwise(F.lit(max(len(firsts) - 1, 0)))
    both = F.when(F.col("at.is_head"), F.array(own, F.struct(before.alias("part"), F.lit(1).alias("head")))).otherwise(F.array(own))
    laid = placed.withColumn("to", F.explode(both)).select("to.part", "to.head", "id", "text", "key")
    laid = laid.repartition(parts, "part").sortWithinPartitions("part", "head", "key", "text")
    return laid.select("part", "head", "id", "text").mapInArrow(run, schema)


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, both fingerprints, and likeness to the edited text and to the next document.

    The edited text has the last half of its code points replaced by the first as many (or all) of the next document.
    """
    schema = T.StructType([docs.select(id_col).schema[id_col], T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), *(T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next"))])

    def edit(row: tuple, following: tuple) -> tuple:
        key, text, own = row
        half = len(text) // 2
        edited = text[: len(text) - half] + following[1][:half]
        other = fingerprint(edited)
        return (key, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own.tobytes().hex(), other.tobytes().hex(), likeness(own, other), likeness(own, following[2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by range; after its own rows, a range has the head row of the next, once or with its equals."""
        waiting: tuple | None = None
        part, closed = None, False
        for batch in batches:
            out = []
            for p, head, key, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if p != part:
                    part, closed, waiting = p, False, None
                if closed:
                    continue
                row = (key, text, fingerprint(text))
                if waiting is not None:
                    out.append(edit(waiting, row))
                waiting, closed = row, head == 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return with_successor(docs, run, schema, id_col, text_col)


def op6_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(read_table(spark, sf_dir, "documents"))
