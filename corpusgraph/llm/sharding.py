"""Shards along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to the same number of bits, in its own order: numbers by the logarithm of their size, text by
its place among the column's distinct values. The cells are numbered along a Hilbert curve, so rows with like metadata lie
near each other, and the table in curve order is cut into runs of equal row counts (at most one apart). A file then spans
short ranges of every dimension, and its minima and maxima let a reader skip it. Rows of one cell are ordered by text
checksum and id; a hot cell is cut like any other run.

Nulls in a dimension are a value of their own (cell 0), a null text has no bytes, null ids come first in their cell. Texts
count whole. Equal rows take different slots. An empty table gives an empty result. Columns beside those named are carried
only by write_shards; where they have a name that it gives, its own gets signs `_` behind it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialize, read_table, text_of
from .ordering import global_rank

SHARDS = 40
BITS = 8
ROW_BYTES = 16


def boundaries(df: DataFrame, column: str, bits: int) -> list[str]:
    """At most 2**bits - 1 values that part the column's distinct values, in their order, into cells of like counts."""
    most = (1 << bits) - 1
    ranked, n = global_rank(df.select(F.col(column).cast("string").alias("v")).where("v is not null").distinct(), ["v"], "rank")
    firsts = ranked.where(F.expr(f"rank * {most} div {max(n, most)} > (rank - 1) * {most} div {max(n, most)} or rank = 0")) if n > most else ranked
    return sorted(r["v"] for r in firsts.select("v").collect())


def quantise(df: DataFrame, column: str, bits: int) -> Column:
    """A cell from 0 to 2**bits - 1 that keeps the column's order: eighths of the binary logarithm of numbers (those below 1
    share a cell), the place among boundaries of text,
    spread over all cells; null is cell 0."""
    most = (1 << bits) - 1
    if isinstance(df.schema[column].dataType, T.NumericType):
        cell = F.floor(F.log2(F.greatest(F.col(column).cast("double"), F.lit(1.0))) * 8) + 1
        return F.coalesce(F.least(cell, F.lit(most)), F.lit(0)).cast("int")
    edges = boundaries(df, column, bits)

    @F.pandas_udf(T.IntegerType())
    def cell_of(values):
        import bisect

        return values.map(lambda v: 0 if v is None else bisect.bisect_right(edges, v) * most // len(edges)).astype("int32")

    return cell_of(F.col(column).cast("string"))


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the curve of points (rows of cells, one column a dimension), by Gray code and rotation of axes."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    high = 1 << (bits - 1)
    step = high
    while step > 1:
        low = step - 1
        for i in range(n):
            up = (x[i] & step) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0]) ^ swap
            x[i] ^= swap
        step >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    step = high
    while step > 1:
        turn ^= np.where((x[n - 1] & step) > 0, step - 1, 0)
        step >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def with_curve_index(df: DataFrame, dimensions: list[str], bits: int = BITS, name: str = "_curve") -> DataFrame:
    """df with each row's place along the curve over the dimensions."""
    if bits * len(dimensions) > 62:
        raise ValueError("bits times dimensions must be at most 62")

    @F.pandas_udf(T.LongType())
    def curve(cells):
        import pandas as pd

        return pd.Series(hilbert_index(np.stack(cells.to_numpy()) if len(cells) else np.zeros((0, len(dimensions)), np.int64), bits))

    return df.withColumn(name, curve(F.array(*(quantise(df, d, bits) for d in dimensions))))


def cut_runs(df: DataFrame, order: list[str], shards: int, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """df with shard and slot: runs in the given order whose counts are at most one apart; slots are gapless from 0."""
    rank = free_name(df, "_rank")
    ranked, n = global_rank(df, order, rank)
    start = F.expr(f"(cast({shard} as bigint) * {n} + {shards - 1}) div {shards}")
    return ranked.withColumn(shard, F.expr(f"cast({rank} * {shards} div {max(n, 1)} as int)")).withColumn(slot, F.col(rank) - start).drop(rank)


def assign_shards(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = ("lang", "source"), id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """id, size, text_crc32, curve index, shard, slot for each row; the size of a row is a dimension too."""
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col), *(F.col(d).alias(f"_d{k}") for k, d in enumerate(dimensions)), (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.encode(text_of(text_col), "UTF-8")).alias("text_crc32"))
    indexed = with_curve_index(slim, [f"_d{k}" for k in range(len(dimensions))] + ["size"], bits)
    kept = materialize(indexed.select(id_col, "size", "text_crc32", "_curve"))
    return cut_runs(kept, ["_curve", "text_crc32", id_col], shards)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, dimensions: tuple[str, ...] = ("lang", "source", "n_chars"), id_col: str = "doc_id", bits: int = BITS) -> DataFrame:
    """Write docs with all columns, one folder a shard, in curve order; return each shard's rows and range of each dimension.

    The folders are named by shard, or shard_ if docs has such a column; the result's first column has the same name.
    """
    curve, shard, slot = (free_name(docs, c) for c in ("_curve", "shard", "slot"))
    indexed = with_curve_index(docs, list(dimensions), bits, curve)
    cut = cut_runs(indexed, [curve, id_col], shards, shard, slot)
    cut.sortWithinPartitions(shard, curve, id_col).drop(curve).write.partitionBy(shard).parquet(path)
    written = docs.sparkSession.read.parquet(path)
    ranges = [f(d).alias(f"{f.__name__}_{d}") for d in dimensions for f in (F.min, F.max)]
    return written.groupBy(shard).agg(F.count("*").alias("rows"), *ranges)


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign_shards(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
