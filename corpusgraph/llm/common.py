"""Helpers shared by the operators: tables in shared storage, slices of text columns, vectorised word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import materialize  # noqa: F401


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, with signs `_` behind it until df has no such column (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salts: int = SALTS) -> DataFrame:
    """Inner join of left, whose keys may be hot, with right, which has each key once: the rows of a key are dealt to salts
    tasks by the hash of the whole row, and right's row is sent to each of them."""
    salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in left.columns)), F.lit(salts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return left.withColumn("_salt", salt).join(right.withColumn("_salt", copies), [*keys, "_salt"]).drop("_salt")


def bound_batches(spark: SparkSession, rows: int = 4000) -> None:
    """Hand whole texts to Python in batches of at most so many rows, so that a worker holds little at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def text_of(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows, max_bytes or one row at a time; nulls must be gone."""
    array = batch.column(column)
    if len(array) == 0:
        return
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(array):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


_U = np.uint64
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_BYTE_VALUE[65:91] = _BYTE_VALUE[97:123]  # A-Z count as a-z
_BASE = _U(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(max(n, 1024), _BASE)]))
    return _powers


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space separated words of each row, A-Z lower-cased, in order.

    Returns the hashes and, for each row and one more, the place of its first word among them.
    """
    n = len(data)
    inside = ~WHITE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    row_starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[row_starts] = inside[row_starts]
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    lengths = np.diff(np.append(starts, n))
    relative = np.arange(starts[0], n) - np.repeat(starts, lengths)
    value = _BYTE_VALUE[data[starts[0] :]] * _power_table(int(lengths.max()) + 1)[relative]
    value[~inside[starts[0] :]] = 0
    return mix(np.add.reduceat(value, starts - starts[0])), bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of width words inside each row; a row with fewer words, but any, has one: all its words.

    Returns the hashes, with repeats, and the bounds of each row among them.
    """
    count = np.diff(bounds)
    per_row = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(per_row)])
    out = np.empty(out_bounds[-1], np.uint64)
    long_rows = count >= width
    if len(words) >= width:
        rolling = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            rolling = (rolling + words[k : len(words) - width + 1 + k]) * _U(0xD6E8FEB86659FD93)
            rolling ^= rolling >> _U(32)
        keep = np.zeros(len(rolling) + 1, np.int64)
        np.add.at(keep, np.minimum(bounds[:-1][long_rows], len(rolling)), 1)
        np.add.at(keep, np.minimum(bounds[1:][long_rows] - width + 1, len(rolling)), -1)
        target = np.repeat(long_rows, per_row)
        out[target] = mix(rolling[np.cumsum(keep)[:-1] > 0])
    for row in np.flatnonzero((count > 0) & ~long_rows):
        h = _U(count[row])
        for w in words[bounds[row] : bounds[row + 1]]:
            h = mix(np.array([h ^ w]) * _BASE)[0]
        out[out_bounds[row]] = h
    return out, out_bounds


def distinct_per_row(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, with their bounds."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[new], np.searchsorted(row[new], np.arange(len(bounds)))
