"""Ranks over a whole table, without a window over one partition."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize


def global_rank(df: DataFrame, order: list, name: str) -> tuple[DataFrame, int]:
    """df with a long column of places from 0 in the given order (equal rows in any order), and the number of rows.

    The rows are range-partitioned and sorted once and written; each partition's count, of which there are as many as
    shuffle partitions, goes to the driver, and a row's place is its partition's start and its place inside.
    """
    spark = df.sparkSession
    parts, at = int(spark.conf.get("spark.sql.shuffle.partitions")), free_name(df, "_at")
    laid = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    laid = materialize(laid)
    part = F.shiftright(at, 33)
    counts = laid.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
    n = np.zeros(max((r["part"] for r in counts), default=-1) + 1, np.int64)
    for r in counts:
        n[r["part"]] = r["n"]
    starts = np.cumsum(n) - n
    if not len(n):
        return laid.drop(at).withColumn(name, F.lit(0).cast("long")), 0
    place = F.element_at(F.lit(starts.tolist()).cast("array<bigint>"), (part + 1).cast("int")) + F.col(at).bitwiseAND((1 << 33) - 1)
    return laid.withColumn(name, place).drop(at), int(n.sum())
