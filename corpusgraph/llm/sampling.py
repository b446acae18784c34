"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of


def id_remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % divisor


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, use: Column, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, text, label of at most bound labelled documents that satisfy use, chosen by a hash of the id.

    Rows without id or label are left out; a document labelled more than once has the largest label. The chosen labels
    are at most bound rows, so they are broadcast; their texts are written once.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & use)
    known = known.groupBy(F.col(id_col).cast("long").alias("key")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(bound)
    texts = docs.select(F.col(id_col).cast("long").alias("key"), text_of(text_col).alias("text"))
    return materialize(texts.join(F.broadcast(chosen), "key"))
