"""Documents that contain benchmark items, by size-partitioned MinHash containment search.

Items are parted by size, so that all of a class keep sketches of one size: the s smallest hashes of an item's shingles
with s one more than the shingles a qualifying document may lack. So a document that holds the required share of an
item's shingles holds at least one of its sketch, whatever the document's length: no pair is missed. Documents look
their shingles up in the sketches; the pairs found are verified on the words of all of the item's shingles.

Words are runs of letters, digits and underscores, lower-cased. An item with fewer than WIDTH words is one shingle: all
its words, to be found side by side. Null and empty texts, and items without words, match nothing. Repeated documents
and items are matched one by one (rows of equal ids give equal pairs), null ids too. Very long texts are read whole. An
empty table of documents or items gives an empty result. Columns beside ids and texts are not read, whatever their names.
Items are handled in blocks of bounded size: the driver holds one block at a time, broadcasts it, has it held against all
documents, writes what it finds and releases it, so a benchmark of any size fits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, mix, read_table, text_of

WIDTH = 5
SHARE = 0.8
BLOCK_BYTES = 8 << 20  # item text in one block
WORD = re.compile(r"\w+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_keys(ids: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of width word numbers."""
    out = np.zeros(max(len(ids) - width + 1, 0), np.uint64)
    for k in range(width):
        out = (out + ids[k : len(ids) - width + 1 + k].astype(np.uint64)) * _STEP
        out ^= out >> np.uint64(32)
    return mix(out)


def allowed_lack(n: int, share: float) -> int:
    """How many of n shingles a document may lack and still hold the share."""
    return n - math.ceil(share * n - 1e-9)


class Index:
    """Sketches of a block of items by shingle width, and the items' shingles for the verification."""

    def __init__(self, items: list[tuple[int, str]], width: int = WIDTH, share: float = SHARE):
        self.number: dict[str, int] = {}
        self.items: list[tuple[int, int, np.ndarray]] = []
        self.share = share
        kept: dict[int, list[tuple[np.ndarray, int]]] = {}
        for key, text in items:
            words = WORD.findall(text.lower())
            if not words:
                continue
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words])
            w = min(width, len(words))
            shingles = np.unique(np.lib.stride_tricks.sliding_window_view(ids, w), axis=0)
            class_top = (1 << len(shingles).bit_length()) - 1  # sizes up to the next power of two share a sketch size
            size = min(allowed_lack(class_top, share) + 1, len(shingles))
            hashes = np.sort(np.concatenate([shingle_keys(s, w) for s in shingles]))
            kept.setdefault(w, []).append((hashes[:size], len(self.items)))
            self.items.append((key, w, shingles))
        self.sketches = {}
        for w, parts in kept.items():
            hashes = np.concatenate([h for h, _ in parts])
            owners = np.concatenate([np.full(len(h), k) for h, k in parts])
            order = np.argsort(hashes, kind="stable")
            self.sketches[w] = (hashes[order], owners[order])

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """(item, its shingles, how many of them the text holds) of the items of which it holds the share."""
        get = self.number.get
        ids = np.array([get(w, 0) for w in WORD.findall(text.lower())], np.int64)
        if not ids.any():
            return []
        out = []
        for w, (hashes, owners) in self.sketches.items():
            clean = np.flatnonzero(np.convolve(ids == 0, np.ones(w, int), "valid") == 0) if len(ids) >= w else np.zeros(0, int)
            if not len(clean):
                continue
            windows = np.lib.stride_tricks.sliding_window_view(ids, w)[clean]
            keys = np.unique(shingle_keys(ids, w)[clean])
            low = np.searchsorted(hashes, keys, "left")
            high = np.searchsorted(hashes, keys, "right")
            found = {int(k) for a, b in zip(low[high > low], high[high > low]) for k in owners[a:b]}
            if not found:
                continue
            held = set(map(tuple, windows.tolist()))
            for k in sorted(found):
                key, _, shingles = self.items[k]
                shared = sum(tuple(s) in held for s in shingles.tolist())
                if len(shingles) - shared <= allowed_lack(len(shingles), self.share):
                    out.append((key, len(shingles), shared))
        return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """Blocks of items of at most block_bytes of text, or one item, each when it is asked for; and whether it is the last."""
    block, size = [], 0
    for r in items.select(F.col(id_col).alias("k"), text_of(text_col).alias("t")).distinct().orderBy("k", "t").toLocalIterator():
        if size and size + len(r["t"]) > block_bytes:
            yield block, False
            block, size = [], 0
        block.append((r["k"], r["t"]))
        size += len(r["t"])
    yield block, True


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, item, n_shingles, n_shared, containment: all pairs where the document holds at least the share of the item's shingles."""
    context = docs.sparkSession.sparkContext
    slim = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    schema = T.StructType([slim.schema[id_col], T.StructField("item_id", items.schema[item_id].dataType), *(T.StructField(c, T.LongType()) for c in ("n_shingles", "n_shared"))])

    def against(index) -> DataFrame:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = index.value
            for batch in batches:
                rows, found = [], []
                for row, text in enumerate(batch.column(1).to_pylist()):
                    for hit in known.search(text):
                        rows.append(row)
                        found.append(hit)
                item, n, shared = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(item, kinds[1]), pa.array(n, pa.int64()), pa.array(shared, pa.int64())], names=schema.names)

        return slim.mapInArrow(run, schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema).types
    found = []
    for block, last in item_blocks(items, item_id, item_text, block_bytes):
        index = context.broadcast(Index(block, WIDTH, share))  # block_bytes of text
        found.append(against(index))
        if not last:
            found[-1] = materialize(found[-1])
            index.destroy()
    pairs = reduce(DataFrame.unionAll, found)
    return pairs.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    context = docs.sparkSession.sparkContext
    for block, last in item_blocks(items, item_id, item_text, block_bytes):
        index = context.broadcast(Index(block, WIDTH, share))
        holds = F.pandas_udf(lambda texts, index=index: texts.map(lambda x: bool(index.value.search(x))), T.BooleanType())
        docs = docs.where(~holds(text_of(text_col)))
        if not last:
            docs = materialize(docs)
            index.destroy()
    return docs


def op5_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).distinct()


OP5_SQL = f"""
with worded as (
  select 'd' as kind, doc_id as id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') as w from documents
  union all
  select 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') from benchmark
), items as (
  select id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - {WIDTH} + 2, 2)), lambda k: array_to_string(w[k : k + {WIDTH - 1}], ' ')))) as s,
    least(len(w), {WIDTH}) as width
  from worded where kind = 'i' and len(w) > 0
), sized as (
  select *, count(*) over (partition by id) as n from items
), docs as (
  select distinct id, width, unnest(list_distinct(list_transform(range(1, len(w) - width + 2), lambda k: array_to_string(w[k : k + width - 1], ' ')))) as s
  from worded, (select distinct width from items) where kind = 'd' and len(w) >= width
)
select docs.id as doc_id, sized.id as item_id, any_value(n) as n_shingles, count(*) as n_shared, count(*) / any_value(n) as containment
from docs join sized using (s, width) group by all having count(*) * 100 >= {round(SHARE * 100)} * any_value(n)
"""
