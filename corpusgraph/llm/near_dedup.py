"""Near-duplicate groups: MinHash signatures under a multi-index, verified on full shingle sets.

A document's set holds the hashes of its distinct runs of five words. Equal sets are merged first. A signature has b = 16
bits of each of several minima; it is cut into chunks of CHUNK symbols. By the pigeonhole principle two signatures that
differ in fewer than (LACK + 1) times as many symbols as there are chunks agree in one chunk but for LACK symbols; so
each chunk is indexed once for every choice of symbols to leave out, and all such pairs share a key. The number of
chunks makes it 1 in a million or less that two sets at the threshold share none.

So all pairs under the signature distance are candidates. Documents that share keys form families, joined through each
key's least member, so no key's pairs are listed. Families are then compared by their full sets, large ones in pairs of
blocks; a comparison returns a spanning forest of the true links, which is all that the components need. The distance of
two signatures is not asked for once more before the sets are compared: that could only lose links. Blocks are bounded in
documents and in shingles, and their pairs are dealt to tasks in turn, however large a group is.

Words are split at white space, A-Z lower-cased. A text with fewer than five words has one shingle, all its words; one
without words is linked with nothing. Null texts count as empty. Rows without id are linked with nothing and kept.
Repeated rows are equal sets; they have the same component. Very long texts count whole. An empty table gives an empty
result. Columns beside the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import distinct_per_row, materialize, mix, read_table, shingle_hashes, slices, text_of, word_hashes
from .components import components

WIDTH = 5
CHUNK = 5  # symbols
LACK = 1  # symbols that may differ in a chunk
MISS = 1e-6
BLOCK, LARGEST_BLOCK, BLOCKS = 250, 4000, 24  # documents in a block; blocks of a family until they grow
BLOCK_SHINGLES = 2_000_000  # shingles in a block, about, of documents that have fewer
DENSE = 8_000_000  # cells of a dense matrix
BROADCAST_IDS = 2_000_000  # ids that a broadcast may have; more are joined by a shuffle


def chunks_for(percent: int) -> int:
    """Chunks with which a pair of sets of this likeness shares a key but once in 1 / MISS."""
    p = percent / 100
    agree = sum(math.comb(CHUNK, k) * (1 - p) ** k * p ** (CHUNK - k) for k in range(LACK + 1))
    return max(1, math.ceil(math.log(MISS) / math.log(1 - agree))) if agree < 1 else 1


def text_sets(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct shingle hashes, bounds) of slices of a batch."""
    for first, end, data, offsets in slices(batch, column):
        yield first, end, *distinct_per_row(*shingle_hashes(*word_hashes(data, offsets), WIDTH))


def signatures(values: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """16 bits of each of size minima, for the rows that have values."""
    rng = np.random.default_rng(1913)
    multipliers = rng.integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    masks = rng.integers(1, 2**63, size, dtype=np.uint64)
    starts = bounds[:-1][bounds[:-1] < bounds[1:]]
    out = np.empty((len(starts), size), np.uint16)
    if len(starts):
        for k in range(size):
            out[:, k] = mix(np.minimum.reduceat((values ^ masks[k]) * multipliers[k], starts)) & np.uint64(0xFFFF)
    return out


def signed(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, set_hash, signature (both null for an empty set)."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, values, bounds in text_sets(batch, "text"):
                counts = np.diff(bounds)
                rows = iter(signatures(values, bounds, size))
                hashes = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in itertools.pairwise(bounds)]
                made = [next(rows).tobytes() if n else None for n in counts]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, end - first), pa.array(counts, pa.int64()), pa.array(hashes, pa.binary()), pa.array(made, pa.binary())], names=["id", "n_shingles", "set_hash", "signature"])

    return slim.mapInArrow(run, "id long, n_shingles long, set_hash binary, signature binary")


def index_keys(sets: DataFrame) -> DataFrame:
    """tag, key, node: one row for each chunk and choice of symbols to leave out."""
    choices = np.array(list(itertools.combinations(range(CHUNK), CHUNK - LACK)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            symbols = np.stack([np.frombuffer(x, np.uint16) for x in batch.column("signature").to_pylist()]).astype(np.uint64)
            chunks = symbols.reshape(len(symbols), -1, CHUNK)[:, :, choices]
            shift = np.uint64(16) * np.arange(CHUNK - LACK, dtype=np.uint64)
            keys = (chunks << shift).sum(axis=-1, dtype=np.uint64).reshape(len(symbols), -1)
            tags = np.tile(np.arange(keys.shape[1], dtype=np.int32), len(keys))
            nodes = np.repeat(batch.column("node").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(tags), pa.array(keys.reshape(-1).view(np.int64)), pa.array(nodes)], names=["tag", "key", "node"])

    return sets.select("node", "signature").mapInArrow(run, "tag int, key long, node long")


def linked_forest(values: np.ndarray, bounds: np.ndarray, block: np.ndarray, across: bool, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of sets (across: of two blocks only) whose likeness is at least percent.

    Shingles that several sets hold are columns of dense 0-1 matrices, a part of them at a time; a product of these counts
    what two sets share. Only the counts of all pairs, two bytes or four each, are kept.
    """
    n, sizes = len(bounds) - 1, np.diff(bounds)
    _, place, count = np.unique(values[bounds[0] : bounds[-1]], return_inverse=True, return_counts=True)
    column = np.full(len(count), -1)
    column[count > 1] = np.arange(np.count_nonzero(count > 1))
    rows, columns = np.repeat(np.arange(n), sizes), column[place]
    rows, columns = rows[columns >= 0], columns[columns >= 0]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    low = block == block.min()
    left, right = (np.flatnonzero(low), np.flatnonzero(~low)) if across else (np.arange(n),) * 2
    if not len(left) or not len(right):
        return []
    shared = np.zeros((len(left), len(right)), np.float32)
    step = max(1, DENSE // n)
    for at in range(0, int(columns[-1]) + 1 if len(columns) else 0, step):
        a, b = np.searchsorted(columns, [at, at + step])
        part = np.zeros((n, min(step, int(columns[-1]) + 1 - at)), np.float32)
        part[rows[a:b], columns[a:b] - at] = 1
        for k in range(0, len(left), 500):
            shared[k : k + 500] += part[left[k : k + 500]] @ part[right].T
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    forest = []
    for k, x in enumerate(left.tolist()):
        both = shared[k].astype(np.int64)
        for y in right[100 * both >= percent * (sizes[x] + sizes[right] - both)].tolist():
            if x != y and (p := top(x)) != (q := top(y)):
                root[p] = q
                forest.append((x, y))
    return forest


def verified_links(docs: DataFrame, members: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """a, b: a spanning forest, by full sets, of each family's links. members: node, rep, set_hash, n_shingles, family."""
    members = materialize(members)
    sizes = members.groupBy("family").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("shingles")).where("size > 1")
    block_size = F.least(F.greatest(F.lit(BLOCK), F.ceil(F.col("size") / BLOCKS)), F.lit(LARGEST_BLOCK))
    blocks = F.greatest(F.ceil(F.col("size") / block_size), F.least("size", F.ceil(F.col("shingles") / BLOCK_SHINGLES))).cast("int")
    placed = members.join(materialize(sizes.select("family", blocks.alias("blocks"))), "family").drop("n_shingles")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = materialize(placed)
    if placed.count() <= BROADCAST_IDS:
        placed = F.broadcast(placed)
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), text_of(text_col).alias("text")).join(placed, "rep")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("low"), F.greatest("block", k).alias("high")))
    units = texts.withColumn("unit", F.explode(others))
    turn = F.expr("(unit.high * (unit.high + 1L)) div 2 + unit.low")  # pairs of blocks of a family one after the other
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = F.pmod(F.xxhash64("family") % 1_000_003 + turn, F.lit(parts)).cast("int")
    units = units.repartitionById(parts, dealt).select("family", "unit.low", "unit.high", "block", "node", "set_hash", "text").sortWithinPartitions("family", "low", "high")

    def compare(rows: pa.Table) -> list[tuple[int, int]]:
        """Links of complete units."""
        unit = np.stack([rows.column(c).to_numpy() for c in ("family", "low", "high")])
        node, block = rows.column("node").to_numpy(), rows.column("block").to_numpy()
        sets, expected = [], rows.column("set_hash").to_pylist()
        for batch in rows.to_batches():  # texts of over 2 GB stay in several
            for _, _, values, bounds in text_sets(batch, "text"):
                sets += [values[a:b] for a, b in itertools.pairwise(bounds)]
        right = np.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() == e for s, e in zip(sets, expected)])  # rows that share an id with another text
        cuts = np.flatnonzero(np.append(True, (unit[:, 1:] != unit[:, :-1]).any(axis=0)))
        found = []
        for a, b in itertools.pairwise([*cuts, rows.num_rows]):
            own = np.arange(a, b)[right[a:b]]
            own = own[np.unique(node[own], return_index=True)[1]]
            if len(own) > 1:
                bounds = np.concatenate([[0], np.cumsum([len(sets[k]) for k in own])])
                forest = linked_forest(np.concatenate([sets[k] for k in own]), bounds, block[own], unit[1, a] != unit[2, a], percent)
                found += [(int(node[own[x]]), int(node[own[y]])) for x, y in forest]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units may go on in the next batch: the last one of a batch waits for it."""
        waiting: list[pa.RecordBatch] = []

        def give(rows: pa.Table) -> pa.RecordBatch:
            found = compare(rows) if rows.num_rows else []
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("family", "low", "high")])
            start = int(np.argmax((keys == keys[:, -1:]).all(axis=0)))
            done, rest = batch.slice(0, start), batch.slice(start)
            if waiting and start == 0 and all(waiting[-1].column(c)[-1].as_py() == keys[k, 0] for k, c in enumerate(("family", "low", "high"))):
                waiting.append(batch)
                continue
            yield give(pa.Table.from_batches([*waiting, done], batch.schema))
            waiting = [rest]
        if waiting:
            yield give(pa.Table.from_batches(waiting))

    return units.mapInArrow(run, "a long, b long")


def _judged(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """near_duplicates with set_hash and root, the group's least node (both null for an empty set)."""
    size = CHUNK * chunks_for(percent)
    all_sets = materialize(signed(docs, size, id_col, text_col))
    some = all_sets.where("n_shingles > 0 and id is not null")
    best = some.groupBy("set_hash").agg(F.min(F.struct("id", "signature")).alias("least"), F.max("n_shingles").alias("n_shingles"))
    sets = materialize(best.select(F.monotonically_increasing_id().alias("node"), "set_hash", F.col("least.id").alias("rep"), F.col("least.signature").alias("signature"), "n_shingles"))
    keys = index_keys(sets)
    hubs = materialize(keys.groupBy("tag", "key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n"))
    stars = keys.join(hubs, ["tag", "key"]).where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    families = components(stars)
    members = sets.select("node", "set_hash", "rep", "n_shingles").join(families.withColumnRenamed("root", "family"), "node")
    links = materialize(verified_links(docs, members, percent, id_col, text_col))
    groups = components(links)
    grouped = sets.select("node", "set_hash", "rep").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    grouped = materialize(grouped.select("set_hash", "rep", "root"))
    least = materialize(grouped.groupBy("root").agg(F.min("rep").alias("component_id")))
    named = materialize(grouped.join(least, "root").select("set_hash", "component_id", "root"))
    found = all_sets.select("id", "n_shingles", "set_hash").join(named, "set_hash", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), "set_hash", "root")


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept: groups linked by 100 * intersection >= percent * union of shingle sets."""
    return _judged(docs, percent, id_col, text_col).drop("set_hash", "root")


@F.pandas_udf(T.BinaryType())
def _set_hash(texts: pd.Series) -> pd.Series:
    """As signed gives it."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    return pd.Series([hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None for _, _, values, bounds in text_sets(batch, "text") for a, b in itertools.pairwise(bounds)], dtype=object)


def drop_near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, that of the least id, with all its columns; of equal rows one.

    Where different texts share an id, each is judged by its own set; of those of one group under the least id, that with the
    least set hash stays.
    """
    judged = materialize(_judged(docs, percent, id_col, text_col))
    gone = judged.where("not kept").select(F.col(id_col).alias("_gone")).distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    shared = materialize(judged.groupBy(F.col(id_col).alias("_id")).count().where("count > 1 and _id is not null").select("_id"))
    if not shared.limit(1).count():
        return docs.join(gone, F.col(f"`{id_col}`") == F.col("_gone"), "left_anti")
    doc_id = F.col(f"`{id_col}`")
    single = docs.join(shared, doc_id == F.col("_id"), "left_anti").join(gone, doc_id == F.col("_gone"), "left_anti")
    hashed = docs.join(shared, doc_id == F.col("_id"), "left_semi").withColumn("_set", _set_hash(text_of(text_col)))
    stay = judged.where("kept and root is not null").join(shared, F.col(id_col) == F.col("_id"), "left_semi").groupBy(F.col(id_col).alias("_id"), "root").agg(F.min("set_hash").alias("_kept"))
    empty = hashed.where("_set is null").dropDuplicates([id_col, text_col])
    full = hashed.join(stay.select("_id", "_kept"), (doc_id == F.col("_id")) & (F.col("_set") == F.col("_kept")), "left_semi").dropDuplicates([id_col, "_set"])
    return single.unionByName(empty.unionByName(full).drop("_set"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), 85)


OP7_SQL = f"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < {WIDTH} then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - {WIDTH} + 2), lambda k: array_to_string(w[k : k + {WIDTH - 1}], ' '))) end as s from worded
), shingles as (
  select doc_id, len(s) as n, unnest(s) as x from sets
), pairs as (
  select a.doc_id as a, b.doc_id as b, any_value(a.n) + any_value(b.n) as total, count(*) as shared
  from shingles a join shingles b on a.x = b.x and a.doc_id < b.doc_id group by all
), links as (
  select a, b from pairs where 100 * shared >= 85 * (total - shared)
), edges as (
  select a, b from links union all select b, a from links
), reached as (
  select doc_id as a, doc_id as b from sets union select r.a, e.b from reached r join edges e on r.b = e.a
), named as (
  select a as doc_id, min(b) as component_id from reached group by a
)
select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept from sets join named using (doc_id)
"""
