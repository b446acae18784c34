"""Streams: landed feed entries, new entries once, caps with a backlog, discovery and edge checks for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.checks import check_dangling_edges, check_missing_reverse
from ..operators.discovery import cap_new, dedup_keys, run_turns
from ..operators.graph import edges_touching, first_per_key
from ..sources.storage import materialize, scratch

ENTRY_SCHEMA = "feed_id string, id string, guid string, title string, link string, summary string, updated timestamp"
DAYS, MOST = 90, 5000


def with_guid(entries: DataFrame) -> DataFrame:
    """entries with a stable key: id, guid, link or title."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return entries.withColumn("entry_key", F.coalesce(some("id"), some("guid"), F.concat(F.lit("link:"), some("link")), F.concat(F.lit("title:"), some("title"))))


def stream_feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """A stream of landed JSON entries with their keys."""
    return with_guid(spark.readStream.schema(ENTRY_SCHEMA).json(path))


def stream_rejected(entries: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """The reject output of both forms of new entries: the rows without a time, as they came."""
    return entries.where("updated is null").writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()


def stream_new_entries(entries: DataFrame, days: int = DAYS) -> DataFrame:
    """Each key once for each feed; keys are forgotten after so many days. Entries without a time never pass the watermark: stream_rejected writes them."""
    return entries.where("updated is not null").withWatermark("updated", f"{days} days").dropDuplicatesWithinWatermark(["feed_id", "entry_key"])


STORE_KEY, STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENTRY, KNOWN = "feed_id string, entry_key string, updated timestamp", "keys array<string>, times array<long>"


def start_with_state(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a stream whose state is in RocksDB; a stream keeps the settings that it starts with."""
    before = spark.conf.get(STORE_KEY)
    spark.conf.set(STORE_KEY, STORE)
    try:
        return start()
    finally:
        spark.conf.set(STORE_KEY, before)


def _in_micros(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int]]:
    for frame in frames:
        yield from zip(frame["entry_key"].tolist(), frame["micros"].tolist())


def _rows(feed: str, entries: list[tuple[str, int]]) -> pd.DataFrame:
    keys, times = zip(*entries)
    return pd.DataFrame({"feed_id": [feed] * len(keys), "entry_key": keys, "micros": times})


def known_entries(days: int, most: int) -> Callable[[Any, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """An update of a feed's known keys with their newest times; the oldest go beyond days or most.

    They are one row of the store, most keys at most, which comes and goes with the feed's rows: a poll asks the store for
    nothing in between, as it would for each entry.
    """

    def update(key: Any, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first: dict[str, int] = {}
        last: dict[str, int] = {}
        for k, t in _in_micros(rows):
            first[k], last[k] = min(t, first.get(k, t)), max(t, last.get(k, t))
        known = dict(zip(*state.get)) if state.exists else {}
        new = sorted(((k, t) for k, t in first.items() if k not in known), key=lambda x: (x[1], x[0]))
        now = known | last
        oldest = max(now.values(), default=0) - days * 86_400_000_000
        kept = sorted(((k, t) for k, t in now.items() if t >= oldest), key=lambda x: (x[1], x[0]), reverse=True)[:most]
        state.update(([k for k, _ in kept], [t for _, t in kept]))
        if new:
            yield _rows(key[0], new)

    return update


def stream_new_entries_capped(entries: DataFrame, days: int = DAYS, most: int = MOST) -> DataFrame:
    """feed_id, entry_key, updated: each key once for each feed, as long as it is known.

    A feed knows at most so many keys, the newest, and none that is more days older than its newest one. A key that comes
    again after it was forgotten is new again. Start the stream by start_with_state.
    """
    slim = entries.where("updated is not null").select("feed_id", "entry_key", F.unix_micros("updated").alias("micros"))  # times of a feed go to Python and back as numbers
    new = slim.groupBy("feed_id").applyInPandasWithState(known_entries(days, most), "feed_id string, entry_key string, micros long", KNOWN, "append", GroupStateTimeout.NoTimeout)
    return new.select("feed_id", "entry_key", F.timestamp_micros("micros").alias("updated"))


def _table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def capped_batch(out: str, backlog: str, max_new: int) -> Callable[[DataFrame, int], None]:
    """A batch writer: emits at most max_new unseen entries of each feed; the others wait in the backlog for the next poll.

    Output and backlog are written by batch number, so a batch that is run again replaces what it wrote.
    """
    schema = "feed_id string, entry_key string, updated timestamp"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = _table(spark, out, schema + ", batch long").where(F.col("batch") < number)
        waiting = _table(spark, backlog, schema + ", batch long").where(F.col("batch") == number - 1).drop("batch")
        offered = batch.select("feed_id", "entry_key", "updated").unionByName(waiting)
        new = offered.groupBy("feed_id", "entry_key").agg(F.min("updated").alias("updated")).join(seen.select("feed_id", "entry_key"), ["feed_id", "entry_key"], "left_anti")
        new = materialize(new)
        now = cap_new(new, max_new, ["feed_id"], [F.desc("updated"), "entry_key"])
        rest = new.join(now.select("feed_id", "entry_key"), ["feed_id", "entry_key"], "left_anti")
        now.write.mode("overwrite").parquet(f"{out}/batch={number}")
        rest.write.mode("overwrite").parquet(f"{backlog}/batch={number}")

    return write


def stream_capped(entries: DataFrame, out: str, backlog: str, checkpoint: str, max_new: int) -> StreamingQuery:
    """A poll is a micro-batch; see capped_batch."""
    return entries.writeStream.foreachBatch(capped_batch(out, backlog, max_new)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def discovery_batch(out: str, backlog: str, max_new: int, order: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A batch writer: emits candidates with keys that are not stored yet, at most max_new of each item and source.

    Items are taken in the given order, others after them by name: earlier ones win a key, and what a cap leaves a later item
    may emit. The candidates that no item emits wait in the backlog for the next batch. Both are written by batch number.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = _table(spark, out, "dedup_key string, batch long").where(F.col("batch") < number).select("dedup_key")
        keyed = dedup_keys(batch)
        schema = T.StructType([*keyed.schema.fields, T.StructField("batch", T.LongType())])
        waiting = _table(spark, backlog, schema).where(F.col("batch") == number - 1).drop("batch")
        named = lambda df: df.withColumn("_item", F.coalesce("item", F.lit("")))
        offered = named(keyed.unionByName(waiting)).join(stored.distinct(), "dedup_key", "left_anti")
        offered = offered.withColumn("_source", F.coalesce("source", F.lit("")))
        offered = materialize(first_per_key(offered, ["_item", "_source", "dedup_key"], ["rank"]))
        place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("_item")), F.lit(0)) if order else F.lit(0)
        items = offered.select("_item").distinct().withColumn("_place", F.when(place > 0, place))
        items = items.select(F.col("_item").alias("item"), F.row_number().over(Window.orderBy(F.asc_nulls_last("_place"), "_item")).alias("pos"), F.lit(max_new).alias("max_new"))  # watch items are set by hand
        slim = offered.select(F.col("_item").alias("item"), F.col("_source").alias("source"), "rank", "dedup_key")
        none = slim.limit(0)
        new = run_turns(items, slim, none, none.select("dedup_key")).where("not cut").select(F.col("item").alias("_item"), F.col("source").alias("_source"), "dedup_key")
        now = materialize(offered.join(new, ["_item", "_source", "dedup_key"], "left_semi").select(*keyed.columns))
        now.write.mode("overwrite").parquet(f"{out}/batch={number}")
        offered.join(now.select("dedup_key"), "dedup_key", "left_anti").select(*keyed.columns).write.mode("overwrite").parquet(f"{backlog}/batch={number}")

    return write


def stream_discovery(candidates: DataFrame, out: str, checkpoint: str, max_new: int, backlog: str | None = None, order: list[str] | None = None) -> StreamingQuery:
    """New candidates by their keys against the stored ones; see discovery_batch. The backlog is beside the output unless named."""
    write = discovery_batch(out, backlog or f"{out.rstrip('/')}-backlog", max_new, order)
    return candidates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_edge_checks(changes: DataFrame, edges: DataFrame, notes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Missing reverses and dangling ends among the edges that touch changed notes (changes: slug)."""

    def write(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession) as keep:
            near = keep(edges_touching(edges, batch.select("slug")))  # written once for the checks; equal rows are still in it
            # a reverse may lie on edges of either end, which are all near
            found = check_missing_reverse(near, distinct=True).unionByName(check_dangling_edges(near, notes, distinct=True, keep=keep))
            found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
