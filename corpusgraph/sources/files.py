"""Reading and writing the corpus: notes, edges, records, activity, documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import file_system, materialize

EDGE_SCHEMA = "`from` string, type string, `to` string, confidence string"
KINDS = (("pdf", "pdf"), ("docx", "document"), ("rtf", "document"), ("epub", "book"), ("html", "web"), ("htm", "web"), ("tex", "tex"), ("md", "text"), ("txt", "text"))


def scan_notes(spark: SparkSession, root: str) -> DataFrame:
    """path, slug, basename, entity_type, content, modified_at of all .md files below root; metadata comes with the scan."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    inside = F.regexp_replace(F.regexp_replace(F.expr("_metadata.file_path"), "^file:/+", "file:/"), "^" + full.replace("file:///", "file:/") + "/", "")
    slug = F.regexp_replace(F.url_decode(F.replace(inside, F.lit("+"), F.lit("%2B"))), r"\.md$", "")
    return read.select(slug.alias("path"), slug.alias("slug"), F.substring_index(slug, "/", -1).alias("basename"), F.when(slug.contains("/"), F.substring_index(slug, "/", 1)).alias("entity_type"), F.col("value").alias("content"), F.expr("_metadata.file_modification_time").alias("modified_at"))


def scan_edges(spark: SparkSession, path: str, mode: str = "lenient") -> DataFrame:
    """Edges of JSON lines, with seq, their places from 0 by file, and by line in a file, however Spark packs the files.

    lenient drops bad lines and lines without an end or a type, strict fails on bad ones. The edges are written once for that,
    as they are read: a line's place is its block's first one, from the counts of the blocks before it, and its place in the block.
    """
    how = {"lenient": "DROPMALFORMED", "strict": "FAILFAST"}[mode]
    read = spark.read.schema(EDGE_SCHEMA).option("mode", how).json(path)
    rows = read.select(F.col("from").alias("src"), "type", F.col("to").alias("dst"), "confidence", F.expr("_metadata.file_path").alias("_file"), F.expr("_metadata.file_block_start").alias("_block"))
    if mode == "lenient":
        rows = rows.where("src is not null and type is not null and dst is not null")
    # a block of a file is read by one task from its first line to its last, so the running id counts its lines without gaps
    laid = materialize(rows.withColumn("_line", F.monotonically_increasing_id()))
    blocks = laid.groupBy("_file", "_block").agg(F.min("_line").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file", "_block")) - F.col("_n")  # a row for each block
    starts = blocks.select("_file", "_block", (before - F.col("_first")).alias("_start"))
    return laid.join(F.broadcast(starts), ["_file", "_block"]).select((F.col("_line") + F.col("_start")).alias("seq"), "src", "type", "dst", "confidence")


def scan_discovered(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """JSON records below root; unreadable ones are skipped."""
    full = T.StructType.fromDDL(schema).add("_corrupt_record", T.StringType())
    read = spark.read.schema(full).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("columnNameOfCorruptRecord", "_corrupt_record").json(root)
    return read.where("_corrupt_record is null").drop("_corrupt_record")


def scan_activity(spark: SparkSession, path: str) -> DataFrame:
    """day, skill, session, details from headings `## [date] skill | session:hex | details`."""
    pattern = r"^## \[(\d{4}-\d{2}-\d{2})\] ([^|]+?)\s*\|\s*(?:session:([0-9a-f]+)\s*\|\s*)?(.*)$"
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    part = lambda k: F.nullif(F.regexp_extract("value", pattern, k), F.lit(""))
    return lines.select(F.try_to_date(part(1)).alias("day"), part(2).alias("skill"), part(3).alias("session"), part(4).alias("details"))


class Conflict(RuntimeError):
    """Another writer was first."""


def _last_commit(spark: SparkSession, path: str) -> int:
    """The number of the newest commit below path, 0 if there is none."""
    log, fs = file_system(spark, f"{path}/commits")
    return max((int(s.getPath().getName()) for s in (fs.listStatus(log) if fs.exists(log) else ())), default=0)


#: Edges that a task sorts at most when a set is written; they fit its memory, so a sort does not spill as the set grows.
SORTED_ROWS = 1_000_000


def _in_order(edges: DataFrame) -> DataFrame:
    """edges by seq, in as many ranges as keep each within SORTED_ROWS, or about so."""
    usual, rows = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), edges.select("seq").count()
    if rows <= usual * SORTED_ROWS:
        return edges.orderBy("seq")
    return edges.repartitionByRange(-(-rows // SORTED_ROWS), "seq").sortWithinPartitions("seq")


def write_edges(edges: DataFrame, path: str, after: int | None = None) -> int:
    """Write the whole set in order to a new version folder and commit it; returns the commit's number.

    A commit is a file with the next number that names the version. It is created only if no file has that number, and none
    is ever changed, so readers always find a whole set. Of two writers that start from the same commit (after; by
    default the newest when this is called) the second raises Conflict and leaves the set alone.
    """
    spark = edges.sparkSession
    number = (_last_commit(spark, path) if after is None else after) + 1
    version = f"v-{uuid.uuid4().hex}"
    _in_order(edges).select(F.col("src").alias("from"), "type", F.col("dst").alias("to"), "confidence").write.option("compression", "gzip").json(f"{path}/{version}")
    commit, fs = file_system(spark, f"{path}/commits/{number:020d}")
    named, _ = file_system(spark, f"{path}/{version}/commit-name")
    try:
        if _last_commit(spark, path) >= number:
            raise Conflict(f"commit {number} of {path} is there already")
        out = fs.create(named, True)
        out.write(bytearray(version, "ascii"))
        out.close()
        fs.mkdirs(commit.getParent())
        _create_new(spark, fs, named, commit)
    except Conflict:
        fs.delete(file_system(spark, f"{path}/{version}")[0], True)
        raise
    return number


def _create_new(spark: SparkSession, fs, named, commit) -> None:
    """Move a whole small file to a name that must be free: a rename that does not replace, which file systems do at once."""
    from py4j.protocol import Py4JJavaError

    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        context.rename(fs.makeQualified(named), fs.makeQualified(commit), options)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            raise Conflict(f"{commit.toString()} is there already") from e
        raise


def read_current_edges(spark: SparkSession, path: str) -> DataFrame:
    """The edges of the newest commit, in their order."""
    version = spark.read.text(f"{path}/commits/{_last_commit(spark, path):020d}").first()["value"]
    return scan_edges(spark, f"{path}/{version}/part-*.json*", "strict")


def write_discovered(records: DataFrame, root: str) -> int:
    """Append records (day, item_id, source, id, ...) that are not there yet; an existing one is never overwritten. Returns how many.

    Only the days and items of the new records are read of what is there: their folders are found before the join.
    """
    spark = records.sparkSession
    keys = ["day", "item_id", "source", "id"]
    where, fs = file_system(spark, root)
    new = materialize(records.dropDuplicates(keys))
    if fs.exists(where):
        there = spark.read.schema(records.schema).parquet(root).select(*keys)
        days = [r["day"] for r in new.select("day").distinct().collect()]  # a run writes few days
        new = materialize(new.join(there.where(F.col("day").isin(days)), keys, "left_anti"))
    new.write.partitionBy("day", "item_id").mode("append").parquet(root)
    return new.count()


def kind_of(name: Column) -> Column:
    """Document kind by extension."""
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.coalesce(*(F.when(extension == e, F.lit(k)) for e, k in KINDS), F.lit("other"))


def document_manifest(docs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """sha256, slug, kind, size, n_chars of documents (name, content), one a content; contents that exist already are left out."""
    hashed = docs.select(F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), kind_of(F.col("name")).alias("kind"), F.octet_length("content").alias("size"), F.length("content").alias("n_chars"))
    one = hashed.groupBy("sha256").agg(F.min(F.struct("kind", "size", "n_chars")).alias("x")).select("sha256", F.substring("sha256", 1, 16).alias("slug"), "x.kind", "x.size", "x.n_chars")
    return one if existing is None else one.join(existing.select("sha256"), "sha256", "left_anti")
