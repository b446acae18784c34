"""Views for readers: recaps without spoilers, themes, who appears with whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import check_missing_reverse
from .graph import neighbors


def recap_scope(chapters: DataFrame, edges: DataFrame, cursors: DataFrame, beats: DataFrame | None = None) -> DataFrame:
    """book, kind (chapter, character, beat, error), item: what lies before each book's cursor; a chapter or beat without number
    is an error row. beats, the plot notes: book, up_to_chapter, beat."""
    known = chapters.join(cursors.groupBy("book").agg(F.min("cursor").alias("cursor")), "book")  # one row a book; Spark broadcasts it if it is small
    read = known.where("number < cursor").select("book", "chapter").distinct()
    broken = known.where("number is null").select("book", F.lit("error").alias("kind"), F.col("chapter").alias("item"))
    who = read.join(edges.where("type = 'features'").select(F.col("src").alias("chapter"), F.col("dst").alias("item")), "chapter").select("book", F.lit("character").alias("kind"), "item").distinct()
    scope = read.select("book", F.lit("chapter").alias("kind"), F.col("chapter").alias("item")).union(who).union(broken)
    if beats is None:
        return scope
    told = beats.join(cursors.groupBy("book").agg(F.min("cursor").alias("cursor")), "book").where("up_to_chapter is null or up_to_chapter < cursor")
    return scope.union(told.select("book", F.when(F.col("up_to_chapter").isNull(), "error").otherwise("beat"), "beat").distinct())


def promote_themes(edges: DataFrame, least: int = 2) -> DataFrame:
    """theme, chapters, status (promoted, pending)."""
    counted = edges.where("type = 'tagged_with'").groupBy(F.col("dst").alias("theme")).agg(F.countDistinct("src").alias("chapters"))
    return counted.withColumn("status", F.when(F.col("chapters") >= least, "promoted").otherwise("pending"))


HEAVY = 1000  # characters of a chapter from which on its pairs are dealt to blocks of about so many


def _in_blocks(who: DataFrame, heavy: int) -> DataFrame:
    """who (chapter, character) with blocks, the number of its chapter's blocks (1 for most), and block."""
    sizes = who.groupBy("chapter").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select("chapter", F.ceil(F.col("n") / heavy).cast("int").alias("blocks"))
    dealt = who.join(sizes, "chapter", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return dealt.withColumn("block", F.pmod(F.xxhash64("character"), F.col("blocks")).cast("int"))


def _characters(edges: DataFrame) -> DataFrame:
    return edges.where("type = 'features'").select(F.col("src").alias("chapter"), F.col("dst").alias("character")).distinct()


def theme_characters(edges: DataFrame, least: int = 2, heavy: int = HEAVY) -> DataFrame:
    """theme, character, chapters: characters in at least so many chapters of a theme. A chapter with more than heavy
    characters is dealt to blocks, and its themes go to each."""
    who = _in_blocks(_characters(edges), heavy)
    tagged = edges.where("type = 'tagged_with'").select(F.col("src").alias("chapter"), F.col("dst").alias("theme")).distinct()
    large = who.where("blocks > 1").select("chapter", "blocks").distinct()
    tagged = tagged.join(large, "chapter", "left").withColumn("block", F.explode(F.expr("sequence(0, coalesce(blocks, 1) - 1)"))).drop("blocks")
    return tagged.join(who, ["chapter", "block"]).groupBy("theme", "character").agg(F.count("*").alias("chapters")).where(F.col("chapters") >= least)


def cooccurrence(edges: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """a, b, chapters: pairs of characters that share chapters, once for each pair.

    A chapter with more than heavy characters is dealt to blocks; each pair of blocks is a cell of its own, in which the
    characters of the one meet those of the other, so no task sees all pairs of a chapter.
    """
    who = _in_blocks(_characters(edges), heavy).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cells = who.select("chapter", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "character")
    x, y = cells.withColumnsRenamed({"character": "a", "block": "_x"}), cells.withColumnsRenamed({"character": "b", "block": "_y"})
    met = x.join(y, ["chapter", "i", "j"]).where((F.col("a") < F.col("b")) & ((F.col("i") == F.col("j")) | (F.col("_x") != F.col("_y"))))
    return met.groupBy("a", "b").agg(F.count("*").alias("chapters"))


def topic_candidates(edges: DataFrame, seeds: DataFrame, k: int = 10) -> DataFrame:
    """kind (sources, concepts), neighbor, links: the notes next to the seeds, the best k of each kind."""
    from .discovery import cap_new

    near = neighbors(edges, seeds).join(seeds.select(F.col("slug").alias("neighbor")), "neighbor", "left_anti")
    counted = near.withColumn("kind", F.substring_index("neighbor", "/", 1)).where("kind in ('sources', 'concepts')").groupBy("kind", "neighbor").agg(F.count("*").alias("links"))
    return cap_new(counted, k, ["kind"], [F.desc("links"), "neighbor"])


def missing_appearances(edges: DataFrame) -> DataFrame:
    """Findings: features edges whose character does not appear in the chapter."""
    return check_missing_reverse(edges).where("message like '% appears_in %'")
