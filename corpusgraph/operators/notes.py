"""Notes: metadata, links, fences, identity; and link resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import once
from ..plans.schema import ENTITY_TYPES

# The shapes of links and numbers, and the mark of a catalog.
LINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
CATALOG_MARK = "<!-- catalog"


def _lines(text: Column) -> Column:
    """Lines with their numbers and fence marks: struct(n, line, mark, length)."""
    mark = lambda s: F.regexp_extract(s, r"^\s*(`{3,}|~{3,})", 1)
    return F.transform(F.split(text, "\n"), lambda s, i: F.struct((i + 1).alias("n"), s.alias("line"), mark(s).alias("mark")))


def _with_fences(lines: Column) -> Column:
    """Lines with fenced: a block ends with the same sign, at least as long; an open one goes on to the end.

    Only the fence lines are folded, to spans of lines; each line then asks the spans.
    """
    spans = "array<struct<a:int,b:int>>"
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("at"), F.array().cast(spans).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        is_open = acc["open"] != ""
        closes = is_open & (F.substring(x["mark"], 1, 1) == F.substring(acc["open"], 1, 1)) & (F.length(x["mark"]) >= F.length(acc["open"])) & F.trim(x["line"]).rlike(r"^(`+|~+)$")
        after = F.when(closes, F.lit("")).when(is_open, acc["open"]).otherwise(x["mark"])
        span = F.struct(acc["at"].alias("a"), x["n"].cast("int").alias("b"))
        return F.struct(after.alias("open"), F.when(is_open, acc["at"]).otherwise(x["n"].cast("int")).alias("at"), F.when(closes, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        rest = F.struct(acc["at"].alias("a"), F.lit(2**31 - 1).alias("b"))
        return F.when(acc["open"] != "", F.array_append(acc["out"], rest)).otherwise(acc["out"])

    fences = F.aggregate(F.filter(lines, lambda x: x["mark"] != ""), start, step, finish)
    return once(fences, lambda f: F.transform(lines, lambda x: F.struct(x["n"].cast("int").alias("n"), x["line"].alias("line"), F.exists(f, lambda s: (s["a"] <= x["n"]) & (x["n"] <= s["b"])).alias("fenced"))))


def note_lines(notes: DataFrame, text_col: str = "content") -> DataFrame:
    """path, line_no, line, fenced."""
    return notes.select("path", F.inline(once(_lines(F.col(text_col)), _with_fences)).alias("line_no", "line", "fenced"))


def mask_code_fences(notes: DataFrame, text_col: str = "content") -> DataFrame:
    """notes with the lines of fenced blocks blanked; the number of lines stays."""
    kept = F.transform(once(_lines(F.col(text_col)), _with_fences), lambda x: F.when(x["fenced"], F.lit("")).otherwise(x["line"]))
    return notes.withColumn(text_col, F.array_join(kept, "\n"))


def extract_links(notes: DataFrame, text_col: str = "content") -> DataFrame:
    """src_path, line_no, raw_target, in_fence: every wikilink."""
    lines = note_lines(notes.where(F.col(text_col).contains("[[")), text_col).where(F.col("line").contains("[["))
    return lines.select(F.col("path").alias("src_path"), "line_no", F.explode(F.regexp_extract_all("line", F.lit(LINK), F.lit(1))).alias("raw_target"), F.col("fenced").alias("in_fence")).withColumn("raw_target", F.trim("raw_target"))


def extract_catalog_refs(index_notes: DataFrame, text_col: str = "content") -> DataFrame:
    """target: wikilinks and [text](path) after the catalog mark, or in all of a text without one."""
    at = F.instr(text_col, CATALOG_MARK)
    text = F.when(at > 0, F.expr(f"substring({text_col}, instr({text_col}, '{CATALOG_MARK}'))")).otherwise(F.col(text_col))
    wiki = F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)), lambda x: F.trim(x))
    plain = F.transform(F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)]+)\)"), F.lit(1)), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^\./", ""), r"\.md$", ""))
    return index_notes.select(F.explode(F.concat(wiki, plain)).alias("target")).distinct()


def _value(raw: Column) -> Column:
    """A scalar or list as struct(kind, str, num, items, entries)."""
    bare = F.regexp_replace(F.regexp_replace(raw, r'^"(.*)"$', "$1"), r"^'(.*)'$", "$1")
    items = F.filter(F.transform(F.split(F.regexp_extract(raw, r"^\[(.*)\]$", 1), ","), lambda x: F.regexp_replace(F.trim(x), r"""^["']|["']$""", "")), lambda x: x != "")
    kind = F.when(raw == "", "null").when(raw.rlike(r"^\[.*\]$"), "array").when(raw == "{}", "object").when(raw.rlike(NUMBER), "number").otherwise("string")
    return F.struct(kind.alias("kind"), F.when(kind == "string", bare).alias("str"), F.when(kind == "number", raw.try_cast("double")).alias("num"), F.when(kind == "array", items).alias("items"))


def extract_fields(notes: DataFrame, text_col: str = "content") -> DataFrame:
    """path, key, kind, str, num, items, entries: the metadata block in long form.

    A key's value stands behind it, or below it as indented items or entries. Lines are put under their key within the
    block's own array, so no window is needed.
    """
    block = F.regexp_extract(text_col, r"\A---\r?\n(?s:(.*?))\r?\n---(?:\r?\n|\z)", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda s: ~s.rlike(r"^\s*(#|$)"))
    # Only the lines with a key are looked for; a key's list is the slice of lines up to the next one.
    key_of = lambda s: F.regexp_extract(s, r"^([A-Za-z0-9_-]+):", 1)
    at = F.filter(F.transform("lines", lambda s, i: F.when(key_of(s) != "", i + 1)), lambda i: i.isNotNull())
    ends = F.concat(F.slice("at", 2, F.size("at")), F.array(F.size("lines") + 1))
    below = lambda a, b: F.transform(F.slice("lines", a + 1, b - a - 1), lambda s: F.trim(s))
    entry = lambda a, b: F.struct(key_of(F.element_at("lines", a)).alias("key"), F.trim(F.regexp_extract(F.element_at("lines", a), r"^[A-Za-z0-9_-]+:\s*(.*)$", 1)).alias("raw"), below(a, b).alias("below"))
    parted = notes.where(F.col(text_col).startswith("---")).select("path", lines.alias("lines")).withColumn("at", at).where(F.size("at") > 0)
    rows = parted.select("path", F.inline(F.zip_with("at", ends, entry)).alias("key", "raw", "below"))
    own = rows.withColumn("v", _value(F.col("raw")))
    strip = lambda x: F.regexp_replace(F.trim(x), r"""^["']|["']$""", "")
    listed = F.transform(F.filter("below", lambda x: x.startswith("- ")), lambda x: strip(F.regexp_replace(x, "^- ", "")))
    mapped = F.map_from_entries(F.transform(F.filter("below", lambda x: x.rlike("^[^-:][^:]*:")), lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]+):", 1)).alias("key"), strip(F.regexp_extract(x, r"^[^:]+:\s*(.*)$", 1)).alias("value"))))
    empty = (F.col("raw") == "") & (F.size("below") > 0)
    is_list = empty & F.coalesce(F.try_element_at("below", F.lit(1)).startswith("- "), F.lit(False))
    kind = F.when(is_list, "array").when(empty, "object").otherwise(F.col("v.kind"))
    return own.select("path", "key", kind.alias("kind"), F.col("v.str").alias("str"), F.col("v.num").alias("num"), F.when(is_list, listed).otherwise(F.col("v.items")).alias("items"), F.when(empty & ~is_list, mapped).alias("entries"))


def derive_note_identity(notes: DataFrame, fields: DataFrame, text_col: str = "content") -> DataFrame:
    """path, id, type, title, created: what the note's place, text and older keys imply."""
    old = fields.where(F.col("key").isin("slug", "date_added")).groupBy("path").agg(F.max(F.when(F.col("key") == "slug", F.col("str"))).alias("old_slug"), F.max(F.when(F.col("key") == "date_added", F.col("str"))).alias("old_date"))
    heading = note_lines(notes, text_col).where(~F.col("fenced") & F.col("line").rlike(r"^#\s+\S")).groupBy("path").agg(F.min(F.struct("line_no", "line")).alias("h")).select("path", F.trim(F.regexp_replace("h.line", r"^#\s+", "")).alias("h1"))
    own = notes.join(old, "path", "left").join(heading, "path", "left")
    nested = F.col("entity_type").isin("readings", "chapters", "characters", "themes", "plot")
    key = F.when(nested, F.col("path")).when(F.col("entity_type") == "reflections", F.concat(F.lit("reflection-"), "basename")).otherwise(F.coalesce("old_slug", "basename"))
    label = F.when(F.col("entity_type") == "people", "person").otherwise(F.regexp_replace("entity_type", "s$", ""))
    return own.select("path", key.alias("id"), label.alias("type"), F.coalesce("h1", F.initcap(F.translate("basename", "-", " "))).alias("title"), F.coalesce(F.when(F.col("old_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("old_date")), F.date_format("modified_at", "yyyy-MM-dd")).alias("created"))


def list_notes(notes: DataFrame, type: str | None = None, prefix: str | None = None) -> DataFrame:
    if type:
        notes = notes.where(F.col("entity_type") == type)
    return notes.where(F.col("path").startswith(prefix)) if prefix else notes


def changed_since(notes: DataFrame, day: str, column: str = "updated") -> DataFrame:
    """Notes with an update on or after a day (YYYY-MM-DD)."""
    import re

    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", day):
        raise ValueError(f"not a day: {day}")
    return notes.where(F.col(column) >= day)


def basename_index(notes: DataFrame, most: int = 1000) -> DataFrame:
    """basename, part, slugs (sorted): a basename of more than most notes has several parts, none with more than that."""
    own = notes.select("basename", "slug").distinct()
    large = own.groupBy("basename").agg(F.count("*").alias("n")).where(F.col("n") > most).select("basename", F.ceil(F.col("n") / most).alias("_parts"))
    dealt = own.join(large, "basename", "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("slug"), F.col("_parts")), F.lit(0).cast("long")))
    one = dealt.where("_parts is null").select("basename", "_part", F.lit(0).cast("long").alias("_turn"), "slug")
    turn = F.floor((F.row_number().over(Window.partitionBy("basename", "_part").orderBy("slug")) - 1) / most)
    many = dealt.where("_parts is not null").select("basename", "_part", turn.alias("_turn"), "slug", "_parts")
    parts = one.groupBy("basename", F.lit(0).cast("long").alias("part")).agg(F.sort_array(F.collect_list("slug")).alias("slugs"))
    return parts.unionByName(many.groupBy("basename", (F.col("_part") + F.col("_turn") * F.col("_parts")).alias("part")).agg(F.sort_array(F.collect_list("slug")).alias("slugs")))


def resolve_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """links with resolved (slug or null) and how: exact (.md ignored), else a basename that only one note has."""
    bare = links.withColumn("_bare", F.regexp_replace(F.trim("raw_target"), r"\.md$", "")).withColumn("_base", F.substring_index("_bare", "/", -1))
    exact = notes.select(F.col("slug").alias("_bare"), F.col("slug").alias("_exact"))
    single = notes.groupBy(F.col("basename").alias("_base")).agg(F.count("*").alias("_n"), F.min("slug").alias("_only")).where("_n = 1").drop("_n")
    joined = bare.join(exact, "_bare", "left").join(single, "_base", "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_only").isNotNull(), "basename")
    return joined.withColumn("resolved", F.coalesce("_exact", "_only")).withColumn("how", how).select(*links.columns, "resolved", "how")


def resolve_aliases(terms: DataFrame, foundations: DataFrame) -> DataFrame:
    """term, slug, source (slug, title, alias), ambiguous: case-folded; two pages or more are ambiguous; unmatched terms stay."""
    names = F.concat(F.array(F.struct(F.lit(0).alias("rank"), F.col("slug").alias("name")), F.struct(F.lit(1).alias("rank"), F.col("title").alias("name"))), F.transform(F.coalesce("aliases", F.array()), lambda a: F.struct(F.lit(2).alias("rank"), a.alias("name"))))
    named = foundations.select("slug", F.explode(names).alias("x")).select("slug", "x.rank", F.lower(F.trim("x.name")).alias("name")).groupBy("name", "slug").agg(F.min("rank").alias("rank"))
    found = terms.select("term").distinct().withColumn("name", F.lower(F.trim("term"))).join(named, "name", "left")
    best = found.groupBy("term").agg(F.min(F.struct("rank", "slug")).alias("b"), F.count("slug").alias("n"))
    source = F.element_at(F.array(F.lit("slug"), F.lit("title"), F.lit("alias")), F.col("b.rank") + 1)
    return best.select("term", F.col("b.slug").alias("slug"), F.when(F.col("b.slug").isNotNull(), source).alias("source"), (F.col("n") > 1).alias("ambiguous"))


def stale_mentions(removed_edges: DataFrame, links: DataFrame) -> DataFrame:
    """src, dst of removed edges whose one end still links to the other."""
    ends = removed_edges.select("src", "dst").union(removed_edges.select("dst", "src")).distinct()
    return ends.join(links.select(F.col("src_path").alias("src"), F.col("raw_target").alias("dst")).distinct(), ["src", "dst"])


def catalog_table(notes: DataFrame) -> DataFrame:
    """Ordered listing of all entity notes but reflections and reading notes."""
    types = [t for group in ENTITY_TYPES.values() for t in group if t not in ("reflections", "readings")]
    return notes.where(F.col("entity_type").isin(types)).orderBy("slug")


def type_coverage(notes: DataFrame, fields: DataFrame) -> DataFrame:
    """entity_type, confidence, n, with totals over either (null)."""
    own = notes.select("path", "entity_type").join(fields.where("key = 'confidence'").select("path", F.col("str").alias("confidence")), "path", "left")
    return own.cube("entity_type", "confidence").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))
