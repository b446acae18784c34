"""Bulk repairs. Each returns the changed rows with old and new value; nothing is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug
from ..plans.schema import NAMESPACES, enum_defaults, field_defs
from ..sources.storage import materialize
from .checks import KEBAB, _present, value_is_valid
from .graph import few_slugs
from .notes import LINK, note_lines

# Which edges fill which array field: (entity type, key, edge type, direction); and of which kind of note the body's links may fill it.
ARRAY_EDGES = (
    *(("concepts", "key_sources", t, "out") for t in ("introduced_in", "used_in", "extended_in", "critiqued_in")),
    *(("concepts", "key_sources", t, "in") for t in ("introduces_concept", "uses_concept", "extends_concept", "critiques_concept")),
    ("concepts", "related_concepts", "related_to", "both"), ("people", "key_sources", "authored", "out"), ("people", "key_sources", "authored_by", "in"),
    ("topics", "key_sources", "includes_source", "out"), ("topics", "key_sources", "included_in_topic", "in"),
)
ARRAY_LINKS = (("key_sources", "sources"), ("related_sources", "sources"), ("related_concepts", "concepts"))


def fill_required(notes: DataFrame, note_fields: DataFrame, identity: DataFrame) -> DataFrame:
    """path, key, new_value: derived values for missing required keys (identity: path, id, type, title, created)."""
    spark = notes.sparkSession
    defs = field_defs(spark).where("required").join(enum_defaults(spark), ["entity_type", "key"], "left")
    missing = notes.select("path", "entity_type").join(F.broadcast(defs), "entity_type").join(note_fields.where(_present()).select("path", "key").distinct(), ["path", "key"], "left_anti")
    value = (
        F.when(F.col("field_type") == "array", "[]").when(F.col("field_type") == "object", "{}").when(F.col("field_type") == "iso-date", F.col("created"))
        .when(F.col("key") == "id", F.col("id")).when(F.col("key") == "title", F.col("title")).when(F.col("key") == "type", F.col("type")).when(F.col("field_type") == "enum", F.col("value"))
    )
    return missing.join(identity, "path", "left").select("path", "key", value.alias("new_value")).where("new_value is not null")


def _gathered(rows: DataFrame, name: str, by: tuple[str, ...] = ("path", "key")) -> DataFrame:
    """by and the distinct others in order. Repeats go by hash, in the tasks first, so no sets are kept and moved."""
    one = rows.select(*by, "other").distinct()
    return one.groupBy(*by).agg(F.sort_array(F.collect_list("other")).alias(name))


def rebuild_arrays(notes: DataFrame, note_fields: DataFrame, edges: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """path, key, items: arrays for array fields that hold something else. A scalar is wrapped. Nulls, blanks, TODO and empty
    objects are filled from the edges, else from the body's links (src_path, resolved, in_fence; not for reflections), else they
    are empty. notes are all notes: ends that are none of them, and the note itself, do not count."""
    spark = notes.sparkSession
    defs = F.broadcast(field_defs(spark).where("field_type = 'array'").select("entity_type", "key"))
    hollow = (F.col("kind") == "object") & (F.coalesce(F.size("entries"), F.lit(0)) <= 0) if "entries" in note_fields.columns else F.lit(False)
    bad = note_fields.where(~F.col("kind").isin("array", "object") | hollow).join(notes.select("path", "slug", "entity_type"), "path").join(defs, ["entity_type", "key"])
    bad = materialize(bad)  # three passes read these few rows
    blank = F.col("kind").isin("null", "object") | ((F.col("kind") == "string") & F.trim(F.coalesce("str", F.lit(""))).isin("", "TODO"))
    open_ = bad.where(blank).select("path", "slug", "entity_type", "key")
    rules = F.broadcast(spark.createDataFrame(list(ARRAY_EDGES), "entity_type string, key string, type string, direction string"))
    # an edge comes only from the end, or both, at which some rule asks for its type; an edge and its answer fill the same field
    # from one task, and go on as one row to the fields that are open, where they are gathered
    ways = F.array(*(F.struct(F.col(a).alias("slug"), F.col(b).alias("other"), F.lit(way).alias("way")) for a, b, way in (("src", "dst", "out"), ("dst", "src", "in"))))
    ends = edges.where(F.col("type").isin(*sorted({r[2] for r in ARRAY_EDGES}))).select("type", F.inline(ways))
    told = ends.join(rules, "type").where("(direction = 'both' or direction = way) and other <> slug").select("slug", "entity_type", "key", "other")
    # ends that are no notes are looked up once for each slug
    away = materialize(told.select(F.col("other").alias("slug")).distinct().join(notes.select("slug"), "slug", "left_anti"))
    field = ("slug", "entity_type", "key")
    near = told.join(few_slugs(away).withColumnRenamed("slug", "other"), "other", "left_anti").join(open_.select(*field).distinct(), [*field], "left_semi")
    filled = _gathered(near, "graph", field)
    bad = bad.join(filled, [*field], "left")
    body = F.lit(None).cast("array<string>")
    if links is not None:
        kinds = F.broadcast(spark.createDataFrame(list(ARRAY_LINKS), "key string, wanted string"))
        own = links.where(~F.col("in_fence") & F.col("resolved").isNotNull()).select(F.col("src_path").alias("path"), F.col("resolved").alias("other"))
        linked = open_.where("entity_type <> 'reflections'").join(kinds, "key").join(own, "path").where("other <> slug and other like wanted || '/%'").join(notes.select(F.col("slug").alias("other")), "other", "left_semi")
        bad = bad.join(_gathered(linked, "body", field), [*field], "left")
        body = F.col("body")
    number = F.when(F.col("num") == F.floor("num"), F.col("num").cast("bigint").cast("string")).otherwise(F.col("num").cast("string"))
    scalar = F.when(~blank, F.when(F.col("kind") == "number", F.array(number)).otherwise(F.array("str")))
    return bad.select("path", "key", F.coalesce(scalar, "graph", body, F.array().cast("array<string>")).alias("items"))


def drop_legacy_fields(note_fields: DataFrame, legacy_findings: DataFrame) -> DataFrame:
    """path, key of legacy keys whose value the new key carries (removable warnings of the type check)."""
    gone = legacy_findings.where("fixable and severity = 'warning' and message like 'legacy %'").select(F.col("file").alias("path"), F.expr("substring(message, 8)").alias("key")).distinct()
    return note_fields.join(gone, ["path", "key"], "left_semi").select("path", "key")


def add_legacy_defaults(notes: DataFrame, note_fields: DataFrame) -> DataFrame:
    """path, key, value: defaults of enum fields whose key is absent."""
    wanted = notes.select("path", "entity_type").join(F.broadcast(enum_defaults(notes.sparkSession)), "entity_type")
    return wanted.join(note_fields.select("path", "key").distinct(), ["path", "key"], "left_anti").select("path", "key", "value")


def rewrite_links(notes: DataFrame, link_map: DataFrame, text_col: str = "content") -> DataFrame:
    """path, old, new: contents with link targets replaced by link_map (path, target, replacement); aliases and fences stay."""
    lines = note_lines(notes.join(link_map.select("path").distinct(), "path", "left_semi"), text_col)
    maps = link_map.groupBy("path").agg(F.map_from_entries(F.collect_set(F.struct("target", "replacement"))).alias("map"))  # links of one note
    pieces = F.split("line", r"(?=\[\[)|(?<=\]\])")
    swap = lambda p: F.when(p.rlike(f"^{LINK}$") & F.map_contains_key("map", F.trim(F.regexp_extract(p, LINK, 1))), F.concat(F.lit("[["), F.element_at("map", F.trim(F.regexp_extract(p, LINK, 1))), F.regexp_extract(p, r"(\|[^\]]*)?\]\]$", 0))).otherwise(p)
    new = F.when(F.col("fenced"), F.col("line")).otherwise(F.array_join(F.transform(pieces, swap), ""))
    done = lines.join(maps, "path").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", new.alias("line")))), lambda x: x["line"]), "\n").alias("new"))
    return notes.select("path", F.col(text_col).alias("old")).join(done, "path").where("old <> new")


def rename_slugs(notes: DataFrame) -> DataFrame:
    """path, new_path, collides: kebab-case names for notes without one; collisions with a note or another rename are reported."""
    bad = notes.where(~F.col("basename").rlike(KEBAB))
    renamed = bad.select("path", F.concat(F.substring_index("path", "/", 1), F.lit("/"), slug("basename", "rename")).alias("new_path"))
    taken = notes.select(F.col("path").alias("new_path")).unionByName(renamed.select("new_path")).groupBy("new_path").agg(F.count("*").alias("n"))
    return renamed.join(taken, "new_path").select("path", "new_path", (F.col("n") > 1).alias("collides"))


def renamed_links(notes: DataFrame, renames: DataFrame, links: DataFrame) -> DataFrame:
    """path, target, replacement for rewrite_links: bare links (src_path, raw_target) of other notes to a renamed note's old basename.

    notes: path, basename before the renames. Links to a basename of which a rename collides stay.
    """
    moved = renames.join(notes.select("path", "basename"), "path").groupBy(F.col("basename").alias("target")).agg(F.min(F.substring_index("new_path", "/", -1)).alias("replacement"), F.max("collides").alias("stuck")).where("not stuck")
    bare = links.select(F.col("src_path").alias("path"), F.col("raw_target").alias("target")).distinct()
    own = notes.select("path", F.col("basename").alias("target"))
    return bare.join(moved, "target").join(own, ["path", "target"], "left_anti").select("path", "target", "replacement")


FIELD = ["path", "key", "kind", "str", "num", "items", "entries"]
FIELD_SCHEMA = "path string, key string, kind string, str string, num double, items array<string>, entries map<string,string>"


def _whole(df: DataFrame) -> DataFrame:
    """df with all columns of a field; those it lacks are null."""
    types = dict(c.split(" ", 1) for c in FIELD_SCHEMA.split(", "))
    return df.select(*(c if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()), *(c for c in df.columns if c not in FIELD))


def _known_ids(key: Column, entries: Column) -> Column:
    """entries; of external ids only those of a known namespace that are not empty."""
    return F.when(key == "external_ids", F.map_filter(entries, lambda k, v: k.isin(*NAMESPACES) & (v != ""))).otherwise(entries)


def judge_field_updates(notes: DataFrame, updates: DataFrame) -> DataFrame:
    """updates with problem: null, or why the update is refused.

    updates: path, key, kind, str, num, items, entries and, if there is an order or a choice, turn and op (set, merge; null: set).
    A key that no type declares may hold anything, but only in a note that there is.
    """
    whole = _whole(updates)
    extra = {"turn": F.lit(0).cast("long"), "op": F.lit("set")}
    whole = whole.withColumns({c: F.coalesce(F.col(c), e) if c in whole.columns else e for c, e in extra.items()})
    known = notes.select("path", "entity_type").dropDuplicates(["path"])
    judged = whole.join(known, "path", "left").join(F.broadcast(field_defs(notes.sparkSession)), ["entity_type", "key"], "left")
    merge = F.col("op") == "merge"
    problem = (
        F.when(F.col("entity_type").isNull(), "unknown note").when(~F.col("op").isin("set", "merge"), "unknown operation").when(F.col("kind").isNull(), "no kind")
        .when(merge & ((F.col("kind") != "object") | F.col("entries").isNull() | (F.coalesce("field_type", F.lit("object")) != "object")), "only objects merge")
        .when(F.col("field_type").isNull(), F.lit(None)).when(F.col("kind") == "null", F.when(F.col("required"), "required"))
        .when((F.col("field_type") == "string") & (F.trim("str") == "TODO"), "placeholder").when(~F.coalesce(value_is_valid(), F.lit(False)), "wrong type")
    )
    return judged.select(*FIELD, "turn", "op", problem.alias("problem"))


def apply_field_updates(notes: DataFrame, note_fields: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields after the updates, refused updates with problem); updates as in judge_field_updates.

    Of a key's updates that set it, the one of the last turn counts. Updates that merge lay their entries over those of the
    object that is there, or that was set in the same turn or before; each entry has its last turn's value, and goes if that is
    null. Kind null clears a key. Among equal turns the greatest value wins. External ids keep known namespaces and values
    that are not empty. Each step is a keyed minimum or maximum, so the updates of one key never meet in a list.
    """
    judged = judge_field_updates(notes, updates)
    keys, value = ["path", "key"], ["kind", "str", "num", "items", "entries"]
    good = judged.where("problem is null")
    ordered = F.struct("turn", "kind", "str", "num", "items", F.array_sort(F.map_entries("entries")).alias("e"))
    last = good.where("op = 'set'").groupBy(*keys).agg(F.max_by(F.struct(*value, "turn"), ordered).alias("set"))
    laid = good.where("op = 'merge'").select(*keys, "turn", F.explode("entries").alias("name", "text")).join(last.select(*keys, F.col("set.turn").alias("since")), keys, "left").where("since is null or turn >= since")
    laid = laid.where((F.col("key") != "external_ids") | (F.col("name").isin(*NAMESPACES) & ~F.coalesce(F.col("text") == "", F.lit(False))))
    newest = laid.groupBy(*keys, "name").agg(F.max_by("text", F.struct("turn", "text")).alias("text"))
    over = newest.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("over"))  # the names of one object
    touched = last.join(over, keys, "full")
    met = _whole(note_fields).select(*FIELD).withColumn("own", F.lit(True)).join(touched, keys, "full")
    changed = F.col("set").isNotNull() | F.col("over").isNotNull()
    base = F.when(F.col("set").isNotNull(), F.struct(*(F.col(f"set.{c}").alias(c) for c in value))).otherwise(F.struct(*value))
    met = met.select(*keys, changed.alias("changed"), base.alias("v"), "over")
    kept = F.map_filter(F.coalesce("v.entries", F.create_map().cast("map<string,string>")), lambda k, v: ~F.coalesce(F.map_contains_key("over", k), F.lit(False)))
    added = F.map_filter("over", lambda k, v: v.isNotNull())
    entries = F.when(F.col("over").isNotNull(), F.map_concat(kept, added)).otherwise(F.col("v.entries"))
    entries = F.when(F.col("changed"), _known_ids(F.col("key"), entries)).otherwise(entries)
    only = lambda c: F.when(F.col("over").isNull(), F.col(f"v.{c}")).alias(c)
    kind = F.when(F.col("over").isNotNull(), "object").otherwise(F.col("v.kind"))
    after = met.select(*keys, kind.alias("kind"), only("str"), only("num"), only("items"), entries.alias("entries"), "changed")
    return after.where(~F.col("changed") | _present()).drop("changed"), judged.where("problem is not null")


def suggest_fixes(findings: DataFrame) -> DataFrame:
    """check_id, file, advice for findings that no repair resolves."""
    advice = (
        F.when(F.col("check_id") == "L01", "add the key by hand").when(F.col("check_id") == "L02", "correct the value").when(F.col("check_id") == "L04", "link the page or remove it")
        .when(F.col("check_id") == "L05", "create the page or correct the target").when(F.col("check_id") == "L10", "rename one of the claims").otherwise("see the message")
    )
    return findings.where("not fixable").select("check_id", "file", F.concat_ws(": ", advice, "message").alias("advice"))
