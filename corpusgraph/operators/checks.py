"""Integrity checks over notes, metadata, links and edges. Each returns findings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.ids import once
from ..plans.schema import EDGE_CONFIDENCE, ENTITY_TYPES, ENUM_DEFAULTS, LEGACY_KEYS, edge_type_rows, edge_types, enum_defaults, field_defs, field_rows
from ..sources.storage import materialize
from .graph import _needs_reverse, _typed, answer_types, few_slugs, glob_regex

FINDING = ["check_id", "severity", "fixable", "file", "line", "message"]
CHECKS = {
    "L01": "error", "L02": "error", "L03": "error", "L04": "warning", "L05": "error", "L06": "error", "L07": "error", "L08": "error", "L09": "warning",
    "L10": "error", "L11": "warning", "L12": "warning", "L13": "warning", "L14": "error", "L16": "warning", "L17": "error",
}
KEBAB = "^[a-z0-9]+(?:-[a-z0-9]+)*$"
ALL_TYPES = [t for types in ENTITY_TYPES.values() for t in types]


def finding(df: DataFrame, check: str, file: str | Column, message: Column, fixable: bool | Column = False, line: Column | None = None, severity: str | None = None) -> DataFrame:
    flag = F.lit(fixable) if isinstance(fixable, bool) else fixable
    where = F.lit(None).cast("int") if line is None else line.cast("int")
    return df.select(F.lit(check).alias("check_id"), F.lit(severity or CHECKS[check]).alias("severity"), flag.alias("fixable"), (F.col(file) if isinstance(file, str) else file).alias("file"), where.alias("line"), message.alias("message"))


def _present() -> Column:
    return F.col("kind") != "null"


def check_required(notes: DataFrame, note_fields: DataFrame) -> DataFrame:
    """A required key is absent or null; fixable where a value can be derived."""
    spark = notes.sparkSession
    defs = field_defs(spark).where("required").join(enum_defaults(spark).withColumn("has_default", F.lit(True)).drop("value"), ["entity_type", "key"], "left")
    wanted = notes.select("path", "entity_type").join(F.broadcast(defs), "entity_type")
    missing = wanted.join(note_fields.where(_present()).select("path", "key").distinct(), ["path", "key"], "left_anti")
    derivable = F.col("field_type").isin("array", "object", "iso-date") | ((F.col("field_type") == "string") & F.col("key").isin("id", "type", "title")) | F.coalesce("has_default", F.lit(False))
    return finding(missing, "L01", "path", F.concat(F.lit("missing "), "key"), derivable)


def value_is_valid() -> Column:
    """Whether a metadata value (kind, str, num) has its declared type (field_type, allowed)."""
    kind, said, num, field_type, allowed = (F.col(c) for c in ("kind", "str", "num", "field_type", "allowed"))
    text = (kind == "string") & (F.trim(said) != "TODO")
    as_text = F.when(kind == "number", F.when(num == F.floor(num), num.cast("bigint").cast("string")).otherwise(num.cast("string"))).otherwise(said)
    return (
        F.when(field_type == "string", text).when(field_type == "number", (kind == "number") & ~F.isnan(num))
        .when(field_type == "array", kind == "array").when(field_type == "object", kind == "object")
        .when(field_type == "iso-date", (kind == "string") & said.rlike(r"^\d{4}-\d{2}-\d{2}$"))
        .when(field_type == "enum", kind.isin("string", "number") & F.array_contains(allowed, as_text))
    )


def check_types(notes: DataFrame, note_fields: DataFrame) -> DataFrame:
    """A value without its declared type; and a warning for each legacy key, removable if the new key carries its value."""
    spark = notes.sparkSession
    defs = F.broadcast(field_defs(spark))
    valued = note_fields.where(_present()).join(notes.select("path", "entity_type"), "path").join(defs, ["entity_type", "key"])
    wrong = finding(valued.where(~F.coalesce(value_is_valid(), F.lit(False))), "L02", "path", F.concat(F.lit("invalid "), "key"))
    legacy = F.broadcast(spark.createDataFrame(list(LEGACY_KEYS), "key string, new_key string"))
    old = note_fields.where(_present()).join(legacy, "key").join(notes.select("path", "entity_type"), "path").select("path", "entity_type", "key", F.col("new_key"), F.col("str").alias("old"))
    new = valued.where(value_is_valid()).select("path", F.col("key").alias("new_key"), F.coalesce("items", F.array("str")).alias("carried"))
    kept = old.join(new, ["path", "new_key"], "left")
    warn = finding(kept, "L02", "path", F.concat(F.lit("legacy "), "key"), F.coalesce(F.array_contains("carried", F.col("old")), F.lit(False)), severity="warning")
    return wrong.unionByName(warn)


def check_slug_style(notes: DataFrame) -> DataFrame:
    """A basename that is not in kebab case."""
    return finding(notes.where(~F.col("basename").rlike(KEBAB)), "L03", "path", F.concat(F.lit("not kebab-case: "), "basename"), True)


def check_orphans(notes: DataFrame, links: DataFrame) -> DataFrame:
    """No link out, and no resolved link in (links: src_path, raw_target, resolved; fenced ones count)."""
    own = notes.where(F.col("entity_type").isin(ALL_TYPES) & ~F.col("slug").rlike(glob_regex()))
    lonely = own.join(links.select(F.col("src_path").alias("path")).distinct(), "path", "left_anti")
    lonely = lonely.join(links.where("resolved is not null").select(F.col("resolved").alias("slug")).distinct(), "slug", "left_anti")
    return finding(lonely, "L04", "path", F.lit("no links in or out"))


def check_broken_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """An unfenced target that is no slug; fixable if it leads to exactly one note."""
    target = links.where(~F.col("in_fence")).withColumn("target", F.trim("raw_target"))
    broken = target.join(notes.select(F.col("slug").alias("target")), "target", "left_anti").withColumn("bare", F.regexp_replace("target", r"\.md$", ""))
    index = notes.groupBy("basename").agg(F.count("*").alias("named"))
    exact = notes.select(F.col("slug").alias("bare"), F.lit(1).alias("exact"))
    qualified = F.substring_index("bare", "/", 1).isin(ALL_TYPES) & F.col("bare").contains("/")
    known = broken.withColumn("basename", F.substring_index("bare", "/", -1)).join(index, "basename", "left").join(exact, "bare", "left")
    one = F.when(F.col("exact").isNotNull(), F.lit(True)).when(qualified | F.col("target").contains("://"), F.lit(False)).otherwise(F.coalesce(F.col("named") == 1, F.lit(False)))
    return finding(known, "L05", "src_path", F.concat(F.lit("broken link "), "target"), one, F.col("line_no"))


def lacking_reverse(edges: DataFrame) -> DataFrame:
    """The edges, with reverse (a type), that need a reverse and have none. Only edges of types that answer meet what is asked for."""
    wanted = _typed(edges).where(_needs_reverse()).select(*edges.columns, "reverse")
    answering = edges.where(F.col("type").isin(*answer_types()))
    have = answering.select(F.col("src").alias("_s"), F.col("type").alias("_t"), F.col("dst").alias("_d"))
    return wanted.join(have, (F.col("dst") == F.col("_s")) & (F.col("reverse") == F.col("_t")) & (F.col("src") == F.col("_d")), "left_anti")


def check_missing_reverse(edges: DataFrame, distinct: bool = False) -> DataFrame:
    """A forward edge without its reverse; distinct: once for equal rows, which are looked for among the findings only."""
    missing = lacking_reverse(edges)
    return finding(missing.distinct() if distinct else missing, "L06", "src", F.concat_ws(" ", F.lit("missing"), "dst", "reverse", "src"), True)


def check_symmetric_duplicates(edges: DataFrame) -> DataFrame:
    """A symmetric edge present in both orders (all of its rows), or repeated (all but the first)."""
    own = _typed(edges).where("symmetric").select("seq", "src", "type", "dst")
    pair = own.select("*", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    stats = pair.groupBy("a", "type", "b").agg(F.min("seq").alias("first"), F.min("src").alias("lo"), F.max("src").alias("hi"))
    both = pair.join(stats, ["a", "type", "b"]).where((F.col("lo") != F.col("hi")) | (F.col("seq") != F.col("first")))
    return finding(both, "L07", "src", F.concat_ws(" ", F.lit("duplicate"), "src", "type", "dst"), True)


def check_edge_confidence(edges: DataFrame, needing: DataFrame | None = None) -> DataFrame:
    """An edge of a type that needs confidence (needing: type) without one. No shipped type needs it."""
    if needing is None:
        needing = edge_types(edges.sparkSession).where("false").select(F.col("name").alias("type"))
    bad = edges.join(F.broadcast(needing.select("type").distinct()), "type", "left_semi").where(~F.coalesce(F.col("confidence").isin(*EDGE_CONFIDENCE), F.lit(False)))
    return finding(bad, "L08", "src", F.concat_ws(" ", F.lit("needs confidence"), "src", "type", "dst"))


def check_catalog(notes: DataFrame, catalog_refs: DataFrame) -> DataFrame:
    """Entity notes that the catalog names neither by slug, basename nor file; one row with the count and three of them."""
    listed = catalog_refs.select(F.col("target").alias("name")).distinct()
    names = F.array("slug", "basename", F.concat("path", F.lit(".md")))
    own = notes.where(F.col("entity_type").isin(ALL_TYPES) & ~F.col("entity_type").isin("reflections", "readings"))
    found = own.select("path", F.explode(names).alias("name")).join(listed, "name", "left_semi").select("path").distinct()
    missing = own.join(found, "path", "left_anti").select("path")
    few = missing.orderBy("path").limit(3).agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("few"))
    summary = missing.agg(F.count("*").alias("n")).crossJoin(few).where("n > 0")  # one row each
    return finding(summary, "L09", F.lit("index.md"), F.concat(F.lit("missing "), F.col("n").cast("string"), F.lit(": "), "few"), True)


def check_alias_conflicts(foundations: DataFrame) -> DataFrame:
    """A name (title or alias) claimed more than once; one row for each claim."""
    claims = foundations.select("slug", F.explode(F.concat(F.array(F.struct(F.lit("title").alias("as"), F.col("title").alias("name"))), F.transform(F.coalesce("aliases", F.array()), lambda a: F.struct(F.lit("alias").alias("as"), a.alias("name"))))).alias("c"))
    claims = claims.select("slug", "c.as", F.lower(F.trim("c.name")).alias("name")).where("name is not null")
    shared = claims.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    return finding(claims.join(shared, "name"), "L10", "slug", F.concat_ws(" ", F.lit("alias conflict"), "name", "as"))


def check_confidence(notes: DataFrame, note_fields: DataFrame) -> DataFrame:
    """No confidence on a source or concept."""
    own = notes.where(F.col("entity_type").isin("sources", "concepts"))
    return finding(own.join(note_fields.where(_present() & (F.col("key") == "confidence")).select("path").distinct(), "path", "left_anti"), "L11", "path", F.lit("confidence missing"))


def check_raw_paths(note_fields: DataFrame, files: DataFrame) -> DataFrame:
    """A raw path in the temporary zone, outside the corpus, or of no file (files: path)."""
    raw = note_fields.where("key = 'raw_paths' and kind = 'array' and path like 'sources/%'").select("path", F.explode("items").alias("entry")).where("entry <> ''")
    known = raw.join(files.select(F.col("path").alias("entry"), F.lit(1).alias("there")).distinct(), "entry", "left")
    why = F.when(F.col("entry").rlike(r"^(\./)?raw/tmp/"), "transient").when(F.col("entry").rlike(r"^(/|\.\./)"), "unsafe").when(F.col("there").isNull(), "missing")
    return finding(known.withColumn("why", why).where("why is not null"), "L12", "path", F.concat_ws(" ", "why", "entry"))


def derived_ids(sources: DataFrame) -> DataFrame:
    """path, external_ids, ns, value: what the urls imply, the first url wins; sources: path, urls, external_ids."""
    urls = sources.select("path", "external_ids", F.posexplode("urls").alias("at", "url"))
    implied = ids.ids_from_urls(urls, "url", "implied").select("path", "external_ids", "at", F.explode("implied").alias("ns", "value")).where("ns <> 'url'")
    return implied.groupBy("path", "ns").agg(F.min(F.struct("at", "value", F.to_json("external_ids").alias("ext"))).alias("x")).select("path", "ns", F.col("x.value").alias("value"), F.from_json("x.ext", "map<string,string>").alias("external_ids"))


def check_id_coverage(sources: DataFrame) -> DataFrame:
    """An id that the urls imply and the note does not declare."""
    gaps = derived_ids(sources).where(F.coalesce(F.element_at("external_ids", F.col("ns")), F.lit("")) == "")
    return finding(gaps, "L13", "path", F.concat(F.lit("missing "), "ns", F.lit("="), "value"))


def _declared(sources: DataFrame) -> DataFrame:
    flat = sources.select("path", F.explode("external_ids").alias("ns", "value")).where("value <> ''")
    return ids.normalize_ids(flat, "ns", "value").where(F.col("ns").isin(*ids.NAMESPACES))


def check_id_validity(sources: DataFrame) -> DataFrame:
    """A declared id that is not one of its namespace."""
    return finding(_declared(sources).where("not valid"), "L14", "path", F.concat(F.lit("invalid "), "ns", F.lit("="), "value"))


def check_id_mismatch(sources: DataFrame) -> DataFrame:
    """A valid declared id that differs from what the urls imply."""
    implied = derived_ids(sources).select("path", "ns", F.col("value").alias("implied"))
    return finding(_declared(sources).where("valid").join(implied, ["path", "ns"]).where("id <> implied"), "L16", "path", F.concat("ns", F.lit("="), "id", F.lit(" but "), "implied"))


def check_dangling_edges(edges: DataFrame, notes: DataFrame, distinct: bool = False, keep: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """An end of an edge that is neither a URL nor a known slug; distinct: once for equal rows, as in L06.

    The ends are looked up once for each slug; what is no note is written (keep) and meets the edges, which do not move if it is few.
    """
    own = edges.columns if distinct else ["src", "type", "dst"]
    ends = edges.select(*own, F.posexplode(F.array("src", "dst")).alias("end", "slug")).where(~F.col("slug").contains("://"))
    away = keep(ends.select("slug").distinct().join(notes.select("slug"), "slug", "left_anti"))
    dangling = ends.join(few_slugs(away), "slug", "left_semi")
    return finding(dangling.distinct() if distinct else dangling, "L17", "src", F.concat_ws(" ", F.lit("dangling"), "slug", "type"))


def fused_edge_checks(edges: DataFrame, needing: DataFrame | None, wanted: set[str]) -> DataFrame:
    """L06, L07 and L08 in one pass: each edge says what it asks for and what it answers, and counts by these keys decide.

    The counts are summed in the tasks before the one shuffle, so a hot end or an edge of many copies is a row a task. Edges
    of two types that answer each other count under one key (L06+: x of the first type by name, y of the other, turned), so
    an edge and its answer are one row when a task has both; only edges of other types ask and answer in rows of their own.
    """
    spark = edges.sparkSession
    asked = edge_types(spark).where("false").select(F.col("name").alias("type")) if needing is None else needing.select("type").distinct()
    told = _typed(edges.select("src", "type", "dst", "confidence").join(F.broadcast(asked.withColumn("asked", F.lit(True))), "type", "left"))
    back = {r[0]: r[3] for r in edge_type_rows() if r[3] and not r[4] and not r[5]}
    mutual = {t: r for t, r in back.items() if back.get(r) == t and r != t}
    first = sorted(t for t, r in mutual.items() if t < r)
    alone = sorted(t for t in back if t not in mutual)
    answers = sorted({back[t] for t in alone})
    one, zero, whole = F.lit(1).cast("long"), F.lit(0).cast("long"), F.col("src").isNotNull() & F.col("dst").isNotNull()
    turned = F.col("src") > F.col("dst")
    tag = lambda check, when, a, kind, b, x, y: F.when(when, F.struct(F.lit(check).alias("check_id"), a.alias("a"), kind.alias("type"), b.alias("b"), x.alias("x"), y.alias("y")))
    src, kind, dst = F.col("src"), F.col("type"), F.col("dst")
    tags = {
        "L06": [
            tag("L06+", kind.isin(*first), src, kind, dst, one, zero), tag("L06+", kind.isin(*sorted(mutual.keys() - set(first))), dst, F.col("reverse"), src, zero, one),
            tag("L06", kind.isin(*alone) & _needs_reverse(), dst, F.col("reverse"), src, one, zero), tag("L06", kind.isin(*answers) & whole, src, kind, dst, zero, one),
        ],
        "L07": [tag("L07", F.col("symmetric"), F.least(src, dst), kind, F.greatest(src, dst), F.when(turned, zero).otherwise(one), F.when(turned, one).otherwise(zero))],
        "L08": [tag("L08", F.col("asked") & ~F.coalesce(F.col("confidence").isin(*EDGE_CONFIDENCE), F.lit(False)), src, kind, dst, one, zero)],
    }
    each = told.select(F.explode(F.array(*(t for c in sorted(wanted) for t in tags[c]))).alias("t")).where("t is not null").select("t.*")
    counted = each.groupBy("check_id", "a", "type", "b").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    both = (F.col("x") > 0) & (F.col("y") > 0)
    less = lambda n: F.when(both, F.col(n)).otherwise(F.col(n) - 1)
    said = lambda file, first, a, b, fixable, n, kind="type": F.struct(F.col(file).alias("file"), F.concat_ws(" ", F.lit(first), a, kind, b).alias("message"), F.lit(fixable).alias("fixable"), n.alias("n"))
    of = lambda check, n: F.when(F.col("check_id") == check, n).otherwise(zero)
    # a null end equals no other, so it is never answered; a null or exempt target asks for nothing
    asks = lambda to, n, answered: of("L06+", F.when(F.coalesce(~F.col(to).rlike(glob_regex()), F.lit(False)) & ((F.col(answered) == 0) | F.col("a").isNull() | F.col("b").isNull()), F.col(n)).otherwise(zero))
    other = F.element_at(F.create_map(*(F.lit(x) for t in first for x in (t, mutual[t]))), F.col("type"))
    found = F.array(
        said("a", "missing", "b", "a", True, asks("b", "x", "y"), other), said("b", "missing", "a", "b", True, asks("a", "y", "x")),
        said("b", "missing", "a", "b", True, of("L06", F.when(F.col("y") == 0, F.col("x")).otherwise(zero))), said("a", "duplicate", "a", "b", True, of("L07", less("x"))),
        said("b", "duplicate", "b", "a", True, of("L07", less("y"))), said("a", "needs confidence", "a", "b", False, of("L08", F.col("x"))),
    )
    rows = counted.select(F.rtrim("check_id", F.lit("+")).alias("check_id"), F.explode(found).alias("f")).select("check_id", "f.*").where("n > 0").withColumn("copy", F.explode(F.expr("sequence(1, n)")))
    return rows.select("check_id", F.lit("error").alias("severity"), "fixable", "file", F.lit(None).cast("int").alias("line"), "message")


def fused_field_checks(notes: DataFrame, note_fields: DataFrame, wanted: set[str]) -> DataFrame:
    """L01, L02 and L11 in one pass: fields meet their note and are judged row by row; a note keeps a bit for each declared
    key it has, the wrong ones, and the values of older and newer forms of a key."""
    spark = notes.sparkSession
    derivable = lambda t, k, of: of in ("array", "object", "iso-date") or (of == "string" and k in ("id", "type", "title")) or (t, k) in {d[:2] for d in ENUM_DEFAULTS}
    bits: dict[str, int] = {}
    rows, needed = [], {}
    for t, k, of, required, allowed in field_rows():
        bits[t] = bits.get(t, 0) + 1
        rows.append((t, k, of, allowed, 1 << (bits[t] - 1)))
        if required:
            needed.setdefault(t, []).append((k, rows[-1][4], derivable(t, k, of)))
    defs = F.broadcast(spark.createDataFrame(rows, "entity_type string, key string, field_type string, allowed array<string>, bit long"))
    needs = F.broadcast(spark.createDataFrame(list(needed.items()), "entity_type string, needs array<struct<key:string,bit:bigint,derivable:boolean>>"))
    olds, news = sorted({o for o, _ in LEGACY_KEYS}), sorted({n for _, n in LEGACY_KEYS})
    slim = note_fields.where(_present()).select("path", "key", "kind", "str", "num", F.when(F.col("key").isin(*news), F.col("items")).alias("items"))
    own = notes.groupBy("path", "entity_type").agg(F.count("*").alias("copies"))
    told = own.join(slim, "path", "left").join(defs, ["entity_type", "key"], "left").withColumn("good", F.coalesce(value_is_valid(), F.lit(False)))
    declared = F.col("field_type").isNotNull()
    whole = told.groupBy("path", "entity_type").agg(
        F.max("copies").alias("copies"), F.coalesce(F.bit_or(F.col("bit")), F.lit(0).cast("long")).alias("has"), F.coalesce(F.bool_or(F.col("key") == "confidence"), F.lit(False)).alias("sure"),
        F.collect_list(F.when(declared & ~F.col("good"), F.col("key"))).alias("wrong"), F.collect_list(F.when(F.col("key").isin(*olds), F.struct("key", "str"))).alias("olds"),
        F.collect_list(F.when(F.col("key").isin(*news) & F.col("good"), F.struct("key", F.coalesce("items", F.array("str")).alias("held")))).alias("news"),
    ).join(needs, "entity_type", "left")
    said = lambda check, severity, fixable, message: F.struct(F.lit(check).alias("check_id"), F.lit(severity).alias("severity"), fixable.alias("fixable"), message.alias("message"))
    none = F.slice(F.array(said("L01", "error", F.lit(False), F.lit(""))), 1, 0)
    parts = []
    if "L01" in wanted:
        lacking = F.filter("needs", lambda d: F.col("has").bitwiseAND(d["bit"]) == 0)
        parts.append(F.coalesce(F.transform(lacking, lambda d: said("L01", "error", d["derivable"], F.concat(F.lit("missing "), d["key"]))), none))
    if "L02" in wanted:
        parts.append(F.transform("wrong", lambda k: said("L02", "error", F.lit(False), F.concat(F.lit("invalid "), k))))
        nothing = F.array(F.lit(None).cast("array<string>"))
        for old, new in LEGACY_KEYS:
            # each old value is a warning for each valid value of the new key, or one if there is none
            held = F.transform(F.filter("news", lambda y: y["key"] == new), lambda y: y["held"])  # noqa: B023
            warn = lambda x, old=old, held=held: once(held, lambda h: F.transform(F.when(F.size(h) > 0, h).otherwise(nothing), lambda y: said("L02", "warning", F.coalesce(F.array_contains(y, x["str"]), F.lit(False)), F.lit(f"legacy {old}"))))
            parts.append(F.flatten(F.transform(F.filter("olds", lambda x: x["key"] == old), lambda x: warn(x))))  # noqa: B023
    if "L11" in wanted:
        unsure = F.col("entity_type").isin("sources", "concepts") & ~F.col("sure")
        parts.append(F.when(unsure, F.array(said("L11", "warning", F.lit(False), F.lit("confidence missing")))).otherwise(none))
    found = whole.select("path", "copies", F.explode(F.concat(*parts)).alias("x")).withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
    return found.select("x.check_id", "x.severity", "x.fixable", F.col("path").alias("file"), F.lit(None).cast("int").alias("line"), "x.message")


def fused_id_checks(sources: DataFrame, wanted: set[str]) -> DataFrame:
    """L13, L14 and L16 in one pass: the ids that urls imply meet the declared ones by note and namespace."""
    implied = derived_ids(sources).select("path", "ns", F.col("value").alias("implied"))
    both = implied.join(_declared(sources).select("path", "ns", "value", "id", "valid"), ["path", "ns"], "full")
    named = F.concat("ns", F.lit("="))
    rules = {
        "L13": (F.col("value").isNull(), F.concat(F.lit("missing "), named, "implied"), "warning"), "L14": (~F.col("valid"), F.concat(F.lit("invalid "), named, "value"), "error"),
        "L16": (F.col("valid") & (F.col("id") != F.col("implied")), F.concat(named, "id", F.lit(" but "), "implied"), "warning"),
    }
    found = F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(c).alias("check_id"), F.lit(severity).alias("severity"), message.alias("message"))) for c, (cond, message, severity) in rules.items() if c in wanted)))
    return both.select("path", F.explode(found).alias("x")).select("x.check_id", "x.severity", F.lit(False).alias("fixable"), F.col("path").alias("file"), F.lit(None).cast("int").alias("line"), "x.message")


#: Groups of checks that are decided together, each with the tables it reads.
FUSED = {
    ("L06", "L07", "L08"): (("edges",), lambda c, w: fused_edge_checks(c["edges"], c.get("needing"), w)),
    ("L01", "L02", "L11"): (("notes", "note_fields"), lambda c, w: fused_field_checks(c["notes"], c["note_fields"], w)),
    ("L13", "L14", "L16"): (("sources",), lambda c, w: fused_id_checks(c["sources"], w)),
}
#: The others, each with the tables it reads.
SINGLE = {
    "L03": (("notes",), lambda c: check_slug_style(c["notes"])), "L04": (("notes", "links"), lambda c: check_orphans(c["notes"], c["links"])), "L05": (("links", "notes"), lambda c: check_broken_links(c["links"], c["notes"])),
    "L09": (("notes", "catalog_refs"), lambda c: check_catalog(c["notes"], c["catalog_refs"])), "L10": (("foundations",), lambda c: check_alias_conflicts(c["foundations"])),
    "L12": (("note_fields", "files"), lambda c: check_raw_paths(c["note_fields"], c["files"])), "L17": (("edges", "notes"), lambda c: check_dangling_edges(c["edges"], c["notes"])),
}


def run_checks(corpus: dict[str, DataFrame], checks: list[str] | None = None, stored: Collection[str] = ()) -> DataFrame:
    """The findings of the named checks, or of all.

    corpus: notes, note_fields, links (resolved), edges, catalog_refs, foundations, files, sources (path, urls, external_ids),
    and needing if some edge types need confidence. Checks that look at the same things are decided in one pass. Only the
    tables of the named checks are read; those that more than one pass reads are written once, unless they are stored
    already (stored: their names).
    """
    wanted = set(CHECKS if checks is None else checks)
    if not wanted or wanted - set(CHECKS):
        raise ValueError(f"no checks, or unknown ones: {sorted(wanted - set(CHECKS))}")
    runs = [(tables, lambda c, f=f, w=wanted & set(group): f(c, w)) for group, (tables, f) in FUSED.items() if wanted & set(group)]
    runs += [SINGLE[c] for c in SINGLE if c in wanted]
    uses = Counter(t for tables, _ in runs for t in tables)
    tables = {name: materialize(df) if uses[name] > 1 and name not in stored else df for name, df in corpus.items() if uses[name] or name == "needing"}
    return reduce(DataFrame.unionByName, [f(tables) for _, f in runs])
