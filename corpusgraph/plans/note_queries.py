"""Queries of the note, metadata, link and repair operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import checks, notes, repair, report, verify
from ..sources import files
from ..sources.storage import materialize
from . import graph_queries  # noqa: F401, its SQL is used here
from .adapters import landed, table
from .registry import query, sql_of
from .schema import ENUM_DEFAULTS, field_rows, sql_values

DEFS = "defs as (select * from " + sql_values([(t, k, f, r, "," + ",".join(a) + "," if a else None) for t, k, f, r, a in field_rows()]) + " v(entity_type, key, field_type, required, allowed))"
DEFAULTS = "dv as (select * from " + sql_values(list(ENUM_DEFAULTS)) + " v(entity_type, key, value))"
SRC = "src as (select n.path, n.entity_type from notes n where entity_type = 'sources')"
TYPED = f"{DEFS}, {SRC}, val as (select f.*, s.entity_type, field_type, required, allowed from note_fields f join src s on s.path = f.path join defs d on d.entity_type = s.entity_type and d.key = f.key)"
VALID = "case field_type when 'string' then kind = 'string' and trim(str) <> 'TODO' when 'number' then kind = 'number' when 'array' then kind = 'array' when 'object' then kind = 'object' when 'iso-date' then kind = 'string' and regexp_matches(str, '^\\d{4}-\\d{2}-\\d{2}$') else contains(allowed, ',' || coalesce(str, cast(cast(num as bigint) as varchar)) || ',') end"
LINKS = """ln as (select path, generate_subscripts(split(content, chr(10)), 1) as line_no, unnest(split(content, chr(10))) as line from note_texts),
fl as (select *, sum(case when line = '```' then 1 else 0 end) over (partition by path order by line_no) as f from ln),
lk as (select path as src_path, line_no, trim(unnest(regexp_extract_all(line, '\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]', 1))) as raw_target, f % 2 = 1 as in_fence from fl)"""
BARE = "regexp_replace(raw_target, '\\.md$', '')"


def src_notes(spark, d):
    return table(spark, d, "notes").where("entity_type = 'sources'")


def fields(spark, d):
    return table(spark, d, "note_fields")


def texts(spark, d):
    return table(spark, d, "note_texts")


def links(spark, d):
    return notes.extract_links(texts(spark, d))


def raw_files(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 3 = 0").select(F.concat(F.lit("raw/sources/f"), (F.col("o_orderkey") % 100).cast("string")).alias("path")).distinct()


RAW = "files as (select distinct 'raw/sources/f' || (o_orderkey % 100) as path from orders where o_orderkey % 3 = 0)"


@query("l01_required", f"with {DEFS}, {SRC}, {DEFAULTS} select s.path as file, 'missing ' || d.key as message, field_type in ('array', 'object', 'iso-date') or (field_type = 'string' and d.key in ('id', 'type', 'title')) or value is not null as fixable from src s join defs d on d.entity_type = s.entity_type and required left join dv on dv.entity_type = s.entity_type and dv.key = d.key where not exists (select 1 from note_fields f where f.path = s.path and f.key = d.key)")
def l01(spark, d):
    return checks.check_required(src_notes(spark, d), fields(spark, d)).select("file", "message", "fixable")


@query("l02_types", f"""with {TYPED}, ok as (select *, {VALID} as valid from val)
select path as file, 'error' as severity, 'invalid ' || key as message, false as fixable from ok where not coalesce(valid, false)
union all select s.path, 'warning', 'legacy slug', coalesce((select max(o.str) from ok o where o.path = s.path and o.key = 'id' and o.valid) = s.str, false) from note_fields s join src on src.path = s.path where s.key = 'slug'""")
def l02(spark, d):
    return checks.check_types(src_notes(spark, d), fields(spark, d)).select("file", "severity", "message", "fixable")


@query("l03_slug_style", "select path as file, basename from (select path, basename || case when k % 3 = 0 then '_X' else '' end as basename from (select path, basename, cast(substr(basename, 2) as bigint) as k from notes where entity_type <> 'foundations') n) x where not regexp_matches(basename, '^[a-z0-9]+(-[a-z0-9]+)*$')")
def l03(spark, d):
    n = table(spark, d, "notes").where("entity_type <> 'foundations'").withColumn("basename", F.expr("basename || case when try_cast(substr(basename, 2) as bigint) % 3 = 0 then '_X' else '' end"))
    return checks.check_slug_style(n).select("file", F.expr("substring(message, 17)").alias("basename"))


@query("l04_orphans", f"with {LINKS}, rs as (select distinct coalesce((select slug from notes n where n.slug = {BARE}), null) as slug from lk) select path as file from notes where entity_type in ('sources', 'concepts', 'people') and path not in (select src_path from lk) and slug not in (select slug from rs where slug is not null) and basename not in (select {BARE} from lk)")
def l04(spark, d):
    n = table(spark, d, "notes")
    return checks.check_orphans(n.where("entity_type <> 'foundations'"), notes.resolve_links(links(spark, d), n)).select("file")


@query("l05_broken_links", f"with {LINKS}, b as (select * from lk where not in_fence and raw_target not in (select slug from notes)) select src_path as file, line_no as line, 'broken link ' || raw_target as message, case when {BARE} in (select slug from notes) then true when raw_target like '%/%' then false else (select count(*) from notes n where n.basename = {BARE}) = 1 end as fixable from b")
def l05(spark, d):
    return checks.check_broken_links(links(spark, d), table(spark, d, "notes")).select("file", F.col("line").cast("bigint").alias("line"), "message", "fixable")


@query("l09_catalog", "with m as (select path from notes where entity_type <> 'people' or length(basename) > 3) select 'index.md' as file, 'missing ' || (select count(*) from m) || ': ' || (select string_agg(path, ', ' order by path) from (select path from m order by path limit 3) x) as message")
def l09(spark, d):
    n = table(spark, d, "notes")
    return checks.check_catalog(n, n.where("entity_type = 'people' and length(basename) <= 3").select(F.col("basename").alias("target"))).select("file", "message")


@query("l10_alias_conflicts", "with c as (select slug, 'title' as kind, lower(trim(title)) as name from foundations union all select slug, 'alias', lower(trim(unnest(aliases))) from foundations) select slug as file, 'alias conflict ' || name || ' ' || kind as message from c where name in (select name from c group by name having count(*) > 1)")
def l10(spark, d):
    return checks.check_alias_conflicts(table(spark, d, "foundations")).select("file", "message")


@query("l11_confidence", f"with {SRC} select path as file from src where path not in (select path from note_fields where key = 'confidence')")
def l11(spark, d):
    return checks.check_confidence(src_notes(spark, d), fields(spark, d)).select("file")


@query("l12_raw_paths", f"with {RAW}, r as (select path, unnest(items) as entry from note_fields where key = 'raw_paths') select path as file, why || ' ' || entry as message from (select *, case when entry like 'raw/tmp/%' then 'transient' when entry like '../%' then 'unsafe' when entry not in (select path from files) then 'missing' end as why from r) x where why is not null")
def l12(spark, d):
    return checks.check_raw_paths(fields(spark, d), raw_files(spark, d)).select("file", "message")


def sources(spark, d):
    """path, slug, urls and declared ids of source notes; one in five has a declared id that may be wrong."""
    own = fields(spark, d).where("key = 'urls'").select("path", F.col("path").alias("slug"), F.col("items").alias("urls"), F.expr("cast(substr(path, 10) as bigint)").alias("o"))
    declared = F.expr("case when o % 5 = 0 then map('openalex', 'W' || (o + o % 2)) when o % 5 = 1 then map('doi', '10.' || (o % 2000) || '/x' || o, 's2', 'nohex') else cast(map() as map<string,string>) end")
    return own.withColumn("external_ids", declared).drop("o")


IMPLIED = """im as (select 'sources/o' || o_orderkey as path, o_orderkey as o, case o_orderkey % 4 when 0 then 'arxiv' when 1 then 'doi' else 'openalex' end as ns,
  case o_orderkey % 4 when 0 then '2401.' || (10000 + o_orderkey % 90000) when 1 then '10.' || (1000 + o_orderkey % 9000) || '/x' || o_orderkey else 'W' || o_orderkey end as value from orders where o_orderkey % 50 <> 0 and o_orderkey % 4 < 3),
dc as (select 'sources/o' || o_orderkey as path, o_orderkey as o, 'openalex' as ns, 'W' || (o_orderkey + o_orderkey % 2) as value from orders where o_orderkey % 50 <> 0 and o_orderkey % 5 = 0
  union all select 'sources/o' || o_orderkey, o_orderkey, 'doi', '10.' || (o_orderkey % 2000) || '/x' || o_orderkey from orders where o_orderkey % 50 <> 0 and o_orderkey % 5 = 1
  union all select 'sources/o' || o_orderkey, o_orderkey, 's2', 'nohex' from orders where o_orderkey % 50 <> 0 and o_orderkey % 5 = 1)"""


@query("l13_id_coverage", f"with {IMPLIED} select path as file, 'missing ' || ns || '=' || value as message from im where not exists (select 1 from dc where dc.path = im.path and dc.ns = im.ns)")
def l13(spark, d):
    return checks.check_id_coverage(sources(spark, d)).select("file", "message")


@query("l14_id_validity", f"with {IMPLIED} select path as file, 'invalid ' || ns || '=' || value as message from dc where ns = 's2' or (ns = 'doi' and o % 2000 < 1000)")
def l14(spark, d):
    return checks.check_id_validity(sources(spark, d)).select("file", "message")


@query("l16_id_mismatch", f"with {IMPLIED} select im.path as file, im.ns || '=' || dc.value || ' but ' || im.value as message from im join dc on dc.path = im.path and dc.ns = im.ns where dc.value <> im.value and not (im.ns = 'doi' and im.o % 2000 < 1000)")
def l16(spark, d):
    return checks.check_id_mismatch(sources(spark, d)).select("file", "message")


def corpus(spark, d):
    """All tables that the checks read."""
    n = table(spark, d, "notes")
    listed = n.where("entity_type = 'people' and length(basename) <= 3").select(F.col("basename").alias("target"))
    return {
        "notes": n, "note_fields": fields(spark, d), "links": notes.resolve_links(links(spark, d), n), "edges": landed(spark, d, "edges"), "catalog_refs": listed,
        "foundations": table(spark, d, "foundations"), "files": raw_files(spark, d), "sources": sources(spark, d),
    }


REQUIRED = f"with {DEFS}, {DEFAULTS} select s.path, field_type in ('array', 'object', 'iso-date') or (field_type = 'string' and d.key in ('id', 'type', 'title')) or value is not null as fixable from notes s join defs d on d.entity_type = s.entity_type and required left join dv on dv.entity_type = s.entity_type and dv.key = d.key where not exists (select 1 from note_fields f where f.path = s.path and f.key = d.key)"
#: check, severity, fixable, and the SQL whose rows are its findings.
FOUND = [
    ("L01", "'error'", "fixable", REQUIRED), ("L02", "severity", "fixable", sql_of("l02_types")), ("L03", "'error'", "true", "select path from notes where not regexp_matches(basename, '^[a-z0-9]+(-[a-z0-9]+)*$')"),
    ("L04", "'warning'", "false", sql_of("l04_orphans")), ("L05", "'error'", "fixable", sql_of("l05_broken_links")), ("L06", "'error'", "true", sql_of("l06_missing_reverse")), ("L07", "'error'", "true", sql_of("l07_symmetric_duplicates")),
    ("L08", "'error'", "false", "select seq from edges where false"), ("L09", "'warning'", "true", sql_of("l09_catalog")), ("L10", "'error'", "false", sql_of("l10_alias_conflicts")),
    ("L11", "'warning'", "false", "select path from notes where entity_type in ('sources', 'concepts') and path not in (select path from note_fields where key = 'confidence')"), ("L12", "'warning'", "false", sql_of("l12_raw_paths")),
    ("L13", "'warning'", "false", sql_of("l13_id_coverage")), ("L14", "'error'", "false", sql_of("l14_id_validity")), ("L16", "'warning'", "false", sql_of("l16_id_mismatch")), ("L17", "'error'", "false", sql_of("l17_dangling_edges")),
]
COUNTS = " union all ".join(f"select '{c}' as check_id, count(*) as n, count(*) filter (where {s} = 'error') as errors, count(*) filter (where {s} = 'warning') as warnings, count(*) filter (where {f}) as fixable from ({q}) {c.lower()}" for c, s, f, q in FOUND)


@query("l20_run_checks", COUNTS)
def l20(spark, d):
    return report.findings_summary(checks.run_checks(corpus(spark, d), stored=["edges"]), checks.CHECKS)


@query("findings_summary", f"with c as ({COUNTS}) select check_id, n, errors, warnings, fixable, n * 1000000 // (select sum(n) from c) as millionths from c")
def summary(spark, d):
    """All checks, with each one's share of the findings. The counts are written, so that their sum does not run the checks again."""
    counts = materialize(report.findings_summary(checks.run_checks(corpus(spark, d), stored=["edges"]), checks.CHECKS))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("check_id", "n", "errors", "warnings", "fixable", F.expr("n * 1000000 div all").alias("millionths"))  # a row for each check, and one


@query("p01_extract_fields", """with t as (select path, cast(substr(path, 10) as bigint) as o, o_custkey as c, o_orderpriority as pr from note_texts join orders on o_orderkey = cast(substr(path, 10) as bigint))
select path, 'id' as key, 'string' as kind, 'sources/o' || o as str, cast(null as double) as num, '' as listed from t union all select path, 'title', 'string', pr, null, '' from t union all select path, 'importance', 'number', null, o % 7, '' from t
union all select path, 'authors', 'array', null, null, 'c' || c || ';d' || c from t union all select path, 'raw_paths', 'array', null, null, 'raw/f' || (o % 50) || ';raw/g' || o from t union all select path, 'external_ids', 'object', null, null, '' from t""")
def p01(spark, d):
    return notes.extract_fields(texts(spark, d)).select("path", "key", "kind", "str", "num", F.coalesce(F.array_join("items", ";"), F.lit("")).alias("listed"))


@query("p02_mask_code_fences", f"with {LINKS} select path, line_no, case when f % 2 = 1 or line = '```' then '' else line end as line from fl")
def p02(spark, d):
    return notes.mask_code_fences(texts(spark, d)).select("path", F.posexplode(F.split("content", "\n")).alias("i", "line")).select("path", (F.col("i") + 1).cast("bigint").alias("line_no"), "line")


@query("p03_extract_links", f"with {LINKS} select * from lk")
def p03(spark, d):
    return links(spark, d).withColumn("line_no", F.col("line_no").cast("bigint"))


@query("p08_note_identity", "select path, basename as id, 'source' as type, trim(regexp_extract(content, '(^|\\n)# ([^\\n]*)', 2)) as title from note_texts")
def p08(spark, d):
    own = texts(spark, d).withColumn("modified_at", F.lit("2024-01-01").cast("timestamp"))
    return notes.derive_note_identity(own, notes.extract_fields(own)).select("path", "id", "type", "title")


@query("f01_list_notes", "select path from notes where entity_type = 'concepts' and path like 'concepts/p1%'")
def f01(spark, d):
    return notes.list_notes(table(spark, d, "notes"), "concepts", "concepts/p1").select("path")


@query("f07_changed_since", "select path, str as updated from note_fields where key = 'updated' and str >= '1997-01-01'")
def f07(spark, d):
    return notes.changed_since(fields(spark, d).where("key = 'updated'").select("path", F.col("str").alias("updated")), "1997-01-01")


@query("a02_basename_index", "select substr(basename, 2) as basename, string_agg(slug, ',' order by slug) as slugs from notes group by substr(basename, 2)")
def a02(spark, d):
    return notes.basename_index(table(spark, d, "notes").withColumn("basename", F.expr("substr(basename, 2)"))).select("basename", F.array_join("slugs", ",").alias("slugs"))


@query("a04_type_coverage", "select entity_type, confidence, count(*) as n, cast(grouping(entity_type, confidence) as bigint) as level from (select n.path, n.entity_type, f.str as confidence from notes n left join note_fields f on f.path = n.path and f.key = 'confidence') x group by cube (entity_type, confidence)")
def a04(spark, d):
    return notes.type_coverage(table(spark, d, "notes"), fields(spark, d))


@query("j01_resolve_links", f"with {LINKS}, u as (select basename, min(slug) as slug from notes group by basename having count(*) = 1) select src_path, line_no, raw_target, in_fence, coalesce(n.slug, u.slug) as resolved, case when n.slug is not null then 'exact' when u.slug is not null then 'basename' end as how from lk left join notes n on n.slug = {BARE} left join u on u.basename = regexp_replace({BARE}, '^.*/', '')")
def j01(spark, d):
    return notes.resolve_links(links(spark, d), table(spark, d, "notes")).withColumn("line_no", F.col("line_no").cast("bigint"))


@query("j04_resolve_aliases", """with t as (select distinct p_brand as term from part union select distinct upper(p_name) from part where p_partkey % 20 = 0), nm as (select slug, 0 as r, lower(trim(slug)) as name from foundations union all select slug, 1, lower(trim(title)) from foundations union all select slug, 2, lower(trim(unnest(aliases))) from foundations),
b as (select name, slug, min(r) as r from nm group by name, slug), k as (select term, min((r, slug)) as x, count(slug) as n from t left join b on b.name = lower(trim(term)) group by term)
select term, case when n > 0 then x[2] end as slug, case when n > 0 then case x[1] when 0 then 'slug' when 1 then 'title' else 'alias' end end as source, n > 1 as ambiguous from k""")
def j04(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    return notes.resolve_aliases(part.select(F.col("p_brand").alias("term")).union(part.where("p_partkey % 20 = 0").select(F.upper("p_name"))), table(spark, d, "foundations"))


@query("j07_raw_drift", f"with {RAW}, pv as (select path, max(case when key = 'provenance' then str end) as p from note_fields group by path), r as (select path, max(case when e in (select path from files) then 0 else 1 end) as gone from (select path, unnest(items) as e from note_fields where key = 'raw_paths') x group by path) select pv.path, case when gone is null or p = 'missing' then 'skipped' when gone = 1 then 'drift_detected' else 'replayable' end as drift from pv left join r on r.path = pv.path")
def j07(spark, d):
    return verify.raw_drift(fields(spark, d), raw_files(spark, d))


@query("j08_backfill_ids", f"with {IMPLIED}, al as (select path, ns, value from dc union all select path, ns, value from im where not exists (select 1 from dc where dc.path = im.path and dc.ns = im.ns)) select path, string_agg(ns || '=' || value, ',' order by ns) as ids from al group by path")
def j08(spark, d):
    flat = F.transform(F.array_sort(F.map_entries("ids")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return verify.backfill_ids(sources(spark, d)).select("path", F.array_join(flat, ",").alias("ids")).where("ids <> ''")


@query("j09_uningested_files", f"with {RAW} select path from files where path not in (select unnest(items) from note_fields where key = 'raw_paths')")
def j09(spark, d):
    return verify.uningested_files(raw_files(spark, d), fields(spark, d))


@query("j10_stale_mentions", f"with {LINKS}, e as (select src, dst from edges where type in ('uses_concept') union select dst, src from edges where type in ('uses_concept')) select distinct src, dst from e join lk on src_path = src and raw_target = dst")
def j10(spark, d):
    return notes.stale_mentions(table(spark, d, "edges").where("type = 'uses_concept'"), links(spark, d))


@query("r01_fill_required", f"with {DEFS}, {SRC}, {DEFAULTS}, m as (select s.path, d.key, field_type, value from src s join defs d on d.entity_type = s.entity_type and required left join dv on dv.entity_type = s.entity_type and dv.key = d.key where not exists (select 1 from note_fields f where f.path = s.path and f.key = d.key)) select path, key, case field_type when 'array' then '[]' when 'iso-date' then '2024-01-01' end as new_value from m where field_type in ('array', 'iso-date')")
def r01(spark, d):
    n = src_notes(spark, d)
    identity = n.select("path", F.col("basename").alias("id"), F.lit("source").alias("type"), F.col("basename").alias("title"), F.lit("2024-01-01").alias("created"))
    return repair.fill_required(n, fields(spark, d), identity)


#: Concepts whose number is divisible by 5 have no edges here, only links in their texts; line items are the links.
HOLLOW = """cut as (select * from edges where not (src like 'concepts/%' and try_cast(substr(src, 11) as bigint) % 5 = 0) and not (dst like 'concepts/%' and try_cast(substr(dst, 11) as bigint) % 5 = 0)),
open as (select path, 'key_sources' as key from notes where entity_type in ('concepts', 'people') union all select path, 'related_concepts' from notes where entity_type = 'concepts'),
near as (select src as path, 'key_sources' as key, dst as other from cut where type in ('used_in', 'authored') union select dst, 'key_sources', src from cut where type in ('uses_concept', 'authored_by')
  union select src, 'related_concepts', dst from cut where type = 'related_to' union select dst, 'related_concepts', src from cut where type = 'related_to'),
graph as (select path, key, string_agg(other, ',' order by other) as items from (select distinct path, key, other from near where other <> path and other in (select path from notes)) x group by path, key),
body as (select path, 'key_sources' as key, string_agg(other, ',' order by other) as items from (select distinct 'concepts/p' || l_partkey as path, 'sources/o' || l_orderkey as other from lineitem where l_linenumber <> 3) x where other in (select path from notes) group by path)"""


@query("r02_rebuild_arrays", f"""with {HOLLOW} select path, key, str as items from note_fields where key = 'authors' and kind = 'string'
union all select o.path, o.key, coalesce(g.items, b.items, '') from open o left join graph g on g.path = o.path and g.key = o.key left join body b on b.path = o.path and b.key = o.key""")
def r02(spark, d):
    """Sources with one author as text; concepts and people with nulls, blanks and TODO: filled from edges, else from links, else empty."""
    n, none = table(spark, d, "notes"), F.lit(None)
    other = lambda key, kind, said, types: n.where(F.col("entity_type").isin(*types)).select("path", F.lit(key).alias("key"), F.lit(kind).alias("kind"), said.cast("string").alias("str"), none.cast("double").alias("num"), none.cast("array<string>").alias("items"))
    own = fields(spark, d).union(other("key_sources", "null", none, ["concepts"])).union(other("key_sources", "string", F.lit(" "), ["people"])).union(other("related_concepts", "string", F.lit("TODO"), ["concepts"]))
    hollow = lambda end: F.col(end).startswith("concepts/") & (F.expr(f"try_cast(substr({end}, 11) as bigint)") % 5 == 0)
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    linked = lines.select(F.expr("'concepts/p' || l_partkey").alias("src_path"), F.expr("'sources/o' || l_orderkey").alias("raw_target"), (F.col("l_linenumber") == 3).alias("in_fence"))
    return repair.rebuild_arrays(n, own, landed(spark, d, "edges").where(~hollow("src") & ~hollow("dst")), notes.resolve_links(linked, n)).select("path", "key", F.array_join("items", ",").alias("items"))


@query("r03_drop_legacy_fields", f"with {SRC} select s.path, s.key from note_fields s join src on src.path = s.path where s.key = 'slug' and s.str = s.path")
def r03(spark, d):
    f = fields(spark, d)
    return repair.drop_legacy_fields(f, checks.check_types(src_notes(spark, d), f))


@query("r04_legacy_defaults", "select n.path, 'confidence' as key, 'unverified' as value from notes n where entity_type in ('sources', 'concepts') and not exists (select 1 from note_fields f where f.path = n.path and f.key = 'confidence') union all select n.path, 'provenance', 'missing' from notes n where entity_type = 'sources' and not exists (select 1 from note_fields f where f.path = n.path and f.key = 'provenance')")
def r04(spark, d):
    return repair.add_legacy_defaults(table(spark, d, "notes"), fields(spark, d))


@query("r05_rewrite_links", "select path, regexp_replace(content, '\\[\\[(p\\d+)\\|x\\]\\]', '[[concepts/\\1|x]]', 'g') as new from note_texts where regexp_matches(content, '\\[\\[(p\\d+)\\|x\\]\\]')")
def r05(spark, d):
    wanted = links(spark, d).where("not in_fence and raw_target rlike '^p[0-9]+$'").select(F.col("src_path").alias("path"), F.col("raw_target").alias("target"), F.concat(F.lit("concepts/"), "raw_target").alias("replacement")).distinct()
    return repair.rewrite_links(texts(spark, d), wanted).select("path", "new")


@query("r06_rename_slugs", "with b as (select path || '_X' as path, path || '-x' as new_path from notes where entity_type = 'people') select path, new_path, false as collides from b")
def r06(spark, d):
    n = table(spark, d, "notes").where("entity_type = 'people'")
    return repair.rename_slugs(n.withColumn("path", F.concat("path", F.lit("_X"))).withColumn("basename", F.concat("basename", F.lit("_X"))))


@query("r07_field_updates", f"with {SRC} select f.path, f.key, f.kind, case when f.key = 'title' and f.path like '%1' then 'new' else f.str end as str from note_fields f join src on src.path = f.path where not (f.key = 'confidence' and f.path like '%2')")
def r07(spark, d):
    f = fields(spark, d).join(src_notes(spark, d).select("path"), "path", "left_semi")
    change = f.where("key = 'title' and path like '%1'").withColumn("str", F.lit("new")).unionByName(f.where("key = 'confidence' and path like '%2'").withColumn("kind", F.lit("null"))).unionByName(f.where("key = 'year'").withColumn("kind", F.lit("string")).withColumn("str", F.lit("x")))
    return repair.apply_field_updates(src_notes(spark, d), f, change)[0].select("path", "key", "kind", "str")


OBJECTS = """ob as (select 'sources/o' || o_orderkey as path, k as key, o_orderkey as o from orders cross join (values ('external_ids'), ('ranking')) ks(k) where o_orderkey % 50 <> 0 and not (k = 'ranking' and o_orderkey % 7 = 0)),
base as (select path, key, 'doi' as name, '10.1/x' || o as text from ob where key = 'external_ids' union all select path, key, 'odd', 'kept' from ob where key = 'external_ids' union all select path, key, 's2', 's' || o from ob where key = 'external_ids' and o % 2 = 0
  union all select path, key, 'citations', cast(o % 50 as varchar) from ob where key = 'ranking')"""
#: Updates of objects from line items, some of them refused: op, key, up to two entries, and the kind of value.
OBJECT_UPDATES = """up as (select 'sources/o' || l_orderkey as path, cast(l_linenumber as bigint) * 10000000000 + l_partkey * 10000 + l_suppkey as turn, case when l_partkey % 5 = 0 then 'set' else 'merge' end as op,
  case when l_partkey % 2 = 0 then 'external_ids' else 'ranking' end as key, case when l_suppkey % 11 = 0 then 'string' else 'object' end as kind,
  case when l_partkey % 2 = 1 then 'line' || l_linenumber when l_partkey % 3 = 0 then 's2' when l_partkey % 3 = 1 then 'openalex' else 'junk' end as n1, case when l_suppkey % 6 = 0 then null else 'v' || l_partkey end as t1,
  case when l_partkey % 2 = 1 then 'score' when l_suppkey % 4 = 0 then 'doi' else 'arxiv' end as n2, case when l_suppkey % 13 = 0 then '' else 'w' || l_suppkey end as t2 from lineitem)"""
JUDGED = """jd as (select u.*, case when s.path is null then 'unknown note' when op = 'merge' and kind <> 'object' then 'only objects merge' when kind <> 'object' then 'wrong type' end as problem from up u left join src s on s.path = u.path)"""


def object_fields(spark, d):
    """External ids and rankings of source notes as objects."""
    o = spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 50 <> 0").select(F.col("o_orderkey").alias("o"))
    both = o.select("o", F.explode(F.array(F.lit("external_ids"), F.lit("ranking"))).alias("key")).where("not (key = 'ranking' and o % 7 = 0)")
    ids = F.expr("map_filter(map('doi', '10.1/x' || o, 'odd', 'kept', 's2', case when o % 2 = 0 then 's' || o end), (k, v) -> v is not null)")
    entries = F.when(F.col("key") == "external_ids", ids).otherwise(F.expr("map('citations', cast(o % 50 as string))"))
    return both.select(F.concat(F.lit("sources/o"), "o").alias("path"), "key", F.lit("object").alias("kind"), F.lit(None).cast("string").alias("str"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("array<string>").alias("items"), entries.alias("entries"))


def object_updates(spark, d):
    up = spark.sql(OBJECT_UPDATES[len("up as (") : -1].replace("from lineitem", "from {lineitem}"), lineitem=spark.read.parquet(f"{d}/lineitem.parquet"))
    entries = F.when(F.col("kind") == "object", F.map_from_arrays(F.array("n1", "n2"), F.array("t1", "t2")))
    return up.select("path", "key", "kind", F.when(F.col("kind") == "string", F.lit("text")).alias("str"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("array<string>").alias("items"), entries.alias("entries"), "turn", "op")


@query("r07_object_updates", f"""with {SRC}, {OBJECTS}, {OBJECT_UPDATES}, {JUDGED},
ls as (select path, key, max(turn) as since from jd where problem is null and op = 'set' group by path, key),
se as (select distinct j.path, j.key, unnest([n1, n2]) as name, unnest([t1, t2]) as text from jd j join ls on ls.path = j.path and ls.key = j.key and j.turn = since where problem is null and op = 'set'),
ov as (select j.path, j.key, turn, unnest([n1, n2]) as name, unnest([t1, t2]) as text from jd j left join ls on ls.path = j.path and ls.key = j.key where problem is null and op = 'merge' and (since is null or turn >= since)),
nw as (select path, key, name, text from (select *, row_number() over (partition by path, key, name order by turn desc, text desc nulls last) as rn from ov where key <> 'external_ids' or (name in ('doi', 'arxiv', 's2', 'url', 'openalex') and coalesce(text, 'x') <> '')) x where rn = 1),
st as (select path, key, name, text from se union all select b.path, b.key, name, text from base b where not exists (select 1 from ls where ls.path = b.path and ls.key = b.key)),
tk as (select path, key from ls union select path, key from nw),
al as (select path, key, name, text from nw where text is not null union all select s.path, s.key, s.name, s.text from st s where not exists (select 1 from nw where nw.path = s.path and nw.key = s.key and nw.name = s.name)),
cl as (select al.* from al left join tk on tk.path = al.path and tk.key = al.key where al.key <> 'external_ids' or tk.path is null or (name in ('doi', 'arxiv', 's2', 'url', 'openalex') and text <> '')),
ks as (select path, key from ob union select path, key from tk)
select ks.path, ks.key, coalesce(string_agg(name || '=' || coalesce(text, 'null'), ',' order by name), '') as entries from ks left join cl on cl.path = ks.path and cl.key = ks.key group by ks.path, ks.key""")
def r07_objects(spark, d):
    after = repair.apply_field_updates(src_notes(spark, d), object_fields(spark, d), object_updates(spark, d))[0]
    flat = F.transform(F.array_sort(F.map_entries("entries")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))
    return after.select("path", "key", F.array_join(flat, ",").alias("entries"))


@query("r07_refused_updates", f"with {SRC}, {OBJECT_UPDATES}, {JUDGED} select path, key, turn, op, problem from jd where problem is not null")
def r07_refused(spark, d):
    return repair.apply_field_updates(src_notes(spark, d), object_fields(spark, d), object_updates(spark, d))[1].select("path", "key", "turn", "op", "problem")


@query("r08_suggest_fixes", f"with {SRC} select 'L11' as check_id, path as file, 'see the message: confidence missing' as advice from src where path not in (select path from note_fields where key = 'confidence')")
def r08(spark, d):
    return repair.suggest_fixes(checks.check_confidence(src_notes(spark, d), fields(spark, d)))


@query("s07_catalog_table", "select slug from notes order by slug")
def s07(spark, d):
    return notes.catalog_table(table(spark, d, "notes")).select("slug")


@query("s08_document_manifest", "select sha256(text) as sha256, substr(sha256(text), 1, 16) as slug, 'text' as kind, cast(max(strlen(text)) as bigint) as size, cast(max(length(text)) as bigint) as n_chars from documents group by text")
def s08(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").alias("content"))
    return files.document_manifest(docs).withColumn("size", F.col("size").cast("bigint")).withColumn("n_chars", F.col("n_chars").cast("bigint"))


@query("p05_html_to_text", "select page_id, md5(array_to_string(list_filter(list_transform(split(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script)\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<head\\b[^>]*>.*?</head\\s*>', chr(10), 'g'), '(?s)<!--.*?-->', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g'), '&nbsp;', '\u00a0'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), chr(10)), lambda x: regexp_replace(x, '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g')), lambda x: x <> ''), chr(10))) as digest from pages")
def p05(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.md5(text.html_to_text("html")).alias("digest"))


@query("p07_assign_slugs", "with s as (select doc_id, regexp_replace(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')), ' +', '-', 'g') as slug from documents) select doc_id, md5(slug) as digest, count(*) over (partition by slug) as collisions from s")
def p07_whole(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return text.assign_slugs(docs, "text", "note").select("doc_id", F.md5("slug").alias("digest"), "collisions")


@query("u01_fold_text", "select doc_id, md5(trim(regexp_replace(regexp_replace(replace(lower(strip_accents(replace(replace(translate(text, '‘’–—', '''''--'), 'đ', 'd'), 'Đ', 'd'))), '-', ' '), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))) as digest from documents")
def u01(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(text.fold_text("text")).alias("digest"))
