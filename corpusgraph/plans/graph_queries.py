"""Queries of the graph operators over the edges made from line items."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..operators import checks, graph
from .adapters import duckdb_text, landed, table
from .registry import query, sql_of
from .schema import edge_type_rows, sql_values

TYPES = "et as (select * from " + sql_values([(r[0], r[3], r[4], r[5]) for r in edge_type_rows()]) + " v(name, reverse, sym, terminal))"
EXEMPT = "regexp_matches(dst, '^(foundations/.*|outputs/.*|reflections/.*|.*://.*)$')"
NEEDS = f"reverse is not null and not sym and not terminal and not {EXEMPT}"
CANON = "select seq, case when sym and src > dst then dst else src end as src, type, case when sym and src > dst then src else dst end as dst, confidence"
MISSING = f"select f.* from (select e.*, reverse from edges e join et on name = type where {NEEDS}) f left join (select distinct src, type, dst from edges) r on r.src = f.dst and r.type = f.reverse and r.dst = f.src where r.src is null"


def edges(spark, d):
    return landed(spark, d, "edges")


def citations(spark, d):
    return landed(spark, d, "citations")


def notes(spark, d):
    return table(spark, d, "notes")


@query("l06_missing_reverse", f"with {TYPES}, m as ({MISSING}) select src as file, 'missing ' || dst || ' ' || reverse || ' ' || src as message from m")
def l06(spark, d):
    return checks.check_missing_reverse(edges(spark, d)).select("file", "message")


@query("l07_symmetric_duplicates", f"""with {TYPES}, s as (select e.*, row_number() over (partition by type, src, dst order by seq) as rn from edges e join et on name = type where sym)
select src as file, 'duplicate ' || src || ' ' || type || ' ' || dst as message from s where rn > 1 or (src <> dst and exists (select 1 from s r where r.type = s.type and r.src = s.dst and r.dst = s.src))""")
def l07(spark, d):
    return checks.check_symmetric_duplicates(edges(spark, d)).select("file", "message")


@query("l08_edge_confidence", "select src as file, 'needs confidence ' || src || ' ' || type || ' ' || dst as message from edges where type = 'uses_concept' and (confidence is null or confidence not in ('high', 'medium', 'low'))")
def l08(spark, d):
    return checks.check_edge_confidence(edges(spark, d), spark.createDataFrame([("uses_concept",)], "type string")).select("file", "message")


@query("l17_dangling_edges", "with ends as (select src, type, src as slug from edges union all select src, type, dst from edges) select src as file, 'dangling ' || slug || ' ' || type as message from ends where not contains(slug, '://') and slug not in (select slug from notes)")
def l17(spark, d):
    return checks.check_dangling_edges(edges(spark, d), notes(spark, d)).select("file", "message")


@query("f02_edges_of", "with s as (select slug from notes where entity_type = 'people') select seq, src, type, dst, confidence, 'out' as direction from edges where src in (select slug from s) union all select seq, src, type, dst, confidence, 'in' from edges where dst in (select slug from s)")
def f02_all(spark, d):
    return graph.edges_of(edges(spark, d), notes(spark, d).where("entity_type = 'people'"))


@query("f03_citations_of", "with c as (select src, dst from edges where type = 'cites'), s as (select slug from notes where entity_type = 'sources') select src as slug, 'cites' as direction, dst as other from c where src in (select slug from s) union all select dst, 'cited_by', src from c where dst in (select slug from s)")
def f03(spark, d):
    return graph.citations_of(citations(spark, d), notes(spark, d).where("entity_type = 'sources'"))


@query("f04_exempt_targets", f"select dst, {EXEMPT} as exempt, count(*) as n from edges group by dst")
def f04(spark, d):
    return graph.exempt_targets(edges(spark, d), "dst").groupBy("dst", "exempt").agg(F.count("*").alias("n"))


@query("f10_validate_edge_batch", "select seq, case when type = 'grounded_in' then 'unknown type' when confidence = 'odd' then 'bad confidence' end as problem from (select seq, type, case when confidence = 'low' then 'odd' else confidence end as confidence from edges) e")
def f10(spark, d):
    batch = edges(spark, d).withColumn("type", F.when(F.col("type") == "grounded_in", "grounds").otherwise(F.col("type"))).withColumn("confidence", F.when(F.col("confidence") == "low", "odd").otherwise(F.col("confidence")))
    return graph.validate_edge_batch(batch).select("seq", "problem")


@query("j02_neighbors", "with s as (select slug from notes where entity_type = 'people'), b as (select src as slug, dst as neighbor from edges union select dst, src from edges) select slug, neighbor from b where slug in (select slug from s)")
def j02(spark, d):
    return graph.neighbors(edges(spark, d), notes(spark, d).where("entity_type = 'people'"))


@query("j03_expand_subgraph", """with b as (select src as slug, dst as nxt from edges where type in ('cites', 'related_to') union select dst, src from edges where type in ('cites', 'related_to')),
h0 as (select distinct slug from notes where entity_type = 'concepts' and length(basename) = 2), h1 as (select distinct nxt as slug from b where slug in (select slug from h0) and nxt not in (select slug from h0)),
h2 as (select distinct nxt as slug from b where slug in (select slug from h1) and nxt not in (select slug from h0) and nxt not in (select slug from h1)),
h3 as (select distinct nxt as slug from b where slug in (select slug from h2) and nxt not in (select slug from h0) and nxt not in (select slug from h1) and nxt not in (select slug from h2))
select slug, 0 as hops from h0 union all select slug, 1 from h1 union all select slug, 2 from h2 union all select slug, 3 from h3""")
def j03(spark, d):
    return graph.expand_subgraph(edges(spark, d).where("type in ('cites', 'related_to')"), notes(spark, d).where("entity_type = 'concepts' and length(basename) = 2"), 3)


@query("a03_link_degrees", "select slug, cast(sum(o) as bigint) as n_out, cast(sum(i) as bigint) as n_in from (select src as slug, 1 as o, 0 as i from edges union all select dst, 0, 1 from edges) e group by slug")
def a03(spark, d):
    return graph.link_degrees(edges(spark, d))


@query("w03_first_per_key", "select seq, src, type, dst, confidence from (select *, row_number() over (partition by src, type order by seq, dst) as rn from edges) e where rn = 1")
def w03(spark, d):
    return graph.first_per_key(edges(spark, d), ["src", "type"], ["seq", "dst"])


@query("g01_add_edges", f"""with {TYPES}, have as ({CANON} from edges join et on name = type where seq % 3 <> 0), old as (select * from edges where seq % 3 <> 0),
batch as (select *, row_number() over (partition by src, type, dst order by seq) as rn from ({CANON} from edges join et on name = type where seq % 3 = 0) x),
held as materialized (select distinct src, type, dst from have),
fresh as materialized (select b.seq, b.src, b.type, b.dst, b.confidence from batch b left join held h on h.src = b.src and h.type = b.type and h.dst = b.dst where b.rn = 1 and h.src is null),
offer as (select *, 'forward' as source, seq * 2 as turn from fresh union all select f.seq, dst, reverse, src, confidence, 'reverse', seq * 2 + 1 from fresh f join et on name = type where {NEEDS}),
ranked as (select o.*, row_number() over (partition by o.src, o.type, o.dst order by turn) as rn from offer o left join held h on h.src = o.src and h.type = o.type and h.dst = o.dst where h.src is null)
select seq, src, type, dst, confidence, 'existing' as source from old union all select seq, src, type, dst, confidence, source from ranked where rn = 1""")
def g01(spark, d):
    e = edges(spark, d)
    return graph.add_edges(e.where("seq % 3 <> 0"), e.where("seq % 3 = 0"))


G01 = sql_of("g01_add_edges")


@query("g01_edge_counts", f"select count(*) filter (where source = 'forward') as added, (select count(*) from lineitem_edges where seq % 3 = 0) - count(*) filter (where source = 'forward') as skipped, count(*) filter (where source = 'reverse') as reverses from ({G01}) g".replace("lineitem_edges", f"({duckdb_text('edges')})"))
def g01_counts(spark, d):
    """The counts of g01_add_edges, observed while its result is written."""
    e, counts = edges(spark, d), Observation()
    graph.add_edges(e.where("seq % 3 <> 0"), e.where("seq % 3 = 0"), counts).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(counts.get[c] for c in ("added", "skipped", "reverses"))], "added long, skipped long, reverses long")


@query("g02_dedup_edges", f"with {TYPES}, c as (select *, row_number() over (partition by src, type, dst order by seq) as rn from ({CANON} from edges join et on name = type) x) select seq, src, type, dst, confidence from c where rn = 1")
def g02(spark, d):
    return graph.dedup_edges(edges(spark, d))


GONE = f"spec as (select distinct src, type, dst from ({CANON} from edges join et on name = type where type in ('uses_concept', 'related_to') and seq % 7 = 0) x), gone as (select src, type, dst from spec union select dst, reverse, src from spec join et on name = type where {NEEDS})"
KEPT = "select x.seq, x.src, x.type, x.dst, x.confidence from (select e.*, case when sym and src > dst then dst else src end as a, case when sym and src > dst then src else dst end as b from edges e join et on name = type) x left join gone g on g.src = x.a and g.type = x.type and g.dst = x.b where g.src is null"


MARKED = "marked as (select x.seq, g.named from (select e.*, case when sym and src > dst then dst else src end as a, case when sym and src > dst then src else dst end as b from edges e join et on name = type) x left join roled g on g.src = x.a and g.type = x.type and g.dst = x.b)"


@query("g03_remove_edges", f"with {TYPES}, {GONE} {KEPT}")
def g03(spark, d):
    e = edges(spark, d)
    return graph.remove_edges(e, e.where("type in ('uses_concept', 'related_to') and seq % 7 = 0"))


@query("g03_removal_counts", f"with {TYPES}, {GONE}, roled as (select g.*, exists (select 1 from spec where spec.src = g.src and spec.type = g.type and spec.dst = g.dst) as named from gone g), {MARKED} select count(*) as before, count(*) filter (where named) as forward_removed, count(*) filter (where not named) as reverse_removed, count(*) filter (where named is null) as after from marked")
def g03_counts(spark, d):
    """The counts of g03_remove_edges, observed while its result is written."""
    e, counts = edges(spark, d), Observation()
    graph.remove_edges(e, e.where("type in ('uses_concept', 'related_to') and seq % 7 = 0"), counts).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(counts.get[c] for c in ("before", "forward_removed", "reverse_removed", "after"))], "before long, forward_removed long, reverse_removed long, after long")


@query("g04_replace_edges", f"""with {TYPES}, spec as (select distinct src, type, dst from edges where type = 'uses_concept' and seq % 70 = 0), gone as (select src, type, dst from spec union select dst, 'used_in', src from spec),
kept as ({KEPT}), olds as (select seq, src, dst, confidence from (select e.*, row_number() over (partition by src, dst order by seq, confidence nulls first) as rn from edges e where type = 'uses_concept') x where rn = 1),
new as (select o.seq, s.src, 'extends_concept' as type, s.dst, o.confidence from spec s join olds o on o.src = s.src and o.dst = s.dst)
select * from kept union all select * from new union all select seq, dst, 'extended_in', src, confidence from new""")
def g04(spark, d):
    e = edges(spark, d)
    specs = e.where("type = 'uses_concept' and seq % 70 = 0").select("src", "type", "dst").distinct()
    return graph.replace_edges(e, specs.withColumn("new_type", F.lit("extends_concept")).withColumn("confidence", F.lit(None).cast("string")))


@query("g05_citations", "with c as (select distinct src, dst from edges where type = 'cites') select src, dst from c where not (src like '%1' and dst like '%2')")
def g05(spark, d):
    c = citations(spark, d)
    return graph.change_citations(c.where("seq % 2 = 0"), c, c.where("src like '%1' and dst like '%2'"))


@query("g06_close_reverse", f"with {TYPES}, m as ({MISSING}), r as (select seq, dst as src, reverse as type, src as dst, confidence, row_number() over (partition by dst, reverse, src order by seq) as rn from m) select seq, src, type, dst, confidence from edges union all select seq, src, type, dst, confidence from r where rn = 1")
def g06(spark, d):
    return graph.close_reverse(edges(spark, d))


@query("g07_canonicalize_symmetric", f"with {TYPES}, c as (select x.*, row_number() over (partition by src, type, dst order by case when type in (select name from et where sym) then seq else -seq end) as rn from ({CANON} from edges join et on name = type) x) select seq, src, type, dst, confidence from c where rn = 1")
def g07(spark, d):
    return graph.canonicalize_symmetric(edges(spark, d))


@query("x01_edge_diff", f"with {TYPES}, c as ({CANON} from edges join et on name = type), a as (select distinct src, type, dst from c where seq % 3 <> 0), b as (select distinct src, type, dst from c where seq % 3 <> 1) select 'added' as change, * from (select * from b except select * from a) x union all select 'removed', * from (select * from a except select * from b) y")
def x01(spark, d):
    e = edges(spark, d)
    return graph.edge_diff(e.where("seq % 3 <> 0"), e.where("seq % 3 <> 1"))


@query("x02_merge_edge_sets", f"with {TYPES}, c as (select *, row_number() over (partition by src, type, dst order by seq % 3 = 1, seq) as rn from ({CANON} from edges join et on name = type) x) select seq, src, type, dst, confidence from c where rn = 1")
def x02(spark, d):
    e = edges(spark, d)
    return graph.merge_edge_sets(e.where("seq % 3 <> 1"), e.where("seq % 3 = 1"))
