"""Queries of the document, verification, review and reading operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import reading, report, verify
from ..sources.storage import shared_dir
from ..streaming import feeds
from .adapters import landed, table
from .registry import query


def pages(spark, d):
    return landed(spark, d, "source_pages")


@query("p22_document_sizing", "select source_id, count(*) as pages, cast(sum(length(text)) as bigint) as chars, cast(sum(length(text)) // 4 as bigint) as tokens, sum(length(text)) < 32 * count(*) as scanned, count(*) >= 50 or sum(length(text)) // 4 >= 50000 as is_long from source_pages group by source_id")
def p22(spark, d):
    return verify.document_sizing(pages(spark, d))


@query("p18_segment_pages", "with t as (select doc_id, line as text, i from (select doc_id, generate_subscripts(split(text, chr(10)), 1) as i, unnest(split(text, chr(10))) as line from documents) x) select doc_id as source_id, i % 5 + 1 as page_no, arg_max(text, i) as text from t where not regexp_matches(text, '^\\[\\[page') group by doc_id, i % 5")
def p18(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda s, i: F.concat(F.lit("[[page "), ((i + 1) % 5 + 1).cast("string"), F.lit("]]\n"), s)), "\n")
    return verify.segment_pages(docs.select(F.col("doc_id").alias("source_id"), F.concat(F.lit("lead\n"), marked).alias("text"))).withColumn("page_no", F.col("page_no").cast("bigint"))


QUOTED = """ln as (select path, generate_subscripts(split(content, chr(10)), 1) as line, unnest(split(content, chr(10))) as t from note_texts)
select path as note, line, cast(regexp_extract(t, '\\(p\\. (\\d+)\\)', 1) as int) as lo, cast(regexp_extract(t, '\\(p\\. (\\d+)\\)', 1) as int) as hi, 'quoted words of which there are many' as quote from ln where regexp_matches(t, '\\(p\\. \\d+\\)')"""


@query("p19_extract_quotes", f"with {QUOTED}")
def p19(spark, d):
    return verify.extract_quotes(table(spark, d, "note_texts")).withColumn("line", F.col("line").cast("bigint")).withColumn("lo", F.col("lo").cast("int")).withColumn("hi", F.col("hi").cast("int"))


FOLD = "trim(regexp_replace(regexp_replace(replace(lower(strip_accents(replace(replace(translate({}, '‘’–—', '''''--'), 'đ', 'd'), 'Đ', 'd'))), '-', ' '), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
JUDGED = f"""pg as (select source_id, page_no, {FOLD.format('text')} as f from source_pages), q as (select *, {FOLD.format('quote')} as n from quotes),
w as (select q.quote_id, n, string_agg(case when pg.page_no between lo and hi then f end, ' ' order by pg.page_no) as exact, string_agg(f, ' ' order by pg.page_no) as wide from q join (select * from pg where f <> '') pg on pg.source_id = q.source_id and pg.page_no between lo - 1 and hi + 1 group by q.quote_id, n),
v as (select q.quote_id, q.source_id, case when contains(exact, q.n) then 'OK' when contains(wide, q.n) then 'NEAR' else 'FAIL' end as verdict from q left join w on w.quote_id = q.quote_id)"""


@query("v01_verify_quotes", f"with {JUDGED} select quote_id, verdict from v")
def v01(spark, d):
    return verify.verify_quotes(table(spark, d, "quotes"), pages(spark, d)).select("quote_id", "verdict")


@query("v02_quote_report", f"with {JUDGED} select source_id % 10 as note, count(*) as checked, cast(sum(case when verdict = 'OK' then 1 else 0 end) as bigint) as ok, cast(sum(case when verdict = 'NEAR' then 1 else 0 end) as bigint) as near, cast(sum(case when verdict = 'FAIL' then 1 else 0 end) as bigint) as fail from v group by rollup (source_id % 10)")
def v02(spark, d):
    judged = verify.verify_quotes(table(spark, d, "quotes"), pages(spark, d))
    return verify.quote_report(judged.withColumn("note", F.col("source_id") % 10))


def reviews(spark, d):
    return table(spark, d, "reviews")


RANK = "case class when 'dismiss' then 1 when 'defer' then 2 when 'patch' then 3 else 4 end"


@query("f09_validate_reviews", "select id, case when reviewer = 'external' then 'unknown reviewer' when id % 4 = 0 then 'no claim' end as problem from reviews")
def f09(spark, d):
    own = reviews(spark, d).withColumn("reviewer", F.expr("case when reviewer = 'external' then 'other' else reviewer end")).withColumn("claim", F.expr("case when id % 4 = 0 then ' ' else claim end"))
    return verify.validate_review_findings(own).select("id", "problem")


@query("v03_merge_reviews", f"select entry, claim, case max({RANK}) when 1 then 'dismiss' when 2 then 'defer' when 3 then 'patch' else 'decision_needed' end as class, count(*) as n from reviews group by entry, claim")
def v03(spark, d):
    return verify.merge_reviews(reviews(spark, d))


@query("v04_verdicts", f"with m as (select entry, max({RANK}) as w from reviews where class <> 'dismiss' or id % 2 = 0 group by entry), e as (select distinct entry, cast(substr(entry, 2) as bigint) as k from reviews) select e.entry, case when k % 5 = 0 then 'drift_detected' when w = 4 then 'needs_decision' when w in (2, 3) then 'findings_pending' when k % 5 = 1 then 'skipped' when w is null and k % 5 <> 2 then 'not_applicable' else 'passed' end as verdict from e left join m on m.entry = e.entry")
def v04(spark, d):
    own = reviews(spark, d)
    entries = own.select("entry").distinct()
    drift = entries.withColumn("k", F.expr("cast(substr(entry, 2) as bigint) % 5")).where("k < 3").select("entry", F.expr("case k when 0 then 'drift_detected' when 1 then 'skipped' else 'replayable' end").alias("drift"))
    return verify.verdicts(entries, drift, verify.merge_reviews(own.where("class <> 'dismiss' or id % 2 = 0")))


@query("w07_number_findings", "select id, row_number() over (partition by entry order by case reviewer when 'blind' then 1 when 'grounding' then 2 else 3 end, id) as number from reviews")
def w07(spark, d):
    return verify.number_findings(reviews(spark, d)).select("id", F.col("number").cast("bigint").alias("number"))


EDGES = "ce as (select distinct 'features' as type, chapter as src, c1 as dst from chapters union select 'features', chapter, c2 from chapters union select 'tagged_with', chapter, theme from chapters union select 'appears_in', c1, chapter from chapters where number % 3 <> 0)"


def chapters(spark, d):
    return table(spark, d, "chapters")


def chapter_edges(spark, d):
    c = chapters(spark, d)
    one = lambda t, a, b: c.select(F.lit(t).alias("type"), F.col(a).alias("src"), F.col(b).alias("dst"))
    some = c.where("number % 3 <> 0").select(F.lit("appears_in").alias("type"), F.col("c1").alias("src"), F.col("chapter").alias("dst"))
    return one("features", "chapter", "c1").union(one("features", "chapter", "c2")).union(one("tagged_with", "chapter", "theme")).union(some).distinct()


@query("b01_recap_scope", f"with {EDGES}, r as (select distinct book, chapter from chapters where number < 3) select book, 'chapter' as kind, chapter as item from r union all select distinct book, 'character', dst from r join ce on src = chapter and type = 'features' union all select book, 'error', 'chapters/x' from chapters where number = 1")
def b01(spark, d):
    c = chapters(spark, d).select("book", "number", "chapter")
    broken = c.where("number = 1").select("book", F.lit(None).cast("bigint").alias("number"), F.lit("chapters/x").alias("chapter"))
    return reading.recap_scope(c.unionByName(broken), chapter_edges(spark, d), c.select("book", F.lit(3).alias("cursor")).distinct())


@query("b02_promote_themes", f"with {EDGES} select dst as theme, count(distinct src) as chapters, case when count(distinct src) >= 2 then 'promoted' else 'pending' end as status from ce where type = 'tagged_with' group by dst")
def b02(spark, d):
    return reading.promote_themes(chapter_edges(spark, d))


@query("b03_theme_characters", f"with {EDGES} select t.dst as theme, f.dst as character, count(distinct t.src) as chapters from ce t join ce f on f.src = t.src and f.type = 'features' where t.type = 'tagged_with' group by t.dst, f.dst having count(distinct t.src) >= 2")
def b03(spark, d):
    return reading.theme_characters(chapter_edges(spark, d))


@query("b04_cooccurrence", f"with {EDGES} select x.dst as a, y.dst as b, count(distinct x.src) as chapters from ce x join ce y on x.src = y.src and x.dst < y.dst where x.type = 'features' and y.type = 'features' group by x.dst, y.dst")
def b04(spark, d):
    return reading.cooccurrence(chapter_edges(spark, d))


@query("b05_topic_candidates", "with s as (select slug from notes where entity_type = 'people'), b as (select src as slug, dst as nb from edges union select dst, src from edges), n as (select split(nb, '/')[1] as kind, nb, count(*) as links from b where slug in (select slug from s) and nb not in (select slug from s) and (nb like 'sources/%' or nb like 'concepts/%') group by nb) select kind, nb as neighbor, links from (select *, row_number() over (partition by kind order by links desc, nb) as rn from n) x where rn <= 10")
def b05_all(spark, d):
    return reading.topic_candidates(table(spark, d, "edges"), table(spark, d, "notes").where("entity_type = 'people'").select("slug"))


@query("b06_missing_appearances", f"with {EDGES} select src as file, dst as character from ce f where type = 'features' and not exists (select 1 from ce r where r.type = 'appears_in' and r.src = f.dst and r.dst = f.src)")
def b06(spark, d):
    own = chapter_edges(spark, d).withColumn("seq", F.lit(0)).withColumn("confidence", F.lit(None).cast("string"))
    return reading.missing_appearances(own).select("file", F.split("message", " ")[1].alias("character")).where("character like 'characters/%'")


@query("a08_activity_gap", "select event_type as skill, count(*) as events, cast(max(ts) as date) as last_day, cast(date '2030-01-01' - cast(max(ts) as date) as int) as days_since, date '2030-01-01' - cast(max(ts) as date) > 30 as idle from events group by event_type")
def a08(spark, d):
    own = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("skill"), F.to_date("ts").alias("day"))
    return report.activity_gap(own, "2030-01-01")


def streamed(spark, d, name, run):
    """run(folder of the events as landed JSON, output folder, checkpoint folder)."""
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{d}/events.parquet")
    entries = events.select(F.col("user_id").cast("string").alias("feed_id"), (F.col("event_id") % 3000).cast("string").alias("id"), F.lit(None).cast("string").alias("guid"), F.col("event_type").alias("title"), F.lit("").alias("link"), F.lit("").alias("summary"), F.col("ts").alias("updated"))
    entries.coalesce(4).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(f"{root}/landed")
    return run(f"{root}/landed", f"{root}/out", f"{root}/checkpoint")


KEYS = "select distinct cast(user_id as varchar) as feed_id, cast(event_id % 3000 as varchar) as entry_key from events"


@query("t02_stream_new_entries", KEYS)
def t02(spark, d):
    def run(landed, out, checkpoint):
        new = feeds.stream_new_entries(feeds.stream_feed_entries(spark, landed), days=36500)
        new.select("feed_id", "entry_key").writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
        return spark.read.schema("feed_id string, entry_key string").parquet(out)

    return streamed(spark, d, "t02", run)


MOST, DAYS = 12, 20


def _forgetting() -> str:
    """Three polls: what each emits, and what the feeds know after it."""
    out = ["ev as (select cast(user_id as varchar) as feed_id, cast(event_id % 40 as varchar) as k, date_trunc('milliseconds', ts) as t, (event_id // 40) % 3 as b from events)"]
    for b in range(3):
        out.append(f"f{b} as (select feed_id, k, min(t) as f, max(t) as l from ev where b = {b} group by feed_id, k)")
        before = f"known{b - 1}" if b else "(select feed_id, k, l from f0 where false)"
        out.append(f"e{b} as (select feed_id, k, f from f{b} where not exists (select 1 from {before} o where o.feed_id = f{b}.feed_id and o.k = f{b}.k))")
        out.append(f"now{b} as (select feed_id, k, l from f{b} union all select feed_id, k, l from {before} o where not exists (select 1 from f{b} n where n.feed_id = o.feed_id and n.k = o.k))")
        out.append(f"young{b} as (select * from (select *, max(l) over (partition by feed_id) as newest from now{b}) x where l >= newest - interval {DAYS} day)")
        out.append(f"known{b} as (select feed_id, k, l from (select *, row_number() over (partition by feed_id order by l desc, k desc) as rn from young{b}) x where rn <= {MOST})")
    return "with " + ", ".join(out) + " select feed_id, k as entry_key, f as updated from e0 union all select * from e1 union all select * from e2"


@query("t02_stream_forgetting", _forgetting())
def t02_forgetting(spark, d):
    """Three polls of feeds that know few keys and forget them soon, so that some come again."""
    root = f"{shared_dir(spark)}/t02-{uuid.uuid4().hex}"
    none = F.lit(None).cast("string")
    entries = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("feed_id"), (F.col("event_id") % 40).cast("string").alias("id"), none.alias("guid"), none.alias("title"), none.alias("link"), none.alias("summary"), F.col("ts").alias("updated"), F.expr("event_id div 40 % 3").alias("b"))
    for b in range(3):
        entries.where(f"b = {b}").drop("b").write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(f"{root}/landed")
        new = feeds.stream_new_entries_capped(feeds.stream_feed_entries(spark, f"{root}/landed"), DAYS, MOST)
        feeds.start_with_state(spark, new.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/out").trigger(availableNow=True).start).awaitTermination()
    return spark.read.schema(feeds.ENTRY).parquet(f"{root}/out")


@query("t03_stream_capped", "with k as (select cast(user_id as varchar) as feed_id, cast(event_id % 3000 as varchar) as entry_key, min(ts) as updated from events group by user_id, event_id % 3000) select feed_id, entry_key from (select *, row_number() over (partition by feed_id order by updated desc, entry_key) as rn from k) x where rn <= 5")
def t03(spark, d):
    def run(landed, out, checkpoint):
        feeds.stream_capped(feeds.stream_feed_entries(spark, landed), out, out + "-backlog", checkpoint, 5).awaitTermination()
        return spark.read.schema("feed_id string, entry_key string").parquet(out).select("feed_id", "entry_key")

    return streamed(spark, d, "t03", run)
