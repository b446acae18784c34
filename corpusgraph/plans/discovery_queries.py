"""Queries of the id, ranking and discovery operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import discovery, graph
from .adapters import table
from .registry import query

YEAR = 2024
TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


def score_sql(topic: str) -> str:
    wanted = TOKENS.format(topic)
    text = TOKENS.format("title || ' ' || abstract")
    return f"0.4 * ln(1 + citations) + 0.3 * (case when year is null then 0 when year > {YEAR} then 1 else greatest(0, 1 - ({YEAR} - year) / 10.0) end) + 0.3 * (len(list_intersect({wanted}, {text})) / len({wanted}))"


def candidates(spark, d):
    return table(spark, d, "candidates")


def scored(spark, d, topic="large polished steel"):
    return discovery.score_candidates(candidates(spark, d), topic, YEAR)


MICRO = "cast(floor(({}) * 1000000 + 0.000001) as bigint)"


def micro(c):
    return F.floor(F.col(c) * 1000000 + 0.000001).cast("bigint")


@query("w01_score_candidates", f"select id, {MICRO.format(score_sql(repr('large polished steel')))} as score from candidates")
def w01(spark, d):
    return scored(spark, d).select("id", micro("score").alias("score"))


TOPICS = ("large polished steel", "small part", "red copper tin")


@query("w02_rank_candidates", f"with t as (select * from (values {', '.join(f'({t!r})' for t in TOPICS)}) v(topic)), s as (select topic, id, row_number() over (partition by topic order by round({score_sql('topic')}, 9) desc, lower(title), id) as rank from candidates cross join t) select topic, id, rank from s where rank <= 20")
def w02(spark, d):
    topics = spark.createDataFrame([(t,) for t in TOPICS], "topic string")
    return discovery.rank_candidates(candidates(spark, d), topics, YEAR).select("topic", "id", F.col("rank").cast("bigint").alias("rank"))


@query("w04_cap_new", "select id, item, source from (select *, row_number() over (partition by item, source order by citations desc, k) as rn from candidates) c where rn <= 5")
def w04(spark, d):
    return discovery.cap_new(candidates(spark, d), 5, ["item", "source"], [F.desc("citations"), "k"]).select("id", "item", "source")


@query("w05_evict_seen", "select feed, guid from (select *, row_number() over (partition by feed order by t desc, guid) as rn from (select user_id as feed, event_id as guid, case when event_id % 50 <> 0 then ts end as t from events) e where t >= (select max(ts) from events) - interval 90 days) x where rn <= 5")
def w05(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    now = events.agg(F.max("ts").cast("string")).first()[0]
    seen = events.select(F.col("user_id").alias("feed"), F.col("event_id").alias("guid"), F.when(F.col("event_id") % 50 == 0, "junk").otherwise(F.col("ts").cast("string")).alias("seen_at"))
    return discovery.evict_seen(seen, now, 90, 5).select("feed", "guid")


@query("w06_top_seeds", "select id, citations from candidates order by citations desc, id limit 5")
def w06(spark, d):
    return discovery.top_seeds(candidates(spark, d)).select("id", "citations")


@query("a05_top_authors", "select author, count(*) as papers from candidates group by author order by count(*) desc, min(k), author limit 3")
def a05(spark, d):
    return discovery.top_authors(candidates(spark, d).select(F.col("k").alias("pos"), F.array("author").alias("authors")))


@query("a06_duplicate_groups", "select text as key, count(*) as n, min(doc_id) as canonical from documents group by text having count(*) > 1")
def a06(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("key"), F.lit(1).alias("rich"))
    return discovery.duplicate_groups(docs, "key", "rich")


@query("a07_discovery_summary", "select item, source, count(*) as fetched, cast(sum(case when k % 3 = 0 then 1 else 0 end) as bigint) as fresh, cast(sum(case when k % 3 = 1 then 1 else 0 end) as bigint) as duplicates from candidates group by rollup (item, source)")
def a07(spark, d):
    return discovery.discovery_summary(candidates(spark, d).withColumn("status", F.expr("case k % 3 when 0 then 'new' when 1 then 'duplicate' else 'error' end")))


@query("a09_shortlist", f"with s as (select id, case when citations >= 30 then 'ready' when citations >= 20 then 'maybe' else 'skip' end as bucket, round({score_sql(repr('large polished steel'))}, 9) as score from candidates) select bucket, id from (select *, row_number() over (partition by bucket order by score desc, id) as rn from s) x where rn <= 10")
def a09(spark, d):
    own = scored(spark, d).withColumn("completeness", F.expr("case when citations >= 30 then 5 when citations >= 20 then 3 else 1 end")).withColumn("score", F.round("score", 9))
    return discovery.shortlist(own.withColumn("score", F.col("score") + 1e6), 10).select("bucket", "id")


@query("p23_candidate_quality", f"select id, 4 + case when k % 2 = 0 then 1 else 0 end - case when k % 5 = 0 then 1 else 0 end as completeness, cast(greatest(0, floor(10 * round({score_sql(repr('large polished steel'))}, 9) + 0.5)) as int) as score_int from candidates")
def p23(spark, d):
    own = scored(spark, d).withColumn("score", F.round("score", 9)).withColumn("url", F.expr("case when k % 2 = 0 then 'https://x.org/' || id end")).withColumn("authors", F.expr("case when k % 5 = 0 then cast(array() as array<string>) else array(author) end"))
    return discovery.candidate_quality(own).select("id", "completeness", "score_int")


@query("d01_keyword_phase", "with c as (select * from (select *, row_number() over (partition by source order by k) as rn from candidates) x where rn <= 50), o as (select *, row_number() over (partition by title order by k) as r2 from c) select title, k from o where r2 = 1 and title not in (select title from candidates where k % 13 = 0)")
def d01(spark, d):
    own = candidates(spark, d).select(F.col("title").alias("id"), "source", F.col("k").alias("pos"))
    titles = candidates(spark, d).where("k % 13 = 0").select(F.col("title").alias("key"))
    kept = discovery.discovery_keyword(own, titles, 50)
    return kept.select(F.col("id").alias("title"), F.col("pos").alias("k"))


def phase1(spark, d):
    """The records that the keyword phase (d01) finds."""
    own = candidates(spark, d)
    titles = own.where("k % 13 = 0").select(F.col("title").alias("key"))
    kept = discovery.discovery_keyword(own.select(F.col("title").alias("id"), "source", F.col("k").alias("pos")), titles, 50)
    return own.join(kept.select(F.col("pos").alias("k")), "k", "left_semi")


PHASE1 = "c1 as (select * from (select *, row_number() over (partition by source order by k) as rn from candidates) x where rn <= 50), o1 as (select *, row_number() over (partition by title order by k) as r2 from c1), p as (select * from o1 where r2 = 1 and title not in (select title from candidates where k % 13 = 0))"


@query("d02_author_phase", f"with {PHASE1}, a as (select author from p group by author order by count(*) desc, min(k), author limit 3) select id from candidates where author in (select author from a) and id not in (select id from p)")
def d02_after(spark, d):
    works = candidates(spark, d).select("id", F.array("author").alias("authors"))
    return discovery.discovery_authors(phase1(spark, d).select("id", F.array("author").alias("authors"), F.col("k").alias("pos")), works).select("id")


@query("d03_citation_phase", f"with {PHASE1}, s as (select id, k from p order by citations desc, id limit 5), c as (select 'p' || (k + i) as id, k, i, row_number() over (partition by k order by i) as rn from s cross join (select unnest(range(1, 31)) as i) r), x as (select distinct id from c where rn <= 10) select id from x where id not in (select id from p)")
def d03_after(spark, d):
    citing = candidates(spark, d).select(F.col("id").alias("cited"), F.explode(F.sequence(F.lit(1), F.lit(30))).alias("pos"), "k").select(F.concat(F.lit("p"), (F.col("k") + F.col("pos")).cast("string")).alias("id"), "cited", "pos")
    return discovery.discovery_citations(phase1(spark, d), citing)


def keyed(spark, d):
    own = candidates(spark, d)
    return own.withColumn("doi", F.expr("case when k % 4 = 0 then '10.1000/X' || k end")).withColumn("arxiv", F.expr("case when k % 4 = 1 then 'arXiv:2401.' || (10000 + k) || 'v2' end")).withColumn("url", F.expr("case when k % 4 = 3 then 'https://x.org/' || k || '/' end")).withColumn("title", F.expr("case when k % 4 = 3 then '' else title end")).withColumn("authors", F.array("author")).withColumn("source", F.lit("s2"))


@query("d04_dedup_keys", "select id, case k % 4 when 0 then 'doi:10.1000/x' || k when 1 then 'arxiv:2401.' || (10000 + k) when 2 then 'title:' || sha256(lower(title) || '|' || lower(author) || '|' || coalesce(cast(year as varchar), '')) else 'url:' || sha256('https://x.org/' || k) end as dedup_key from candidates")
def d04(spark, d):
    return discovery.dedup_keys(keyed(spark, d)).select("id", "dedup_key")


@query("d05_run_watchlist", "with f as (select item, source, k as rank, id as dedup_key from candidates where k % 9 <> 0 and k % 13 <> 0) select item, dedup_key from (select *, row_number() over (partition by item, source order by rank) as rn from f) x where rn <= 5")
def d05(spark, d):
    own = candidates(spark, d).select("item", "source", F.col("k").alias("rank"), F.col("id").alias("dedup_key"), "k")
    items = table(spark, d, "watch_items").select("item", F.regexp_replace("item", "[^0-9]", "").cast("int").alias("pos"), "max_new")
    return discovery.run_watchlist(items, own.drop("k"), own.where("k % 9 = 0").select("item", "dedup_key"), own.where("k % 13 = 0").select("dedup_key"))


@query("d05_watch_summary", "with c as (select item, source, k, k % 9 = 0 or k % 13 = 0 as known from candidates), r as (select *, sum(case when known then 0 else 1 end) over (partition by item, source order by k rows unbounded preceding) as n from c) select item, source, count(*) as fetched, cast(sum(case when n <= 5 and not known then 1 else 0 end) as bigint) as fresh, cast(sum(case when n <= 5 and known then 1 else 0 end) as bigint) as duplicates from r group by rollup (item, source)")
def d05_summary(spark, d):
    """The summary of d05's run: what comes after the first new record that a cap leaves is neither new nor a duplicate."""
    own = candidates(spark, d).select("item", "source", F.col("k").alias("rank"), F.col("id").alias("dedup_key"))
    items = table(spark, d, "watch_items").select("item", F.regexp_replace("item", "[^0-9]", "").cast("int").alias("pos"), "max_new")
    found = discovery.watch_statuses(items, own, own.where("rank % 9 = 0").select("item", "dedup_key"), own.where("rank % 13 = 0").select("dedup_key"))
    return discovery.discovery_summary(found)


@query("f05_exclude_known", "select id from candidates where not (k % 3 = 0 and k % 2 = 0) and not (k % 3 = 1 and k % 5 = 0)")
def f05(spark, d):
    own = candidates(spark, d).withColumn("ids", F.expr("case k % 3 when 0 then map('arxiv', '2401.' || (10000 + k)) else cast(map() as map<string,string>) end"))
    known = own.where("k % 3 = 0 and k % 2 = 0").select(F.expr("'doi:10.48550/arxiv.2401.' || (10000 + k)").alias("key")).union(own.where("k % 3 = 1 and k % 5 = 0").select("id"))
    return discovery.exclude_known(own, known).select("id")


@query("f06_due_items", "select id, case when k % 7 = 0 then 'disabled' when k % 2 = 0 then 'other schedule' when source <> 'arxiv' then 'other source' end as skipped from candidates")
def f06(spark, d):
    own = candidates(spark, d).select("id", (F.col("k") % 7 != 0).alias("enabled"), F.expr("case when k % 2 = 0 then 'weekly' else 'daily' end").alias("schedule"), F.array("source").alias("sources"))
    return discovery.due_items(own, "daily", "arxiv").select("id", "skipped")


@query("f08_validate_watch_items", "select id, case when k % 11 = 0 then 'bad id' when k % 5 = 0 then 'bad limit' when k % 4 = 0 then 'feed needs https' end as problem from (select case when k % 11 = 0 then 'P ' || k else id end as id, k from candidates) c")
def f08(spark, d):
    own = candidates(spark, d).select(F.expr("case when k % 11 = 0 then 'P ' || k else id end").alias("id"), F.expr("case when k % 4 = 0 then 'feed' else 'topic' end").alias("type"), F.lit(None).cast("boolean").alias("enabled"), F.lit("q").alias("query"), F.lit("http://x").alias("url"), F.array("source").alias("sources"), F.lit(None).cast("string").alias("schedule"), F.expr("case when k % 5 = 0 then 500 end").alias("item_limit"), F.lit(None).cast("int").alias("max_new"))
    return discovery.validate_watch_items(own).select("id", "problem")


@query("j05_enrich_ranking", "select id, case when k % 2 = 0 then citations end as cited_by, case when k % 3 = 0 then k end as contrasting, case when k % 5 = 0 then k * 2 end as attention from candidates")
def j05(spark, d):
    own = candidates(spark, d).withColumn("doi", F.expr("'https://doi.org/10.1000/A' || k"))
    plain = own.withColumn("doi", F.expr("'doi:10.1000/a' || k"))
    return discovery.enrich_ranking(own, plain.where("k % 2 = 0").select("doi", F.col("citations").alias("cited_by")), plain.where("k % 3 = 0").select("doi", F.col("k").alias("contradicting")), plain.where("k % 5 = 0").select("doi", (F.col("k") * 2).alias("attention"))).select("id", "cited_by", "contrasting", "attention")


@query("j06_match_existing", "select id, case when k % 3 < 2 then 'n/' || id else 'n/' || lower(id) end as path, case when k % 3 < 2 then 'doi' else 'slug' end as how from candidates")
def j06(spark, d):
    own = candidates(spark, d)
    cands = own.select("id", F.col("id").alias("slug"), F.expr("case k % 3 when 0 then map('doi', '10.1000/a' || k, 'openalex', 'W' || k) when 1 then map('arxiv', '2401.' || (10000 + k)) else cast(map() as map<string,string>) end").alias("ids"))
    sources = own.select(F.expr("'n/' || id").alias("path"), F.col("id").alias("slug"), F.expr("case k % 3 when 0 then map('doi', '10.1000/a' || k) when 1 then map('arxiv', '2401.' || (10000 + k), 'url', 'u' || k) else cast(map() as map<string,string>) end").alias("ids"))
    return discovery.match_existing_sources(cands, sources)


@query("j11_resolution_ladder", "select id as work, case when k % 2 = 0 then 'oa' || k when k % 3 = 0 then 'up' || k when f is not null then f when k % 7 = 0 then 'https://arxiv.org/pdf/2401.1.pdf' end as pdf_url, case when k % 2 = 0 then 'openalex' when k % 3 = 0 then 'unpaywall' when f is not null then 'core' when k % 7 = 0 then 'arxiv' else 'metadata_only' end as via from candidates left join (select lower(trim(title)) as t, min('co' || k) as f from candidates where k % 5 = 0 group by 1) core on t = lower(trim(title))")
def j11_core(spark, d):
    own = candidates(spark, d)
    works = own.select(F.col("id").alias("work"), F.expr("'W' || k").alias("openalex"), F.expr("'10.1/' || k").alias("doi"), "title", F.expr("case when k % 7 = 0 then '2401.1' end").alias("arxiv"))
    core = own.where("k % 5 = 0").select(F.upper("title").alias("title"), F.expr("'co' || k").alias("pdf_url"))
    return discovery.resolution_ladder(works, own.where("k % 2 = 0").select(F.expr("'W' || k").alias("openalex"), F.expr("'oa' || k").alias("pdf_url")), own.where("k % 3 = 0").select(F.expr("'10.1/' || k").alias("doi"), F.expr("'up' || k").alias("pdf_url")), core)


@query("p20_rebuild_abstracts", "select doc_id as id, regexp_replace(trim(text), '\\s+', ' ', 'g') as abstract from documents where doc_id % 1 = 0 and trim(text) <> ''")
def p20(spark, d):
    words = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(F.split(F.regexp_replace(F.trim("text"), r"\s+", " "), " ")).alias("p", "w")).where("w <> ''")
    index = words.groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps")).groupBy(F.col("doc_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("inverted"))
    return discovery.rebuild_abstracts(index)


@query("p21_normalize_candidates", "select id, source, title, citations, year from (select id, 's2' as source, title, citations, year from candidates where source = 's2' union all select '2401.' || k, 'arxiv', title, null, 2020 from candidates where source = 'arxiv') x")
def p21(spark, d):
    own = candidates(spark, d)
    s2 = own.where("source = 's2'").select(F.col("id").alias("paperId"), "title", "abstract", F.col("citations").alias("citationCount"), "year", F.array(F.struct(F.col("author").alias("name"))).alias("authors"))
    arxiv = own.where("source = 'arxiv'").select(F.expr("'2401.' || k").alias("id"), "title", F.col("abstract").alias("summary"), F.lit("2020-01-02T00:00:00Z").alias("published"), F.array("author").alias("authors"))
    both = discovery.normalize_candidates(s2, "s2").unionByName(discovery.normalize_candidates(arxiv, "arxiv"))
    return both.select("id", "source", "title", "citations", "year")


# How each provider names what it gives, as expressions over candidates.
LANDED = {
    "arxiv": {"id": "'2401.' || k", "title": "title", "summary": "abstract", "published": "'2020-01-02T00:00:00Z'"},
    "s2": {"paperId": "id", "title": "title", "abstract": "abstract", "citationCount": "citations", "year": "year"},
    "openalex": {"id": "'W' || k", "display_name": "title", "cited_by_count": "citations", "publication_date": "year || '-03-01'"},
    "core": {"id": "k", "title": "title", "abstract": "abstract", "year": "year"},
    "unpaywall": {"doi": "'10.1000/a' || k", "title": "title", "year": "year"},
    "wikipedia": {"pageid": "k", "title": "title", "extract": "abstract"},
    "feed": {"link": "'https://x.org/' || k", "title": "title", "summary": "abstract", "updated": "'Mon, 02 Jan 2023 00:00:00 GMT'"},
}


@query("p21_all_providers", """select case k % 7 when 0 then '2401.' || k when 1 then id when 2 then 'W' || k when 3 then cast(k as varchar) when 4 then '10.1000/a' || k when 5 then cast(k as varchar) else 'https://x.org/' || k end as id,
case k % 7 when 0 then 'arxiv' when 1 then 's2' when 2 then 'openalex' when 3 then 'core' when 4 then 'unpaywall' when 5 then 'wikipedia' else 'feed' end as source, trim(title) as title,
case when k % 7 not in (2, 4) then abstract end as abstract, cast(case k % 7 when 0 then 2020 when 5 then null when 6 then 2023 else year end as int) as year, cast(case when k % 7 in (1, 2) then citations end as bigint) as citations from candidates""")
def p21_all(spark, d):
    """All candidates, dealt over the seven providers in their landed forms."""
    own, out = candidates(spark, d), None
    for n, (provider, fields) in enumerate(LANDED.items()):
        raw = own.where(F.col("k") % 7 == n).select(*(F.expr(e).alias(c) for c, e in fields.items()))
        common = discovery.normalize_candidates(raw, provider).select("id", "source", "title", "abstract", "year", "citations")
        out = common if out is None else out.unionByName(common)
    return out


CANON = "'https://' || lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) || case when regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') = '' then '/' else regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') end || case when url like '%page=2%' then '?page=2' else '' end"


@query("p09_canonical_urls", f"select url, {CANON} as canonical from urls")
def p09(spark, d):
    return ids.canonical_urls(table(spark, d, "urls"), "url")


RAWIDS = "raw as (select doc_id, case doc_id % 4 when 0 then 'doi' when 1 then 'arxiv' when 2 then 'openalex' else 's2' end as ns, case doc_id % 4 when 0 then 'https://doi.org/10.' || (doc_id % 3000) || '/A.' || doc_id when 1 then 'arXiv:2401.' || doc_id || 'v3' when 2 then 'https://openalex.org/W' || doc_id else md5(cast(doc_id as varchar)) || '0A0b0c0d' end as raw from documents)"


@query("p10_normalize_ids", f"with {RAWIDS} select doc_id, ns, case ns when 'doi' then case when doc_id % 3000 >= 1000 then '10.' || (doc_id % 3000) || '/a.' || doc_id end when 'arxiv' then case when doc_id between 1000 and 99999 then '2401.' || doc_id end when 'openalex' then 'W' || doc_id else md5(cast(doc_id as varchar)) || '0a0b0c0d' end as id, case when ns = 'arxiv' and doc_id between 1000 and 99999 then 3 end as version from raw")
def p10(spark, d):
    raw = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.expr("case doc_id % 4 when 0 then 'doi' when 1 then 'arxiv' when 2 then 'openalex' else 's2' end").alias("ns"), F.expr("case doc_id % 4 when 0 then 'https://doi.org/10.' || (doc_id % 3000) || '/A.' || doc_id when 1 then 'arXiv:2401.' || doc_id || 'v3' when 2 then 'https://openalex.org/W' || doc_id else md5(cast(doc_id as string)) || '0A0b0c0d' end").alias("raw"))
    return ids.normalize_ids(raw, "ns", "raw").select("doc_id", "ns", "id", "version")


FLAT = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


@query("p11_ids_from_urls", f"select url, 'url=' || {CANON} as ids from urls")
def p11(spark, d):
    return ids.ids_from_urls(table(spark, d, "urls"), "url").select("url", FLAT("ids").alias("ids"))


@query("p14_ids_from_text", "select doc_id, case doc_id % 3 when 0 then 'doi=10.' || (1000 + doc_id % 9000) || '/x' || doc_id when 1 then 'arxiv=2401.' || (10000 + doc_id % 90000) || ',doi=10.48550/arxiv.2401.' || (10000 + doc_id % 90000) else 'doi=10.' || (1000 + doc_id % 9000) || '/y' || doc_id || ',openalex=W' || doc_id end as ids, case doc_id % 3 when 0 then 'doi:10.' || (1000 + doc_id % 9000) || '/x' || doc_id when 1 then 'doi:10.48550/arxiv.2401.' || (10000 + doc_id % 90000) else 'doi:10.' || (1000 + doc_id % 9000) || '/y' || doc_id end as match_key from documents")
def p14(spark, d):
    return ids.match_key(ids.ids_from_text(table(spark, d, "id_text"), "txt")).select("doc_id", FLAT("ids").alias("ids"), "match_key")


@query("p12_crosswalk_ids", "select doc_id, case when doc_id % 2 = 0 then 'arxiv=2401.' || (10000 + doc_id) || ',doi=10.48550/arxiv.2401.' || (10000 + doc_id) else 'arxiv=2401.' || (10000 + doc_id) || 'v2,doi=10.48550/arXiv.2401.' || (10000 + doc_id) || 'v2' end as ids from documents")
def p12(spark, d):
    own = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.expr("case when doc_id % 2 = 0 then map('arxiv', '2401.' || (10000 + doc_id)) else map('doi', '10.48550/arXiv.2401.' || (10000 + doc_id) || 'v2', 'other', 'x') end").alias("ids"))
    return ids.crosswalk_ids(own).select("doc_id", FLAT("ids").alias("ids"))


@query("p13_match_key", "select doc_id, case doc_id % 4 when 0 then 'doi:d' || doc_id when 1 then 's2:s' || doc_id when 2 then 'openalex:W' || doc_id end as match_key from documents")
def p13(spark, d):
    own = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.expr("case doc_id % 4 when 0 then map('url', 'u', 'doi', 'd' || doc_id) when 1 then map('url', 'u', 's2', 's' || doc_id, 'doi', '') when 2 then map('openalex', 'W' || doc_id) else cast(map() as map<string,string>) end").alias("ids"))
    return ids.match_key(own).select("doc_id", "match_key")


@query("p15_merge_ids", "select doc_id, 'arxiv=a' || doc_id || ',doi=' || case when doc_id % 2 = 0 then 'old' else 'new' end as merged from documents")
def p15(spark, d):
    own = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.expr("case when doc_id % 2 = 0 then map('doi', 'old', 'x', 'y') else map('doi', '') end").alias("a"), F.expr("map('doi', 'new', 'arxiv', 'a' || doc_id)").alias("b"))
    return ids.merge_ids(own, "a", "b").select("doc_id", FLAT("merged").alias("merged"))


@query("p16_append_provenance", "select doc_id, doc_id % 5 <> 0 as accepted, case when doc_id % 5 <> 0 then 'arxiv|' || case when doc_id % 2 = 0 then 'https://x' else '' end || '|' || case when doc_id % 3 = 0 then 'doi=1' else '' end else '' end as entries from documents")
def p16(spark, d):
    own = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.expr("case when doc_id % 5 = 0 then 'Bad One' else 'arxiv' end").alias("provider"), F.lit("2024").alias("fetched_at"), F.expr("case when doc_id % 2 = 0 then 'https://x' else 'ftp://x' end").alias("url"), F.expr("case when doc_id % 3 = 0 then 'doi' end").alias("ns"), F.lit("1").alias("value"), F.expr("cast(array() as array<struct<provider:string,fetched_at:string,url:string,ns:string,value:string>>)").alias("provenance"))
    shown = F.array_join(F.transform("provenance", lambda e: F.concat(e["provider"], F.lit("|"), F.coalesce(e["url"], F.lit("")), F.lit("|"), F.coalesce(F.concat(e["ns"], F.lit("="), e["value"]), F.lit("")))), ";")
    return ids.append_provenance(own).select("doc_id", "accepted", shown.alias("entries"))


@query("p17_classify_resources", f"with {RAWIDS}, u as (select doc_id, case when ns = 's2' then 'https://www.semanticscholar.org/paper/T/' || lower(raw) when ns = 'openalex' then 'https://x.org/' || doc_id else raw end as url, ns, raw from raw) select doc_id, case when ns = 'doi' and doc_id % 3000 >= 1000 then 'doi' when ns = 'arxiv' and doc_id between 1000 and 99999 then 'arxiv' when ns = 's2' then 's2' else 'web' end as resource from u")
def p17(spark, d):
    own = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.expr("case doc_id % 4 when 0 then 'https://doi.org/10.' || (doc_id % 3000) || '/A.' || doc_id when 1 then 'arXiv:2401.' || doc_id || 'v3' when 2 then 'https://x.org/' || doc_id else 'https://www.semanticscholar.org/paper/T/' || md5(cast(doc_id as string)) || '0a0b0c0d' end").alias("url"))
    return ids.classify_resources(own, "url").select("doc_id", "resource")
