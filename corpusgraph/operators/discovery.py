"""Candidate records: scores, keys, ranking, incremental discovery.

Candidates have id, source, title, abstract, citations, year; other columns pass through.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import ids
from ..plans.schema import NAMESPACES
from ..sources.storage import materialize
from .graph import first_per_key

# Weights of citations, recency and topic; the years over which recency falls to nothing.
W_CITATIONS, W_RECENCY, W_TOPIC, YEARS = 0.4, 0.3, 0.3, 10
TOKEN = "[a-z0-9]+"


def tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)))


def score_candidates(candidates: DataFrame, topic: str | Column, as_of_year: int) -> DataFrame:
    """candidates with score: citations, recency (linear, none after YEARS; the future counts 1) and topic overlap."""
    wanted = tokens(F.lit(topic) if isinstance(topic, str) else topic)
    text = tokens(F.concat_ws(" ", "title", "abstract"))
    match = F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, text)) / F.size(wanted)).otherwise(0.0)
    recency = F.when(F.col("year").isNull(), 0.0).when(F.col("year") > as_of_year, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (as_of_year - F.col("year")) / F.lit(YEARS)))
    return candidates.withColumn("score", W_CITATIONS * F.log1p(F.greatest(F.coalesce("citations", F.lit(0)), F.lit(0))) + W_RECENCY * recency + W_TOPIC * match)


def rank_candidates(candidates: DataFrame, topics: DataFrame, as_of_year: int, top: int = 20) -> DataFrame:
    """The best of each topic (topics: topic, few rows), by score, title and id; score shown to 4 places.

    Ranks are taken in each task before the rows of a topic meet (Spark's window group limit).
    """
    both = candidates.crossJoin(F.broadcast(topics.select("topic")))  # topics are what one asks for, tens at most
    scored = score_candidates(both, F.col("topic"), as_of_year)
    order = Window.partitionBy("topic").orderBy(F.desc("score"), F.lower("title"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("score", F.round("score", 4))


def cap_new(df: DataFrame, n: int | Column, keys: list[str], order: list) -> DataFrame:
    """At most n records of each key, in order."""
    return df.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_turn") <= n).drop("_turn")


def evict_seen(seen: DataFrame, now: str, days: int = 90, most: int = 5000) -> DataFrame:
    """seen (feed, guid, seen_at text) without entries that are older, or have no time, and the newest of each feed only."""
    timed = seen.withColumn("_t", F.try_to_timestamp("seen_at")).where(F.col("_t") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))
    return cap_new(timed, most, ["feed"], [F.desc("_t"), "guid"]).drop("_t")


def top_seeds(candidates: DataFrame, k: int = 5) -> DataFrame:
    return candidates.orderBy(F.desc(F.coalesce("citations", F.lit(0))), "id").limit(k)


def top_authors(candidates: DataFrame, n: int = 3) -> DataFrame:
    """author, papers: the most frequent, first seen first among equals (candidates: pos, authors)."""
    named = candidates.select("pos", F.explode("authors").alias("author")).where("trim(author) <> ''")
    return named.groupBy("author").agg(F.count("*").alias("papers"), F.min("pos").alias("first")).orderBy(F.desc("papers"), "first", "author").limit(n).drop("first")


def duplicate_groups(df: DataFrame, key: str, richness: str, id_col: str = "id") -> DataFrame:
    """key, n, canonical: records that share a key, and the one with the richest metadata (then the least id)."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct((-F.col(richness)).alias("r"), F.col(id_col).alias("i"))).alias("b")).where("n > 1").select(key, "n", F.col("b.i").alias("canonical"))


def candidate_quality(candidates: DataFrame) -> DataFrame:
    """candidates with completeness (0 to 5), rationale and score_int."""
    has = lambda c: (F.col(c).isNotNull() & (F.col(c) != "")).cast("int")
    complete = has("title") + has("url") + (F.coalesce(F.size("authors"), F.lit(0)) > 0).cast("int") + has("abstract") + has("id")
    why = F.array_compact(F.array(F.when(F.col("score").isNotNull(), F.lit("ranked")), F.when(F.coalesce("citations", F.lit(0)) > 0, F.lit("citations")), F.when(has("abstract") == 1, F.lit("abstract"))))
    points = F.when(F.isnan("score"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor(F.coalesce("score", F.lit(0.0)) * 10 + 0.5)))
    return candidates.withColumn("completeness", complete).withColumn("rationale", why).withColumn("score_int", points.cast("int"))


def shortlist(candidates: DataFrame, k: int) -> DataFrame:
    """bucket (ready, maybe, skip) by completeness and score; the best k of each."""
    bucket = F.when((F.col("completeness") >= 4) & (F.col("score") >= 1), "ready").when(F.col("completeness") >= 3, "maybe").otherwise("skip")
    return cap_new(candidates.withColumn("bucket", bucket), k, ["bucket"], [F.desc("score"), "id"])


def dedup_keys(candidates: DataFrame) -> DataFrame:
    """candidates (doi, arxiv, title, authors, year, url, source, id) with dedup_key. An arXiv number counts with all its digits.

    In a URL an old number (archive/7 digits) counts only behind arXiv's prefix, since any host or folder before digits looks like one.
    """
    some = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    authors = F.lower(F.array_join(F.filter(F.coalesce("authors", F.array().cast("array<string>")), lambda a: a != ""), "|"))
    paper = F.concat(F.lit("title:"), F.sha2(F.concat_ws("|", F.lower(F.coalesce(some("title"), F.lit(""))), authors, F.coalesce(F.col("year").cast("string"), F.lit(""))), 256))
    ax = lambda c, behind="": F.nullif(F.lower(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), rf"(?i)(?:arxiv\.org/(?:abs|pdf)/|arXiv:)?({behind}[a-z.-]+/\d{{7}}|\d{{4}}\.\d{{4,}})(?:v\d+)?", 1)), F.lit(""))
    arxiv = F.coalesce(ax("arxiv"), F.when(F.col("source") == "arxiv", ax("id")), ax("url", r"(?<=arxiv\.org/(?:abs|pdf)/|arxiv:)"))
    known = some("title").isNotNull() & ((authors != "") | F.col("year").isNotNull())
    key = F.coalesce(F.concat(F.lit("doi:"), F.lower(some("doi"))), F.concat(F.lit("arxiv:"), arxiv), F.when(known, paper), F.concat(F.lit("url:"), F.sha2(F.regexp_replace(some("url"), "/$", ""), 256)), F.concat(F.col("source"), F.lit(":"), F.lower(some("id"))), paper)
    return candidates.withColumn("dedup_key", key)


def exclude_known(candidates: DataFrame, known: DataFrame, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """Candidates of which no cross-walked id (ns:value), nor the raw id, is in known (key)."""
    crossed = ids.crosswalk(F.col(ids_col))
    keys = F.concat(F.array(F.col(id_col)), F.transform(F.map_entries(crossed), lambda e: F.concat(e["key"], F.lit(":"), e["value"])))
    hit = candidates.select(F.col(id_col), F.explode(keys).alias("key")).join(known.select("key").distinct(), "key", "left_semi").select(id_col).distinct()
    return candidates.join(hit, id_col, "left_anti")


def due_items(items: DataFrame, schedule: str | None = None, source: str | None = None) -> DataFrame:
    """Watch items with skipped: null, or why the run leaves them out."""
    skipped = F.when(~F.col("enabled"), "disabled")
    if schedule:
        skipped = skipped.when(F.col("schedule") != schedule, "other schedule")
    if source:
        skipped = skipped.when(~F.array_contains("sources", source), "other source")
    return items.withColumn("skipped", skipped)


def validate_watch_items(items: DataFrame, known_sources: tuple[str, ...] = ("arxiv", "s2", "openalex", "core", "feed")) -> DataFrame:
    """items with defaults filled and problem: null, or why the item is refused."""
    filled = items.withColumn("schedule", F.coalesce("schedule", F.lit("daily"))).withColumn("item_limit", F.coalesce("item_limit", F.lit(20))).withColumn("max_new", F.coalesce("max_new", F.lit(5))).withColumn("enabled", F.coalesce("enabled", F.lit(True)))
    twice = filled.groupBy("id").agg(F.count("*").alias("_n"))
    problem = (
        F.when(~F.coalesce(F.col("id").rlike("^[a-z0-9][a-z0-9-]*$"), F.lit(False)), "bad id").when(F.col("_n") > 1, "duplicate id").when(~F.col("type").isin("topic", "feed"), "bad type")
        .when(~F.col("schedule").isin("daily", "weekly", "manual"), "bad schedule").when(~F.col("item_limit").between(1, 100), "bad limit")
        .when((F.col("type") == "feed") & ~F.coalesce(F.col("url").rlike("^https://"), F.lit(False)), "feed needs https")
        .when((F.col("type") == "topic") & (F.coalesce(F.trim("query"), F.lit("")) == ""), "no query")
        .when(F.exists(F.coalesce("sources", F.array().cast("array<string>")), lambda s: ~s.isin(*known_sources)), "unknown source")
    )
    return filled.join(twice, "id", "left").withColumn("problem", problem).drop("_n")


def discovery_keyword(candidates: DataFrame, excluded: DataFrame, limit: int) -> DataFrame:
    """Phase 1: the first of each provider (pos), one record for each id (blank ids stay), without excluded ids (key)."""
    cut = cap_new(candidates, limit, ["source"], ["pos"])
    named, blank = cut.where("coalesce(id, '') <> ''"), cut.where("coalesce(id, '') = ''")
    found = first_per_key(named, ["id"], ["pos"]).select(*candidates.columns).unionByName(blank)
    return found.join(excluded.select(F.col("key").alias("id")).distinct(), "id", "left_anti").select(*candidates.columns)


def discovery_authors(phase1: DataFrame, works: DataFrame, n: int = 3) -> DataFrame:
    """Phase 2: further works (id, authors) of the most frequent authors of phase 1."""
    names = F.broadcast(top_authors(phase1, n).select("author"))  # n rows
    own = works.select("id", F.explode("authors").alias("author")).join(names, "author", "left_semi").select("id").distinct()
    return works.join(own, "id", "left_semi").join(phase1.select("id").distinct(), "id", "left_anti")


def discovery_citations(phase1: DataFrame, citations: DataFrame, seeds: int = 5, each: int = 10) -> DataFrame:
    """Phase 3: the first citing works (citations: id, cited, pos) of the most cited records; new against phase 1 only."""
    cited = F.broadcast(top_seeds(phase1, seeds).select(F.col("id").alias("cited")))  # seeds rows
    cut = cap_new(citations.join(cited, "cited", "left_semi"), each, ["cited"], ["pos", "id"])
    return cut.select("id").distinct().join(phase1.select("id").distinct(), "id", "left_anti")


CHUNK_ROWS = 200_000  # records that the turns of a chunk can need, at most (a chunk has one turn at least)


def _numbered_turns(fresh: DataFrame) -> tuple[DataFrame, int, int]:
    """(the turns with their chunk and place, how many chunks, the most records that one turn of a chunk can need)."""
    turns = materialize(fresh.select("pos", "item", "place", "source", "max_new").distinct())
    n = turns.agg(F.count("*").alias("n"), F.max("max_new").alias("most")).first()
    most = n["most"] or 0
    size = 1
    while (size + 1) * ((size + 1) * most + most + 1) <= CHUNK_ROWS and size < n["n"]:
        size += 1
    order = F.row_number().over(Window.orderBy("pos", "item", "place", "source", "max_new")) - 1  # one row a turn: watch items, set by hand, times their sources
    return turns.withColumn("turn", order).withColumn("chunk", F.floor(F.col("turn") / size).cast("int")), -(-n["n"] // size), size * most + 1


def _in_turns(frame: pd.DataFrame) -> pd.DataFrame:
    """The turns of a chunk one after another: each takes its first max_new records whose keys none before it has taken."""
    taken: set[str] = set()
    rows = []
    for _, own in frame.sort_values(["turn", "rank", "dedup_key"], na_position="first").groupby("turn", sort=True):
        left = int(own["max_new"].iat[0])
        for r in own.itertuples(index=False):
            if r.dedup_key is not None and r.dedup_key in taken:
                continue
            rows.append((r.chunk, r.item, r.source, r.rank, r.dedup_key, left <= 0))
            if left <= 0:
                break
            left -= 1
            if r.dedup_key is not None:
                taken.add(r.dedup_key)
    return pd.DataFrame(rows, columns=["chunk", "item", "source", "rank", "dedup_key", "cut"])


def run_turns(items: DataFrame, candidates: DataFrame, seen: DataFrame, existing: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """item, source, rank, dedup_key, cut: what each turn emits, and (cut) the first new record that its cap leaves.

    Turns are put in chunks, in order. In a round all chunks run at once, each on what the chunks before it have taken by
    the round before; inside a chunk turns go one by one. What a chunk takes is final as soon as all before it are, so there
    are at most as many rounds as chunks; mostly the results agree after a few. A turn can be refused no more records of
    its chunk than the chunk takes in all, so only its first ones reach the chunk's task: CHUNK_ROWS bounds them.
    rounds, if given, gets the number of rounds.
    """
    place = F.array_position("sources", F.col("source")) if "sources" in items.columns else F.lit(0).cast("long")
    own = candidates.select("item", F.coalesce("source", F.lit("")).alias("source"), "rank", "dedup_key").join(F.broadcast(items.drop("source", "rank", "dedup_key")), "item")
    own = own.select("item", "source", "rank", "dedup_key", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("max_new", F.lit(0)).alias("max_new"), F.coalesce(place, F.lit(0)).alias("place"))
    fresh = own.join(seen.select("item", "dedup_key").distinct(), ["item", "dedup_key"], "left_anti").join(existing.select("dedup_key").distinct(), "dedup_key", "left_anti")
    fresh = materialize(first_per_key(fresh, ["item", "source", "dedup_key"], ["rank"]).select(*own.columns))
    turns, chunks, most = _numbered_turns(fresh)
    fresh = fresh.join(F.broadcast(turns.select("item", "source", "turn", "chunk")), ["item", "source"])
    schema = f"chunk int, item string, source string, rank {fresh.schema['rank'].dataType.simpleString()}, dedup_key string, cut boolean"
    order = Window.partitionBy("turn").orderBy("rank", "dedup_key")
    done, before = materialize(fresh.sparkSession.createDataFrame([], schema)), None
    final, round_ = -1, 0
    while True:
        open_ = fresh.where(F.col("chunk") > final).alias("f")
        known = done if before is None else done.unionByName(before)
        if round_:
            gone = known.where("not cut and dedup_key is not null").select(F.col("dedup_key").alias("_key"), F.col("chunk").alias("_chunk"))
            open_ = open_.join(gone, (F.col("dedup_key") == F.col("_key")) & (F.col("_chunk") < F.col("chunk")), "left_anti")
        # the literal lets each task keep no more than most + 1 records of a turn before they meet
        first = open_.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most + 1)
        now = first.select("chunk", "turn", "item", "source", "rank", "dedup_key", "max_new").groupBy("chunk").applyInPandas(_in_turns, schema)
        now = materialize(now)
        round_ += 1
        if before is None:
            twice = now.where("not cut and dedup_key is not null").groupBy("dedup_key").agg(F.count_distinct("chunk").alias("n")).where("n > 1")
            changed = None if chunks <= 1 or twice.isEmpty() else 0
        else:
            rows = now.exceptAll(before).select("chunk").union(before.exceptAll(now).select("chunk"))
            changed = rows.agg(F.min("chunk")).first()[0]
        if changed is None or changed >= chunks - 1:
            break
        # what stands before the first change, and that chunk itself, came from final chunks
        done = materialize(done.unionByName(now.where(F.col("chunk") <= changed)))
        before, final = materialize(now.where(F.col("chunk") > changed)), changed
    if rounds is not None:
        rounds.append(round_)
    return done.unionByName(now.where(F.col("chunk") > final)).drop("chunk")


def run_watchlist(items: DataFrame, candidates: DataFrame, seen: DataFrame, existing: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """item, dedup_key: what an incremental run emits.

    items: item, pos, max_new (null: 0) and perhaps sources (their order; else by name); candidates: item, source (null: empty),
    rank, dedup_key; seen: item, dedup_key; existing: dedup_key. A turn is an item's source; turns go by pos, item and source.
    A key is new if the item has not seen it and no record exists; a turn emits at most max_new, by rank and key, and what its
    cap leaves may be emitted by a later one. Turns run in few rounds, chunk beside chunk; rounds, if given, gets their number.
    Candidates of unknown items go; a null key is met once in each turn and nothing has seen it.
    """
    return run_turns(items, candidates, seen, existing, rounds).where("not cut").select("item", "dedup_key")


def watch_statuses(items: DataFrame, candidates: DataFrame, seen: DataFrame, existing: DataFrame) -> DataFrame:
    """item, source, rank, dedup_key, status: new, duplicate, or left (from the first new record on that a turn's cap leaves).

    Arguments as in run_watchlist; equal rows count once. discovery_summary counts the statuses, watch_seen gives the next seen set.
    """
    met = run_turns(items, candidates, seen, existing)
    known = candidates.join(F.broadcast(items.select("item")), "item", "left_semi")
    offered = known.select("item", F.coalesce("source", F.lit("")).alias("source"), "rank", "dedup_key").distinct()
    stop = met.where("cut").select("item", "source", F.struct("rank", "dedup_key").alias("_stop"))
    new = met.where("not cut").select(F.col("item").alias("_item"), F.col("source").alias("_source"), F.col("rank").alias("_rank"), F.col("dedup_key").alias("_key"))
    same = (F.col("item") == F.col("_item")) & (F.col("source") == F.col("_source")) & F.col("dedup_key").eqNullSafe(F.col("_key")) & F.col("rank").eqNullSafe(F.col("_rank"))
    status = F.when(F.col("_item").isNotNull(), "new").when(F.struct("rank", "dedup_key") >= F.col("_stop"), "left").otherwise("duplicate")
    return offered.join(stop, ["item", "source"], "left").join(new, same, "left").select("item", "source", "rank", "dedup_key", status.alias("status"))


def watch_seen(seen: DataFrame, statuses: DataFrame) -> DataFrame:
    """item, dedup_key: what the items have seen after the run: all they met before their caps, new or not."""
    return seen.select("item", "dedup_key").union(statuses.where("status <> 'left'").select("item", "dedup_key")).distinct()


def discovery_summary(run: DataFrame) -> DataFrame:
    """item, source, fetched, fresh, duplicates with totals; run: item, source, status (new, duplicate, ...)."""
    count = lambda v: F.sum((F.col("status") == v).cast("long"))
    return run.rollup("item", "source").agg(F.count("*").alias("fetched"), count("new").alias("fresh"), count("duplicate").alias("duplicates"))


def match_existing_sources(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """id, path, how: a source with the same id in any namespace (the best one), else the same slug. Both have ids, a map."""
    order = F.array(*(F.lit(n) for n in NAMESPACES))
    keys = lambda df, c: df.select(c, F.explode(ids.crosswalk(F.col("ids"))).alias("ns", "value")).withColumn("rank", F.array_position(order, F.col("ns")))
    by_id = keys(candidates, "id").join(keys(sources, "path").drop("rank"), ["ns", "value"]).groupBy("id").agg(F.min(F.struct("rank", "path", "ns")).alias("b")).select("id", F.col("b.path").alias("path"), F.col("b.ns").alias("how"))
    by_slug = candidates.join(by_id, "id", "left_anti").join(sources.select("slug", "path"), "slug").groupBy("id").agg(F.min("path").alias("path")).withColumn("how", F.lit("slug"))
    return by_id.unionByName(by_slug)


def enrich_ranking(sources: DataFrame, signals: DataFrame, scite: DataFrame, altmetric: DataFrame) -> DataFrame:
    """sources (doi) with citation, scite and attention signals; what is absent stays null, never zero."""
    key = lambda df: df.withColumn("_doi", ids.doi("doi")).drop("doi")
    own = sources.withColumn("_doi", ids.doi("doi"))
    scite = key(scite)
    if "contradicting" in scite.columns:
        scite = scite.withColumnRenamed("contradicting", "contrasting")
    for df in (key(signals), scite, key(altmetric)):
        own = own.join(df, "_doi", "left")
    return own.drop("_doi")


def resolution_ladder(works: DataFrame, openalex: DataFrame, unpaywall: DataFrame, core: DataFrame) -> DataFrame:
    """work, pdf_url, via: the first that has a file: OpenAlex, Unpaywall (by DOI), CORE (by title), arXiv; else metadata only."""
    joined = works.join(openalex.select("openalex", F.col("pdf_url").alias("_oa")), "openalex", "left").join(unpaywall.select("doi", F.col("pdf_url").alias("_up")), "doi", "left")
    joined = joined.join(core.select(F.lower(F.trim("title")).alias("_t"), F.col("pdf_url").alias("_core")).groupBy("_t").agg(F.min("_core").alias("_core")), F.lower(F.trim(F.col("title"))) == F.col("_t"), "left")
    ax = F.when(F.col("arxiv").isNotNull(), F.concat(F.lit("https://arxiv.org/pdf/"), "arxiv", F.lit(".pdf")))
    via = F.when(F.col("_oa").isNotNull(), "openalex").when(F.col("_up").isNotNull(), "unpaywall").when(F.col("_core").isNotNull(), "core").when(ax.isNotNull(), "arxiv").otherwise("metadata_only")
    return joined.select("work", F.coalesce("_oa", "_up", "_core", ax).alias("pdf_url"), via.alias("via"))


def rebuild_abstracts(works: DataFrame) -> DataFrame:
    """id, abstract from an inverted index (map of word to positions); at one position the last word wins."""
    at = works.select("id", F.posexplode("inverted").alias("turn", "word", "positions")).select("id", "turn", "word", F.explode("positions").alias("p"))
    one = at.groupBy("id", "p").agg(F.max(F.struct("turn", "word")).alias("w"))
    return one.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", F.col("w.word").alias("word")))), lambda x: x["word"]), " ").alias("abstract"))


def normalize_candidates(raw: DataFrame, provider: str) -> DataFrame:
    """One provider's landed records in the common form: id, source, title, abstract, url, authors, year, citations, doi, arxiv."""
    have = lambda *names: F.coalesce(*(F.col(n).cast("string") for n in names if n in raw.columns), F.lit(None).cast("string"))
    year = F.regexp_extract(F.coalesce(have("year"), have("published", "publicationDate", "publication_date", "updated"), F.lit("")), r"(\d{4})", 1).try_cast("int")
    ident = {"arxiv": ("id",), "s2": ("paperId", "id"), "openalex": ("id",), "core": ("id",), "unpaywall": ("doi", "id"), "wikipedia": ("pageid", "id"), "feed": ("id", "link")}[provider]
    people = F.array().cast("array<string>")
    if "authors" in raw.columns:
        inner = raw.schema["authors"].dataType.elementType
        people = F.col("authors") if inner.typeName() == "string" else F.col("authors.name")
    ax = F.when(F.lit(provider == "arxiv"), ids.arxiv(have("id"))) if "arxiv" not in raw.columns else ids.arxiv("arxiv")
    return raw.select(have(*ident).alias("id"), F.lit(provider).alias("source"), F.trim(have("title", "display_name")).alias("title"), have("abstract", "summary", "extract").alias("abstract"), have("url", "link", "landing_page_url").alias("url"), people.alias("authors"), year.alias("year"), have("citationCount", "citation_count", "cited_by_count").try_cast("long").alias("citations"), ids.doi(have("doi")).alias("doi"), ax.alias("arxiv"))
