"""Divergence of sources: how the words of each source of a language differ from those of its other sources.

Equal texts of a language are collapsed first: a text is shuffled and cut into terms once, and its counts are added for
each source as many times as the source holds it. A language keeps the terms of at least LEAST_DOCS of its documents
(copies count). Shares are smoothed and in whole numbers: p = 1 + (10**9 * (count + 5)) div (N + 5 * V).

Pairs of sources are compared on the postings alone. A term that a source lacks has the source's least share there, so the
sum over all V terms is V times the distance of the least shares, and a correction for each term that either source has.
The corrections are added up in tiles: up to BLOCK sources by BLOCK sources by about CHUNK terms, each a dense matrix of
bounded size; a posting goes to as many tiles as there are blocks of sources. The result itself holds all pairs of
sources of a language, so a language's sources are few enough to be listed with a text or a term.

Null texts, languages and sources count as ''. A text without terms adds nothing, but its group occurs. A language
without kept terms has distances 0, ranked by source. Ties are ranked by the item's UTF-8 order. Repeated rows count
each time, null ids too (ids are not read). Texts are read whole. An empty table gives an empty result. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table
from .terms import cutter

LEAST_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
BLOCK = 64  # sources at a tile's side
CHUNK = 1024  # terms of a tile, about
HELD = 300_000  # counts that a task holds before it hands them on


def numbered_groups(docs: DataFrame) -> DataFrame:
    """lang, source, at: each group that occurs, with its place among the language's sources; docs: lang, source."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # as many rows as a language has sources
    return docs.select("lang", "source").distinct().withColumn("at", place)


def collapsed(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, digest, sources (at, m), text: one row for each text of a language; docs: lang, source, text."""
    keyed = docs.withColumn("digest", F.unhex(F.sha2("text", 256)))
    many = keyed.groupBy("lang", "digest", "source").agg(F.count("*").alias("m"))  # hot texts shrink in the tasks that read them
    sources = many.join(groups.select("lang", "source", "at"), ["lang", "source"]).groupBy("lang", "digest").agg(F.collect_list(F.struct("at", "m")).alias("sources"))
    return keyed.groupBy("lang", "digest").agg(F.any_value("text").alias("text")).join(sources, ["lang", "digest"])


def term_counts(texts: DataFrame) -> DataFrame:
    """lang, term, held (at, n, docs): partial sums of occurrences and documents of each source, one row a task and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, sums, size = cutter(digits=False), {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, sources in sums.items():
                at = np.repeat(list(sources), [len(held) for held in sources.values()]).astype(np.int32)
                numbers = np.array([x for held in sources.values() for x in held.values()], np.int64).reshape(-1, 2)
                terms = pa.array([t for held in sources.values() for t in held], pa.binary()).dictionary_encode()
                codes = terms.indices.to_numpy()
                order = np.argsort(codes, kind="stable")
                bounds = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(terms.dictionary)))]).astype(np.int32)
                fields = pa.StructArray.from_arrays([pa.array(at[order]), pa.array(numbers[order, 0]), pa.array(numbers[order, 1])], names=["at", "n", "docs"])
                whole = pa.RecordBatch.from_arrays([pa.array([lang] * len(terms.dictionary)), terms.dictionary, pa.ListArray.from_arrays(bounds, fields)], names=["lang", "term", "held"])
                for at_row in range(0, whole.num_rows, 20_000):
                    yield whole.slice(at_row, 20_000)
            sums.clear()

        for batch in batches:
            columns = (batch.column("lang").to_pylist(), batch.column("sources").to_pylist(), batch.column("text").cast(pa.binary()))
            for lang, sources, text in zip(*columns):
                counts = Counter(cut(text.as_py()))
                for s in sources:
                    m, held = s["m"], sums.setdefault(lang, {}).setdefault(s["at"], {})
                    size -= len(held)
                    for term, k in counts.items():
                        n, docs = held.get(term, (0, 0))
                        held[term] = (n + m * k, docs + m)
                    size += len(held)
                    if size > HELD:
                        yield from flush()
                        size = 0
        yield from flush()

    return texts.select("lang", "sources", "text").mapInArrow(run, "lang string, term binary, held array<struct<at:int,n:long,docs:long>>")


def kept_terms(texts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, total, postings (at, n): the terms of at least so many documents of a language.

    A term's partial sums, a row for each task that met it, are dealt by language and term once; both sums follow there.
    """
    dealt = term_counts(texts).repartition("lang", "term").select("lang", "term", F.inline("held"))
    counts = dealt.groupBy("lang", "term", "at").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("at", "n")).alias("postings"))
    return by_term.where(F.col("docs") >= least_docs).select("lang", F.col("term").cast("string").alias("term"), "total", "postings")


def share(n: str, total: str, v: str) -> Column:
    """The smoothed share of a count, a whole number of billionths: exact, in decimals. Null where there are no terms."""
    big = lambda c: f"cast({c} as decimal(19,0))"
    return F.expr(f"1 + ({big(f'{n} + {SMOOTH}')} * {SCALE}) div nullif({big(total)} + {SMOOTH} * {big(v)}, 0)")


def group_sizes(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, at, total, v, all_total, p0: each group with its sums, those of its language, and its least share."""
    of_source = kept.select("lang", F.inline("postings")).groupBy("lang", "at").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all_total"))
    sized = groups.join(of_source, ["lang", "at"], "left").join(of_lang, "lang", "left").na.fill(0)
    return sized.withColumn("p0", share("0", "total", "v"))


def top_terms(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: the terms whose share in the source is furthest above the language's."""
    held = kept.select("lang", "term", F.col("total").alias("lang_n"), F.inline("postings")).join(groups, ["lang", "at"])
    above = held.select("lang", "source", F.col("term").alias("item"), (share("n", "total", "v") - share("lang_n", "all_total", "v")).alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")  # ranks are cut in each task first
    return above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _tile(frame: pd.DataFrame) -> pd.DataFrame:
    """lang, a, b, value: over a tile's terms, how much further apart each pair of its sources is than on their least shares."""
    first = frame["i"].iat[0] == frame["j"].iat[0]
    marks = frame[frame["term"].isna()].sort_values("at")
    cells = frame[frame["term"].notna()]
    at, p0, block = marks["at"].to_numpy(), marks["p0"].to_numpy(np.int64), marks["block"].to_numpy()
    terms = pd.factorize(cells["term"])[0]
    shares = np.repeat(p0[:, None], terms.max(initial=-1) + 1, axis=1)
    shares[np.searchsorted(at, cells["at"].to_numpy()), terms] = cells["p"].to_numpy(np.int64)
    left = np.flatnonzero(block == frame["i"].iat[0])
    right = np.flatnonzero(block == frame["j"].iat[0])
    out = []
    for k in left:
        others = right[right > k] if first else right
        base = np.abs(p0[others] - p0[k])
        value = np.abs(shares[others] - shares[k]).sum(axis=1) - base * shares.shape[1]
        if frame["chunk"].iat[0] == 0:
            value = value + base * int(marks["v"].iat[0])
        out.append(pd.DataFrame({"a": at[k], "b": at[others], "value": value}))
    both = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "value": []})
    return both.assign(lang=frame["lang"].iat[0])[["lang", "a", "b", "value"]].astype({"a": int, "b": int, "value": int})


def source_distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: every other source of the language by its distance, the sum over all kept terms."""
    chunks = (F.floor(F.col("v") / CHUNK) + 1).cast("int")
    block = F.floor(F.col("at") / BLOCK).cast("int")
    held = kept.select("lang", "term", F.inline("postings")).join(groups, ["lang", "at"])
    cells = held.select("lang", "at", "p0", "v", "term", share("n", "total", "v").alias("p"), F.pmod(F.xxhash64("term"), chunks).cast("int").alias("chunk"))
    empty = groups.select("lang", "at", F.coalesce("p0", F.lit(1)).alias("p0"), "v", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    blocks = groups.groupBy("lang").agg((F.floor(F.max("at") / BLOCK) + 1).cast("int").alias("blocks"))
    spread = cells.unionByName(empty).withColumn("block", block).join(blocks, "lang").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    tiles = spread.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "chunk", "at", "block", "p0", "v", "term", "p")
    parts = tiles.groupBy("lang", "i", "j", "chunk").applyInPandas(_tile, "lang string, a long, b long, value long")
    half = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = half.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"), "value").select("lang", "x.a", "x.b", "value")
    name = lambda at, called: groups.select("lang", F.col("at").cast("long").alias(at), F.col("source").alias(called))
    named = ends.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", "item", "value")
    return named.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank of every group of lang and source that occurs."""
    own = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    groups = materialize(numbered_groups(own))
    kept = materialize(kept_terms(collapsed(own, groups), least_docs))
    groups = materialize(group_sizes(groups, kept))
    out = [part.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, part in (("pair", source_distances(kept, groups)), ("term", top_terms(kept, groups, top)))]
    return out[0].unionByName(out[1])


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"))


OP11_SQL = f"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text, row_number() over () as r from documents),
w as (select lang, source, r, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
kt as (select lang, term, count(*) as q from w group by lang, term having count(distinct r) >= {LEAST_DOCS}),
c as (select w.lang, w.source, w.term, count(*) as k from w join kt on kt.lang = w.lang and kt.term = w.term group by all),
g as (select distinct lang, source from d),
s as (select g.lang, g.source, coalesce(sum(k), 0) as total from g left join c on c.lang = g.lang and c.source = g.source group by all),
l as (select lang, count(*) as v, sum(q) as total from kt group by lang),
p as materialized (select g.lang, g.source, kt.term, coalesce(k, 0) as k, 1 + ({SCALE}::hugeint * (coalesce(k, 0) + {SMOOTH})) // (s.total + {SMOOTH} * v) as p, 1 + ({SCALE}::hugeint * (q + {SMOOTH})) // (l.total + {SMOOTH} * v) as q
  from g join kt on kt.lang = g.lang join l on l.lang = g.lang join s on s.lang = g.lang and s.source = g.source left join c on c.lang = g.lang and c.source = g.source and c.term = kt.term),
pairs as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on b.lang = a.lang and b.term = a.term and b.source <> a.source group by all),
everything as (select a.lang, a.source, b.source as item, coalesce(value, 0) as value from g a join g b on b.lang = a.lang and b.source <> a.source left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source),
ranked as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from everything
  union all select lang, source, 'term', term, p - q, row_number() over (partition by lang, source order by p - q desc, term) from p where k > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= {TOP}
"""
