"""Edges: lookups, bulk changes, reachability. Edge tables have seq, src, type, dst, confidence; seq is the input order."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.schema import EDGE_CONFIDENCE, EXEMPT_GLOBS, edge_type_rows, edge_types
from ..sources.storage import file_system, materialize, shared_dir

EDGE = ["seq", "src", "type", "dst", "confidence"]


def glob_regex(globs=EXEMPT_GLOBS) -> str:
    """One pattern for globs: * is one segment, ** any, and *://* any URL."""
    parts = []
    for g in globs:
        if g == "*://*":
            parts.append(r".*://.*")
        else:
            parts.append(g.replace(".", r"\.").replace("**", "\0").replace("*", "[^/]*").replace("\0", ".*"))
    return "^(?:" + "|".join(parts) + ")$"


def exempt_targets(df: DataFrame, column: str, globs=EXEMPT_GLOBS, name: str = "exempt") -> DataFrame:
    """df with a flag: whether the column matches one of the globs."""
    return df.withColumn(name, F.col(column).rlike(glob_regex(globs)))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first record of each key. A minimum of whole records: summed in the tasks first, so hot keys do not pile up."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    whole = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(*keys).agg(whole).select(*[F.col(c) if c in keys else F.col(f"_first.{c}") for c in df.columns])


def _typed(edges: DataFrame) -> DataFrame:
    types = F.broadcast(edge_types(edges.sparkSession).select(F.col("name").alias("type"), "reverse", "symmetric", "terminal"))
    return edges.join(types, "type", "left")


def _needs_reverse() -> Column:
    return F.col("reverse").isNotNull() & ~F.col("symmetric") & ~F.col("terminal") & ~F.col("dst").rlike(glob_regex())


def _turned() -> Column:
    """Whether the canonical form of a typed edge has its ends the other way round."""
    return F.coalesce(F.coalesce("symmetric", F.lit(False)) & (F.col("src") > F.col("dst")), F.lit(False))


def canonical(edges: DataFrame) -> DataFrame:
    """edges with the ends of symmetric types sorted."""
    typed, swap = _typed(edges), _turned()
    return typed.withColumn("_s", F.when(swap, F.col("dst")).otherwise(F.col("src"))).withColumn("dst", F.when(swap, F.col("src")).otherwise(F.col("dst"))).withColumn("src", F.col("_s")).select(*edges.columns)


def reverses(edges: DataFrame) -> DataFrame:
    """The reverse edges that these edges require."""
    return _typed(edges).where(_needs_reverse()).select("seq", F.col("dst").alias("src"), F.col("reverse").alias("type"), F.col("src").alias("dst"), "confidence")


#: Slugs up to this many are sent to all tasks, so that edges that name them need not move; more of them meet the edges by slug.
FEW_SLUGS = 2_000_000


def few_slugs(slugs: DataFrame) -> DataFrame:
    """The distinct slugs, for a join: sent to all tasks if they are few."""
    keys = slugs.select("slug").distinct()
    return F.broadcast(keys) if keys.limit(FEW_SLUGS + 1).count() <= FEW_SLUGS else keys


def edges_of(edges: DataFrame, slugs: DataFrame, type: str | None = None, direction: str = "both") -> DataFrame:
    """Edges from or to a set of notes (slug), with their direction."""
    if type:
        edges = edges.where(F.col("type") == type)
    keys = few_slugs(slugs)
    out = edges.join(keys, F.col("src") == F.col("slug"), "left_semi").withColumn("direction", F.lit("out"))
    into = edges.join(keys, F.col("dst") == F.col("slug"), "left_semi").withColumn("direction", F.lit("in"))
    return {"out": out, "in": into}.get(direction) or out.unionByName(into)


def edges_touching(edges: DataFrame, slugs: DataFrame) -> DataFrame:
    """Edges with either end among the slugs, each row once."""
    keys = few_slugs(slugs)
    at = lambda end: keys.select(F.col("slug").alias(f"_{end}"))
    met = edges.join(at("src"), F.col("src") == F.col("_src"), "left").join(at("dst"), F.col("dst") == F.col("_dst"), "left")
    return met.where("_src is not null or _dst is not null").select(*edges.columns)


def citations_of(citations: DataFrame, slugs: DataFrame) -> DataFrame:
    """slug, direction (cites, cited_by) and the other end, for a set of notes."""
    keys = few_slugs(slugs)
    citing = citations.join(keys, F.col("src") == F.col("slug")).select("slug", F.lit("cites").alias("direction"), F.col("dst").alias("other"))
    cited = citations.join(keys, F.col("dst") == F.col("slug")).select("slug", F.lit("cited_by").alias("direction"), F.col("src").alias("other"))
    return citing.union(cited)


def neighbors(edges: DataFrame, slugs: DataFrame) -> DataFrame:
    """slug, neighbor: distinct, in both directions."""
    both = edges.select(F.col("src").alias("slug"), F.col("dst").alias("neighbor")).union(edges.select("dst", "src"))
    return both.join(few_slugs(slugs), "slug", "left_semi").distinct()


def lay_out(edges: DataFrame, buckets: int | None = None) -> str:
    """Write each edge under both of its ends, in buckets by slug, as a table (slug, next) in the shared folder; returns its name.

    A join of the table with some slugs reads its buckets as they lie: only the slugs are shuffled.
    """
    spark = edges.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, both = f"laid_{uuid.uuid4().hex}", edges.select(F.col("src").alias("slug"), F.col("dst").alias("next")).union(edges.select("dst", "src")).distinct()
    path = f"{shared_dir(spark)}/{name}"
    both.repartition(buckets, "slug").write.bucketBy(buckets, "slug").sortBy("slug").option("path", path).format("parquet").saveAsTable(name)
    where, fs = file_system(spark, path)
    fs.deleteOnExit(where)
    return name


def next_hop(laid: DataFrame, reached: DataFrame) -> DataFrame:
    """slug: what lies next to the slugs reached."""
    return laid.join(reached.select("slug"), "slug", "left_semi").select(F.col("next").alias("slug")).distinct()


def expand_subgraph(edges: DataFrame, seeds: DataFrame, max_hops: int, laid: str | None = None) -> DataFrame:
    """slug, hops: what is reachable along edges in either direction; each hop's notes are written before the next.

    The edges are laid out once (see lay_out; laid names a table that is there already), so a hop shuffles only its notes.
    """
    spark, own = edges.sparkSession, laid is None
    laid = laid or lay_out(edges)
    seen = reached = materialize(seeds.select("slug").distinct().withColumn("hops", F.lit(0)))
    for hop in range(1, max_hops + 1):
        reached = materialize(next_hop(spark.table(laid), reached).join(seen.select("slug"), "slug", "left_anti").withColumn("hops", F.lit(hop)))
        if reached.isEmpty():
            break
        seen = seen.union(reached)
    if own:
        spark.sql(f"drop table {laid}")  # the files go with the session
    return seen


def link_degrees(edges: DataFrame) -> DataFrame:
    """slug, n_out, n_in; hubs are counted in the tasks first."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("slug"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("slug"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("slug").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def validate_edge_batch(batch: DataFrame) -> DataFrame:
    """batch with problem: null, or why the edge is refused. A batch with any problem is to be refused whole."""
    problem = (
        F.when(F.coalesce(F.trim("src"), F.lit("")) == "", "missing src").when(F.coalesce(F.trim("dst"), F.lit("")) == "", "missing dst")
        .when(F.col("symmetric").isNull(), "unknown type").when(F.col("confidence").isNotNull() & ~F.col("confidence").isin(*EDGE_CONFIDENCE), "bad confidence")
    )
    return _typed(batch).select(*batch.columns, problem.alias("problem"))


def _keyed(edges: DataFrame) -> DataFrame:
    return first_per_key(canonical(edges), ["src", "type", "dst"], ["seq"])


def dedup_edges(edges: DataFrame) -> DataFrame:
    """Canonical form, the first copy of each edge."""
    return _keyed(edges).select(*edges.columns)


def merge_edge_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by identity; an edge of a wins over its copy in b."""
    both = canonical(a).select(*EDGE).withColumn("side", F.lit(0)).union(canonical(b).select(*EDGE).withColumn("side", F.lit(1)))
    return first_per_key(both, ["src", "type", "dst"], ["side", "seq"]).drop("side")


def answer_types(types=None) -> list[str]:
    """The types of the reverses that edges of these types, or of all, require."""
    return sorted({r[3] for r in edge_type_rows() if (types is None or r[0] in types) and r[3] and not r[4] and not r[5]})


def asking_types() -> tuple[dict[str, str], dict[str, str]]:
    """Of the types that require a reverse: the pairs that are each other's, by the first name, and the others with their reverse."""
    back = {r[0]: r[3] for r in edge_type_rows() if r[3] and not r[4] and not r[5]}
    mutual = {t for t, r in back.items() if back.get(r) == t and r != t}
    return {t: back[t] for t in sorted(mutual) if t < back[t]}, {t: back[t] for t in sorted(back.keys() - mutual)}


def _other(pairs: dict[str, str], type_: Column) -> Column:
    """The second type of a pair, by its first."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)), type_)


#: What an edge of an accepted batch can have as confidence, in the order of Spark's sort.
CONFIDENCES = (None, *sorted(EDGE_CONFIDENCE))


def _least_by_confidence(name: str, when: Column) -> list[Column]:
    """The least seq for each confidence, as sums of numbers that need no sort; see _first_of."""
    return [F.min(F.when(when & F.col("confidence").eqNullSafe(F.lit(c)), F.col("seq"))).alias(f"{name}{i}") for i, c in enumerate(CONFIDENCES)]


def _first_of(name: str) -> tuple[Column, Column]:
    """seq and confidence of the first row (by seq, then confidence) that _least_by_confidence has summed."""
    columns = [F.col(f"{name}{i}") for i in range(len(CONFIDENCES))]
    seq, confidence = F.least(*columns), F.lit(None).cast("string")
    for c, held in reversed(list(zip(CONFIDENCES, columns))):
        confidence = F.when(held == seq, F.lit(c).cast("string")).otherwise(confidence)
    return seq, confidence


def _added(edges: DataFrame, batch: DataFrame, types: list[str]) -> DataFrame:
    """What the batch adds to edges: seq, src, type, dst, confidence, source (forward or reverse).

    Where types are each other's reverse, an edge, its copies and what answers it count under one key, so all of it is decided
    in one meeting, summed in the tasks first. Only types that share an answer go in steps.
    """
    _, alone = asking_types()
    shared = {x for t in types if t in alone for x in (t, alone[t])}
    in_steps = sorted(x for x in types if x in shared)
    paired = _added_in_pairs(edges, batch, sorted(set(types) - shared))
    if not in_steps:
        return paired
    return paired.unionByName(_added_in_steps(edges, batch.where(F.col("type").isin(*in_steps)), in_steps))


def _added_in_pairs(edges: DataFrame, batch: DataFrame, types: list[str]) -> DataFrame:
    """_added for types of which each is the only one that its answer answers, or that ask for nothing."""
    pairs, _ = asking_types()
    mine = lambda df, more, held: df.where(F.col("type").isin(*types, *more)).select("src", "type", "dst", F.lit(held).alias("held"), *((F.lit(None).cast(t).alias(c) if held else F.col(c)) for c, t in (("seq", "long"), ("confidence", "string"))))
    typed = _typed(mine(edges, answer_types(types), True).unionByName(mine(batch, (), False))).where("src is not null and dst is not null")
    # the second type of a pair counts under the first, with its ends the other way round
    second = F.col("type").isin(*pairs.values())
    turn = second | _turned()
    slim = typed.select(F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("a"), F.when(second, F.col("reverse")).otherwise(F.col("type")).alias("type"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("b"), second.alias("second"), "held", "seq", "confidence")
    there = lambda of: F.bool_or(F.col("held") & of)
    new = ~F.col("held")
    known = slim.groupBy("a", "type", "b").agg(there(~F.col("second")).alias("held_f"), there(F.col("second")).alias("held_r"), *_least_by_confidence("f", new & ~F.col("second")), *_least_by_confidence("r", new & F.col("second")))
    (f_seq, f_conf), (r_seq, r_conf) = _first_of("f"), _first_of("r")
    known = known.select("a", "type", "b", "held_f", "held_r", f_seq.alias("f_seq"), f_conf.alias("f_conf"), r_seq.alias("r_seq"), r_conf.alias("r_conf"))
    paired, a, b = F.col("type").isin(*pairs), F.col("a"), F.col("b")
    asks = lambda side, to: paired & F.col(f"{side}_seq").isNotNull() & ~F.col(f"held_{side}") & ~to.rlike(glob_regex())

    def row(own: str, other: str, src: Column, type_: Column, dst: Column) -> Column:
        """What stands at a key that was not there: its own forward, or the reverse that a fresh forward (to src) asks for."""
        seq, theirs = F.col(f"{own}_seq"), F.when(asks(other, src), F.col(f"{other}_seq"))
        forward = F.coalesce(seq <= theirs, seq.isNotNull())  # a forward comes before a reverse of the same turn
        pick = lambda x, y: F.when(forward, x).otherwise(y)
        fields = {"seq": pick(seq, theirs), "src": src, "type": type_, "dst": dst, "confidence": pick(F.col(f"{own}_conf"), F.col(f"{other}_conf")), "source": pick(F.lit("forward"), F.lit("reverse"))}
        return F.when(~F.col(f"held_{own}") & F.coalesce(seq, theirs).isNotNull(), F.struct(*(v.alias(k) for k, v in fields.items())))

    return known.select(F.inline(F.array_compact(F.array(row("f", "r", a, F.col("type"), b), row("r", "f", b, _other(pairs, F.col("type")), a)))))


def _added_in_steps(edges: DataFrame, batch: DataFrame, types: list[str]) -> DataFrame:
    """_added for any types.

    An edge, its copies and its reverse lie between the same two ends, so all rows are dealt to tasks by the unordered pair of
    ends, once: what exists hides forwards, the forwards that are left ask for reverses, and the first offer of a key wins.
    Only edges of the batch's types can hide a forward, only those of the types that answer them a reverse.
    """
    sides = edges.where(F.col("type").isin(*{*types, *answer_types(types)})).select(*EDGE).withColumn("held", F.lit(True)).unionByName(batch.select(*EDGE).withColumn("held", F.lit(False)))
    typed = _typed(sides).where("src is not null and dst is not null")
    turned = (F.col("src") > F.col("dst")) & ~F.coalesce("symmetric", F.lit(False))
    slim = typed.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "type", turned.alias("turned"), "held", F.when(~F.col("held"), F.col("seq")).alias("seq"), F.when(~F.col("held"), F.col("confidence")).alias("confidence"))
    key = ["a", "b", "type", "turned"]
    known = slim.repartition("a", "b").groupBy(*key).agg(F.bool_or("held").alias("held"), *_least_by_confidence("m", ~F.col("held")))
    seq, confidence = _first_of("m")
    src, dst = F.when(F.col("turned"), F.col("b")).otherwise(F.col("a")), F.when(F.col("turned"), F.col("a")).otherwise(F.col("b"))
    told = _typed(known.select(*key, "held", seq.alias("seq"), confidence.alias("confidence"), src.alias("src"), dst.alias("dst")))
    asks = ~F.col("held") & _needs_reverse()
    row = lambda kind, turned, offer: F.struct(kind.alias("type"), turned.alias("turned"), F.lit(offer).alias("back"), (F.col("held") & F.lit(not offer)).alias("held"), "seq", "confidence")
    back = row(F.col("reverse"), ~F.col("turned") & (F.col("a") != F.col("b")), True)
    offers = told.select("a", "b", F.inline(F.array_compact(F.array(row(F.col("type"), F.col("turned"), False), F.when(asks, back)))))
    met = offers.groupBy(*key).agg(F.bool_or("held").alias("held"), *_least_by_confidence("f", ~F.col("back")), *_least_by_confidence("r", F.col("back"))).where("not held")
    (f_seq, f_conf), (r_seq, r_conf) = _first_of("f"), _first_of("r")
    forward = F.coalesce(f_seq <= r_seq, f_seq.isNotNull())  # a forward comes before a reverse of the same turn
    pick = lambda x, y: F.when(F.col("forward"), x).otherwise(y)
    return met.withColumn("forward", forward).select(pick(f_seq, r_seq).alias("seq"), src.alias("src"), "type", dst.alias("dst"), pick(f_conf, r_conf).alias("confidence"), pick(F.lit("forward"), F.lit("reverse")).alias("source"))


def add_edges(edges: DataFrame, batch: DataFrame, counts: Observation | None = None) -> DataFrame:
    """edges, and what the batch adds: forwards that are new, and the reverses that new forwards require.

    A forward that exists is skipped and its reverse is not added. Rows have source: existing, forward or reverse. Raises if
    any edge of the batch is refused, which takes a job over the batch when this is called. counts, if given, has after the
    first action on the result: added and skipped (of the batch's forwards) and reverses, taken in the same pass.
    """
    judged = validate_edge_batch(batch).agg(F.count("*").alias("n"), F.min("problem").alias("problem"), F.collect_set(F.when(F.col("problem").isNull(), F.col("type"))).alias("types")).first()
    if judged["problem"]:
        raise ValueError(f"edge batch refused: {judged['problem']}")
    added = _added(edges, batch, judged["types"])
    if counts is not None:
        n = F.count_if(F.col("source") == "forward")
        added = added.observe(counts, n.alias("added"), (F.lit(judged["n"]) - n).alias("skipped"), F.count_if(F.col("source") == "reverse").alias("reverses"))
    return edges.select(*EDGE).withColumn("source", F.lit("existing")).unionByName(added)


#: From so many types on, edges are not told apart by type before they meet keys.
MANY_TYPES = 200


def _types(specs: DataFrame) -> list[str] | None:
    """The types that specs name, None if they are too many to list."""
    found = [r[0] for r in specs.where("type is not null").select("type").distinct().limit(MANY_TYPES).collect()]
    return found if len(found) < MANY_TYPES else None


def remove_edges(edges: DataFrame, specs: DataFrame, counts: Observation | None = None) -> DataFrame:
    """edges without those that specs (src, type, dst) name, and without the reverses these required.

    counts, if given, has after the first action on the result: before, forward_removed, reverse_removed and after.
    """
    named = canonical(specs.select(F.lit(0).alias("seq"), "src", "type", "dst", F.lit(None).cast("string").alias("confidence")))
    keys = named.select("src", "type", "dst", F.lit(0).alias("_role")).union(reverses(named).select("src", "type", "dst", F.lit(1)))
    keys = keys.groupBy("src", "type", "dst").agg(F.min("_role").alias("_role"))
    # only edges of named types, or of types that answer them, can go
    types = _types(specs)
    can_go = F.lit(True) if types is None else F.coalesce(F.col("type").isin(*types, *answer_types(types)), F.lit(False))
    # an edge travels once, in its canonical form, with a flag to turn it back
    marked = canonical(_typed(edges.where(can_go)).withColumn("_back", _turned()).select(*edges.columns, "_back")).join(keys, ["src", "type", "dst"], "left")
    marked = marked.unionByName(edges.where(~can_go).withColumns({"_back": F.lit(False), "_role": F.lit(None).cast("int")}))
    if counts is not None:
        role = lambda n: F.count_if(F.col("_role") == n)
        marked = marked.observe(counts, F.count(F.lit(1)).alias("before"), role(0).alias("forward_removed"), role(1).alias("reverse_removed"), F.count_if(F.col("_role").isNull()).alias("after"))
    end = lambda a, b: F.when(F.col("_back"), F.col(b)).otherwise(F.col(a)).alias(a)
    return marked.where("_role is null").select(*(end(c, "dst" if c == "src" else "src") if c in ("src", "dst") else c for c in edges.columns))


def replace_edges(edges: DataFrame, specs: DataFrame) -> DataFrame:
    """Edges of specs (src, type, dst, new_type, confidence) change type; confidence is the spec's, else the old one's."""
    keys = ["src", "type", "dst"]
    specs = materialize(specs)
    # the edges that specs name are found before they are summed by key
    types = _types(specs)
    named = edges if types is None else edges.where(F.col("type").isin(*types))
    old = named.select(*keys, F.col("confidence").alias("old"), "seq").join(specs.select(*keys).distinct(), keys, "left_semi")
    batch = materialize(specs.join(first_per_key(old, keys, ["seq"]), keys).select("seq", "src", F.col("new_type").alias("type"), "dst", F.coalesce("confidence", "old").alias("confidence")))
    return add_edges(remove_edges(edges, specs.select("src", "type", "dst")), batch).drop("source")


def add_citations(citations: DataFrame, batch: DataFrame) -> DataFrame:
    return citations.select("src", "dst").union(batch.select("src", "dst")).distinct()


def remove_citations(citations: DataFrame, batch: DataFrame) -> DataFrame:
    return citations.join(batch.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def change_citations(citations: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The same as remove_citations after add_citations, with all three sides meeting once, summed in the tasks first."""
    # a removal without both ends equals no citation, as in a join
    sides = ((citations, False), (added, False), (removed.where("src is not null and dst is not null"), True))
    kept, new, gone = [x.select("src", "dst", F.lit(flag).alias("gone")) for x, flag in sides]
    return kept.union(new).union(gone).groupBy("src", "dst").agg(F.bool_or("gone").alias("gone")).where("not gone").select("src", "dst")


def close_reverse(edges: DataFrame) -> DataFrame:
    """edges and every missing reverse, once, with its forward's confidence.

    Each edge says which reverse it asks for and which key it answers. Two types that are each other's reverse count under
    one key, that of the first by name, so an edge and its answer are one row when a task has both: they meet once, summed in
    the tasks first. A null end equals no other, so it answers nothing.
    """
    pairs, alone = asking_types()
    src, kind, dst, whole, asks = F.col("src"), F.col("type"), F.col("dst"), F.col("src").isNotNull() & F.col("dst").isNotNull(), F.coalesce(_needs_reverse(), F.lit(False))
    # of a key's forward form 1: it is there, 4: it asks for the other; of its other form 2 and 8
    row = lambda when, a, type_, b, there, ask: F.when(when, F.struct(a.alias("a"), type_.alias("type"), b.alias("b"), (F.when(whole, there).otherwise(0) + F.when(asks, ask).otherwise(0)).alias("bits"), F.when(asks & F.lit(ask > 0), F.struct("seq", "confidence")).alias("asked")))
    rows = [row(kind.isin(*pairs), src, kind, dst, 1, 4), row(kind.isin(*pairs.values()), dst, F.col("reverse"), src, 2, 8), row(kind.isin(*alone) & asks, dst, F.col("reverse"), src, 0, 8), row(kind.isin(*alone.values()), src, kind, dst, 1, 0)]
    known = edges.where(F.col("type").isin(*pairs, *pairs.values(), *alone, *alone.values()))
    told = _typed(known).select(F.inline(F.array_compact(F.array(*rows))))
    met = told.groupBy("a", "type", "b").agg(F.bit_or("bits").alias("bits"), F.min("asked").alias("asked"))
    has = lambda bit: F.col("bits").bitwiseAND(bit) != 0
    lacks_other, lacks_first = has(4) & ~has(2), has(8) & ~has(1)
    pick = lambda x, y: F.when(lacks_first, x).otherwise(y)
    missing = met.where(lacks_other | lacks_first).select(F.col("asked.seq").alias("seq"), pick(F.col("a"), F.col("b")).alias("src"), pick(F.col("type"), _other(pairs, F.col("type"))).alias("type"), pick(F.col("b"), F.col("a")).alias("dst"), F.col("asked.confidence").alias("confidence"))
    return edges.select(*EDGE).unionByName(missing)


def canonicalize_symmetric(edges: DataFrame) -> DataFrame:
    """Each edge once: of symmetric ones, ends sorted, the first copy; of others the last."""
    typed = _typed(canonical(edges)).withColumn("turn", F.when(F.coalesce("symmetric", F.lit(False)), F.col("seq")).otherwise(-F.col("seq")))
    return first_per_key(typed.select(*EDGE, "turn"), ["src", "type", "dst"], ["turn"]).select(*EDGE)


def edge_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """change (added, removed), src, type, dst by identity."""
    keys = ["src", "type", "dst"]
    sided = [canonical(x.select(*keys)).select(*keys, F.lit(bit).alias("side")) for x, bit in ((before, 1), (after, 2))]
    # both sides meet once: a key that only one has is the other's loss or gain
    met = sided[0].union(sided[1]).groupBy(*keys).agg(F.bit_or("side").alias("side")).where("side <> 3")
    return met.select(F.when(F.col("side") == 2, "added").otherwise("removed").alias("change"), *keys)
