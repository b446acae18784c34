"""URL filter: rules, and for what no rule judges, a tree of path templates for each host.

Paths are cut into segments. Segments that look variable (digits, long hexadecimal, very long) become wildcards at once,
so a host's pages shrink to few shapes before anything is shuffled by host. A shape's purity is the smoothed share of its
labelled pages that are blocked; it is backed off from the host to its parent domains and at last to all hosts, each level
smoothed towards the one above and the last towards EVEN, so labels reach hosts that have none. Then, in rounds until nothing changes, a node's
branches are compared: a branch that is one of many and rare, or whose purity, children and page count do not differ from
its siblings' beyond chance, merges into their wildcard. A template of which labels were seen at any level is rejected if
its purity, pooled over its shapes, is at least PURITY. Pages under a rule are the labels, unless others are given.

Only DataFrame functions are used. A null url, or one without `://`, has an empty host and path. Equal rows and repeated or
null ids are judged alike and one by one. Very long urls count whole: all segments of a path and all labels of a host.
Empty tables give empty results. Without labels nothing is rejected beyond the rules. Columns beside the id and the url are
not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, salted_join

# The rules of the contract (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

MANY, RARE = 20, 0.05  # branches of a node from which on one below this share of its pages is variable
Z = 1.96  # what differs by more standard errors is different
SMOOTHING = 5.0
EVEN = 0.5  # purity of what no label tells of
PURITY = 0.8
WILD = "*"
PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
VARIABLE = r"(?s)\A(?:[0-9]+|[0-9a-fA-F-]{8,}|[^.]*[0-9]{3,}[^.]*|.{40,}?)(\.[A-Za-z0-9]{1,5})?\z"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUMS = ("pages", "blocked", "allowed", "prior", "evidence")

# Expressions that Spark and the comparison SQL share. prior: millionths of the backed-off purity, summed over pages.
BACKED = "(blocked + {s} * prior / pages / 1e6) / (blocked + allowed + {s})".format(s=f"{SMOOTHING}e0")
REST = "(all_blocked - blocked + {s} * (all_prior - prior) / (all_pages - pages) / 1e6) / (all_blocked + all_allowed - blocked - allowed + {s})".format(s=f"{SMOOTHING}e0")
OWN_N, REST_N = f"(blocked + allowed + {SMOOTHING}e0)", f"(all_blocked + all_allowed - blocked - allowed + {SMOOTHING}e0)"
BOTH = f"((own * {OWN_N} + rest * {REST_N}) / ({OWN_N} + {REST_N}))"
ALIKE = f"abs(own - rest) <= {Z}e0 * sqrt({BOTH} * (1e0 - {BOTH}) * (1e0 / {OWN_N} + 1e0 / {REST_N})) + 1e-9"
CHILDREN_ALIKE = f"kinds = all_kinds and spread - pages <= all_kinds - 1 + {Z}e0 * sqrt(2e0 * (all_kinds - 1)) + 1e-6"
MEAN = "(all_pages / (width * 1e0))"
COUNT_ALIKE = f"abs(pages - {MEAN}) <= {Z}e0 * sqrt(greatest({MEAN}, squares / width - {MEAN} * {MEAN})) + 1e-6"
VARIES = f"(width > {MANY} and pages < {RARE}e0 * all_pages) or (width > 1 and {ALIKE} and {CHILDREN_ALIKE} and {COUNT_ALIKE})"


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host and path."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER)
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(url, PARTS, 2))


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, as text, and its verdict; null if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for _, h, p in ordered]
    pick = lambda value: F.coalesce(F.lit(None).cast("string"), *(F.when(fit, F.lit(value(r))) for fit, r in zip(fits, ordered)))
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def shape(path: Column) -> Column:
    """Segments of a path; those that look variable are wildcards, an extension stays."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    variable = lambda s: F.regexp_replace(s, VARIABLE, WILD + "$1")
    return F.transform(segments, variable)


def with_prior(shapes: DataFrame) -> DataFrame:
    """shapes with prior (millionths of the purity backed off over the host's domains, times pages) and evidence (1 if any
    page of the shape, on any host, has a label)."""
    parts = F.split("host", r"\.")
    levels = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda d: F.struct(d.alias("level"), F.array_join(F.slice(parts, F.size(parts) - d + 1, d), ".").alias("domain")))
    spread = shapes.withColumn("at", F.explode(levels)).select("host", "shape", "at.level", "at.domain", "blocked", "allowed")
    known = spread.groupBy("level", "domain", "shape").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a")).where("a + b > 0")
    found = salted_join(spread.drop("blocked", "allowed"), materialize(known), ["level", "domain", "shape"])
    chain = F.array_sort(F.collect_list(F.struct("level", "b", "a")))  # as many as the host has labels
    purity = F.aggregate("chain", F.lit(EVEN), lambda q, x: (x["b"] + SMOOTHING * q) / (x["b"] + x["a"] + SMOOTHING))
    backed = found.groupBy("host", "shape").agg(chain.alias("chain")).select("host", "shape", F.round(purity * 1e6).cast("long").alias("millionths"))
    whole = shapes.join(materialize(backed), ["host", "shape"], "left")
    prior = F.col("pages") * F.coalesce("millionths", F.lit(round(EVEN * 1e6)).cast("long"))
    return materialize(whole.select(*shapes.columns, prior.alias("prior"), F.col("millionths").isNotNull().cast("long").alias("evidence")))


def generalise(shapes: DataFrame) -> DataFrame:
    """One round of merging branches, over rows host, shape, segments and the SUMS."""
    nodes = shapes.select("host", "shape", F.posexplode_outer("segments").alias("at", "segment"), "segments", *SUMS)
    nodes = nodes.withColumn("above", F.when(F.col("at").isNull(), F.lit("")).otherwise(F.array_join(F.expr("slice(segments, 1, coalesce(at, 0))"), "/")))
    nodes = nodes.withColumn("below", F.coalesce(F.expr("try_element_at(segments, at + 2)"), F.lit(""))).drop("segments")
    node, sums = ["host", "at", "above"], [F.sum(c).alias(c) for c in SUMS]
    children = materialize(nodes.where(F.col("segment").isNotNull()).groupBy(*node, "segment", "below").agg(*sums))
    kinds = children.groupBy(*node, "below").agg(F.sum("pages").alias("kind_pages"))
    lone = children.groupBy(*node, "segment").agg(*sums)
    around = lone.groupBy(*node).agg(F.count("*").alias("width"), F.sum(F.expr("pages * pages * 1e0")).alias("squares"), *(F.sum(c).alias("all_" + c) for c in SUMS))
    around = materialize(around.join(kinds.groupBy(*node).agg(F.count("*").alias("all_kinds")), node))
    shares = salted_join(salted_join(children, materialize(kinds), [*node, "below"]), around.select(*node, "all_pages"), node)
    squares = F.sum(F.expr("pages * (pages * 1e0) * all_pages / kind_pages"))
    spread = shares.groupBy(*node, "segment").agg(*sums, squares.alias("total"), F.count("*").alias("kinds")).withColumn("spread", F.expr("total / pages")).drop("total")
    decided = salted_join(spread, around, node).withColumn("own", F.expr(BACKED)).withColumn("rest", F.when(F.col("width") > 1, F.expr(REST)))
    decided = decided.select(*node, "segment", F.when(F.expr(VARIES), F.lit(WILD)).otherwise(F.col("segment")).alias("merged"))
    again = nodes.join(materialize(decided), [*node, "segment"], "left")
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "merged")))), lambda x: x["merged"])  # of one path
    return materialize(again.groupBy("host", "shape").agg(parts.alias("segments"), *(F.first(c).alias(c) for c in SUMS)))


def _wildcards(shapes: DataFrame) -> int:
    return shapes.agg(F.sum(F.size(F.filter("segments", lambda s: s == WILD)))).first()[0] or 0


def template_verdicts(pages: DataFrame) -> DataFrame:
    """host, shape, template, purity, rejected; pages has host, shape (joined segments), segments and label (block, allow, null)."""
    count = lambda v: F.sum(F.when(F.col("label") == v, 1).otherwise(0)).cast("long")
    shapes = pages.groupBy("host", "shape", "segments").agg(F.count("*").alias("pages"), count("block").alias("blocked"), count("allow").alias("allowed"))
    shapes = with_prior(materialize(shapes))
    wild, before = _wildcards(shapes), -1
    while wild != before:  # a round only turns segments into wildcards, so this ends
        shapes = generalise(shapes)
        wild, before = _wildcards(shapes), wild
    named = shapes.withColumn("template", F.concat(F.lit("/"), F.array_join("segments", "/")))
    pure = named.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in SUMS)).withColumn("purity", F.expr(f"round({BACKED}, 6)"))
    pure = pure.select("host", "template", "purity", ((F.col("evidence") > 0) & (F.col("purity") >= PURITY)).alias("rejected"))
    return materialize(salted_join(named.select("host", "shape", "template"), materialize(pure), ["host", "template"]))


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", labels: DataFrame | None = None) -> DataFrame:
    """id, host, path, rule, verdict, template, purity. labels, if given: id, label (block or allow)."""
    rule, verdict = rule_of(rules)
    parted = with_parts(pages.select(F.col(id_col), F.col(url_col)), url_col).drop(url_col)
    parted = parted.withColumn("rule", rule).withColumn("rule_verdict", verdict).withColumn("segments", shape(F.col("path")))
    parted = parted.withColumn("shape", F.array_join("segments", "/"))
    known = parted.withColumn("label", F.col("rule_verdict")) if labels is None else parted.join(labels.select(id_col, "label"), id_col, "left")
    templates = template_verdicts(known.select("host", "shape", "segments", "label"))
    judged = salted_join(parted, templates, ["host", "shape"])
    method = F.when(F.coalesce("rejected", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(id_col, "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "template", "purity")


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"))


ROUNDS = 4  # of the comparison SQL, for urls of so many segments; further rounds change nothing there


def _round_sql(k: int) -> str:
    """One round of merging, as common table expressions from s{k-1} to s{k}."""
    p = k - 1
    sums = ", ".join(f"sum({c}) as {c}" for c in SUMS)
    own = ", ".join(SUMS)
    return f"""
n{k} as materialized (select host, shape, i as lvl, segs[i] as segment, array_to_string(segs[1:i - 1], '/') as above, coalesce(segs[i + 1], '') as below, {own}
  from (select *, unnest(range(1, len(segs) + 1)) as i from s{p}) x),
b{k} as materialized (select host, lvl, above, segment, below, {sums} from n{k} group by all),
k{k} as (select host, lvl, above, below, sum(pages) as kind_pages from b{k} group by all),
l{k} as (select host, lvl, above, segment, {sums} from b{k} group by all),
a{k} as materialized (select host, lvl, above, count(*) as width, sum(pages * pages * 1e0) as squares, {", ".join(f"sum({c}) as all_{c}" for c in SUMS)} from l{k} group by all),
m{k} as materialized (select host, lvl, above, count(*) as all_kinds from k{k} group by all),
t{k} as (select host, lvl, above, segment, {", ".join(f"sum(b.{c}) as {c}" for c in SUMS)}, sum(b.pages * (b.pages * 1e0) * all_pages / kind_pages) / sum(b.pages) as spread, count(*) as kinds
  from b{k} b join k{k} using (host, lvl, above, below) join a{k} using (host, lvl, above) group by all),
c{k} as (select t.*, width, squares, all_kinds, {", ".join(f"all_{c}" for c in SUMS)} from t{k} t join a{k} using (host, lvl, above) join m{k} using (host, lvl, above)),
o{k} as (select *, {BACKED} as own, case when width > 1 then {REST} end as rest from c{k}),
d{k} as materialized (select host, lvl, above, segment, case when {VARIES} then '{WILD}' else segment end as merged from o{k}),
s{k} as materialized (select host, shape, list(merged order by lvl) as segs, {", ".join(f"any_value({c}) as {c}" for c in SUMS)} from n{k} join d{k} using (host, lvl, above, segment) group by host, shape
  union all select host, shape, segs, {own} from s{p} where len(segs) = 0)"""


def _sql() -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [f"when (host = '{h}' or suffix(host, '.{h}')) and starts_with(path, '{p}') then" for _, h, p in ordered]
    rule = "case " + " ".join(f"{f} '{r[1] + r[2]}'" for f, r in zip(fits, ordered)) + " end"
    verdict = "case " + " ".join(f"{f} '{r[0]}'" for f, r in zip(fits, ordered)) + " end"
    return f"""
with cut as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(coalesce(url, ''), '{PARTS}', 2) as path from pages
), parted as materialized (
  select *, {rule} as rule, {verdict} as said, list_transform(list_filter(split(path, '/'), lambda s: s <> ''), lambda s: regexp_replace(s, '{VARIABLE}', '{WILD}\\1')) as segs, array_to_string(segs, '/') as shape from cut
), first_shapes as materialized (
  select host, shape, segs, count(*) as pages, sum(case when said = 'block' then 1 else 0 end) as blocked, sum(case when said = 'allow' then 1 else 0 end) as allowed from parted group by all
), spread as materialized (
  select host, shape, d as level, array_to_string(labels[len(labels) - d + 1 : len(labels)], '.') as domain, blocked, allowed
  from (select *, unnest(range(0, len(labels) + 1)) as d from (select *, split(host, '.') as labels from first_shapes) x) y
), known as materialized (
  select level, domain, shape, sum(blocked) as b, sum(allowed) as a from spread group by all having sum(blocked) + sum(allowed) > 0
), chains as (
  select host, shape, list({{'b': known.b * 1e0, 'a': known.a * 1e0, 'q': 0e0}} order by level) as c from spread join known using (level, domain, shape) group by host, shape
), backed as materialized (
  select host, shape, cast(round(list_reduce(list_prepend({{'b': 0e0, 'a': 0e0, 'q': {EVEN}e0}}, c), lambda x, y: {{'b': 0e0, 'a': 0e0, 'q': (y.b + {SMOOTHING}e0 * x.q) / (y.b + y.a + {SMOOTHING}e0)}}).q * 1e6) as bigint) as millionths from chains
), s0 as materialized (
  select host, shape, segs, pages, blocked, allowed, pages * coalesce(millionths, {round(EVEN * 1e6)}) as prior, case when millionths is null then 0 else 1 end as evidence
  from first_shapes left join backed using (host, shape)
), {", ".join(_round_sql(k) for k in range(1, ROUNDS + 1))}, templates as materialized (
  select *, '/' || array_to_string(segs, '/') as template from s{ROUNDS}
), sums as (
  select host, template, {", ".join(f"sum({c}) as {c}" for c in SUMS)} from templates group by host, template
), pure as (
  select host, template, round({BACKED}, 6) as purity, evidence > 0 as seen from sums
)
select page_id, host, path, rule, coalesce(said, case when seen and purity >= {PURITY} then 'block' else 'allow' end) as verdict, template, purity
from parted join (select host, shape, template from templates) t using (host, shape) join pure using (host, template)
"""


OP10_SQL = _sql()
