"""Quotations against paged sources; review findings; drift of raw files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import ids
from ..functions.text import fold_text
from ..sources.storage import materialize

# The shapes of page citations and quoted spans.
CITATION = r"\((?:pp?|tr)\.\s*(\d+)(?:-(\d+))?\)"
QUOTED = '["“”]([^"“”]+)["“”]'

# Classes by rising severity, reviewers in order.
CLASSES = ("dismiss", "defer", "patch", "decision_needed")
REVIEWERS = ("blind", "grounding", "external")
QUOTE_WORDS = 5
WIDE = 64  # pages from which on a cited range goes by the index of words, not by each page's number


def _rank(c: str, names: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*(F.lit(n) for n in names)), F.col(c))


def segment_pages(docs: DataFrame, id_col: str = "source_id", text_col: str = "text") -> DataFrame:
    """id, page_no, text: parted at `[[page N]]` lines; what stands before the first is ignored, of a repeated page the last counts.

    Each text is parted within its own row, so no window or shuffle over lines is needed. A number of more than 64 bits is
    no page.
    """
    parts = F.split(F.concat(F.lit("\n"), F.col(text_col), F.lit("\n")), r"\n(?=\[\[page \d+\]\][ \t\r]*\n)")
    rows = docs.select(F.col(id_col), F.posexplode(parts).alias("turn", "piece")).where("turn > 0")
    page = F.regexp_extract("piece", r"^\[\[page (\d+)\]\]", 1).try_cast("long")
    body = F.regexp_replace(F.regexp_replace("piece", r"^\[\[page \d+\]\][ \t\r]*(\n|$)", ""), r"\n$", "")
    return rows.select(id_col, page.alias("page_no"), "turn", body.alias("text")).where("page_no is not null").groupBy(id_col, "page_no").agg(F.max_by("text", "turn").alias("text"))


def extract_quotes(notes: DataFrame, text_col: str = "content") -> DataFrame:
    """note, line, lo, hi, quote: quoted spans of five words or more on lines with a page citation, outside metadata and fences.

    A page number of more than 64 bits gives null, a citation that no page answers.
    """
    lines = F.transform(F.split(text_col, "\n"), lambda s, i: F.struct((i + 1).alias("n"), s.alias("line")))

    def head(ls: Column) -> Column:
        dashes = F.transform(F.filter(ls, lambda x: F.trim(x["line"]) == "---"), lambda x: x["n"])
        return F.when(F.col(text_col).startswith("---"), F.coalesce(F.try_element_at(dashes, F.lit(2)), F.lit(0))).otherwise(F.lit(0))

    def fences(ls: Column, h: Column) -> Column:
        return F.transform(F.filter(ls, lambda x: x["line"].rlike(r"^\s*(```|~~~)") & (x["n"] > h)), lambda x: x["n"])

    # what the lines have in common is found once a note; the fences before a line are looked at for cited lines alone
    cited = lambda ls, h, f: F.filter(ls, lambda x: x["line"].rlike(CITATION) & (x["n"] > h) & (F.size(F.filter(f, lambda at: at <= x["n"])) % 2 == 0))
    found = ids.once(lines, lambda ls: ids.once(head(ls), lambda h: ids.once(fences(ls, h), lambda f: cited(ls, h, f))))
    some = notes.where(F.col(text_col).rlike(CITATION)).select(F.col("path").alias("note"), F.explode(found).alias("x"))
    a, b = (F.nullif(F.regexp_extract("x.line", CITATION, k), F.lit("")).try_cast("long") for k in (1, 2))
    spans = F.filter(F.transform(F.regexp_extract_all("x.line", F.lit(QUOTED), F.lit(1)), lambda x: F.trim(x)), lambda q: F.size(F.split(q, r"\s+")) >= QUOTE_WORDS)
    last = F.coalesce(b, a)
    return some.select("note", F.col("x.n").alias("line"), F.least(a, last).alias("lo"), F.greatest(a, last).alias("hi"), F.explode(spans).alias("quote"))


BLOCK = 4096  # page numbers of a source that one task orders


def _with_next(pages: DataFrame) -> DataFrame:
    """source_id, page_no, folded of the pages (source_id, page_no, text) with words; next, the number of the source's next
    page here, and opens, its first word.

    Pages are folded and looked at in blocks of numbers; a block's last page gets the first of the next block that has
    any. So no task orders all pages of a source, and each text is sent to its block once.
    """
    dealt = pages.withColumn("_b", F.floor(F.col("page_no") / BLOCK)).repartition("source_id", "_b")
    # the array keeps Spark from folding a text twice, to test it and to show it
    cut = dealt.select("source_id", "page_no", "_b", F.explode(F.array(fold_text("text"))).alias("folded")).where("folded <> ''")
    word = F.substring_index("folded", " ", 1)
    led = cut.withColumn("_in", F.lead(F.struct("page_no", word.alias("word"))).over(Window.partitionBy("source_id", "_b").orderBy("page_no")))
    led = materialize(led)  # read again by each use; the join below is with a row for each block
    firsts = led.groupBy("source_id", "_b").agg(F.min(F.struct("page_no", F.substring_index("folded", " ", 1).alias("word"))).alias("_first"))
    after = firsts.select("source_id", "_b", F.lead("_first").over(Window.partitionBy("source_id").orderBy("_b")).alias("_after"))
    joined = led.join(after, ["source_id", "_b"]).withColumn("_next", F.coalesce("_in", "_after"))
    return joined.select("source_id", "page_no", "folded", F.col("_next.page_no").alias("next"), F.col("_next.word").alias("opens"))


def _grams(words: Column, n: int) -> Column:
    """Runs of n words: struct(size, gram), the gram a hash."""
    runs = F.transform(F.expr(f"sequence(1, greatest(size(words) - {n - 1}, 1))"), lambda k: F.struct(F.lit(n).alias("size"), F.xxhash64(F.array_join(F.slice(words, k, n), " ")).alias("gram")))
    return F.when(F.size(words) >= n, runs).otherwise(F.slice(runs, 1, 0))


def _first_words(words: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, F.lit(1), n), " ")


def _ends_with_start(folded: Column, words: Column) -> Column:
    """The numbers of first words of a quote with which a page ends, all of the quote's words but the last one at most."""
    counts = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.expr("slice(array(1), 1, 0)"))
    return F.filter(counts, lambda n: folded.endswith(_first_words(words, n)))


#: Quotes that go on at so many pages are sent to all tasks, so that the texts need not move for them; more of them meet the texts by page.
FEW_OPEN = 100_000


def _folded_at(pages: DataFrame, rows: DataFrame, few: bool = False) -> DataFrame:
    """rows (source_id, page_no and more) with folded, the page's text; pages without words go.

    Only pages that rows name are folded, once each. A text moves by page, to be chosen and, folded, to meet the rows; if these
    are few it does not move.
    """
    on = ["source_id", "page_no"]
    sent = F.broadcast if few else lambda df: df
    asked = pages.join(sent(rows.select(*on).distinct()), on, "left_semi")
    # the array keeps Spark from folding a text twice, to test it and to show it
    return asked.select(*on, F.explode(F.array(fold_text("text"))).alias("folded")).where("folded <> ''").join(sent(rows), on)


def _next_pages(keys: DataFrame) -> DataFrame:
    """source_id, page_no, next: the number of the source's next page here, ordered in blocks as in _with_next."""
    dealt = keys.select("source_id", "page_no").distinct().withColumn("_b", F.floor(F.col("page_no") / BLOCK))
    led = dealt.withColumn("_in", F.lead("page_no").over(Window.partitionBy("source_id", "_b").orderBy("page_no")))
    firsts = dealt.groupBy("source_id", "_b").agg(F.min("page_no").alias("_first"))
    after = firsts.select("source_id", "_b", F.lead("_first").over(Window.partitionBy("source_id").orderBy("_b")).alias("_after"))
    return led.join(after, ["source_id", "_b"]).select("source_id", "page_no", F.coalesce("_in", "_after").alias("next")).where("next is not null")


def _wide_hits(asked: DataFrame, own: DataFrame, wide: int) -> tuple[DataFrame, DataFrame]:
    """(hits of the quotes whose range is wide, the pages with words of their sources); see verify_quotes."""
    distant, short = asked.where("far"), asked.where(~F.col("far") & (F.col("hi") - F.col("lo") >= wide))
    spans = distant.unionByName(short).groupBy("source_id").agg((F.min("lo") - 1).alias("_from"), (F.max("hi") + 1).alias("_to"))
    pages = _with_next(own.join(spans, "source_id").where("page_no between _from and _to").select("source_id", "page_no", "text"))
    rest = ["quote_id", "source_id", "lo", "hi", "needle", "words"]
    none = F.expr("slice(array(1), 1, 0)")
    # one or two words give the index no inner word: their ranges are joined with the pages that there are
    met = short.select(*rest).join(pages, "source_id").where("page_no between lo - 1 and hi + 1")
    hits = [met.select(*rest, "page_no", F.col("folded").contains(F.col("needle")).alias("holds"), _ends_with_start(F.col("folded"), F.col("words")).alias("begun"))]
    index = distant.withColumn("size", F.least(F.lit(3), F.size("words") - 2)).select(*rest, "size", F.xxhash64(F.array_join(F.slice("words", F.lit(2), F.col("size")), " ")).alias("gram"))
    worded = pages.join(distant.select("source_id").distinct(), "source_id", "left_semi").withColumn("words", F.split("folded", " "))
    grams = F.array_distinct(F.concat(*(_grams(F.col("words"), n) for n in (1, 2, 3))))
    inner = worded.select("source_id", "page_no", "folded", F.inline(grams)).join(index, ["source_id", "size", "gram"]).where("page_no between lo - 1 and hi + 1 and contains(folded, needle)")
    hits.append(inner.select(*rest, "page_no", F.lit(True).alias("holds"), none.alias("begun")))
    ends = F.array(F.struct(F.lit("last").alias("side"), F.element_at("words", -1).alias("word")), F.struct(F.lit("next").alias("side"), F.col("opens").alias("word")))
    borders = worded.select("source_id", "page_no", "next", "folded", F.inline(ends))
    sides = distant.select(*rest, F.posexplode(F.expr("transform(sequence(1, size(words) - 1), n -> if(n = 1, struct('next' as side, words[1] as word), struct('last' as side, words[n - 1] as word)))")).alias("at", "s")).select(*rest, (F.col("at") + 1).alias("n"), "s.side", "s.word")
    crossed = borders.join(sides, ["source_id", "side", "word"]).where("page_no between lo - 1 and hi and next is not null").where(F.col("folded").endswith(_first_words(F.col("words"), F.col("n"))))
    hits.append(crossed.select(*rest, "page_no", F.lit(False).alias("holds"), F.array("n").alias("begun")))
    return reduce(DataFrame.unionByName, hits), pages


def verify_quotes(quotes: DataFrame, source_pages: DataFrame, wide: int = WIDE) -> DataFrame:
    """quotes (quote_id, source_id, lo, hi, quote) with verdict: OK on the cited pages, NEAR with one page more at either side, else FAIL.

    A quote stands on a page, or begins at the end of one and goes on over the next ones; pages without words don't count.
    A range of fewer than wide pages asks for each of them by number. For wider ranges the quotes' inner words are an
    index: runs of up to three of them lead to the pages that hold them, and single ones to pages that end, or whose next
    page begins, with them. Either way only hits are verified, and a quote that crosses borders is followed page by page,
    so no row holds a range. Only asked pages are folded. Without words a quote stands on every page with words.
    """
    far = 1 << 60
    number = lambda c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("long"), F.lit(-far)), F.lit(far))).alias(c)
    asked = quotes.select("quote_id", "source_id", number("lo"), number("hi"), fold_text("quote").alias("needle")).where("lo <= hi").withColumn("words", F.split("needle", " "))
    is_wide = F.col("hi") - F.col("lo") >= wide
    asked = materialize(asked.withColumn("far", is_wide & (F.size("words") > 2)))
    own = source_pages.select("source_id", F.col("page_no").cast("long").alias("page_no"), "text")
    words = lambda use: ids.once(F.split("needle", " "), use)
    shown = ["quote_id", "source_id", "lo", "hi", "page_no", "holds", "begun", "needle"]
    listed = asked.where(~is_wide).select("quote_id", "source_id", "lo", "hi", "needle", F.explode(F.sequence(F.col("lo") - 1, F.col("hi") + 1)).alias("page_no"))
    met = _folded_at(own, listed).select("quote_id", "source_id", "lo", "hi", "page_no", F.col("folded").contains(F.col("needle")).alias("holds"), words(lambda w: _ends_with_start(F.col("folded"), w)).alias("begun"), "needle")
    # all asked pages with words, for their order; the quote itself is needed only where it goes on
    met = materialize(met.withColumn("needle", F.when(F.size("begun") > 0, F.col("needle"))))
    hits, keys = met.where("holds or size(begun) > 0"), met.select("source_id", "page_no")
    if not asked.where(is_wide).isEmpty():
        some, pages = _wide_hits(asked, own, wide)
        hits, keys = hits.unionByName(materialize(some.select(*shown))), keys.union(pages.select("source_id", "page_no"))
    # a page's next one counts if it is in a quote's range, and then it is among the keys
    nexts = materialize(_next_pages(keys))
    goes_on = lambda df: df.join(nexts, ["source_id", "page_no"]).where("next <= hi + 1")
    found = [hits.where("holds").select("quote_id", "lo", "hi", F.col("page_no").alias("first"), F.col("page_no").alias("last"))]
    # quotes begun at a page's end: the next page holds the rest, or all of it is the next words of the rest
    rest = ["quote_id", "source_id", "lo", "hi", "needle"]
    open_ = goes_on(hits.where("size(begun) > 0")).select(*rest, F.col("page_no").alias("first"), F.col("next").alias("page_no"), F.explode("begun").alias("n")).distinct()
    while True:  # each round eats a word of the quote at least
        open_ = materialize(open_)
        if open_.isEmpty():
            break
        left = words(lambda w: F.array_join(F.slice(w, F.col("n") + 1, F.size(w)), " "))
        step = _folded_at(own, open_, open_.limit(FEW_OPEN + 1).count() <= FEW_OPEN).withColumn("_left", left)
        step = step.withColumn("_done", F.col("folded").startswith(F.col("_left"))).withColumn("_more", F.col("_left").startswith(F.concat("folded", F.lit(" ")))).where("_done or _more")
        step = materialize(step.select(*rest, "first", "page_no", "_done", "_more", (F.col("n") + F.size(F.split("folded", " "))).alias("n")))
        found.append(step.where("_done").select("quote_id", "lo", "hi", "first", F.col("page_no").alias("last")))
        open_ = goes_on(step.where("_more and not _done")).select(*rest, "first", F.col("next").alias("page_no"), "n")
    whole = reduce(DataFrame.unionByName, found).groupBy("quote_id").agg(F.max((F.col("first") >= F.col("lo")) & (F.col("last") <= F.col("hi"))).alias("ok"))
    return quotes.join(whole, "quote_id", "left").withColumn("verdict", F.when(F.col("ok"), "OK").when(F.col("ok").isNotNull(), "NEAR").otherwise("FAIL")).drop("ok")


def quote_report(verified: DataFrame, note_col: str = "note") -> DataFrame:
    """note, checked, ok, near, fail, with a total (null)."""
    count = lambda v: F.sum((F.col("verdict") == v).cast("long")).alias(v.lower())
    return verified.rollup(note_col).agg(F.count("*").alias("checked"), count("OK"), count("NEAR"), count("FAIL"))


def validate_review_findings(findings: DataFrame) -> DataFrame:
    """findings with problem: null, or what is missing or unknown."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return findings.withColumn("problem", F.when(F.col("id").isNull(), "no id").when(~F.coalesce(F.col("reviewer").isin(*REVIEWERS), F.lit(False)), "unknown reviewer").when(~F.coalesce(F.col("class").isin(*CLASSES), F.lit(False)), "unknown class").when(empty("claim"), "no claim"))


def merge_reviews(findings: DataFrame) -> DataFrame:
    """entry, claim, class, n: one row a claim, with the most severe of its classes."""
    return findings.groupBy("entry", "claim").agg(F.max_by("class", _rank("class", CLASSES)).alias("class"), F.count("*").alias("n"))


def number_findings(findings: DataFrame) -> DataFrame:
    """findings with number from 1 in each entry, by reviewer and id."""
    return findings.withColumn("number", F.row_number().over(Window.partitionBy("entry").orderBy(_rank("reviewer", REVIEWERS), "id")))


def raw_drift(note_fields: DataFrame, files: DataFrame) -> DataFrame:
    """path, drift: skipped (no raw paths, or provenance missing), drift_detected (a file is gone), else replayable."""
    own = note_fields.where("path like 'sources/%'")
    said, none = F.when(F.col("key") == "provenance", F.col("str")), F.lit(None).cast("boolean")
    # flags only, so that a note's rows are summed by hash in the tasks: the greatest provenance is missing if none is greater
    told = own.select("path", said.isNotNull().alias("some"), (said == "missing").alias("equal"), (said > "missing").alias("greater"), none.alias("gone"))
    raw = own.where("key = 'raw_paths'").select("path", F.explode("items").alias("file"))
    found = raw.join(files.select(F.col("path").alias("file"), F.lit(1).alias("there")).distinct(), "file", "left").select("path", none, none, none, F.col("there").isNull())
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    met = told.union(found).groupBy("path").agg(any_("some").alias("some"), any_("equal").alias("equal"), any_("greater").alias("greater"), F.bool_or("gone").alias("missing"))
    unsure = ~F.col("greater") & (F.col("equal") | ~F.col("some"))
    drift = F.when(F.col("missing").isNull() | unsure, "skipped").when(F.col("missing"), "drift_detected").otherwise("replayable")
    return met.select("path", drift.alias("drift"))


def verdicts(entries: DataFrame, drift: DataFrame, merged: DataFrame) -> DataFrame:
    """entry, verdict from drift and merged reviews: drift first, then open decisions, then pending findings."""
    worst = merged.groupBy("entry").agg(F.max(_rank("class", CLASSES)).alias("worst"))
    joined = entries.select("entry").distinct().join(drift, "entry", "left").join(worst, "entry", "left")
    verdict = (
        F.when(F.col("drift") == "drift_detected", "drift_detected").when(F.col("worst") == 4, "needs_decision").when(F.col("worst").between(2, 3), "findings_pending")
        .when(F.col("drift") == "skipped", "skipped").when(F.col("worst").isNull() & F.col("drift").isNull(), "not_applicable").otherwise("passed")
    )
    return joined.select("entry", verdict.alias("verdict"))


def uningested_files(files: DataFrame, note_fields: DataFrame) -> DataFrame:
    """Files that no source refers to."""
    used = note_fields.where("key = 'raw_paths'").select(F.explode("items").alias("path")).distinct()
    return files.join(used, "path", "left_anti")


def backfill_ids(sources: DataFrame) -> DataFrame:
    """path, ids: declared ids, completed by what the urls imply."""
    from .checks import derived_ids

    implied = derived_ids(sources).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("ns", "value"))).alias("implied"))  # five namespaces at most
    return ids.merge_ids(sources.join(implied, "path", "left"), "external_ids", "implied", "ids").select("path", "ids")


def document_sizing(source_pages: DataFrame) -> DataFrame:
    """source_id, pages, chars, tokens (about), scanned, is_long."""
    sized = source_pages.groupBy("source_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))
    tokens = F.floor(F.col("chars") / 4)
    return sized.select("*", tokens.alias("tokens"), (F.col("chars") < 32 * F.col("pages")).alias("scanned"), ((F.col("pages") >= 50) | (tokens >= 50_000)).alias("is_long"))
