"""Text expressions: folding, slugs, plain text from markup."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What goes from a TeX source, in this order, and what stands instead.
TEX_PARTS = (
    ("%[^\n]*", ""), (r"\\[a-zA-Z]+\*?\[[^\]]*\]\{[^}]*\}", " "), (r"\\[a-zA-Z]+\*?\{[^}]*\}", " "), (r"\\[a-zA-Z]+\*?", " "),
    ("[{}]", " "), ("\n{3,}", "\n\n"), (" {2,}", " "), (r"^\s+|\s+$", ""),
)

# The entities that the plain-text job resolves.
ENTITIES = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def _bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


#: Latin letters that lose a diacritic, and what is left of them.
MARKED = "".join(chr(k) for k in range(0xC0, 0x250) if len(_bare(chr(k))) == 1 and _bare(chr(k)) != chr(k))
BARE = "".join(map(_bare, MARKED))


@F.pandas_udf(StringType())
def _without_marks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _bare(t))


def without_marks(c: Column, signs: str = "", instead: str = "") -> Column:
    """Letters without diacritics, and each of some signs (below U+0250 or in general punctuation) as another one.

    ASCII texts stay as they are. Latin letters are translated natively; the Python function is evaluated on texts that have
    other letters or marks (general punctuation aside), and all other rows send null to it.
    """
    latin = F.translate(c, MARKED + signs, BARE + instead)
    odd = F.when(c.rlike(r"[^\x00-\u024F\u2010-\u2027]"), latin)
    return F.coalesce(_without_marks(odd), F.when(c.rlike(r"[^\x00-\x7F]"), latin).otherwise(c))


def fold_text(c: str | Column) -> Column:
    """Lower case without diacritics and punctuation; dashes and white space are single blanks."""
    text = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(without_marks(text, "‘’–—đĐ", "''--dd")), "[^a-z0-9]+", " "))


def slug(c: str | Column, rule: str) -> Column:
    """note: words of a-z0-9 joined by -; topic: word characters, 64 at most, default discovery; rename: _ and blanks to -, the rest dropped."""
    text = F.col(c) if isinstance(c, str) else c
    if rule == "note":
        return F.regexp_replace(F.trim(F.regexp_replace(F.lower(without_marks(text)), "[^a-z0-9]+", " ")), " +", "-")
    if rule == "topic":
        cut = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"(?U)[^\w\s-]", ""), r"(?U)[\s_-]+", "-"), 1, 64)
        return F.coalesce(F.nullif(F.regexp_replace(cut, "^-+|-+$", ""), F.lit("")), F.lit("discovery"))
    if rule == "rename":
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), "[_ ]+", "-"), "[^a-z0-9-]", ""), "-+", "-"), "^-|-$", "")
    raise ValueError(rule)


def assign_slugs(df: DataFrame, title_col: str, rule: str) -> DataFrame:
    """df with slug and collisions, the number of rows with that slug. Counted by key, then joined: a common title does not fill a window."""
    slugged = df.withColumn("slug", slug(title_col, rule))
    counts = slugged.groupBy(F.col("slug").alias("_slug")).agg(F.count("*").alias("collisions"))
    return slugged.join(counts, F.col("slug").eqNullSafe(F.col("_slug"))).drop("_slug")  # rows without a title stay


def html_to_text(c: str | Column) -> Column:
    """Text pieces of a page, one a line; scripts, styles and the head are left out."""
    text = F.col(c) if isinstance(c, str) else c
    text = F.regexp_replace(text, r"(?is)<(script|style|head)\b[^>]*>.*?</\1\s*>", "\n")
    text = F.regexp_replace(F.regexp_replace(text, "(?s)<!--.*?-->", "\n"), "(?s)<[^>]*>", "\n")
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[\s\u00a0]+|[\s\u00a0]+$", "")), lambda x: x != "")
    return F.array_join(lines, "\n")


def tex_to_text(c: str | Column) -> Column:
    """Text without TeX comments, commands with their arguments, and braces; blanks collapsed."""
    text = F.col(c) if isinstance(c, str) else c
    for pattern, instead in TEX_PARTS:
        text = F.regexp_replace(text, pattern, instead)
    return text
