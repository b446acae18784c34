"""Token counts at every prefix of a text, for byte-level BPE.

BPE splits a text into pieces and merges bytes inside each piece. The encoding of a prefix of a piece ends in exactly
one token t for which the encoding of what is before t may stand beside t; so one pass over the piece finds the last
token and the count of every prefix. Units (white space and the word behind it) do not influence each other, so their
tables are kept and joined. A text's table has one signed byte a code point: by how much the count grows there.

Null texts count as empty: no tokens. Any text is read whole. A null id stays null, repeated rows are counted one by one,
an empty table gives an empty result. Columns beside
the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, text_of

# White space as Unicode has it, and the pattern that byte-level BPE files of this kind split texts by.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
LEAD = re.compile(f"[{SPACE}]*")
CUT_CONTRACTIONS = ("'re", "'ve", "'ll")
KEPT_UNITS = 250_000
KEPT_PAIRS = 500_000
TOKEN_LIMIT = 1024


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the file: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in plain}
    return letters | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}


class PrefixCounter:
    """Prefix tables of texts under one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        as_bytes = lambda s: bytes(letter[c] for c in s)
        self.token: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            left, right = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            t = self.token.setdefault(left + right, 256 + k)
            self.merged[self.token[left], self.token[right]] = 256 + k
            self.parts.setdefault(t, (self.token[left], self.token[right]))
        self.longest = max(map(len, self.token))
        self.special = [x["content"] for x in spec["added_tokens"] if x["special"]]
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self.beside: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}  # of recent units; those before them are in old
        self.old: dict[str, bytes] = {}
        self.young_pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    def _may_stand(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens: no earlier merge joins across the seam."""
        limit = 1 << 40
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            open_left, open_right = left in self.parts, right in self.parts
            # undo the later of the two merges; at the same rank the left one was done first
            if open_left and (not open_right or left > right):
                limit, left = left, self.parts[left][1]
            elif open_right:
                limit, right = right + 1, self.parts[right][0]
            else:
                return True

    def learn(self, pieces: set[str]) -> None:
        """Tables of new pieces. In sorted order a piece shares the work on its first bytes with the one before it."""
        token, beside, longest = self.token, self.beside, self.longest
        if len(beside) > KEPT_PAIRS:
            beside.clear()
        before, last, counts = b"", [-1], [0]
        for data, piece in sorted((x.encode("utf-8", "surrogatepass"), x) for x in pieces):
            same = len(os.path.commonprefix((before, data)))
            del last[same + 1 :], counts[same + 1 :]
            for end in range(same + 1, len(data) + 1):
                for begin in range(end - longest if end > longest else 0, end):
                    t = token.get(data[begin:end])
                    if t is None:
                        continue
                    if begin:
                        pair = last[begin] << 20 | t
                        fits = beside.get(pair)
                        if fits is None:
                            fits = beside[pair] = self._may_stand(last[begin], t)
                        if not fits:
                            continue
                    last.append(t)
                    counts.append(counts[begin] + 1)
                    break
            before = data
            inside = counts[1:]
            if len(data) != len(piece):
                inside = [counts[k] for k in itertools.accumulate(len(c.encode("utf-8", "surrogatepass")) for c in piece)]
            if piece in CUT_CONTRACTIONS:
                inside[1] = 2  # one that is cut is not a contraction yet
            self.young_pieces[piece] = bytes([(b - a) & 255 for a, b in zip([0, *inside], inside)])

    def unit(self, unit: str) -> bytes:
        """The table of white space and the word behind it, from those of its pieces."""
        known = self.young_pieces
        lead = LEAD.match(unit).end()
        pieces = [known[p] for p in self.pieces.findall(unit)]
        if lead < 2 or lead == len(unit):
            return b"".join(pieces)
        # A text that ends inside the white space has it as one piece; behind it, the true pieces count.
        joined = np.cumsum(np.frombuffer(b"".join(pieces), np.int8), dtype=np.int64)
        joined[:lead] = np.cumsum(np.frombuffer(known[unit[:lead]], np.int8), dtype=np.int64)
        return np.diff(joined, prepend=0).astype(np.int8).tobytes()

    def know(self, units: set[str]) -> None:
        """Have the tables of all these units in self.young."""
        young, old = self.young, self.old
        missing = []
        for u in units:
            if u not in young:
                table = old.get(u)
                if table is None:
                    missing.append(u)
                else:
                    young[u] = table
        pieces = {p for u in missing for p in self.pieces.findall(u)}
        pieces.update(u[:lead] for u in missing if (lead := LEAD.match(u).end()) > 1)
        known, before = self.young_pieces, self.old_pieces
        known.update((p, before[p]) for p in pieces if p not in known and p in before)
        self.learn({p for p in pieces if p not in known})
        for u in missing:
            young[u] = self.unit(u)

    def prefixes(self, texts: list[str]) -> list[bytes]:
        """The tables of texts. A special token in a text is one token; a part of one is plain text."""
        if len(self.young) > KEPT_UNITS:
            self.young, self.old = {}, self.young
        if len(self.young_pieces) > KEPT_UNITS:
            self.young_pieces, self.old_pieces = {}, self.young_pieces
        odd = {k for k, x in enumerate(texts) if any(s in x for s in self.special)}
        found = [[] if k in odd else UNIT.findall(x) for k, x in enumerate(texts)]
        self.know(set(itertools.chain.from_iterable(found)))
        table = self.young.__getitem__
        return [self.with_special(texts[k]) if k in odd else b"".join(map(table, units)) for k, units in enumerate(found)]

    def with_special(self, text: str) -> bytes:
        out: list[bytes] = []
        for k, part in enumerate(self.split.split(text)):
            units = UNIT.findall(part)
            if k % 2 == 0:
                before = part
                self.know(set(units))
                out += map(self.young.__getitem__, units)
                continue
            tail = (UNIT.findall(before) or [""])[-1]
            both = UNIT.findall(tail + part)
            self.know({*both, tail} - {""})
            counts = np.cumsum(np.frombuffer(b"".join(self.young[u] for u in both), np.int8), dtype=np.int64)
            counts -= counts[len(tail) - 1] if tail else 0
            counts[-1] = 1
            out.append(np.diff(counts[len(tail) :], prepend=0).astype(np.int8).tobytes())
        return b"".join(out)


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One for each worker process and file; it keeps the tables of recent units."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def prefix_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, prefix_table: the table has one signed byte a code point, the growth of the count there.

    tokenizer: path of a byte-level BPE file in the tokenizers library's format, on every executor.
    """
    slim = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    schema = T.StructType([slim.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("prefix_table", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                tables = count.prefixes(part.column(1).to_pylist())
                totals = [int(np.frombuffer(x, np.int8).sum(dtype=np.int64)) for x in tables]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(totals, pa.int64()), pa.array(tables, pa.binary())], names=schema.names)

    return slim.mapInArrow(run, schema)


def tokens_at(table: bytes, chars: int) -> int:
    """Tokens of the first chars code points, from the table alone."""
    return int(np.frombuffer(table, np.int8)[: max(chars, 0)].sum(dtype=np.int64))


def longest_within(table: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most budget tokens, from the table alone."""
    counts = np.concatenate([[0], np.cumsum(np.frombuffer(table, np.int8), dtype=np.int64)])
    return int(np.flatnonzero(counts <= max(budget, 0))[-1])


def truncate_to_budget(docs: DataFrame, tokenizer: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the code points that fit the budget of tokens, answered from the tables."""
    cut = F.pandas_udf(lambda tables: tables.map(lambda t: longest_within(t, budget)), T.LongType())
    return prefix_counts(docs, tokenizer, id_col, text_col).select(id_col, "n_tokens", cut("prefix_table").alias("n_chars_kept"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    counted = prefix_counts(docs.select("doc_id", "text", F.octet_length(text_of()).cast("long").alias("n_bytes")).withColumn("key", F.struct("doc_id", "n_bytes")), public_tokenizers.path("byte_bpe_50k.json"), "key")
    return counted.select("key.doc_id", "key.n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))
