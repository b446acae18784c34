"""License notices found by template automata.

A template is licence wording with regions that may be left out, `[ ... ]`, and places that any few words may fill,
`{n}` (at most n words). Regions may lie in each other. It is compiled once into an automaton over words; a document's words are run through it from
every place where a template may begin, and a match needs the mandatory wording word for word. Phrases are templates
without such regions, counted at all their places.

A-Z are lower-cased; words are runs of digits, a-z and non-ASCII characters. Null texts count as empty. A text without
words has no labels and score 0. Repeated rows and null ids are judged one by one. Very long texts are read whole. An empty
table gives an empty result. Columns beside the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, text_of

# Phrases of the contract, and wording of public licence notices.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
TEMPLATES = (
    ("apache-2", "licensed under the apache license version 2 0 [ the license ] you may not use {3} file except in compliance with the license"),
    ("apache-2.0-notice", "licensed under the apache license [ version ] 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [ 1 ] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [ 2 ] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [ 1 ] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [ 2 ] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [ 3 ] neither the name of {8} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("cc-by", "licensed under [ a ] [ the ] creative commons attribution {2} [ international ] license"),
    ("cc-by-nc-4.0", "licensed under [ a ] [ the ] cc by nc 4 0"),
    ("cc-by-sa", "licensed under [ a ] [ the ] cc by sa [ 4 0 ]"),
    ("gpl", "under the [ terms of the ] gnu general public license [ as published by the free software foundation {3} ] version {1} [ of the license ] [ or at your option any later version ]"),
    ("gpl-notice", "[ this {2} program is free software [ you can redistribute it and or modify it ] ] under the terms of the gnu general public license [ as published by the free software foundation [ inc ] ] either version {1} of the license or at your option any later version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("lgpl", "under the [ terms of the ] gnu lesser general public license [ as published by the free software foundation {3} ] version {2}"),
    ("mit-notice", "[ this {3} is ] [ released ] [ licensed ] under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit-license", "[ the ] mit license [ mit ] [ copyright [ c ] {12} ] permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [ including the next paragraph ] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


class Automaton:
    """A template over words: steps that a word, any word or nothing takes."""

    def __init__(self, template: str):
        self.word: list[dict[str, int]] = []
        self.any: list[int | None] = []
        self.free: list[list[int]] = []
        self.mandatory: list[str] = []
        at, opened = self._state(), []
        for item in template.split():
            if item == "[":
                opened.append(at)
            elif item == "]":
                end = self._state()
                self.free[at].append(end)
                self.free[opened.pop()].append(end)
                at = end
            elif item[0] == "{":
                end = self._state()
                for _ in range(int(item[1:-1])):
                    self.free[at].append(end)
                    filled = self._state()
                    self.any[at] = filled
                    at = filled
                self.free[at].append(end)
                at = end
            else:
                nxt = self._state()
                self.word[at][item] = nxt
                at = nxt
                if not opened:
                    self.mandatory.append(item)
        self.end = at
        self.begin = self._reach({0})
        self.firsts = {w for s in self.begin for w in self.word[s]}

    def _state(self) -> int:
        self.word.append({})
        self.any.append(None)
        self.free.append([])
        return len(self.word) - 1

    def _reach(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def match(self, words: list[str], at: int) -> int:
        """End of the longest match that begins at this place, or -1."""
        states, found = self.begin, -1
        for k in range(at, len(words)):
            nxt = {self.word[s].get(words[k]) for s in states} | {self.any[s] for s in states}
            nxt.discard(None)
            if not nxt:
                break
            states = self._reach(nxt)
            if self.end in states:
                found = k + 1
        return found


class Scanner:
    """Phrases and templates together, with words that a text must have for any of them."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.phrases = [(tuple(p.split()), label) for p, label in phrases]
        self.templates = [(Automaton(t), label) for label, t in templates]
        needed = [max(p, key=len) for p, _ in self.phrases] + [max(a.mandatory, key=len) for a, _ in self.templates]
        self.anchors = sorted({w.encode() for w in needed})
        self.starts: dict[str, list] = {}
        for p, label in self.phrases:
            self.starts.setdefault(p[0], []).append((p, None, label))
        for a, label in self.templates:
            for w in a.firsts:
                self.starts.setdefault(w, []).append((None, a, label))

    def scan(self, data: bytes) -> tuple:
        """n_base, first, last, base labels, labels, score of lower-cased UTF-8."""
        if not any(a in data for a in self.anchors):
            return 0, None, None, "", "", 0.0
        words = [w.decode("utf-8", "replace") for w in WORD.findall(data)]
        places, base, labels, most = [], set(), set(), 0
        for at, w in enumerate(words):
            for phrase, automaton, label in self.starts.get(w, ()):
                if phrase is not None:
                    if tuple(words[at : at + len(phrase)]) == phrase:
                        places.append(at)
                        base.add(label)
                        most = max(most, len(phrase))
                elif automaton.match(words, at) >= 0:
                    labels.add(label)
                    most = max(most, len(automaton.mandatory))
        join = lambda x: ",".join(sorted(x))
        return len(places), min(places, default=None), max(places, default=None), join(base), join(base | labels), most / (most + 1)


WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def license_labels(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of phrases, first_word and last_word are the smallest and largest (null: none). The score
    is m / (m + 1) for the m mandatory words of the longest phrase or template found.
    """
    slim = docs.select(F.col(id_col), F.encode(text_of(text_col), "UTF-8").alias("data"))
    schema = T.StructType([slim.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")), *(T.StructField(c, T.StringType()) for c in ("base_labels", "labels")), T.StructField("score", T.DoubleType())])
    scanner = Scanner(phrases, templates)
    kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = [], []
            for data in batch.column(1):
                data = data.as_buffer()
                inside = _IN_WORD[np.frombuffer(data, np.uint8)]
                counts.append(int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(len(inside) > 0 and inside[0]))
                found.append(scanner.scan(data.to_pybytes().lower()))
            columns = [pa.array(c, kind) for c, kind in zip(zip(*found), kinds)] if found else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *columns], names=schema.names)

    return slim.mapInArrow(run, schema)


def op2_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(read_table(spark, sf_dir, "documents"))


def template_regex(template: str) -> str:
    """The template over words that each have a blank before and behind them, as a regular expression."""
    out = ""
    for item in template.split():
        if item == "[":
            out += "(?:"
        elif item == "]":
            out += ")?"
        elif item[0] == "{":
            out += "(?: [^ ]+){0," + item[1:-1] + "}"
        else:
            out += " " + item
    return out + " "


def _sql() -> str:
    places = " || ".join("list_filter(range(1, len(w) + 1), lambda i: " + " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) + ")" for p, _ in PHRASES)
    base = ", ".join(f"case when contains(t, ' {p} ') then '{label}' end" for p, label in PHRASES)
    more = ", ".join(f"case when regexp_matches(t, '{template_regex(x)}') then '{label}' end" for label, x in TEMPLATES)
    sizes = ", ".join([f"case when contains(t, ' {p} ') then {len(p.split())} end" for p, _ in PHRASES] + [f"case when regexp_matches(t, '{template_regex(x)}') then {len(Automaton(x).mandatory)} end" for label, x in TEMPLATES])
    joined = lambda x: f"array_to_string(list_sort(list_distinct([{x}])), ',')"
    return f"""
with lowered as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), worded as (
  select doc_id, regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from lowered
), joined as (
  select doc_id, w, ' ' || array_to_string(w, ' ') || ' ' as t from worded
), placed as (
  select *, {places} as p, coalesce(list_max([{sizes}]), 0) as m from joined
)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(p) as bigint) as n_base,
  cast(list_min(p) - 1 as bigint) as first_word, cast(list_max(p) - 1 as bigint) as last_word,
  {joined(base)} as base_labels, {joined(base + ", " + more)} as labels, cast(m as double) / (m + 1) as score
from placed
"""


OP2_SQL = _sql()
