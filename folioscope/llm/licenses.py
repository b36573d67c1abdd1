"""License scans: templates with optional and replaceable regions as token automata.

Markup: `[[ ... ]]` holds words that may be absent (nested, if need be), `{{n}}` stands for 0 to n words of any kind.
All else is mandatory wording. A text has a template's label where its words, in order and without a gap, run the
automaton from start to end.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ALNUM_WORDS, LOWER, _hash_piece, batch_words, prepare

ANY = 0
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

#: The base phrases and their labels, as the contract of the query states them.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Templates of common license notices, by label.
TEMPLATES = {
    "gpl-3.0": "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3 [[of the license]]",
    "gpl-2.0": "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2 [[of the license]]",
    "apache-2.0": "licensed under the apache license version 2 0 [[the license]]",
    "cc-by-nc-4.0": "licensed under [[a]] [[the]] cc by nc 4 0 [[license]]",
    "cc-by-sa-4.0": "licensed under [[a]] [[the]] cc by sa 4 0 [[license]]",
    "cc-by-4.0": "licensed under [[a]] [[the]] [[creative commons attribution]] cc by 4 0 [[international]] license",
    "mit-notice": "released under the [[terms of the]] mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this {{6}} and associated documentation files",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted [[provided that the following conditions are met]]",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "copyright-reserved": "copyright [[c]] {{8}} all rights reserved",
}


def word_code(word: str) -> int:
    low = LOWER[np.frombuffer(word.encode(), np.uint8)]
    return int(_hash_piece(low, ALNUM_WORDS, np.zeros(0, np.int64))[0][0])


class Automaton:
    """States are positions of the template's tokens; skips[s] are the states reachable without a word."""

    def __init__(self, template: str):
        self.need: list[int] = []  # the word that leads from state s to s + 1, or ANY
        jumps: list[tuple[int, int]] = []
        opened: list[int] = []
        for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
            if token == "[[":
                opened.append(len(self.need))
            elif token == "]]":
                jumps.append((opened.pop(), len(self.need)))
            elif token.startswith("{{"):
                for _ in range(int(token[2:-2])):
                    jumps.append((len(self.need), len(self.need) + 1))
                    self.need.append(ANY)
            else:
                self.need += [word_code(w) for w in WORD.findall(token.lower())]
        if opened or not any(self.need):
            raise ValueError(f"not a template: {template}")
        self.end = len(self.need)
        self.skips = [self._closure({s}, jumps) for s in range(self.end + 1)]
        #: words that a match can begin with; ANY if it can begin with any
        self.first = {self.need[s] for s in self.skips[0] if s < self.end}
        if ANY in self.first or self.end in self.skips[0]:
            raise ValueError("a template begins with mandatory wording")

    @staticmethod
    def _closure(states: set[int], jumps: list[tuple[int, int]]) -> frozenset[int]:
        while more := {b for a, b in jumps if a in states} - states:
            states = states | more
        return frozenset(states)

    def match(self, words: np.ndarray, at: int) -> int | None:
        """The end (exclusive) of the shortest match from word `at` on, if any."""
        states = self.skips[0]
        for i in range(at, len(words)):
            w = int(words[i])
            states = frozenset().union(*[self.skips[s + 1] for s in states if s < self.end and self.need[s] in (ANY, w)])
            if self.end in states:
                return i + 1
            if not states:
                return None
        return None


@functools.cache
def compiled(templates: tuple[tuple[str, str], ...]) -> tuple[tuple[str, Automaton], ...]:
    return tuple((label, Automaton(body)) for label, body in templates)


def scan_words(words: np.ndarray, automata: tuple[tuple[str, Automaton], ...]) -> list[tuple[str, int, int]]:
    """(label, start, end) of every place where a template matches, by words."""
    starts: dict[int, list[tuple[str, Automaton]]] = {}
    for label, a in automata:
        for w in a.first:
            starts.setdefault(w, []).append((label, a))
    hit = np.flatnonzero(np.isin(words, np.array(list(starts), np.uint64)))
    return [(label, int(i), end) for i in hit for label, a in starts[int(words[i])] if (end := a.match(words, int(i))) is not None]


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,stop:long>>"


def scan(docs: DataFrame, text: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """Adds the license columns of RESULT to every row.

    phrases (words -> label) and templates (label -> markup) all run as automata. n_base counts all places of phrases,
    overlapping ones too; first_word and last_word are the smallest and the largest start of them; base_labels are
    theirs, labels those of phrases and templates, distinct, sorted and comma-joined (empty if none). score is 1 with
    a template's match, 0.5 with phrases alone, else 0. spans are all matches in words.

    Null and empty texts have no words. Whole texts count, however long. Repeated rows count each; columns that clash
    with the results are replaced.
    """
    prepare(docs.sparkSession)
    base = tuple((phrase, phrase) for phrase in (PHRASES if phrases is None else phrases))
    label_of = dict(PHRASES if phrases is None else phrases)
    more = tuple((TEMPLATES if templates is None else templates).items())
    added = T.StructType.fromDDL(RESULT)
    docs = docs.drop(*added.names)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *added.fields])
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), span]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = compiled(base), compiled(more)
        for batch in batches:
            rows = []
            for words in batch_words(batch.column(at), ALNUM_WORDS):
                found = [(label_of[p], a, b) for p, a, b in scan_words(words, low)]
                extra = scan_words(words, high)
                own = [a for _, a, _ in found]
                names = {x for x, *_ in found}
                rows.append((
                    len(words), len(own), min(own, default=None), max(own, default=None), ",".join(sorted(names)), ",".join(sorted(names | {x for x, *_ in extra})),
                    1.0 if extra else 0.5 if own else 0.0, [{"label": x, "start": a, "stop": b} for x, a, b in sorted(found + extra, key=lambda s: (s[1], s[2], s[0]))],
                ))
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return docs.mapInArrow(run, schema)


def _regex(template: str) -> str:
    """A template over words that are each followed by one blank."""
    out = ""
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
        if token == "[[":
            out += "(?:"
        elif token == "]]":
            out += ")?"
        elif token.startswith("{{"):
            out += f"(?:[^ ]+ ){{0,{token[2:-2]}}}"
        else:
            out += "".join(f"{w} " for w in WORD.findall(token.lower()))
    return out


def scan_sql(table: str) -> str:
    """The digest of scan() with the default phrases and templates, as DuckDB SQL."""
    places = []
    for phrase in PHRASES:
        words = phrase.split()
        test = " AND ".join(f"w[i + {k}] = '{x}'" if k else f"w[i] = '{x}'" for k, x in enumerate(words))
        places.append((phrase, f"list_filter(range(1, len(w) + 1), lambda i: {test})"))
    lists = ", ".join(f"{sql} AS p{k}" for k, (_, sql) in enumerate(places))
    every = "[]::BIGINT[]"
    for k in range(len(places)):
        every = f"list_concat({every}, p{k})"
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{PHRASES[p]}' END" for k, (p, _) in enumerate(places))
    more = ", ".join(f"CASE WHEN regexp_matches(t, '(?:^| ){_regex(m)}') THEN '{label}' END" for label, m in TEMPLATES.items())
    return rf"""
WITH a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM {table}),
b AS (SELECT doc_id, w, array_to_string(w, ' ') || ' ' AS t, {lists} FROM a),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, {every} AS o, list_filter([{base}], lambda x: x IS NOT NULL) AS y, list_filter([{more}], lambda x: x IS NOT NULL) AS z FROM b)
SELECT doc_id, n_words, len(o)::BIGINT AS n_base, (list_min(o) - 1)::BIGINT AS first_word, (list_max(o) - 1)::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(y)), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(y, z))), ',') AS labels,
  CASE WHEN len(z) > 0 THEN 1.0::DOUBLE WHEN len(o) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM c
"""
