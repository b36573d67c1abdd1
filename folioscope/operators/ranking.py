"""Scans of texts, each task over its own: words and their counts, BM25 as a sparse product, aliases and quoted passages.

Words are lower-cased and split as Python does it, which is what WORDS[...] asks of the SQL engines. The functions that run on
executors name nothing of this module, so executors need not have it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def bm25_best(pages: DataFrame, weights: list[tuple[int, str, float]], mean_length: float, always: list[str], depth: int = 20, block: int = 512, rows: int = 1000) -> DataFrame:
    """(chunk_id, text) and a question's (query_id, word, idf times its count) -> (query_id, chunk_id, score), rounded.

    Of each task at least the `depth` best pages of a question, ties by chunk_id, and those of `always` that share a word
    with it. A task holds scores of `rows` pages for `block` questions, and `depth` rows a question.
    """
    terms, queries = sorted({t for _, t, _ in weights}), sorted({q for q, _, _ in weights})
    row, col = {t: i for i, t in enumerate(terms)}, {q: i for i, q in enumerate(queries)}
    held = sorted((row[t], col[q], w) for q, t, w in weights)
    w_term, w_query = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)
    w_value = np.array([h[2] for h in held], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_terms, n_queries, known_at = len(terms), len(queries), row.get
        always_ = np.array(always, object)
        blocks = []
        for lo in range(0, n_queries, block):
            own = (w_query >= lo) & (w_query < lo + block)
            begin = np.searchsorted(w_term[own], np.arange(n_terms + 1))
            blocks.append((lo, min(block, n_queries - lo), begin, w_query[own] - lo, w_value[own]))
        kept = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        least = np.full(n_queries, -np.inf)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                words = [(t or "").lower().split() for t in batch.column(1).to_pylist()]
                lengths = np.array([len(w) for w in words], np.int64)
                found = np.fromiter((known_at(w, -1) for w in chain.from_iterable(words)), np.int64, int(lengths.sum()))
                known = found >= 0
                key, tf = np.unique(np.repeat(np.arange(len(lengths)), lengths)[known] * max(n_terms, 1) + found[known], return_counts=True)
                if not len(key):
                    continue
                page, term = np.divmod(key, n_terms)
                part = tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * lengths[page] / mean_length))
                names = np.array(batch.column(0).to_pylist(), object)
                first = np.isin(names, always_)
                new = [kept]
                for lo, n, begin, query, value in blocks:
                    # each word of a page goes to the questions that have it
                    many = begin[term + 1] - begin[term]
                    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[term], many)
                    cell = np.repeat(page, many) * n + query[place]
                    score = np.bincount(cell, np.repeat(part, many) * value[place], len(lengths) * n).reshape(-1, n).round(6)
                    hit = np.bincount(cell, minlength=len(lengths) * n).reshape(-1, n) > 0
                    p, q = np.nonzero(hit & ((score >= least[lo : lo + n]) | first[:, None]))
                    new.append((q + lo, score[p, q], names[p]))
                q, s, name = (np.concatenate(x) for x in zip(*new, strict=True))
                if len(q) == len(kept[0]):
                    continue
                order = np.lexsort((np.unique(name, return_inverse=True)[1], -s, q))
                q, s, name = q[order], s[order], name[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                least[q[place == depth - 1]] = s[place == depth - 1]
                stay = (place < depth) | np.isin(name, always_)
                kept = q[stay], s[stay], name[stay]
        if len(kept[0]):
            yield pa.RecordBatch.from_arrays([pa.array(np.array(queries, np.int64)[kept[0]]), pa.array(kept[2].tolist(), pa.string()), pa.array(kept[1])], ["query_id", "chunk_id", "score"])

    return pages.select("chunk_id", "text").mapInArrow(run, "query_id long, chunk_id string, score double")


def word_counts(pages: DataFrame, most: int = 200_000) -> DataFrame:
    """(text) -> (term, pages, words): how many pages have a word, in parts to be added up; the row without a word has all pages with words and all words.

    A task adds up to `most` words before it hands them on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(terms: list, counts: list, words: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int64()), pa.array(words, pa.int64())], ["term", "pages", "words"])

        count, pages_, words_ = {}, 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = (text or "").lower().split()
                if words:
                    pages_ += 1
                    words_ += len(words)
                    for w in set(words):
                        count[w] = count.get(w, 0) + 1
                if len(count) >= most:
                    yield out(list(count), list(count.values()), [0] * len(count))
                    count = {}
        yield out([*count, None], [*count.values(), pages_], [0] * len(count) + [words_])

    return pages.select("text").mapInArrow(run, "term string, pages long, words long")


def aliases_of(pages: DataFrame, owners: dict[str, list[str]]) -> DataFrame:
    """(chunk_id, doc_id, page, text) -> (chunk_id, doc_id, page, name, n): the names whose aliases, of one or two words each, stand in a page, and the largest count of an alias's first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = {a.split(" ")[0] for a in owners}
        pairs = {tuple(a.split(" ")) for a in owners if " " in a}
        split = re.compile("[a-z0-9]+").findall
        for batch in batches:
            at, names, counts = [], [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                words = split((text or "").lower())
                here = firsts.intersection(words)
                if not here:
                    continue
                own = {}
                found = [w for w in here if w in owners] + [" ".join(p) for p in pairs.intersection(zip(words, words[1:]))]
                for alias in found:
                    n = words.count(alias.split(" ")[0])
                    for name in owners[alias]:
                        own[name] = max(own.get(name, 0), n)
                at += [i] * len(own)
                names += own.keys()
                counts += own.values()
            if at:
                rows = batch.select([0, 1, 2]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["chunk_id", "doc_id", "page", "name", "n"])

    kinds = dict(pages.dtypes)
    return pages.select("chunk_id", "doc_id", "page", "text").mapInArrow(run, f"chunk_id string, doc_id {kinds['doc_id']}, page {kinds['page']}, name string, n long")


def holders(docs: DataFrame, passages: list[tuple[int, str]]) -> DataFrame:
    """(doc_id, text) and (query_id, passage) -> (query_id, doc_id): the texts that hold a passage, lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text is not None:
                    low = text.lower()
                    own = [q for q, p in passages if p in low]
                    at += [i] * len(own)
                    found += own
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), batch.column(0).take(pa.array(at, pa.int64()))], ["query_id", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, f"query_id long, doc_id {dict(docs.dtypes)['doc_id']}")
