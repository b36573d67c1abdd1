"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare

ORDERS = (1, 2, 3)
UNKNOWN = "und"


@functools.cache
def alphabet() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case form if it is a letter or a mark, else a blank; and whether it is a letter."""
    table, letter = np.full(0x110000, 32, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        x = chr(c)
        kind = unicodedata.category(x)[0]
        if kind in "LM":
            table[c] = ord(x.lower()[0])
            letter[c] = kind == "L"
    return table, letter


class Grams(NamedTuple):
    """Hashed n-grams of a few texts."""

    ids: np.ndarray  # buckets
    row: np.ndarray  # of each, the text it is in
    letters: np.ndarray  # by text, whether it has a letter


def grams(texts: list[str], bits: int, tables: tuple[np.ndarray, np.ndarray]) -> Grams:
    """n-grams of the letters of whole texts, runs of anything else being one blank; none goes over the end of a text."""
    table, letter = tables
    code = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    n = np.array([len(x) for x in code], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint32), *code])
    owner = np.repeat(np.arange(len(texts)), n)
    letters = np.bincount(owner[letter[flat]], minlength=len(texts)) > 0
    # a blank before and after each text
    start = np.concatenate([[0], np.cumsum(n + 2)])
    x = np.full(int(start[-1]), 32, np.uint64)
    x[np.arange(len(flat)) + 2 * owner + 1] = table[flat]
    row = np.repeat(np.arange(len(texts)), n + 2)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32) | (row[1:] != row[:-1])
    x, row = x[keep], row[keep]
    shift, h = np.uint64(64 - bits), x
    ids, rows = [], []
    for k in ORDERS:
        if k > 1:  # order k continues the hash of order k - 1 by one character to the right
            h = h[: len(x) - k + 1] * np.uint64(0x100000001B3) + x[k - 1 :]
        own = row[: len(h)] == row[k - 1 :] if len(h) else np.zeros(0, bool)
        ids.append((((h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)[own])
        rows.append(row[: len(h)][own])
    return Grams(np.concatenate(ids), np.concatenate(rows), letters)


def buckets(text: str, bits: int, tables: tuple[np.ndarray, np.ndarray], piece: int = 1 << 20) -> Iterator[np.ndarray]:
    """The n-grams of one long text as grams() has them, slice by slice."""
    shift, width = np.uint64(64 - bits), max(ORDERS) - 1
    carry = np.array([32], np.uint64)
    for at in range(0, len(text), piece):
        code = np.frombuffer(text[at : at + piece].encode("utf-32-le", "surrogatepass"), np.uint32)
        x = np.concatenate([carry, tables[0][code].astype(np.uint64)] + [np.array([32], np.uint64)] * (at + piece >= len(text)))
        new = len(carry)
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
        keep[:new] = True
        x = x[keep]
        h = x
        for k in ORDERS:
            if k > 1:
                h = h[: len(x) - k + 1] * np.uint64(0x100000001B3) + x[k - 1 :]
            skip = max(0, new - k + 1) if at else 0  # those were counted with the slice before
            yield (((h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)[skip:]
        carry = x[-width:]


def pieces(texts: list[str | None], piece: int = 1 << 18) -> Iterator[tuple[int, list[str] | str]]:
    """(first row, texts) of runs of texts of about piece characters; (row, text) of a longer one."""
    run, first, size = [], 0, 0
    for i, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > piece:
            yield first, run
            run, size = [], 0
        if len(t) > piece:
            yield i, t
            continue
        if not run:
            first = i
        run.append(t)
        size += len(t)
    if run:
        yield first, run


def fit(train: DataFrame, text: str = "text", lang: str = "lang", max_docs_per_lang: int = 10_000, bits: int = 15, id_col: str = "doc_id", max_langs: int = 4096) -> dict:
    """Learns {"langs", "logp", "bits"} from rows with a language.

    max_docs_per_lang bounds the labelled sample: of a language with more rows about so many are taken, by a hash of
    the id, so that training costs the same at any corpus size and no hot language outweighs the others. Rows with a
    null language or text are not used; without any row there are no languages. A repeated row counts each time. Of more than
    max_langs languages, which no column of language codes has, those with the most rows are learned, ties by name.
    """
    rows = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(id_col).alias("id"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    if not sizes:
        return {"langs": [], "logp": np.zeros((1 << bits, 0), np.float64), "bits": bits}
    while bits > 12 and len(sizes) << bits > 1 << 22:
        bits -= 1  # keeps the broadcast matrix under 32 MB
    langs = sorted(sizes)
    code = {x: i for i, x in enumerate(langs)}
    rates = {x: min(1.0, max_docs_per_lang / n) for x, n in sizes.items()}
    if any(r < 1 for r in rates.values()):
        rate = F.coalesce(*[F.when(F.col("lang") == F.lit(x), F.lit(r)) for x, r in rates.items() if r < 1], F.lit(1.0))
        rows = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < rate * F.lit(float(1 << 30)))

    tables = train.sparkSession.sparkContext.broadcast(alphabet())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), 1 << bits), np.int64)
        for batch in batches:
            kinds = np.array([code.get(x, -1) for x in batch.column(0).to_pylist()])
            for first, texts in pieces(batch.column(1).to_pylist()):
                if isinstance(texts, str):
                    for ids in buckets(texts, bits, tables.value) if kinds[first] >= 0 else ():
                        total[kinds[first]] += np.bincount(ids, minlength=1 << bits)
                    continue
                found = grams(texts, bits, tables.value)
                kind = kinds[first + found.row]
                for k in np.unique(kind[kind >= 0]):
                    total[k] += np.bincount(found.ids[kind == k], minlength=1 << bits)
        for k in range(len(langs)):
            hit = np.flatnonzero(total[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), k, np.int32)), pa.array(hit.astype(np.int32)), pa.array(total[k, hit])], names=["k", "bucket", "n"])

    found = rows.select("lang", "text").mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((1 << bits, len(langs)))
    counts[found["bucket"].to_numpy(), found["k"].to_numpy()] = found["n"].to_numpy()
    # languages have equal priors: the share of a language in the sample says nothing about the next document
    logp = np.log(counts + 0.5) - np.log(counts.sum(0) + 0.5 * (1 << bits))
    return {"langs": langs, "logp": logp, "bits": bits}


def log_scores(texts: list[str | None], model: dict, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages) log-likelihoods, and whether each text has a letter.

    The batch is one sparse matrix of texts by buckets, in rows of distinct buckets and their counts, times the matrix
    of log-probabilities.
    """
    bits, logp = model["bits"], model["logp"]
    out, letters = np.zeros((len(texts), logp.shape[1])), np.zeros(len(texts), bool)
    for first, run in pieces(texts):
        if isinstance(run, str):
            letters[first] = any(unicodedata.category(c)[0] == "L" for c in run)
            for ids in buckets(run, bits, tables):
                count = np.bincount(ids, minlength=1 << bits)
                hit = np.flatnonzero(count)
                out[first] += count[hit] @ logp[hit]
            continue
        found = grams(run, bits, tables)
        letters[first : first + len(run)] |= found.letters
        # texts of a run are short beside the matrix, so that its entries are sorted as one number each
        entry, count = np.unique((found.row << bits) + found.ids, return_counts=True)
        row = entry >> bits
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        if len(begin):
            out[first + row[begin]] += np.add.reduceat(logp[entry & (1 << bits) - 1] * count[:, None], begin, axis=0)
    return out, letters


def predict(texts: list[str | None], model: dict, tables: tuple[np.ndarray, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """Language and posterior of every text; of equal scores the language first by name counts."""
    if not model["langs"]:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    s, letters = log_scores(texts, model, tables)
    best = s.argmax(1)
    with np.errstate(under="ignore"):
        sure = 1.0 / np.exp(s - s[np.arange(len(s)), best][:, None]).sum(1)
    return [model["langs"][k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)], np.where(letters, sure, 0.0)


def identify(docs: DataFrame, model: dict, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language and its posterior to every row; other columns stay as they are.

    Null texts, texts without a letter and models without languages give `und` and 0. A text counts whole, however
    long. Equal scores go to the language first by name. Repeated rows get a result each, and an empty table stays empty.
    A column that already has the name of a result is replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop(pred, score)
    shared = spark.sparkContext.broadcast((model, alphabet()))
    schema = T.StructType([*docs.schema.fields]).add(pred, "string").add(score, "double")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sure = predict(batch.column(at).to_pylist(), *shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(sure)], names=[*batch.schema.names, pred, score])

    return docs.mapInArrow(run, schema)
