"""Quality classifier: Bradley-Terry scores learned from preference pairs, thresholded at a score quantile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACE_WORDS, Stages, prepare, sized, text_buffers, word_spans

#: Byte classes counted per text, each as a share of its bytes.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t", "line": b"\n", "stop": b".?", "bang": b"!", "comma": b",;:",
    "pipe": b"|", "hash": b"#", "star": b"*", "cash": b"$%&", "bracket": b"<>[]{}()", "quote": b"\"'", "slash": b"/\\_=+-~^`@", "control": bytes(range(9)) + bytes(range(14, 32)),
}
FEATURES = [*CLASSES, "high", "log_words", "word_length", "long_words", "symbol_ends", "upper_starts", "upper_words", "distinct_words", "distinct_lines", "line_words", "empty"]

#: Tasks of a step over all features, at most.
TASKS = 64


def features_of(raw: np.ndarray) -> np.ndarray:
    """Features of one whole text (UTF-8 bytes); an empty text has the feature `empty` alone."""
    x = np.zeros(len(FEATURES))
    if len(raw) == 0:
        x[-1] = 1
        return x
    count = np.bincount(raw, minlength=256)
    for i, members in enumerate(CLASSES.values()):
        x[i] = count[list(members)].sum() / len(raw)
    k = len(CLASSES)
    x[k] = count[128:].sum() / len(raw)
    start, end = word_spans(raw, SPACE_WORDS, np.zeros(0, np.int64))
    if len(start) == 0:
        x[-1] = 1
        return x
    size = end - start
    last, first = raw[end - 1], raw[start]
    alpha = lambda b: ((b | 32) >= 97) & ((b | 32) <= 122) | (b >= 128)
    up = lambda b: (b >= 65) & (b <= 90)
    plain = alpha(last) | ((last >= 48) & (last <= 57)) | np.isin(last, [46, 44])
    second = raw[np.minimum(start + 1, len(raw) - 1)]
    x[k + 1 : k + 7] = np.log1p(len(start)), size.mean() / 10, (size > 20).mean(), 1 - plain.mean(), up(first).mean(), (up(first) & up(second)).mean()
    # distinct words by their length, first and last three bytes; enough to tell repetition from prose
    code = size.astype(np.int64)
    for i in range(3):
        code = code * 257 + LOWER[raw[np.minimum(start + i, end - 1)]]
        code = code * 257 + LOWER[raw[np.maximum(end - 1 - i, start)]]
    x[k + 7] = len(np.unique(code)) / len(code)
    lines = [s for s in raw.tobytes().split(b"\n") if s.strip()]
    x[k + 8], x[k + 9] = len(set(lines)) / max(1, len(lines)), np.log1p(len(start) / max(1, len(lines)))
    return x


def batch_features(column: pa.Array) -> np.ndarray:
    raw, off = text_buffers(column)
    return np.array([features_of(raw[off[i] : off[i + 1]]) for i in range(len(off) - 1)]).reshape(-1, len(FEATURES))


#: Scores fall in cells of this width; within a cell a sum over pairs is a polynomial through so many Chebyshev nodes, off by about 1e-11 of itself.
CELL, NODES = 0.5, 8
AT = np.cos((np.arange(NODES) + 0.5) * np.pi / NODES)
TILT = (-1.0) ** np.arange(NODES) * np.sin((np.arange(NODES) + 0.5) * np.pi / NODES)


def pair_sums(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the documents of a batch add to sums over pairs: (label, cell) and a row of sums for each that occurs.

    A row has the documents' weights at the nodes of the cell, those weights times z, and z times z.
    """
    s = (z * w).sum(1)
    cell = np.floor(s / CELL)
    keys, row = np.unique(np.stack([y, cell], 1), axis=0, return_inverse=True)
    row = row.ravel()
    away = ((s / CELL - cell) * 2 - 1)[:, None] - AT
    hit = away == 0
    share = np.where(hit.any(1)[:, None], hit, TILT / np.where(hit, 1, away))
    share /= share.sum(1, keepdims=True)
    out = []
    for k in range(len(keys)):
        m, own = share[row == k], z[row == k]
        out.append(np.concatenate([m.sum(0), (m.T @ own).ravel(), (own.T @ own).ravel()]))
    return keys, np.array(out).reshape(len(keys), -1)


def bradley_terry(gather, width: int, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights w that maximise the likelihood of every good document beating every bad one: sigmoid(w . (good - bad)), by Newton.

    gather(w) gives pair_sums of all documents, a label and cell once or several times. All pairs count, without being
    made: a document's sum over the others depends on its score alone. The Hessian takes scores at the middle of their
    cell; that changes the way to the maximum, not the maximum.
    """
    w = np.zeros(width)
    for _ in range(steps):
        keys, rows = gather(w)
        keys, at = np.unique(keys, axis=0, return_inverse=True)
        sums = np.zeros((len(keys), rows.shape[1]))
        np.add.at(sums, at.ravel(), rows)
        good, bad = keys[:, 0] == 1, keys[:, 0] != 1
        place = (keys[:, 1:] + (AT + 1) / 2) * CELL
        weight, moment = sums[:, :NODES], sums[:, NODES : NODES * (1 + width)].reshape(-1, NODES, width)
        square = sums[:, NODES * (1 + width) :].reshape(-1, width, width)
        middle = (keys[:, 1] + 0.5) * CELL
        pairs = weight[good].sum() * weight[bad].sum()
        grad, hess = -ridge * w, ridge * np.eye(width)
        won, lost = np.zeros((int(good.sum()), NODES)), np.zeros((int(bad.sum()), NODES))
        near = _sigmoid(middle[good][:, None] - middle[bad])
        near *= 1 - near
        for k in range(len(won)):  # one cell at a time, so that memory stays small
            p = _sigmoid(place[bad] - place[good][k][:, None, None])
            won[k] = (p * weight[bad]).sum((1, 2))
            lost += np.tensordot(weight[good][k], p, 1)
        grad += (np.tensordot(won, moment[good], 2) - np.tensordot(lost, moment[bad], 2)) / pairs
        cross = moment[good].sum(1).T @ near @ moment[bad].sum(1)
        hess += (np.tensordot(near @ weight[bad].sum(1), square[good], 1) + np.tensordot(weight[good].sum(1) @ near, square[bad], 1) - cross - cross.T) / pairs
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def _sortable(s: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order; 0.0 and -0.0 are one."""
    bits = (s + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def ranked(histogram, ranks: list[int]) -> list[float]:
    """The values at these ranks (from 0) of all scores in ascending order, 16 bits at a time.

    histogram(shift, heads) gives the keys of _sortable without their last shift bits, and their counts, each key once or
    several times; of the scores that begin with one of the heads only, or of all if heads is None.
    """
    heads, left = None, list(ranks)
    for shift in (48, 32, 16, 0):
        keys, counts = histogram(shift, heads)
        keys, at = np.unique(keys, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at.ravel(), counts)
        found = []
        for k, rank in enumerate(left):
            own = np.ones(len(keys), bool) if heads is None else (keys >> np.uint64(16)) == heads[k]
            upto = np.cumsum(total[own])
            i = int(np.searchsorted(upto, rank, "right"))
            found.append(keys[own][i])
            left[k] = rank - int(upto[i] - total[own][i])
        heads = np.array(found, np.uint64)
    top = np.uint64(1 << 63)
    return np.where(heads & top, heads ^ top, ~heads).view(np.float64).tolist()


def fit(docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", label: str = "quality", cut: float = 0.3) -> dict:
    """Learns from all documents that have a label and satisfy usable.

    Pairs are all preferences of a label 1 over a label 0 document. The threshold is the quantile of the learned
    documents' scores that the share of label 0 in all labels names; score() maps it to `cut`. Features are written once
    and read for each step; a step sends sums to the driver, not documents. Null labels and texts aren't used; of
    repeated labels of a document the smallest counts. Without both labels all documents score cut.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y")).where(usable)
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    width = len(FEATURES)
    none = {"w": np.zeros(width), "mean": np.zeros(width), "scale": np.ones(width), "at": 0.0, "spread": 1.0, "cut": cut}
    if not n.get(0) or not n.get(1):
        return none
    rows = docs.where(F.col(text).isNotNull()).select("doc_id", text).join(sized(known), "doc_id").select("y", text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch_features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["y", "x"])

    with Stages(docs.sparkSession) as stages:
        # few tasks a step: each sends its own sums
        learned = stages.keep(rows.mapInArrow(run, T.StructType([rows.schema["y"]]).add("x", T.ArrayType(T.DoubleType())))).coalesce(TASKS)

        def summed(of) -> tuple[np.ndarray, np.ndarray]:
            """of(x, y) -> (keys, rows), both of doubles, over all batches; a task adds up what has the same key."""

            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total: dict[tuple, np.ndarray] = {}
                for batch in batches:
                    y = batch.column(0).to_numpy(zero_copy_only=False)
                    keys, sums = of(np.asarray(batch.column(1).flatten()).reshape(len(y), -1), y)
                    for key, one in zip(map(tuple, keys.tolist()), sums, strict=True):
                        total[key] = total[key] + one if key in total else one
                if total:
                    yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in total], pa.list_(pa.float64())), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["k", "v"])

            got = learned.mapInArrow(add, "k array<double>, v array<double>").toArrow()
            return tuple(np.array(got[c].combine_chunks().flatten()).reshape(got.num_rows, -1) if got.num_rows else np.zeros((0, 1)) for c in "kv")

        one = lambda y: (np.unique(y)[:, None], [y == v for v in np.unique(y)])

        def first(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keys, own = one(y)
            return keys, np.array([[m.sum(), *x[m].sum(0)] for m in own])

        keys, sums = summed(first)
        if len(np.unique(keys)) < 2:
            return none
        many = int(sums[:, 0].sum())
        # rounded, since the order of rows moves the last digits of sums
        mean = np.round(sums[:, 1:].sum(0) / many, 12)
        scale = np.round(np.sqrt(summed(lambda x, y: (np.zeros((1, 1)), ((x - mean) ** 2).sum(0)[None]))[1].sum(0) / many), 12) + 1e-3
        w = np.round(bradley_terry(lambda w: summed(lambda x, y: pair_sums((x - mean) / scale, y, w)), width), 9)
        model = {"w": w, "mean": mean, "scale": scale, "cut": cut}
        s1, s2 = summed(lambda x, y: (np.zeros((1, 1)), np.array([[(s := raw_scores(x, model)).sum(), (s * s).sum()]])))[1].sum(0) / many

        def histogram(shift: int, heads: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            def of(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                keys = _sortable(raw_scores(x, model)) >> np.uint64(shift)
                keys, counts = np.unique(keys if heads is None else keys[np.isin(keys >> np.uint64(16), heads)], return_counts=True)
                # doubles hold 32 bits each
                return np.stack([keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)], 1).astype(float), counts[:, None].astype(float)

            keys, counts = summed(of)
            return (keys[:, 0].astype(np.uint64) << np.uint64(32)) | keys[:, 1].astype(np.uint64), counts[:, 0].astype(np.int64)

        rank = (many - 1) * n[0] / (n[0] + n[1])
        low, high = ranked(histogram, [int(rank), min(int(rank) + 1, many - 1)])
        return model | {"at": low + (high - low) * (rank - int(rank)), "spread": float(np.sqrt(max(0.0, s2 - s1 * s1)) + 1e-9)}


def raw_scores(x: np.ndarray, model: dict) -> np.ndarray:
    """Row by row, so that a document's score doesn't depend on its batch."""
    return ((x - model["mean"]) / model["scale"] * model["w"]).sum(1)


def score_features(x: np.ndarray, model: dict) -> np.ndarray:
    base = np.log(model["cut"] / (1 - model["cut"]))
    return 1 / (1 + np.exp(-np.clip(2 * (raw_scores(x, model) - model["at"]) / model["spread"] + base, -30, 30)))


def score(docs: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """Adds the score, 0 to 1, of every whole text; null counts as empty. A column of that name is replaced."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop(name)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score_features(batch_features(batch.column(at)), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields]).add(name, "double"))
