"""Benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows, then exact edit distance.

The CGK random walk copies a string to a longer one, moving on or staying at each step by a random bit of the step and
the current character. Strings at a small edit distance fall into step again and so end at a small Hamming distance,
which sampled places of the walks (signatures) find by equality. Benchmark items are queries of a stated size: blocks
of them are broadcast, and every text is read once per block, without a shuffle.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, prepare

Q = 12
BITMAP_BITS = 22
#: A walk tells so many codes apart.
CODES = 256
#: Places whose q-grams are hashed at once.
PIECE = 1 << 17
#: Signatures of windows made at once.
SIGNATURES = 1 << 19


@functools.cache
def _plain() -> np.ndarray:
    """Letters and digits in lower case, all else a blank."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalnum():
            table[c] = ord(x.lower()[0])
    return table


def normal(text: str | None, piece: int = 1 << 20) -> np.ndarray:
    """Lower-case letters and digits, one blank between runs of them, none at the ends."""
    out, last = [], 32
    for at in range(0, len(text or ""), piece):
        x = _plain()[np.frombuffer(text[at : at + piece].encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = x != 32
        keep[1:] |= x[:-1] != 32
        keep[0] |= last != 32
        x = x[keep]
        if len(x):
            last = int(x[-1])
            out.append(x)
    x = np.concatenate(out) if out else np.zeros(0, np.uint32)
    return x[:-1] if len(x) and x[-1] == 32 else x


def q_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of the Q codes from each place on, by doubling."""
    p, n = 0x9E3779B97F4A7C15, len(x) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    part, w, out, done = x.astype(np.uint64) + np.uint64(1), 1, np.zeros(n, np.uint64), 0
    while done < Q:
        if Q & w:
            out = out * np.uint64(pow(p, w, 1 << 64)) + part[done : done + n]
            done += w
        if done < Q:
            part = part[:-w] * np.uint64(pow(p, w, 1 << 64)) + part[w:]
            w *= 2
    return out


def _slot(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _marks(x: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """The bitmap's entry of the q-gram from each place on, piece by piece: hashes take eight bytes a place, several times over."""
    out = np.zeros(max(0, len(x) - Q + 1), bitmap.dtype)
    for at in range(0, len(out), PIECE):
        out[at : at + PIECE] = bitmap[_slot(q_hashes(x[at : at + PIECE + Q - 1]))]
    return out


class Class(NamedTuple):
    """Items of about one length."""

    length: int  # of the windows: the shortest item's
    reach: int  # from a start, the farthest an item with its edits goes
    hits: int  # q-grams that a window has in common with an item at least
    bits: np.ndarray  # walks x steps x codes modulo CODES, packed: whether the walk moves on
    picks: np.ndarray  # walks x steps x signatures: whether the step is sampled
    sigs: list[np.ndarray]  # by signature, sorted
    items: list[np.ndarray]  # by signature, the item of each


class Index(NamedTuple):
    ids: list[int]
    codes: list[np.ndarray]
    edits: list[int]
    bitmap: np.ndarray  # by hash of a q-gram, a bit for each class (modulo 8) whose items have it
    classes: list[Class]
    longest: int


def allowed_edits(length: int, tolerance: float) -> int:
    k = int(tolerance * length)
    return k if length - Q + 1 - k * Q > 0 else max(0, (length - Q) // Q // 2)


def embed(x: np.ndarray, start: np.ndarray, stop: np.ndarray, bits: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Signatures (windows x walks * signatures) of all walks over the windows [start, stop) of x; past stop all codes are 0."""
    walks, steps, per_walk = picks.shape
    n, last, low = len(start), len(x) - 1, CODES - 1
    moves = np.unpackbits(bits, axis=2).transpose(1, 0, 2).reshape(steps, walks * CODES)
    at, stop, row = np.tile(start.astype(np.int64), walks), np.tile(stop, walks), np.repeat(np.arange(walks) * CODES, n)
    sig = np.zeros((walks * per_walk, n), np.uint64)
    step_of, walk_of, sig_of = np.nonzero(picks.transpose(1, 0, 2))
    cuts = np.searchsorted(step_of, np.arange(steps + 1))
    place = walk_of * per_walk + sig_of
    for step in range(int(step_of[-1]) + 1):
        code = np.where(at < stop, x[np.minimum(at, last)], 0).astype(np.int64)
        lo, hi = cuts[step], cuts[step + 1]
        if hi > lo:
            own = place[lo:hi]
            sig[own] = sig[own] * np.uint64(0x100000001B3) + code.reshape(walks, n)[walk_of[lo:hi]].astype(np.uint64) + np.uint64(1)
        at += moves[step][row + (code & low)]
    return mix(sig).T


def edited(x: np.ndarray, edits: int, rng: np.random.RandomState) -> np.ndarray:
    """x after so many random substitutions, insertions and deletions of codes."""
    out = x.tolist()
    for _ in range(edits):
        kind, at = rng.randint(3), rng.randint(len(out))
        code = int(x[rng.randint(len(x))])
        if kind == 0:
            out[at] = code
        elif kind == 1:
            out.insert(at, code)
        elif len(out) > 1:
            del out[at]
    return np.array(out, x.dtype)


def _walks(length: int, own: list[np.ndarray], edits: list[int], target_recall: float, per_walk: int, sampled: int, most_walks: int, rng: np.random.RandomState, trials: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """bits and picks of as many walks as find target_recall of the class's own items after as many random edits as are allowed.

    More walks are drawn until all but that share of the trials have a signature in common with their item.
    """
    picked = rng.randint(len(own), size=trials)
    tried, after = [own[i] for i in picked], [edited(own[i], edits[i], rng) for i in picked]
    flat = [np.concatenate(x) for x in (tried, after)]
    start = [np.concatenate([[0], np.cumsum([len(y) for y in x])]) for x in (tried, after)]
    missed, all_bits, all_picks, steps = np.ones(trials, bool), [], [], 2 * length
    while len(all_bits) < most_walks and (missed.mean() > 1 - target_recall or not all_bits):
        bits = rng.randint(0, 2, (steps, CODES), np.uint8)
        bits[:, 0] = 1
        bits = np.packbits(bits, axis=1)
        picks = np.zeros((steps, per_walk), bool)
        for s in range(per_walk):
            picks[rng.choice(steps, min(sampled, steps), replace=False), s] = True
        a, b = (embed(x, at[:-1], np.minimum(at[:-1] + length, at[1:]), bits[None], picks[None]) for x, at in zip(flat, start, strict=True))
        missed &= (a != b).all(1)
        all_bits.append(bits)
        all_picks.append(picks)
    return np.array(all_bits), np.array(all_picks)


def build(items: list[tuple[int, str | None]], tolerance: float, target_recall: float, per_walk: int, sampled: int, most_walks: int = 64, seed: int = 11) -> Index:
    ids, codes = [], []
    for i, text in items:
        x = normal(text)
        if len(x) >= Q:
            ids.append(i)
            codes.append(x)
    edits = [allowed_edits(len(x), tolerance) for x in codes]
    bitmap = np.zeros(1 << BITMAP_BITS, np.uint8)
    order = sorted(range(len(ids)), key=lambda i: len(codes[i]))
    classes, rng = [], np.random.RandomState(seed)
    while order:
        length = len(codes[order[0]])
        own = [i for i in order if len(codes[i]) <= max(length + 4, length * 5 // 4)]
        order = order[len(own) :]
        for i in own:
            bitmap[_slot(q_hashes(codes[i]))] |= np.uint8(1 << len(classes) % 8)
        bits, picks = _walks(length, [codes[i] for i in own], [edits[i] for i in own], target_recall, per_walk, sampled, most_walks, rng)
        flat = np.concatenate([codes[i] for i in own])
        start = np.concatenate([[0], np.cumsum([len(codes[i]) for i in own])])[:-1]
        got = embed(flat, start, start + length, bits, picks)
        by = [np.argsort(got[:, s], kind="stable") for s in range(got.shape[1])]
        most = max(edits[i] for i in own)
        classes.append(Class(
            length, max(len(codes[i]) for i in own) + most, min(len(codes[i]) - Q + 1 - edits[i] * Q for i in own),
            bits, picks, [got[o, s] for s, o in enumerate(by)], [np.array(own)[o] for o in by],
        ))
    return Index(ids, codes, edits, bitmap, classes, max((len(x) for x in codes), default=0))


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of item to any stretch of text and where the first such stretch ends, bit-parallel."""
    m = len(item)
    whole, width, at = text.tobytes(), text.itemsize, -1
    if item.dtype == text.dtype:
        wanted = item.tobytes()
        while (at := whole.find(wanted, at + 1)) >= 0:  # the item as it is
            if at % width == 0:
                return 0, at // width + m
    peq: dict[int, int] = {}
    for i, c in enumerate(item.tolist()):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text.tolist()):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def _search(x: np.ndarray, cuts: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, edits, end) of matches in texts joined in x, text i being x[cuts[i] : cuts[i + 1]]."""
    found = _marks(x, index.bitmap)
    if not len(found):
        return
    first = np.zeros(len(x), bool)
    first[1:] = (x[:-1] == 32) & (x[1:] != 32)
    first[cuts[:-1][cuts[:-1] < len(x)]] = True
    words = first.copy()
    seen: set[tuple[int, int, int]] = set()
    for k, c in enumerate(index.classes):
        hit = (found & np.uint8(1 << k % 8)) != 0
        if not hit.any():
            continue
        sums = np.zeros(len(hit) + 1, np.int32)
        np.cumsum(hit, dtype=np.int32, out=sums[1:])
        first[:] = words
        first[: len(hit)][1:] |= hit[1:] & ~hit[:-1]
        starts = np.flatnonzero(first)
        upto = np.minimum(starts + c.reach, len(hit))
        p = starts[sums[upto] - sums[np.minimum(starts, len(hit))] >= c.hits]
        if not len(p):
            continue
        row = np.searchsorted(cuts, p, "right") - 1
        stop = np.minimum(p + c.length, cuts[row + 1])
        size = max(1, SIGNATURES // len(c.sigs))
        for block in range(0, len(p), size):
            own, ends = p[block : block + size], stop[block : block + size]
            sig = embed(x, own, ends, c.bits, c.picks)
            for s in range(sig.shape[1]):
                lo, hi = np.searchsorted(c.sigs[s], sig[:, s], "left"), np.searchsorted(c.sigs[s], sig[:, s], "right")
                for w in np.flatnonzero(hi > lo):
                    for i in c.items[s][lo[w] : hi[w]]:
                        seen.add((int(row[block + w]), int(i), int(own[w])))
    done: dict[tuple[int, int], list[int]] = {}
    for r, i, at in sorted(seen):
        # the starts of one occurrence lie close together and share a check
        spots = done.setdefault((r, i), [])
        if spots and at - spots[-1] <= index.edits[i]:
            continue
        spots.append(at)
    for (r, i), spots in done.items():
        item, k = index.codes[i], index.edits[i]
        found = None
        for at in spots:
            lo, hi = max(cuts[r], at - 2 * k), min(cuts[r + 1], at + len(item) + 3 * k)
            edits, end = best_match(item, x[lo:hi])
            if edits <= k and (found is None or edits < found[0]):
                found = (edits, int(lo + end - cuts[r]))
        if found:
            yield r, i, *found


RESULT = "item_id long, edits int, item_chars int, end_char long"


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", tolerance: float = 0.06, target_recall: float = 0.97, per_walk: int = 8, sampled: int = 6, block_chars: int = 4_000_000) -> DataFrame:
    """(id, text), (item_id, text) -> (id, item_id, edits, item_chars, end_char): every row and the items it contains.

    Texts and items are compared as lower-case letters and digits with one blank between words. A row contains an item
    if some stretch of it is within tolerance * length edits of the item; items too short for that many edits beside a
    common run of 12 characters allow fewer. Candidates: windows from each word's start that share with the items as many
    12-grams as so many edits leave at least (exact), and of these the windows that have a signature in common with an
    item, each of `sampled` places of a CGK walk. Walks are drawn for items of about one length, `per_walk` signatures each,
    until target_recall of trials with as many random edits as are allowed have one (64 walks at most). The edits of
    candidates are computed exactly, code point by code point.

    Items are the query set: blocks of block_chars characters are broadcast one after the other. Null and empty texts
    and items with under 12 letters, digits and blanks match nothing. Very long texts are searched in overlapping slices.
    A repeated row or item is matched again each time; of places with equally few edits the first counts. Without items there
    are no rows, nor from an empty table. Further columns are ignored; an id column named like a result column comes out as
    id_ with that name.
    """
    spark = docs.sparkSession
    prepare(spark)
    results = T.StructType.fromDDL(RESULT).fields
    docs = docs.select(F.col(id_col).alias(f"id_{id_col}" if id_col in [f.name for f in results] else id_col), F.col(text).alias("_text"))
    id_col, text = docs.columns
    schema = T.StructType([docs.schema.fields[0], *results])
    sized = benchmark.where(F.col("text").isNotNull()).select("item_id", "text", F.length("text").alias("n"))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    n_blocks = max(1, -(-total // block_chars))
    out = None
    for block in range(n_blocks):
        part = sized if n_blocks == 1 else sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        items = [(r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()]
        items.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        own = _find_block(docs, text, id_col, spark.sparkContext.broadcast(build(items, tolerance, target_recall, per_walk, sampled)), schema)
        out = own if out is None else out.unionByName(own)
    return out


def _find_block(docs: DataFrame, text: str, id_col: str, index, schema: T.StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx: Index = index.value
        if not idx.ids:
            return
        lap, size = 2 * idx.longest + 64, 1 << 21

        def flush(rows: list[tuple[int, int, np.ndarray]], found: dict) -> None:
            """rows: (row, offset in its text, codes)."""
            parts: list[np.ndarray] = []
            cuts = [0]
            for _, _, x in rows:
                parts += [x, np.array([0], np.uint32)]
                cuts.append(cuts[-1] + len(x) + 1)
            for r, i, edits, end in _search(np.concatenate(parts), np.array(cuts), idx):
                row, offset, _ = rows[r]
                best = (edits, offset + end)
                if (row, i) not in found or best < found[row, i]:
                    found[row, i] = best

        for batch in batches:
            found: dict[tuple[int, int], tuple[int, int]] = {}
            rows, n = [], 0
            for row, body in enumerate(batch.column(1)):
                x = normal(body.as_py())
                for at in range(0, max(1, len(x) - lap), size):
                    y = x[at : at + size + lap]
                    if len(y) < Q:
                        continue
                    rows.append((row, at, y))
                    n += len(y)
                    if n >= size:
                        flush(rows, found)
                        rows, n = [], 0
            if rows:
                flush(rows, found)
            keys = sorted(found)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array([r for r, _ in keys], pa.int64())), pa.array([idx.ids[i] for _, i in keys], pa.int64()), pa.array([found[k][0] for k in keys], pa.int32()),
                pa.array([len(idx.codes[i]) for _, i in keys], pa.int32()), pa.array([found[k][1] for k in keys], pa.int64()),
            ], names=schema.names)

    return docs.select(id_col, text).mapInArrow(run, schema)
