"""Media columns: local image descriptors find cropped or edited copies.

Corners at several scales get binary descriptors turned to their own orientation. Descriptors meet in tables of bit
sampled Hamming blocks, two neighbours at a time with their bearings, and pairs of images with enough matches that agree
on one rotation, scale and shift are copies.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stages, mix, sized
from .components import components

BITS = 128
GOLDEN = (5**0.5 - 1) / 2
BLOCK = 256  # rows of a table of distances made at once
PATCH = 8  # half the side of the square that a descriptor compares within


# ---------------------------------------------------------------- decoding


def _png(data: bytes) -> np.ndarray | None:
    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[6]:
        return None
    w, h, k = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * k)
    out = np.zeros((h, w * k), np.int64)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        up = out[y - 1] if y else np.zeros(w * k, np.int64)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        else:
            for x in range(w * k):
                a, b, c = (out[y, x - k] if x >= k else 0), up[x], (up[x - k] if x >= k else 0)
                if kind == 1:
                    p = a
                elif kind == 3:
                    p = (a + b) // 2
                else:
                    q = a + b - c
                    p = min((abs(q - a), 0, a), (abs(q - b), 1, b), (abs(q - c), 2, c))[2]
                out[y, x] = (line[x] + p) & 255
    pixels = out.reshape(h, w, k)
    return pixels[..., : 3 if k >= 3 else 1].mean(2)


def _pnm(data: bytes) -> np.ndarray | None:
    m = re.match(rb"(P[56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data)
    if not m or int(m[4]) > 255:
        return None
    w, h, k = int(m[2]), int(m[3]), 1 if m[1] == b"P5" else 3
    if len(data) - m.end() < w * h * k:
        return None
    return np.frombuffer(data, np.uint8, w * h * k, m.end()).reshape(h, w, k).mean(2)


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey pixels of a PNG (8 bits, not interlaced), PGM or PPM; None for anything else."""
    try:
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        return _pnm(data) if data else None
    except (ValueError, zlib.error, struct.error):
        return None


# ---------------------------------------------------------------- keypoints


def _blur(x: np.ndarray, times: int = 2) -> np.ndarray:
    for _ in range(times):
        x = np.pad(x, 1, mode="edge")
        x = (x[:-2] + 2 * x[1:-1] + x[2:]) / 4
        x = (x[:, :-2] + 2 * x[:, 1:-1] + x[:, 2:]) / 4
    return x


def _shrink(x: np.ndarray, factor: float) -> np.ndarray:
    h, w = int(x.shape[0] / factor), int(x.shape[1] / factor)
    ys, xs = np.minimum((np.arange(h) + 0.5) * factor - 0.5, x.shape[0] - 1), np.minimum((np.arange(w) + 0.5) * factor - 0.5, x.shape[1] - 1)
    return _sample(x, ys[:, None] + 0 * xs, xs + 0 * ys[:, None])


def _sample(x: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    y0, x0 = np.clip(np.floor(ys).astype(int), 0, x.shape[0] - 2), np.clip(np.floor(xs).astype(int), 0, x.shape[1] - 2)
    fy, fx = ys - y0, xs - x0
    return (x[y0, x0] * (1 - fx) + x[y0, x0 + 1] * fx) * (1 - fy) + (x[y0 + 1, x0] * (1 - fx) + x[y0 + 1, x0 + 1] * fx) * fy


@functools.cache
def _tests() -> np.ndarray:
    """Pairs of points within the patch, the same on every worker."""
    rng = np.random.RandomState(5)
    return np.clip(rng.normal(0, PATCH / 2.2, (BITS, 2, 2)), -PATCH + 1, PATCH - 1)


def keypoints(grey: np.ndarray, scales: tuple[float, ...] = (1, 1.5, 2.25), quality: float = 0.02) -> list[tuple[float, float, float, float, bytes]]:
    """(x, y, scale, angle, descriptor) of all corners of each scale whose strength passes the quality, in pixels of the image."""
    out = []
    for scale in scales:
        img = _blur(grey.astype(float) if scale == 1 else _shrink(_blur(grey.astype(float)), scale))
        if min(img.shape) < 2 * PATCH + 3:
            break
        gy, gx = np.gradient(img)
        a, b, c = _blur(gx * gx), _blur(gy * gy), _blur(gx * gy)
        strength = a * b - c * c - 0.04 * (a + b) ** 2
        p = np.pad(strength, 1, constant_values=-np.inf)
        h, w = strength.shape
        around = np.max([p[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)], axis=0)
        edge = PATCH // 2
        top = (strength == around) & (strength > max(1e-6, quality * strength.max()))
        top[:edge] = top[-edge:] = top[:, :edge] = top[:, -edge:] = False
        ys, xs = np.nonzero(top)
        ys, xs = ys[:, None, None], xs[:, None, None]
        dy, dx = np.mgrid[-4:5, -4:5]
        window = _sample(img, np.clip(ys + dy, 0, h - 1).astype(float), np.clip(xs + dx, 0, w - 1).astype(float))
        angle = np.arctan2((window * dy).sum((1, 2)), (window * dx).sum((1, 2)))[:, None, None]
        px, py = _tests()[..., 0], _tests()[..., 1]
        u, v = np.cos(angle) * px - np.sin(angle) * py, np.sin(angle) * px + np.cos(angle) * py
        values = _sample(img, np.clip(ys + v, 0, h - 1), np.clip(xs + u, 0, w - 1))
        bits = np.packbits(values[..., 0] < values[..., 1], axis=1)
        out += [((x + 0.5) * scale, (y + 0.5) * scale, scale, t, d.tobytes()) for y, x, t, d in zip(ys.ravel(), xs.ravel(), angle.ravel(), bits, strict=True)]
    return out


#: A keypoint in a column of packed points.
POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("angle", "<f4"), ("bits", "u1", BITS // 8)])


def pack(points: list[tuple[float, float, float, float, bytes]]) -> bytes:
    """Keypoints as the bytes of a POINT array."""
    out = np.zeros(len(points), POINT)
    for k, (x, y, scale, angle, bits) in enumerate(points):
        out[k] = x, y, scale, angle, np.frombuffer(bits, np.uint8)
    return out.tobytes()


def describe(images: DataFrame, image: str = "image", id_col: str = "image_id", **options) -> DataFrame:
    """(id, image) -> (id, key, points): a digest of the pixels and the packed keypoints; both null for undecodable images."""
    schema = T.StructType([*images.select(id_col).schema.fields]).add("key", "binary").add("points", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            keys, points = [], []
            for data in batch.column(1):
                grey = decode(data.as_py())
                keys.append(None if grey is None else hashlib.sha256(repr(grey.shape).encode() + grey.tobytes()).digest()[:16])
                points.append(None if grey is None else pack(keypoints(grey, **options)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(points, pa.binary())], names=schema.names)

    return images.select(id_col, image).mapInArrow(run, schema)


@functools.cache
def _tables(n: int, width: int) -> np.ndarray:
    rng = np.random.RandomState(9)
    return np.array([rng.choice(BITS, width, replace=False) for _ in range(n)])


def entries(points: np.ndarray, tables: int, width: int, near: int, sectors: int) -> np.ndarray:
    """Table entries of an image: the sampled bits of a keypoint and of one of its `near` nearest neighbours of the same scale,
    and for each of the two the sector, by its own orientation, in which the other lies.

    One descriptor alone is no good entry: the gradients around blobs look alike in unrelated images. Two side by side
    that lie alike rarely do, and copies and crops keep neighbours together. Sectors begin elsewhere in each table, so
    that a bearing at the border of one is within another.
    """
    if len(points) < 2:
        return np.zeros(0, np.int64)
    bits = np.unpackbits(points["bits"], axis=1).astype(np.uint64)
    code = (bits[:, _tables(tables, width)] << np.arange(width, dtype=np.uint64)).sum(2, dtype=np.uint64)
    pairs = []
    for at in range(0, len(points), BLOCK):
        own = points[at : at + BLOCK]
        away = (own["x"][:, None] - points["x"]) ** 2 + (own["y"][:, None] - points["y"]) ** 2
        away = np.where((own["scale"][:, None] == points["scale"]) & (away >= 4), away, np.inf)
        j = np.argsort(away, axis=1, kind="stable")[:, :near].ravel()
        i = np.repeat(np.arange(len(own)), min(near, len(points)))
        fine = np.isfinite(away[i, j])
        pairs.append((at + i[fine], j[fine]))
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    shift = (np.arange(tables) * GOLDEN) % 1

    def sector(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        bearing = np.arctan2(points["y"][b] - points["y"][a], points["x"][b] - points["x"][a]) - points["angle"][a]
        return (np.floor(bearing[:, None] / (2 * np.pi) % 1 * sectors + shift) % sectors).astype(np.uint64)

    low, high = np.minimum(code[i], code[j]), np.maximum(code[i], code[j])
    of_i, of_j = sector(i, j), sector(j, i)
    # by the order of the codes; of equal codes by the sectors' own
    turned = np.where(code[i] == code[j], of_i > of_j, code[i] > code[j])
    lie = np.where(turned, of_j, of_i) * np.uint64(sectors) + np.where(turned, of_i, of_j)
    return np.unique(mix(mix(mix(mix(low) ^ high) + lie) + np.arange(tables, dtype=np.uint64))).view(np.int64)


def _nearest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each descriptor of a the first nearest of b, and the bits in which they differ."""
    words_a, words_b = (np.ascontiguousarray(x).view(np.uint64) for x in (a["bits"], b["bits"]))
    j, d = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for at in range(0, len(a), BLOCK):
        away = sum(np.bitwise_count(words_a[at : at + BLOCK, None, k] ^ words_b[None, :, k]).astype(np.int64) for k in range(BITS // 64))
        j[at : at + BLOCK] = away.argmin(1)
        d[at : at + BLOCK] = away.min(1)
    return j, d


def consensus(a: np.ndarray, b: np.ndarray, max_bits: int = 20, tolerance: float = 3.0, enough: int | None = None) -> int:
    """Matches of two images' keypoints that agree on one rotation, scale and shift: the best of the hypotheses of all pairs of matches.

    Places may be off by the tolerance in pixels or a hundredth of the matches' extent, times the scale. Many random
    matches agree on something by chance: fewer matches than chance gives one hypothesis in a thousand pictures count as
    0. With enough, hypotheses end once one has so many matches, and more than by chance.
    """
    if not len(a) or not len(b):
        return 0
    i = np.arange(len(a))
    j, d = _nearest(a, b)
    good = (d <= max_bits) & (_nearest(b, a)[0][j] == i)
    i, j = i[good], j[good]
    if len(i) < 2:
        return len(i)
    at, to = (p["x"].astype(float) + 1j * p["y"] for p in (a[i], b[j]))
    level = np.log(b["scale"][j].astype(float) / a["scale"][i])
    extent = np.maximum([np.ptp(to.real), np.ptp(to.imag)], 1)
    slack = max(tolerance, 0.01 * extent.max())
    # Poisson: the least number of matches beside the two of a hypothesis that all of them reach by chance with 0.001 at most
    n = len(i)
    mean = n * min(1.0, np.pi * slack**2 / extent.prod())
    needed, term = 2, n * n / 2 * np.exp(-mean)
    while needed <= n and (term > 1e-3 or needed - 2 < mean):
        needed += 1
        term *= mean / (needed - 2)
    # places that coincide count once
    _, place = np.unique(np.stack([to.real // 2, to.imag // 2], 1).astype(int), axis=0, return_inverse=True)
    place = place.ravel()
    best, step = 1, max(1, 4096 // n)
    for start in range(0, n, step):
        x, y = np.nonzero(np.arange(n) > np.arange(start, min(start + step, n))[:, None])
        x += start
        # close pairs leave rotation and scale open
        x, y = (v[(np.abs(at[y] - at[x]) >= PATCH / 2) & (np.abs(to[y] - to[x]) >= PATCH / 2)] for v in (x, y))
        turn = (to[y] - to[x]) / (at[y] - at[x])
        size = np.abs(turn)
        moved = (at - at[x, None]) * turn[:, None] + to[x, None]
        fits = (np.abs(moved - to) <= slack * np.maximum(1, size)[:, None]) & (np.abs(level - np.log(size)[:, None]) < 0.45)
        counts = fits.sum(1)
        for k in np.argsort(-counts, kind="stable"):
            if counts[k] <= best:
                break
            best = max(best, len(np.unique(place[fits[k]])))
        if enough is not None and best >= max(enough, needed):
            break
    return best if best >= needed else 0


def copies(images: DataFrame, image: str = "image", id_col: str = "image_id", tables: int = 8, width: int = 44, near: int = 3, sectors: int = 12, least: int = 6, stars: int = 3, scouts: int = 4, **options) -> DataFrame:
    """(id, image) -> (id, n_points, copy_id): groups of images that are copies, crops or edits of each other.

    Images of equal pixels are one class; its smallest id stands for it. Classes are candidates if they have a table
    entry in common; candidates with `least` matches of one geometry link. First, every class meets one other class only,
    which many share: a group of copies, whose classes meet in most of their entries, is then nearly one group at the
    cost of its length. `scouts` tables give these pairs, which end no entry. Then, in the entries of all tables that
    several groups still share and up to `stars` times, every class meets one class of each of its entries, which is then
    done and leaves the entry: an entry of any size costs its own length.
    Entries whose classes are all of one group are done; in the others, all pairs of classes of different groups that are
    left are candidates. copy_id is the smallest id reachable.

    Null, broken and unsupported images have no points, link with nothing and are groups of their own. Repeated rows
    are one class, rows of one id are one image whose contents' links join, and rows with a null id link only with equal
    pixels. Ties don't matter; further columns are ignored; an empty table gives no rows.
    """
    with Stages(images.sparkSession) as stages:
        rows = stages.keep(describe(images, image, id_col, **options).withColumnRenamed(id_col, "id"))
        classes = stages.keep(rows.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.first("points").alias("points")))
        known = classes.where("rep is not null").select("rep", "points")
        links = tried = comps = None

        def grouped(df: DataFrame) -> DataFrame:
            if comps is None:
                return df.withColumn("comp", F.col("rep"))
            return df.join(comps, df["rep"] == comps["node"], "left").select(*(df[c] for c in df.columns), F.coalesce("comp", "rep").alias("comp"))

        def entered(n: int) -> DataFrame:
            """(rep, comp, entry): all entries of the first n tables."""
            placed = grouped(known).select("rep", "comp", "points")
            schema = T.StructType([placed.schema["rep"], placed.schema["comp"], T.StructField("entry", T.LongType())])

            def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    own = [entries(np.frombuffer(x.as_buffer(), POINT), n, width, near, sectors) for x in batch.column(2)]
                    at = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate([np.zeros(0, np.int64), *own]))], names=schema.names)

            return placed.mapInArrow(enter, schema)

        def confirm(both: DataFrame) -> None:
            nonlocal links, tried, comps
            pairs = both.distinct()
            pairs = stages.keep(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
            tried = pairs if tried is None else tried.unionByName(pairs)
            new = stages.keep(_confirmed(pairs, known, least))
            links = new if links is None else links.unionByName(new)
            if not new.isEmpty():
                if comps is not None:
                    stages.drop(comps)
                comps = components(links, stages)

        # scouts: every entry has one lead, and every class meets one of the leads of its entries
        some = entered(min(scouts, tables)).select("entry", "rep")
        leads = some.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.min_by("rep", F.xxhash64("rep", F.lit(-1))).alias("lead"))
        leads = stages.keep(leads.where("n > 1").select("entry", "lead"))
        first = F.min_by("lead", F.xxhash64("lead", F.lit(-1))).alias("first")
        met = some.join(sized(leads), "entry").where("rep != lead").groupBy("rep").agg(first)
        confirm(met.select(F.least("rep", "first").alias("a"), F.greatest("rep", "first").alias("b")))
        stages.drop(leads)
        # of all tables, only entries that classes of several groups share are made; they are sought in so many parts
        # that none is larger than the scouts' tables
        every = entered(tables)
        parts, spread = -(-tables // max(1, scouts)), []
        for part in range(parts):
            seen = every.where(F.pmod("entry", F.lit(parts)) == part).groupBy("entry").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            spread.append(stages.keep(seen.where("lo != hi").select("entry")))
        held = stages.keep(every.join(sized(functools.reduce(DataFrame.unionByName, spread)), "entry").select("entry", "rep", "comp"))
        stages.drop(*spread)
        named = held
        for turn in range(stars + 1):
            drawn = F.min_by(F.struct("rep", "comp"), F.xxhash64("rep", F.lit(turn))).alias("lead")
            summed = named.groupBy("entry").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), drawn).where("lo != hi").select("entry", "lead")
            now = stages.keep(named.join(summed, "entry"))
            stages.drop(held)
            if turn < stars:
                confirm(now.where("comp != lead.comp").select(F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b")))
                held, named = now, grouped(now.where("rep != lead.rep").select("entry", "rep"))
            else:
                x, y = now.select("entry", F.col("rep").alias("a"), F.col("comp").alias("ca")), now.select("entry", F.col("rep").alias("b"), F.col("comp").alias("cb"))
                confirm(x.join(y, "entry").where("a < b and ca != cb").select("a", "b"))
        named = classes.select("key", "rep")
        if comps is not None:
            named = named.join(comps, named["rep"] == comps["node"], "left").select("key", F.coalesce("comp", "rep").alias("copy_id"))
        else:
            named = named.select("key", F.col("rep").alias("copy_id"))
        n_points = F.coalesce(F.floor(F.length("points") / POINT.itemsize), F.lit(0)).cast("long").alias("n_points")
        return stages.result(rows.select("id", "key", n_points).join(named, "key", "left").select(F.col("id").alias(id_col), "n_points", F.coalesce("copy_id", "id").alias("copy_id")))


def _confirmed(pairs: DataFrame, points: DataFrame, least: int) -> DataFrame:
    full = pairs.join(points.toDF("a", "pa"), "a").join(points.toDF("b", "pb"), "b").select("a", "b", "pa", "pb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [consensus(*(np.frombuffer(p.as_buffer(), POINT) for p in both), enough=least) >= least for both in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return full.mapInArrow(run, pairs.schema).distinct()


def render_vectors(vectors: DataFrame, vec: str = "embedding", side: int = 48) -> DataFrame:
    """Adds column image: a vector as a grey PGM picture, its numbers being the cells of a smoothed square grid."""
    schema = T.StructType([*vectors.schema.fields]).add("image", "binary")
    at = vectors.columns.index(vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for v in batch.column(at).to_pylist():
                if not v or any(x is None for x in v):
                    made.append(None)
                    continue
                n = int(np.ceil(np.sqrt(len(v))))
                cells = np.zeros(n * n)
                cells[: len(v)] = v
                cells = (cells - cells.min()) / (np.ptp(cells) + 1e-12) * 255
                at_ = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
                pixels = _sample(cells.reshape(n, n), at_[:, None] + 0 * at_, at_ + 0 * at_[:, None]) if n > 1 else np.full((side, side), cells[0])
                made.append(b"P5 %d %d 255\n" % (side, side) + np.round(pixels).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=schema.names)

    return vectors.mapInArrow(run, schema)
