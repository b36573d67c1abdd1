"""N-gram Jaccard join by parity sketches.

Two sets A and B with Jaccard similarity of at least 3/4 differ in at most (|A| + |B|) / 7 elements. Elements are dealt
by hash to k parts and each part is the XOR of its elements' hashes. An element that only one set has changes one part,
so the number of parts that differ is at most the symmetric difference. Sets fall into size bands a factor of 4/3 wide;
for a set of band i and a partner of band i or i + 1 the difference is at most D(i), and k = D(i) + 1 parts leave at
least one part that agrees (pigeonhole). Sets are joined on parts that agree, pairs are filtered by the Hamming
distance of a second, one-bit-per-element sketch, which too bounds the difference from below, and the rest are
verified on the exact sets.

Small bands repeat the dealing until a set has about `parts` parts. Of large bands, `parts` of the k parts are joined:
each agrees with probability over exp(-1) at the very threshold, so that all miss a pair with probability under
(1 - 1/e) ** parts there (1.6e-5 for 24) and far under for closer pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_WORDS, Stages, batch_words, mix, sized
from .components import components

SKETCH_SCHEMA = "key binary, n long, sketch binary, short binary, sigs array<long>"
#: Bytes at most of a short sketch, which is a sketch folded: rows of groups carry it, whatever the size of the set.
SHORT = 256
#: Groups of a row that its rows carry.
HEAD = 8


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than width make one shingle, none make none."""
    if len(words) == 0:
        return words
    w = min(width, len(words))
    h = np.full(len(words) - w + 1, np.uint64(w))
    for i in range(w):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - w + 1 + i])
    return np.unique(h)


def bands(limit: int = 1 << 40) -> np.ndarray:
    """Smallest sizes of the bands: a partner within 4/3 of a set is in its band or a neighbouring one."""
    lo = [1]
    while lo[-1] < limit:
        lo.append(lo[-1] * 4 // 3 + 1)
    return np.array(lo, np.int64)


_BANDS = bands()


def set_key(items: np.ndarray) -> bytes:
    """128 bits of the set's content."""
    a = np.bitwise_xor.reduce(mix(items)) ^ np.uint64(len(items))
    b = np.add.reduce(mix(items ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return np.array([a, b], np.uint64).tobytes()


def sketch_bits(n: int) -> int:
    """Length of the filter sketch of sets of the band of n: a power of two from twice the band's size on, 512 at least."""
    lo = int(_BANDS[np.searchsorted(_BANDS, n, "right") - 1])
    return max(512, 1 << (2 * lo - 1).bit_length())


def filter_sketch(items: np.ndarray, bits: int) -> np.ndarray:
    """One bit per element, by parity."""
    count = np.bincount((mix(items ^ np.uint64(0x5BD1E995)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8))


def part_signatures(items: np.ndarray, parts: int = 24) -> np.ndarray:
    """Signatures of the set's non-empty parts, for its own band and as a partner of the band below."""
    own, out = int(np.searchsorted(_BANDS, len(items), "right") - 1), []
    for band in (own, own - 1):
        if band < 0:
            continue
        most = int(_BANDS[band + 1] - 1) // 3
        if most == 0:
            continue  # such sets link only when they are equal, and equal sets are one class
        k = most + 1
        for turn in range(max(1, -(-parts // k))):
            seed = np.uint64(mix(np.array([band * 1000 + turn], np.uint64))[0])
            h = mix(items ^ seed)
            part = ((h >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            use = part < np.uint64(parts)
            part, h = part[use].astype(np.int64), h[use]
            xor = np.zeros(min(k, parts), np.uint64)
            np.bitwise_xor.at(xor, part, mix(h))
            full = np.bincount(part, minlength=len(xor)) > 0
            out.append(mix(xor[full] ^ (seed + np.flatnonzero(full).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def sketches(docs: DataFrame, width: int = 5, parts: int = 24) -> DataFrame:
    """(rep, text) -> (rep, key, n, sketch, short, sigs), one row per row; key and sketches are null for texts without words."""
    schema = T.StructType([docs.schema["rep"], *T.StructType.fromDDL(SKETCH_SCHEMA).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, bits, short, sigs = [], [], [], [], []
            for words in batch_words(batch.column(1), SPACE_WORDS):
                items = shingle_set(words, width)
                sizes.append(len(items))
                keys.append(set_key(items) if len(items) else None)
                sketch = filter_sketch(items, sketch_bits(len(items))) if len(items) else None
                bits.append(None if sketch is None else sketch.tobytes())
                short.append(None if sketch is None else _fold(sketch[None], min(len(sketch), SHORT)).tobytes())
                sigs.append(part_signatures(items, parts))
            off = np.concatenate([[0], np.cumsum([len(x) for x in sigs])]).astype(np.int32)
            flat = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(short, pa.binary()), pa.ListArray.from_arrays(pa.array(off), flat)], names=schema.names)

    return docs.select("rep", "text").mapInArrow(run, schema)


def class_keys(docs: DataFrame, text: str = "text", width: int = 5) -> DataFrame:
    """Adds class_key, as link() gives it, to every row: equal for texts of equal shingles, null without words. A column of that name is replaced."""
    docs = docs.drop("class_key")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingle_set(words, width) for words in batch_words(batch.column(at), SPACE_WORDS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([set_key(x) if len(x) else None for x in sets], pa.binary())], names=[*batch.schema.names, "class_key"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("class_key", T.BinaryType())]))


def _fold(x: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows x words) of more bits as ones of fewer words: bits are dealt by the low bits of a hash, so halves XOR."""
    return np.bitwise_xor.reduce(x.reshape(len(x), -1, words), axis=1)


def _close(x: bytes, y: bytes, nx: int, ny: int) -> bool:
    """Whether two sketches may belong to sets of similarity 3/4: Hamming distance <= (nx + ny) / 7."""
    if 100 * min(nx, ny) < 75 * max(nx, ny):
        return False
    p, q, bits = int.from_bytes(x, "big"), int.from_bytes(y, "big"), 8 * min(len(x), len(y))
    while p.bit_length() > bits or q.bit_length() > bits:
        p, q = (v >> bits ^ v & (1 << bits) - 1 if v.bit_length() > bits else v for v in (p, q))
    return 7 * (p ^ q).bit_count() <= nx + ny


def _hamming_filter(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches may belong to sets of similarity 3/4."""
    slim = known.select("rep", "n", "sketch")
    rows = pairs.join(slim.toDF("a", "na", "sa"), "a").join(slim.toDF("b", "nb", "sb"), "b")
    rows = rows.where("100 * least(na, nb) >= 75 * greatest(na, nb)").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, sa, sb = (batch.column(i).to_pylist() for i in range(2, 6))
            yield batch.select(["a", "b"]).filter(pa.array(map(_close, sa, sb, na, nb), pa.bool_()))

    return rows.mapInArrow(run, pairs.select("a", "b").schema)


def _block_pairs(n: np.ndarray, comp: np.ndarray, side: np.ndarray, sketch: list[np.ndarray], cells: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of a block pair, of different components and different sides (any, if there is one side), whose sketches pass."""
    width = np.array([len(x) for x in sketch])
    out_i, out_j = [], []
    one = len(np.unique(side)) == 1
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        block = np.stack([sketch[i] for i in mine])
        for v in np.unique(width[width >= w]):
            rest = np.flatnonzero(width == v)
            other = block if v == w else _fold(np.stack([sketch[j] for j in rest]), int(w))
            step = max(1, cells // (len(rest) * int(w)))
            for at in range(0, len(mine), step):
                own = mine[at : at + step]
                fits = (100 * np.minimum.outer(n[own], n[rest]) >= 75 * np.maximum.outer(n[own], n[rest])) & (comp[own][:, None] != comp[rest])
                fits &= (own[:, None] < rest) | (v != w)
                if not one:
                    fits &= side[own][:, None] != side[rest]
                if fits.any():
                    away = np.bitwise_count(block[at : at + step, None] ^ other[None]).sum(2, dtype=np.int64)
                    i, j = np.nonzero(fits & (7 * away <= np.add.outer(n[own], n[rest])))
                    out_i.append(own[i])
                    out_j.append(rest[j])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_i, out_j))


def _pairs_in_groups(rows: DataFrame, block: int = 512) -> DataFrame:
    """(sig, rep, comp, size, n, short, head) -> pairs (a, b) of one group and different components that pass the short sketch.

    A group of `size` rows is dealt by a hash of the row to blocks of about `block` rows, and each pair of its blocks is
    a unit of work of its own: units of one hot group go to many tasks, none holds more than two blocks, and nothing but
    pairs that pass is written. head holds a row's first groups; a pair is left to the first group that both heads have,
    so that few are written more than once.
    """
    blocks = F.ceil(F.col("size") / F.lit(block))
    dealt = rows.withColumn("side", F.pmod(F.xxhash64("rep"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    unit = dealt.select("sig", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", F.xxhash64("comp").alias("comp"), "n", "rep", "short", "head")
    ordered = unit.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi")
    kind = rows.schema["rep"].dataType
    none = np.iinfo(np.int64).max

    def pairs_of(numbers: list[np.ndarray], reps: list[list], shorts: list[list], heads: list[np.ndarray]) -> tuple[list, list]:
        """Of one unit, given in pieces of batches."""
        sig, _, _, side, comp, n = np.concatenate(numbers, axis=1)
        rep, short, head = [x for y in reps for x in y], [np.frombuffer(x, np.uint64) for y in shorts for x in y], np.concatenate(heads)
        i, j = _block_pairs(n, comp, side, short)
        x, y = head[i], head[j]
        before = ((x[:, :, None] == y[:, None, :]) & (x < sig[0])[:, :, None]).any((1, 2))
        both = [(min(rep[p], rep[q]), max(rep[p], rep[q])) for p, q in zip(i[~before], j[~before], strict=True)]
        return [p for p, _ in both], [q for _, q in both]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            numbers = np.stack([batch.column(k).to_numpy() for k in range(6)])
            reps, shorts = batch.column(6).to_pylist(), batch.column(7).to_pylist()
            at = batch.column(8).offsets.to_numpy()
            heads = np.full((batch.num_rows, HEAD), none)
            size = np.diff(at)
            heads[np.arange(HEAD) < size[:, None]] = batch.column(8).values.to_numpy()[at[0] : at[-1]]
            cuts = [0, *(np.flatnonzero((np.diff(numbers[:3], axis=1) != 0).any(0)) + 1).tolist(), batch.num_rows]
            a, b = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and (held[0][0][:3, 0] != numbers[:3, lo]).any():
                    if len(held) > 1 or len(held[0][1]) > 1:
                        p, q = pairs_of(*zip(*held, strict=True))
                        a, b = a + p, b + q
                    held = []
                held.append((numbers[:, lo:hi], reps[lo:hi], shorts[lo:hi], heads[lo:hi]))
            yield pa.RecordBatch.from_arrays([pa.array(a, batch.schema.field(6).type), pa.array(b, batch.schema.field(6).type)], names=["a", "b"])
        if held:
            p, q = pairs_of(*zip(*held, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(p, batch.schema.field(6).type), pa.array(q, batch.schema.field(6).type)], names=["a", "b"])

    return ordered.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rep, items): the sorted shingle hashes of the texts of the wanted reps."""
    schema = T.StructType([docs.schema["rep"], T.StructField("items", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(w, width) for w in batch_words(batch.column(1), SPACE_WORDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "items"])

    return docs.join(sized(wanted), "rep", "left_semi").select("rep", "text").mapInArrow(run, schema)


def _linked(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Of pairs (a, b) those that link exactly."""
    rows = pairs.join(sets.toDF("a", "ia"), "a").join(sets.toDF("b", "ib"), "b").select("a", "b", "ia", "ib")
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = int((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum()) if len(p) else 0
                keep.append(den * common >= num * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, pairs.select("a", "b").schema).distinct()


def _rare_prefixes(sets: DataFrame, bits: int = 14) -> DataFrame:
    """(rep, items) -> (sig, rep): of each set the rarest quarter of its shingles and one more.

    With one order for all, two sets of similarity 3/4 have one of these in common, whatever the order. It is by
    frequency among these sets, counted over all of them in 2 ** bits hashed cells: so many numbers a task at most. A
    shingle that a small part of the sets share stands out of its cell, whose other shingles are many and even.
    """

    def cells(items: np.ndarray) -> np.ndarray:
        return (mix(items) >> np.uint64(64 - bits)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(cells(np.frombuffer(x.as_buffer(), np.uint64)), minlength=1 << bits)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["cell", "n"])

    grams = sets.select("items").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << bits, np.int64)
    table[grams["cell"].to_numpy()] = grams["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sigs = [], []
            for i, x in enumerate(batch.column(1)):
                items = np.frombuffer(x.as_buffer(), np.uint64)
                take = len(items) - -(-3 * len(items) // 4) + 1
                best = items[np.lexsort((items, shared.value[cells(items)]))[:take]] if len(items) else items
                rows.append(np.full(len(best), i))
                sigs.append(best.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), batch.column(0).take(pa.array(np.concatenate(rows)))], names=["sig", "rep"])

    return sets.mapInArrow(run, T.StructType([T.StructField("sig", T.LongType()), sets.schema["rep"]]))


def _open_groups(groups: DataFrame, comps: DataFrame | None, turn: int, stages: Stages) -> DataFrame:
    """(sig, rep) -> (sig, rep, comp, size, lead, lead_comp) of groups with more than one component; lead is one row of them, drawn anew each turn."""
    named = groups.withColumn("comp", F.col("rep")) if comps is None else groups.join(sized(comps), groups["rep"] == comps["node"], "left").select("sig", "rep", F.coalesce("comp", "rep").alias("comp"))
    draw = F.xxhash64("rep", F.lit(turn))
    summed = named.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"), F.min_by("rep", draw).alias("lead"), F.min_by("comp", draw).alias("lead_comp"))
    leads = stages.keep(summed.where("lo != hi").select("sig", "size", "lead", "lead_comp"))
    out = stages.keep(named.join(sized(leads), "sig"))
    stages.drop(leads)
    return out


def link(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 5, parts: int = 24) -> DataFrame:
    """Rows (id, n_shingles, component_id, class_key): connected components of links with similarity >= 0.75.

    Equal sets are one class, found by grouping on the set's 128-bit key; links are sought between classes only, in the
    groups of a common signature. First every class meets one drawn class of each of its groups (a star, so that a group
    of any size costs its own length). Groups whose classes are now of one component are done. All classes of the others,
    such as those of a passage that very many texts share, meet in the groups of their rarest shingles, which is exact by
    the prefix principle: again a star, and then all pairs of different components of the groups that are still open,
    block by block. A group of two is done with its star. No group is capped or sampled, and each step is the same at every size. `parts` of a large band's
    parts are joined; with parts >= all of them (a third of the largest set) the join is exact by the pigeonhole alone.

    Null and empty texts have no shingles, link with nothing and are components of their own. Ties don't matter:
    component_id is the smallest id. Repeated rows fall into one class, and rows of one id are one document, so that its
    texts' links join; rows with a null id link only with equal sets. Texts count whole, however long.
    An empty table gives no rows; further columns are ignored, and an id column may have any name but those of the results.
    """
    threshold = (75, 100)
    slim = docs.select(F.col(id_col).alias("rep"), F.col(text).alias("text"))
    with Stages(docs.sparkSession) as stages:
        base = stages.keep(sketches(slim, width, parts).withColumn("row", F.monotonically_increasing_id()))
        rows = stages.keep(base.select("rep", "key", "n"))
        # of equal sets, the row of the smallest id (null only where all are) stands for all
        first = F.min(F.struct(F.col("rep").isNull().alias("unnamed"), "rep", "row")).alias("first")
        classes = stages.keep(base.where("key is not null").groupBy("key").agg(first).select("key", "first.rep", "first.row"))
        known = stages.keep(base.join(sized(classes.where("rep is not null").select("row")), "row", "left_semi").select("rep", "n", "sketch", "short", "sigs"))
        stages.drop(base)
        if not rows.where("rep is not null and n > 0").groupBy("rep").agg(F.count(F.lit(1)).alias("times")).where("times > 1").isEmpty():
            slim = slim.dropDuplicates(["rep", "text"])  # a row that is repeated makes one set

        def confirmed(pairs: DataFrame, sets: DataFrame | None) -> DataFrame:
            near = stages.keep(_hamming_filter(pairs, known))
            own = sets
            if own is None:
                wanted = stages.keep(near.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
                own = stages.keep(_sets_of(slim, wanted, width))
                stages.drop(wanted)
            out = stages.keep(_linked(near, own, threshold))
            stages.drop(near, *([own] if sets is None else []))
            return out

        def starred(groups: DataFrame) -> DataFrame:
            return groups.where("comp != lead_comp").select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()

        flat = known.select(F.explode("sigs").alias("sig"), "rep")
        multi = stages.keep(flat.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("sig"))
        groups = _open_groups(flat.join(sized(multi), "sig", "left_semi"), None, 0, stages)
        stages.drop(multi)
        links = [confirmed(starred(groups), None)]
        comps = components(links[0], stages)
        now = _open_groups(groups.select("sig", "rep"), comps, 1, stages)
        crowd = stages.keep(now.where("size > 2").select("rep").distinct())  # of two, the star has tried the only pair
        stages.drop(groups, now)
        sets = stages.keep(_sets_of(slim, crowd, width))
        rare = _open_groups(_rare_prefixes(sets), comps, 2, stages)
        links.append(confirmed(starred(rare), sets))
        stages.drop(comps)
        comps = components(links[0].unionByName(links[1]), stages)
        still = _open_groups(rare.select("sig", "rep"), comps, 3, stages)
        stages.drop(rare)
        still = still.where("size > 2").select("sig", "rep", "comp", "size")
        heads = still.groupBy("rep").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, HEAD).alias("head"))
        pairs = stages.keep(_pairs_in_groups(still.join(known.select("rep", "n", "short").join(heads, "rep"), "rep")).distinct())
        links.append(confirmed(pairs, sets))
        if not links[2].isEmpty():
            stages.drop(comps)
            comps = components(links[0].unionByName(links[1]).unionByName(links[2]), stages)
        least = classes.join(sized(comps), classes["rep"] == comps["node"], "left").select("key", F.coalesce("comp", "rep").alias("component_id"))
        out = rows.join(least, "key", "left")
        return stages.result(out.select(F.col("rep").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep").alias("component_id"), F.col("key").alias("class_key")))


LINK_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
f AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 75 * (len(x.s) + len(y.s) - c)),
u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS root FROM s UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.id WHERE r.root < u.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(root) AS component_id FROM s JOIN r ON r.id = s.doc_id GROUP BY s.doc_id, s.s
"""
