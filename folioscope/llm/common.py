"""Shared plumbing: shared-folder checkpoints, package shipping and vectorised text kernels."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHIPPED: set[str] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only on a local master that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="folioscope-checkpoint-"))
    return sc.getCheckpointDir()


def prepare(spark: SparkSession) -> None:
    """Makes a session ready for the operators: checkpoint folder, Arrow batches of few rows and few bytes, package on the workers."""
    sc = spark.sparkContext
    checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths and os.getcwd() != root and sc.applicationId not in _SHIPPED:
        archive = os.path.join(tempfile.mkdtemp(prefix="folioscope-code-"), "folioscope_src.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in os.walk(os.path.join(root, "folioscope")):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.relpath(path, root))
        sc.addPyFile(archive)
        _SHIPPED.add(sc.applicationId)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stages:
    """Tables written once to the shared checkpoint folder, as Parquet, and deleted when the work is done.

    A staged table cuts lineage and outlives executors. The shuffle files of the plan that wrote it go at once, those
    of dropped tables with drop(), and all but results when the block ends, however it ends. A result stays in the
    checkpoint folder for the reader, as a checkpoint would.
    """

    def __init__(self, spark: SparkSession) -> None:
        prepare(spark)
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/stages-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.held: list[DataFrame] = []

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*self.held)

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        # by place, since names may clash in ways that files don't take
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.toDF(*[f"c{i}" for i in range(len(df.columns))]).write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before) if before else self.spark.conf.unset(CLEANUP)
        kinds = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields)])
        return self.spark.read.schema(kinds).parquet(path).toDF(*df.columns)

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes df now and reads it from there until it is dropped or the block ends."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        out = self._write(df, path)
        self.paths[id(out)] = path
        self.held.append(out)
        return out

    def result(self, df: DataFrame) -> DataFrame:
        """Writes df now and leaves it when the block ends."""
        return self._write(df, f"{self.root}-result-{uuid.uuid4().hex}")

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables of keep() that nothing reads any more."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = self.paths.pop(id(df), None)
            if path:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)
        self.held = [x for x in self.held if id(x) in self.paths]
        if not self.paths:
            at = jvm.org.apache.hadoop.fs.Path(self.root)
            at.getFileSystem(conf).delete(at, True)


def sized(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A table of a few numbers a row, broadcast if it has at most so many rows (32 MB), else joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- words of whole Arrow batches


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def byte_class(separators: list[tuple[int, int]]) -> np.ndarray:
    """True for bytes that belong to words, given the inclusive byte ranges that separate them."""
    keep = np.ones(256, bool)
    for lo, hi in separators:
        keep[lo : hi + 1] = False
    return keep


#: `[^\x20\x09-\x0D]+`
SPACE_WORDS = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM_WORDS = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_BYTES = np.random.RandomState(20240229).randint(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _MULT), np.full(size, _INV)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(low: np.ndarray, keep: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of the words of lower-cased bytes; rows begin at cuts and words never cross them."""
    inside = keep[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(low))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hash_piece(low: np.ndarray, keep: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end = word_spans(low, keep, cuts)
    up, down = _powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_BYTES[low] * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), start


def hash_words(low: np.ndarray, keep: np.ndarray, piece: int = 1 << 18) -> np.ndarray:
    """64-bit hashes of the words of one text, in pieces so that memory stays small for very long texts."""
    out, at = [], 0
    while at < len(low):
        to = min(len(low), at + piece)
        while to < len(low) and keep[low[to]]:  # a piece ends between words
            gap = np.flatnonzero(~keep[low[to : to + piece]])
            to = to + int(gap[0]) if len(gap) else min(len(low), to + piece)
        out.append(_hash_piece(low[at:to], keep, np.zeros(0, np.int64))[0])
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def batch_words(column: pa.Array, keep: np.ndarray, piece: int = 1 << 18) -> Iterator[np.ndarray]:
    """For each row of a string column, the hashes of its words in order."""
    raw, off = text_buffers(column)
    low = LOWER[raw]
    row, n = 0, len(off) - 1
    while row < n:
        if off[row + 1] - off[row] > piece:
            yield hash_words(low[off[row] : off[row + 1]], keep, piece)
            row += 1
            continue
        to = max(row + 1, int(np.searchsorted(off, off[row] + piece, "right")) - 1)
        to = min(to, n)
        base = off[row]
        hashes, start = _hash_piece(low[base : off[to]], keep, off[row : to + 1] - base)
        bounds = np.searchsorted(start, off[row : to + 1] - base, "left")
        for i in range(to - row):
            yield hashes[bounds[i] : bounds[i + 1]]
        row = to


def column_or_null(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


