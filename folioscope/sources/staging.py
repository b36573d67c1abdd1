"""Stages written once: tables in the shared checkpoint folder that later queries over the same files read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: dict[tuple, DataFrame] = {}


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of a row's place within its partition, in monotonically_increasing_id().
_PLACE = 33


def stage(df: DataFrame) -> DataFrame:
    """Writes df as Parquet under the folder of spark.checkpoint.dir and reads it from there; a temporary folder only where none is named.

    The shuffle files of the plan that wrote it go at once.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="folioscope-checkpoint-"))
    path = f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
SPLIT, PART, JOINED = 32 << 20, 4 << 20, 16 << 20


def deal(spark: SparkSession, path: str) -> None:
    """Has scans read at most 32 MB a task, and shuffles begin with a part for each 4 MB of the table, which adaptive execution joins up to 16 MB.

    A fixed number of parts would let the memory of one task grow with the table.
    """
    parts = sum(size for _, size, _ in version(spark, path)) // PART
    if parts > int(spark.conf.get(PARTS, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(PARTS, str(parts))
    if spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() > SPLIT:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(SPLIT))
    if spark._jsparkSession.sessionState().conf().getConfString("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64MB") == "64MB":
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(JOINED))


def numbered(df: DataFrame, key: str) -> DataFrame:
    """df, staged, with nth: a row's place from 0 on in the order of key.

    Rows are dealt by ranges of key, so each partition numbers its own; the partitions' counts give where each begins.
    """
    spark = df.sparkSession
    rows = stage(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", _PLACE)
    begins, total = [], 0
    for p, n in sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        begins.append((p, total))
        total += n
    first = F.broadcast(spark.createDataFrame(begins, "_p long, _first long"))
    nth = F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << _PLACE) - 1))
    return rows.join(first, part == F.col("_p")).select(*df.columns, nth.alias("nth"))


def version(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files at path, in whatever store Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found))


def stage_once(df: DataFrame | Callable[[], DataFrame], name: str, paths: list[str], write: Callable[[DataFrame], DataFrame] = stage, spark: SparkSession | None = None) -> DataFrame:
    """The stage of that name over those tables as they are now: written at first use, read by all later ones.

    Tables that change make the stage anew; the older copy is let go. df may be a function, which is then called only
    for a stage that isn't there, and write another way to write it.
    """
    spark = spark or df.sparkSession
    own, now = (spark.sparkContext.applicationId, name, *paths), tuple(version(spark, p) for p in paths)
    if (own, now) not in _MADE:
        for key in [k for k in _MADE if k[0] == own or k[0][0] != own[0]]:
            del _MADE[key]
        _MADE[own, now] = write(df() if callable(df) else df)
    return _MADE[own, now]
