"""Files of questions, answers and scores, read and written as DataFrames.

Paths are any that Spark opens. Null and missing fields are the same to these readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.dialect import render

#: The parts of an experiment's name, in order.
TAGS = ("agent", "variant", "backend", "dataset", "embedder")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Whole JSON files, an object or an array of objects each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Questions with supporting_doc_ids: else those of filtered_supporting_doc_ids, else none."""
    df = read_json(spark, path)
    ids = [F.col(c).cast("array<string>") for c in ("supporting_doc_ids", "filtered_supporting_doc_ids") if c in df.columns]
    return df.withColumn("supporting_doc_ids", F.coalesce(*ids, F.array().cast("array<string>")))


def read_folder(spark: SparkSession, path: str, schema: T.StructType | str | None = None, limit: int | None = None) -> DataFrame:
    """The rows of a folder's JSON files, one document each, with their file's name; files named _* are left out.

    With limit only the first files by name are read; their names, not their rows, are sorted.
    """
    rows = read_json(spark, f"{path}/*.json", schema).withColumn("file", F.col("_metadata.file_name")).where(~F.startswith("file", F.lit("_")))
    if limit is None:
        return rows
    first = rows.select("file").distinct().orderBy("file").limit(limit)
    return rows.join(F.broadcast(first) if limit <= 100_000 else first, "file", "left_semi")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(qid, em, anls) of JSON lines; blank lines are skipped and of a question's lines the last one counts.

    The last is the one furthest in the last file by name: by the place of its split in the file, then by the row's.
    """
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("at"))
    parsed = lines.where(F.trim(F.regexp_replace("value", r"(?U)\s+", " ")) != "").select(F.from_json("value", "qid string, em double, anls double").alias("s"), "at")
    return parsed.groupBy("s.qid").agg(F.max_by("s", "at").alias("s")).select("s.qid", "s.em", "s.anls")


def score(predictions: DataFrame) -> DataFrame:
    """(id, prediction, gold) -> (qid, em, anls), missing texts being empty."""
    plain = {c: F.expr(render(f"NO_ARTICLES[PLAIN[coalesce({c}, '')]]", 0)) for c in ("prediction", "gold")}
    rows = predictions.select(F.col("id").alias("qid"), plain["prediction"].alias("p"), plain["gold"].alias("g"))
    longest, away = F.greatest(F.length("p"), F.length("g")), F.levenshtein("p", "g")
    anls = F.when(longest == 0, 1.0).when(away < 0.5 * longest, 1 - away / longest).otherwise(0.0)
    return rows.select("qid", (F.col("p") == F.col("g")).cast("double").alias("em"), anls.alias("anls"))


def write_scores(predictions: DataFrame, path: str) -> None:
    """Predictions as JSON lines of scores."""
    score(predictions).write.mode("overwrite").json(path)


def experiment(**tags: str) -> str:
    """The name of an experiment, from its tags; those that are missing or empty are left out."""
    return "_".join(str(tags[t]) for t in TAGS if tags.get(t))


def write_predictions(predictions: DataFrame, path: str, **tags: str) -> str:
    """Writes predictions and their averages as JSON under the experiment's name, which is returned; a rerun replaces its own only."""
    name = experiment(**tags)
    predictions.write.mode("overwrite").json(f"{path}/predictions/experiment={name}")
    totals = score(predictions).agg(F.count(F.lit(1)).alias("n"), F.avg("em").alias("em"), F.avg("anls").alias("anls"))
    totals.coalesce(1).write.mode("overwrite").json(f"{path}/metrics/experiment={name}")
    return name


def write_flips(a: DataFrame, b: DataFrame, path: str) -> None:
    """(qid, em, anls) of two systems -> CSV with a header: the questions that one of them alone answers."""
    both = a.select("qid", F.col("em").alias("em_a")).join(b.select("qid", F.col("em").alias("em_b")), "qid")
    flips = both.where("em_a <> em_b").withColumn("flip", F.when(F.col("em_a") > F.col("em_b"), "lost").otherwise("won"))
    flips.write.mode("overwrite").option("header", True).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def undone(df: DataFrame, path: str, key: str) -> DataFrame:
    """The rows whose key isn't in the Parquet table at path yet; all of them where there is none."""
    spark = df.sparkSession
    return df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti") if exists(spark, path) else df


def prompt(template: str, **columns: str):
    """A column: the template with each {name} replaced by the column given for it, null as empty.

    The template is cut at the places of its names first, so what a value holds is never replaced.
    """
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.lit(p) if k % 2 == 0 else F.coalesce(F.col(columns[p]).cast("string"), F.lit("")) if p in columns else F.lit("{%s}" % p) for k, p in enumerate(parts)))
