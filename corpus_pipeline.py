"""A corpus pipeline: documents -> known language -> one of each near-duplicate group -> no benchmark text -> pseudonyms -> mixture.

Every stage takes any table with the columns of documents; further columns go, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontam, jaccard, langid, mixing, pii
from folioscope.llm.common import Stages, prepare, sized, table
from folioscope.llm.queries import pii_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with a posterior of at least one half; goes: null, empty and letterless texts.

    Learned from the rows with a language, by the operator's rules. Null ids and sources are kept as they are, repeated rows
    each; ties go to the language first by name; without any language all rows go, and an empty table stays empty.
    """
    prepare(spark)
    model = langid.fit(docs)
    found = langid.identify(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.5)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one with the smallest doc_id. Documents without words all stay.

    Rows of one id are one document: of those with equal shingles one stays. Of rows with a null id, those that equal a
    row with an id go, and of the others one of each set of equal shingles stays. An empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    with Stages(spark) as stages:
        links = jaccard.link(docs.select("doc_id", "text"))
        worded = links.where("n_shingles > 0")
        gone = stages.keep(worded.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
        kept = docs.join(sized(gone), "doc_id", "left_anti").select(*COLUMNS)
        unnamed = stages.keep(worded.where("doc_id is null").groupBy("class_key").agg(F.max(F.col("component_id").isNotNull()).alias("named")))
        twice = stages.keep(worded.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
        if unnamed.isEmpty() and twice.isEmpty():
            return stages.result(kept)
        again = jaccard.class_keys(kept.join(sized(twice), "doc_id", "left_semi").select(*COLUMNS).unionByName(kept.where("doc_id is null")))
        again = stages.keep(again.join(sized(unnamed.where("named").select("class_key")), "class_key", "left_anti"))
        once = again.where("class_key is not null").dropDuplicates(["doc_id", "class_key"]).unionByName(again.where("class_key is null"))
        rest = kept.where("doc_id is not null").join(sized(twice), "doc_id", "left_anti")
        return stages.result(rest.select(*COLUMNS).unionByName(once.select(*COLUMNS)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item.

    Rows go by doc_id, so that rows of one id stay or go together; rows with a null id go by their text. Null and empty
    texts hold no item and stay, repeated rows each, very long ones count whole; without items all stay.
    """
    with Stages(spark) as stages:
        docs = docs.select(*COLUMNS)
        items = table(spark, sf_dir, "benchmark")
        hits = stages.keep(decontam.find(docs.select("doc_id", "text"), items).select("doc_id").distinct())
        kept = docs.join(sized(hits.where("doc_id is not null")), "doc_id", "left_anti").select(*COLUMNS)
        if not hits.where("doc_id is null").isEmpty():
            texts = kept.where("doc_id is null").select("text")
            bad = stages.keep(decontam.find(texts.where("text is not null").distinct(), items, id_col="text").select("text").distinct())
            kept = kept.where("doc_id is not null").unionByName(kept.where("doc_id is null").join(bad, "text", "left_anti").select(*COLUMNS))
        return stages.result(kept)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal values; n_chars follows the text, and stays null where it is. All rows stay, null texts as they are."""
    out = pii.pseudonymise(docs.select(*COLUMNS), pii_key(spark), spans=None)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot and n_blocks of the mixture of what is left.

    One row per row: null sources are a source of their own, null and empty texts take nothing, repeats count each, and an
    empty table gives no rows.
    """
    return mixing.mix_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pseudonyms),
    ("mixture", mixture),
]

#: The first stage learns a model, so SQL can't express the rows; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each over a table of what the one before left."""
    with Stages(spark) as stages:
        docs = table(spark, sf_dir, "documents")
        for k, (_, f) in enumerate(STAGES):
            now = f(spark, docs, sf_dir)
            if k + 1 == len(STAGES):
                return stages.result(now)
            now = stages.keep(now)
            stages.drop(docs)
            docs = now
