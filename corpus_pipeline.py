"""A training corpus from ``documents`` in five stages: classify, keep one of each near-copy group, drop benchmark text,
mask personal data, pack.

Each stage takes (spark, docs, sf_dir) and decides on all rows that the stage before it kept; its result is written as
Parquet and read again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.llm.decontaminate import contamination
from colsight.llm.jaccard import jaccard_groups
from colsight.llm.packing import pack
from colsight.llm.pii import redact_pii
from colsight.llm.quality import REJECT_BELOW, fit_quality, score_quality
from colsight.llm.shared import cut, cuts_removed, shared_folder


ROW = "pipeline_row"
"""A name that the columns of documents do not have."""


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.3 or more; the model learns from the labels of this stage's documents.

    Null and empty texts are scored as empty ones; without labels, or with one kind only, all have the same score, the
    smoothed share of good labels. Rows are judged one by one, so repeated rows and null ids stay or go by their text.
    """
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).where(F.col("quality_score") >= REJECT_BELOW).drop("quality_score")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id, any id before none; of rows that share it, one.

    Rows are compared as rows, so copies go whether they repeat an id, have another or have none, and different texts
    with one id both stay. Texts without words are in no group and all stay.
    """
    rows = cut(docs.withColumn(ROW, F.monotonically_increasing_id()))
    groups = jaccard_groups(rows.select(ROW, "text"), id_col=ROW, words=5, percent=80).select(ROW, F.col("component_id").alias("group"))
    members = cut(rows.select(ROW, "doc_id").join(groups, ROW))
    first = members.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("first"))
    return rows.join(first.select(F.col(f"first.{ROW}").alias(ROW)), ROW, "left_semi").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified benchmark item. Null and empty texts are clean, all texts are when there are no items;
    repeated rows and null ids stay or go by their text."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col("contaminated")).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked; n_chars follows the text. Null texts stay null and keep their n_chars."""
    masked = redact_pii(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens; a null or empty text is its end token, each row counts, and no
    rows give no sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("benchmark", benchmark), ("personal_data", personal_data), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages; what each one keeps is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        with cuts_removed(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
