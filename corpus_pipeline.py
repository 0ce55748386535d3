"""The corpus pipeline: rules, near duplicates, decontamination, pseudonyms, mixture.

Every stage works on all that its predecessor kept; each is written as Parquet and read again.
Documents without a word are rejected by the rules, also those with a null text; a null doc_id
passes all stages; columns other than those of documents are dropped by the first one. Rows that
repeat a doc_id and text are one document. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import DOC_COLUMNS, Workspace, read_documents
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.mixing import mixture
from tidemark.llm.near_dup import drop_near_duplicates
from tidemark.llm.pseudonyms import pseudonymise, secret
from tidemark.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return keep_good(docs).select(*DOC_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return drop_near_duplicates(docs).select(*DOC_COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*DOC_COLUMNS)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data; n_chars follows where a text changed."""
    out = pseudonymise(docs, secret(spark))
    return out.withColumn("n_chars", F.when(F.col("n_replaced") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOC_COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mixture: which document stands where, by temperature-mixed sources."""
    return mixture(docs, entropy_share=0.95, max_passes=4.0)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pseudonyms", pseudonyms),
    ("mixing", mixing),
]

#: Near duplicates are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = read_documents(spark, sf_dir)
    for _, stage in STAGES:
        before, docs = docs, ws.write(stage(spark, docs, sf_dir))
        ws.drop(before)
    return docs
