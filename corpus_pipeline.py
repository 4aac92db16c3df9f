"""Corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, token ids.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlens.llm import bpe, common, decontam, langid, linededup, minhash
from growthlens.llm.queries import TOKENIZERS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The stages are learned and compared in Python and Spark code that SQL cannot say; tests hold them against brute force.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text where a stage changed it."""
    return docs.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose text is in a known language."""
    return langid.accepted(_counted(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out repeated lines; documents of which nothing is left go.  n_chars is counted anew where lines went."""
    kept = linededup.drop_repeated(_counted(docs).withColumn("_before", F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col("_before"))
    return _counted(kept.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: 5-word shingles, similarity 0.8."""
    return _counted(minhash.keep_one(docs, width=5, percent=80))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that copy a test item."""
    return _counted(decontam.clean(docs, common.table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens): each text as packed token ids."""
    coded = bpe.encode(docs, os.path.join(TOKENIZERS, "byte_bpe_50k.json"))
    return coded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
