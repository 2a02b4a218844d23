"""The training-data pipeline: five stages over documents, each written and read again.

Languages, near-duplicates, benchmark passages and personal data are handled in
turn; the last stage returns sampled piece ids of what is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontam, langid, neardup, pieces, pii
from corpusloom.llm.common import remove_folder, shared_folder, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest language centroid is near enough.

    Null, empty and letter-free texts have no language and go; a null doc_id or lang is no
    reason to go; repeated rows stay or go together.
    """
    return langid.accepted(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near-duplicates.

    Ids may be null or repeated: groups go by fingerprint.  Of rows that repeat an id and a
    text one stays.
    """
    return neardup.without_near_duplicates(docs)


def off_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule doesn't name; null and empty texts hold no benchmark words and stay."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; texts without any, nulls among them, stay as they are."""
    return pii.redacted(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its sampled pieces; a null text has none, a null doc_id samples as id 0."""
    return pieces.encode_rows(docs, ["doc_id", "lang", "source"])


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("decontamination", off_benchmark),
    ("pii", masked),
    ("pieces", encoded),
]

#: Fingerprints, vote models and sampled pieces have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each result but the last is written to the shared folder.

    A stage's folder is removed once the next one is written; that of the last but one stays,
    as the result reads it.  An empty table gives no rows.  Extra columns of documents, whatever
    their names, pass through all stages but the last.
    """
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
