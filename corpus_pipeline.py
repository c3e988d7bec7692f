"""The corpus pipeline: each stage calls one of the training-data operators on all that the stage before it kept.

SQL cannot express the learned rules, the fingerprints or the packing, so ORACLE_SQL is None and the stages are tested
against brute force.

Defined cases, for every stage but the last: columns of other names pass through and may have any name but those of the
documents; an empty table gives an empty one; very long texts are read whole; rows that share an id share their fate. A
null text counts as empty: the quality rules reject it. A null id stays null and never wins against another id among
equal texts; among near copies its row stays. The last stage returns the pieces of all that is left, repeated rows each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from regionspark.llm import exact_dedup, packing, quality_rules, simhash, suffix_dedup
from regionspark.llm.common import remove, shared_folder, table
from regionspark.llm.queries import WORD_VOCABULARY, vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    return quality_rules.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id stays."""
    return simhash.drop_near_copies(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that start earlier too are cut out of the texts."""
    return suffix_dedup.texts_without_repeats(docs, length_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences."""
    return packing.pack(docs, vocabulary(WORD_VOCABULARY))


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", near_stage),
    ("suffix_dedup", repeats_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; what a stage returns is written as Parquet to the shared folder and read again. A
    stage's files go when the next one's are written; those of the last stay, since the result reads them."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
