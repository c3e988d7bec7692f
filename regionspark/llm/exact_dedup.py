"""Exact deduplication by skew-safe combining.

Three combining steps compare whole texts, never digests alone:

1. deduplicate locally: the map side of the first aggregation folds equal texts of one task;
2. merge salted digest groups: rows meet by (digest, salt), the salt coming from the block of ids, so that a group
   with a third of all rows is spread over as many tasks as there are salts;
3. combine the salt winners globally: at most one row for each (digest, salt, text) meets by digest.

The rows then look their group up by (digest, salt) again; a digest has at most one such row for each salt.
Two different texts with one SHA-256 digest would raise an error instead of giving a wrong answer.

Defined cases: a null text counts as empty; a null id never wins against another id, and a group of null ids only
has keep_id null and keeps all its rows; rows that repeat both id and text share their fate; an empty table gives an
empty table. Columns other than the id and the text are neither read nor returned, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Neighbouring ids share a salt, so that copies in one file still fold locally.
ID_BLOCK = 256


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (largest id of the equal texts), group_size, kept, text_sha256."""
    salts = max(64, partitions(docs.sparkSession))
    block = F.floor(F.col(id_col).cast("double") / ID_BLOCK)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("content"),
    ).select(
        "doc_id",
        "content",
        F.unhex(F.sha2("content", 256)).alias("digest"),
        F.pmod(F.xxhash64(block), F.lit(salts)).cast("int").alias("salt"),
    )
    salted = rows.groupBy("digest", "salt", "content").agg(F.max("doc_id").alias("best"), F.count("*").alias("n"))
    whole = (
        salted.repartition("digest")
        .groupBy("digest", "content")
        .agg(F.max("best").alias("best"), F.sum("n").alias("n"))
        .groupBy("digest")
        .agg(F.max("best").alias("keep_id"), F.sum("n").alias("group_size"), F.count("*").alias("texts"))
        .select(
            "digest",
            "keep_id",
            F.when(F.col("texts") == 1, F.col("group_size"))
            .otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long"))
            .alias("group_size"),
        )
    )
    narrow = rows.select("doc_id", "digest", "salt")
    found = narrow.select("digest", "salt").distinct().join(whole, "digest")
    return narrow.join(found, ["digest", "salt"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Ids should be unique: rows that share an id stay if
    one of them does."""
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]), "left_semi")
