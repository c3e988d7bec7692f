"""Sharding by weighted rendezvous hashing (law ``key``).

Every shard j draws u(key, j) in (0, 1) from a hash of the stable key and its own number; the shard with the largest
-weight / ln(u) takes the record. A shard's draw does not depend on the others, so one more shard takes records only
into itself, about weight / total of them, and a removed shard gives up only its own.

Slots are gapless without a window over a whole shard: rows fall into buckets by a hash, buckets are counted and
prefix-summed (shards x buckets rows), and a row's slot is its bucket's start plus its rank in the bucket.

Defined cases: a null key is a key like any other (all such rows share a shard); a null text has size 16 and the
checksum of the empty text; rows that repeat get slots of their own; equal draws, of which there are none in practice, go to the lower
shard; an empty table gives an empty table. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import offsets_by_bucket, partitions


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard that takes the key."""

    def score(j: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(j)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(-j).alias("j"))

    draws = [score(j, w) for j, w in enumerate(weights) if w > 0]
    best = draws[0] if len(draws) == 1 else F.greatest(*draws)
    return (-best["j"]).cast("int")


def shard_records(
    docs: DataFrame,
    weights: Sequence[float],
    grown_weights: Sequence[float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 16), text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard."""
    content = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(content) + 16).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
    )
    buckets = max(64, partitions(docs.sparkSession))

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("shard", rendezvous(F.col("doc_id"), weights)).withColumn(
            "bucket", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("slot")), F.lit(buckets)).cast("int")
        )

    sizes = placed(docs.select(F.col(id_col).alias("doc_id"))).groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = offsets_by_bucket(sizes, "shard", "bucket", "n", "start").select("shard", "bucket", "start")
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    grown = F.lit(None).cast("int") if grown_weights is None else rendezvous(F.col("doc_id"), grown_weights)
    return (
        placed(rows)
        .withColumn("rank", F.row_number().over(inside))
        .join(starts, ["shard", "bucket"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"),
            grown.alias("grown_shard"),
        )
    )
