"""Decisions, cache states, scopes and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECISIONS = ("keep", "remove", "unreviewed")


def normalised(members: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """A decision for every member: unknown ids drop out, missing ones are ``unreviewed``; any other value is an error."""
    wrong = F.raise_error(F.concat(F.lit("unknown decision: "), F.col("decision"))).cast("string")
    decisions = decisions.withColumn("decision", F.when(F.col("decision").isNull() | F.col("decision").isin(*DECISIONS), F.col("decision")).otherwise(wrong))
    return members.select(*keys).join(decisions.select(*keys, "decision"), keys, "left").withColumn("decision", F.coalesce("decision", F.lit("unreviewed")))


def decision_counts(rows: DataFrame, group: str) -> DataFrame:
    """Tallies of the three decisions, zeros kept, and whether nothing is left to review."""
    counts = rows.groupBy(group).agg(*[F.sum((F.col("decision") == d).cast("long")).alias(d) for d in DECISIONS])
    return counts.withColumn("complete", F.col("unreviewed") == 0)


def cache_state(missing: Column, corrupt: Column, old_schema: Column, bad_content: Column, changed: Column) -> Column:
    """State by the first check that fails; their order matters."""
    return (
        F.when(missing, "missing").when(corrupt, "corrupt").when(old_schema, "stale").when(bad_content, "corrupt").when(changed, "stale").otherwise("reusable")
    )


def scope_without(images: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Images that nothing was done for."""
    return images.join(done.select(key).distinct(), key, "left_anti")


def scope_with(images: DataFrame, some: DataFrame, key: str) -> DataFrame:
    """Images of which some condition holds."""
    return images.join(some.select(key).distinct(), key, "left_semi")


def summary(rows: DataFrame, status: str) -> DataFrame:
    """Rows by status."""
    return rows.groupBy(status).agg(F.count("*").alias("n"))
