"""Trees of nodes: closure, inherited decisions, rates and validation.

A tree is a relation (node_id, parent_id). Ancestors come from pointer doubling: log2(depth) self-joins on the node id,
each of which doubles the distance that a row knows, so deep trees need few rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut


def ancestors(nodes: DataFrame) -> DataFrame:
    """(node_id, ancestor_id, distance) of every node and itself and all above it, however deep; an error on cycles."""
    step = cut(nodes.filter("parent_id is not null").select("node_id", F.col("parent_id").alias("ancestor_id")))
    known = nodes.select("node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).cast("long").alias("distance"))
    reach, most = 1, nodes.count()
    while not step.isEmpty():
        if reach > most:
            raise ValueError("the parents form a cycle")
        up = step.select(F.col("node_id").alias("ancestor_id"), F.col("ancestor_id").alias("next_id"))
        further = known.join(up, "ancestor_id").select("node_id", F.col("next_id").alias("ancestor_id"), (F.col("distance") + reach).alias("distance"))
        longer = cut(step.join(up, "ancestor_id").select("node_id", F.col("next_id").alias("ancestor_id")))
        known = known.unionByName(further)
        if not longer.isEmpty():
            known = cut(known)
        step = longer
        reach *= 2
    return known


def effective_decisions(nodes: DataFrame, decisions: DataFrame) -> DataFrame:
    """The decision of the nearest node at or above each node, else ``unreviewed``."""
    held = ancestors(nodes).join(decisions.withColumnRenamed("node_id", "ancestor_id"), "ancestor_id")
    nearest = held.groupBy("node_id").agg(F.min_by("decision", "distance").alias("decision"))
    return nodes.join(nearest, "node_id", "left").select("node_id", "kind", F.coalesce("decision", F.lit("unreviewed")).alias("decision"))


def descendant_counts(nodes: DataFrame) -> DataFrame:
    """Number of nodes below each node."""
    below = ancestors(nodes).filter("distance > 0").groupBy(F.col("ancestor_id").alias("node_id")).agg(F.count("*").alias("n"))
    return nodes.join(below, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0).cast("long")).alias("descendants"))


def violations(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent does not exist, that are their own parent or that share an id."""
    ids = nodes.select(F.col("node_id").alias("parent_id")).distinct()
    orphans = nodes.filter("parent_id is not null").join(ids, "parent_id", "left_anti").select("node_id", F.lit("missing parent").alias("problem"))
    loops = nodes.filter("node_id = parent_id").select("node_id", F.lit("own parent").alias("problem"))
    twice = nodes.groupBy("node_id").agg(F.count("*").alias("n")).filter("n > 1").select("node_id", F.lit("id twice").alias("problem"))
    return orphans.unionByName(loops).unionByName(twice)
