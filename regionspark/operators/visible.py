"""Visible nodes of trees: lookups, splits, collapses and decisions that clear what is below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hierarchy import ancestors


def visible_nodes(nodes: DataFrame, visible: DataFrame) -> DataFrame:
    """The nearest visible node at or above each node; the topmost node where none is visible."""
    above = ancestors(nodes)
    seen = above.join(visible.select(F.col("node_id").alias("ancestor_id"), F.lit(True).alias("_seen")), "ancestor_id", "left")
    best = seen.groupBy("node_id").agg(
        F.min_by("ancestor_id", F.when(F.col("_seen"), F.col("distance"))).alias("_near"), F.max_by("ancestor_id", "distance").alias("_top")
    )
    return best.select("node_id", F.coalesce("_near", "_top").alias("visible_id"))


def split(nodes: DataFrame, visible: DataFrame, chosen: DataFrame) -> DataFrame:
    """The visible nodes after each chosen one that is visible gives way to its children; leaves stay."""
    opened = chosen.select("node_id").distinct().join(visible, "node_id", "left_semi")
    children = nodes.select("node_id", F.col("parent_id")).join(opened.withColumnRenamed("node_id", "parent_id"), "parent_id")
    gone = children.select(F.col("parent_id").alias("node_id")).distinct()
    return visible.select("node_id").join(gone, "node_id", "left_anti").unionByName(children.select("node_id")).distinct()


def collapse(nodes: DataFrame, visible: DataFrame, chosen: DataFrame) -> DataFrame:
    """The visible nodes after each chosen one and its siblings give way to their parent; a root stays."""
    parents = nodes.join(chosen.select("node_id").distinct(), "node_id", "left_semi").filter("parent_id is not null").select("parent_id").distinct()
    gone = nodes.join(parents, "parent_id", "left_semi").select("node_id")
    return visible.select("node_id").join(gone, "node_id", "left_anti").unionByName(parents.select(F.col("parent_id").alias("node_id"))).distinct()


def explicit_below(nodes: DataFrame, decisions: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node_id, below_id): nodes with a decision of their own below each chosen node."""
    above = ancestors(nodes).filter("distance > 0").join(decisions.select("node_id"), "node_id", "left_semi")
    of = chosen.select(F.col("node_id").alias("ancestor_id")).distinct()
    return above.join(of, "ancestor_id", "left_semi").select(F.col("ancestor_id").alias("node_id"), F.col("node_id").alias("below_id"))


def decided_for_all(nodes: DataFrame, decisions: DataFrame, chosen: DataFrame, decision: str) -> DataFrame:
    """The decisions after each chosen node takes one and those below it are cleared; ``unreviewed`` clears its own."""
    gone = explicit_below(nodes, decisions, chosen).select(F.col("below_id").alias("node_id")).unionByName(chosen.select("node_id")).distinct()
    left = decisions.select("node_id", "decision").join(gone, "node_id", "left_anti")
    # a chosen node below another chosen one is cleared with the rest
    top = chosen.select("node_id").distinct()
    below = explicit_below(nodes, top, top).select(F.col("below_id").alias("node_id")).distinct()
    return left if decision == "unreviewed" else left.unionByName(top.join(below, "node_id", "left_anti").withColumn("decision", F.lit(decision)))


def leaves_under(nodes: DataFrame) -> DataFrame:
    """(node_id, leaf_id): the leaves at or below each node."""
    inner = nodes.filter("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct()
    above = ancestors(nodes).join(inner, "node_id", "left_anti")
    return above.select(F.col("ancestor_id").alias("node_id"), F.col("node_id").alias("leaf_id"))


def composed_runs(runs: DataFrame, decisions: DataFrame, unreviewed_as: str | None = None) -> DataFrame:
    """Runs of a label map that are kept, by the decision of their label; labels without one count as ``unreviewed_as``,
    and raise an error without it."""
    joined = runs.join(decisions.select("image", "label", "decision"), ["image", "label"], "left")
    missing: Column = F.raise_error(F.lit("a region is not reviewed")).cast("string") if unreviewed_as is None else F.lit(unreviewed_as)
    decided = F.when(F.col("decision").isin("keep", "remove"), F.col("decision")).otherwise(missing)
    return joined.withColumn("decision", decided).filter("decision = 'keep'").select("image", "label", "s", "e")
