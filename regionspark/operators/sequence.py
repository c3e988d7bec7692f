"""Frame sequences: order, selection and change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import natural_key


def change(frames: DataFrame) -> DataFrame:
    """Ratio of a frame's foreground to the one before it; null for the first and after an empty frame."""
    before = F.lag("foreground").over(Window.partitionBy("seq_key").orderBy("step"))
    return frames.withColumn("area_ratio", F.when(before != 0, F.col("foreground") / before))


def around(frames: DataFrame, reference: DataFrame, n: int) -> DataFrame:
    """Up to n frames before and after each sequence's reference, with the reference's index in the selection."""
    joined = frames.join(reference.withColumnRenamed("step", "reference"), "seq_key")
    chosen = joined.filter(F.abs(F.col("step") - F.col("reference")) <= n)
    first = F.min("step").over(Window.partitionBy("seq_key"))
    return chosen.select("seq_key", "step", (F.col("reference") - first).alias("reference_index"))


def chosen(frames: DataFrame, wanted: DataFrame, reference: DataFrame) -> DataFrame:
    """The wanted frames of each sequence and its reference, each once and in order, with their places and whether they
    are the reference. Wanted steps that a sequence lacks drop out."""
    steps = wanted.select("seq_key", "step").unionByName(reference.select("seq_key", "step")).distinct()
    flagged = frames.select("seq_key", "step").distinct().join(steps, ["seq_key", "step"], "left_semi")
    marked = flagged.join(reference.select("seq_key", F.col("step").alias("_reference")), "seq_key", "left")
    place = F.row_number().over(Window.partitionBy("seq_key").orderBy("step")) - 1
    return marked.select("seq_key", "step", place.cast("long").alias("place"), F.coalesce(F.col("step") == F.col("_reference"), F.lit(False)).alias("is_reference"))


def placed(rows: DataFrame, group: str, value: str, index: str) -> DataFrame:
    """Places by a value that may be missing, such as a registration index or a time of capture: missing ones come last,
    ties go by the index in the list."""
    order = Window.partitionBy(group).orderBy(F.asc_nulls_last(value), F.asc_nulls_last(index))
    return rows.withColumn("place", F.row_number().over(order).cast("long"))


def keep_first(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def circular(items: DataFrame, group: str, order: str) -> DataFrame:
    """The next and previous item of each, around the ends."""
    own = Window.partitionBy(group).orderBy(order)
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return items.select(
        group,
        order,
        F.coalesce(F.lead(order).over(own), F.first(order).over(whole)).alias("next_item"),
        F.coalesce(F.lag(order).over(own), F.last(order).over(whole)).alias("previous_item"),
    )


def naturally_ordered(names: DataFrame, key: str, name: str) -> DataFrame:
    """Rank by the natural order of names, ties by key. Rows are dealt by ranges of the order, numbered within their range
    and moved by the sizes of the ranges before, so no task holds them all."""
    keyed = names.select(key, name, natural_key(F.col(name)).alias("_nk")).repartitionByRange("_nk", key)
    dealt = cut(keyed.withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_nk", key))
    joined = dealt.withColumn("_place", inside).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return joined.select(key, name, (F.col("_place") + F.col("_before")).cast("long").alias("place"))


def top_k(rows: DataFrame, key: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each key."""
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long"))
    return ranked.filter(F.col("place") <= k)


def preview(placed_rows: DataFrame, group: str, name: str, reference: int) -> DataFrame:
    """The places (from 0) and names of each sequence as lines, the reference marked."""
    mark = F.when(F.col("place") == reference, "  (reference)").otherwise("")
    line = F.struct("place", F.concat(F.col("place").cast("string"), F.lit("  "), F.col(name), mark).alias("line"))
    return placed_rows.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(line))["line"], "\n").alias("preview"))
