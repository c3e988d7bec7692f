"""Stored segments and partitions: packing, and validation as one pass of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def packed(annotations: DataFrame) -> DataFrame:
    """Annotations (box as doubles, scores that may be missing) as segment columns: the box rounded half to even, missing
    scores 0, a missing point at the middle of the box."""
    box = {c: F.bround(c, 0).cast("long") for c in ("x", "y", "w", "h")}
    kept = [c for c in annotations.columns if c not in (*box, "iou", "stab", "px", "py")]
    middle = {"px": F.col("x") + F.col("w") / 2, "py": F.col("y") + F.col("h") / 2}
    return annotations.select(
        *kept, *[v.alias(c) for c, v in box.items()], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("iou", "stab")], *[F.coalesce(F.col(c), v).alias(c) for c, v in middle.items()]
    )


def unpacked_counts(stores: DataFrame) -> DataFrame:
    """Members of stores (image, counts, offsets) that hold all counts in one array and where each member's begin."""
    member = F.posexplode(F.expr("slice(offsets, 1, size(offsets) - 1)")).alias("i", "first")
    spread = stores.select("image", "counts", "offsets", member)
    own = F.slice("counts", F.col("first") + 1, F.get("offsets", F.col("i") + 1) - F.col("first"))
    return spread.select("image", (F.col("i") + 1).cast("long").alias("sid"), own.alias("counts"))


def run_problems(counts: Column, size: Column) -> Column:
    """What is wrong with alternating run lengths: EMPTY, NEGATIVE or SUM; null if nothing."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n)
    return F.when(F.size(counts) == 0, "EMPTY").when(F.exists(counts, lambda n: n < 0), "NEGATIVE").when(total != size, "SUM")


def segment_violations(segments: DataFrame, height: int, width: int) -> DataFrame:
    """(image, sid, problem) of segments with counts: ids that repeat or are below 1, broken run lengths, a declared area
    that the runs do not have, boxes outside the image or of negative size."""
    area = F.aggregate(F.filter("counts", lambda n, i: i % 2 == 1), F.lit(0).cast("long"), lambda a, n: a + n)
    bad_runs = run_problems(F.col("counts"), F.lit(height * width))
    outside = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("w") < 0) | (F.col("h") < 0) | (F.col("x") + F.col("w") > width) | (F.col("y") + F.col("h") > height)
    same_id = F.count("*").over(Window.partitionBy("image", "sid"))
    problems = F.array(
        F.when(F.col("_same") > 1, "ID_TWICE"), F.when(F.col("sid") < 1, "ID"), bad_runs,
        F.when(bad_runs.isNull() & (area != F.col("area")), "AREA"), F.when(outside, "BOX"),
    )
    found = segments.withColumn("_same", same_id).select("image", "sid", F.explode(F.array_compact(problems)).alias("problem"))
    return found.distinct()


def region_run_violations(runs: DataFrame, size: Column, leaves: DataFrame) -> DataFrame:
    """(image, problem) of label runs (image, run_idx, region, length), given how many leaves (image, n) an image has:
    LENGTH (not positive), SUM, ID (outside 1 to n), NEIGHBOUR (equal to the run before), MISSING (a leaf without runs)."""
    order = Window.partitionBy("image").orderBy("run_idx")
    marked = runs.withColumn("_same", F.coalesce(F.lag("region").over(order) == F.col("region"), F.lit(False))).join(leaves, "image")
    inside = (F.col("region") >= 1) & (F.col("region") <= F.col("n"))
    facts = marked.groupBy("image").agg(
        F.count_if(F.col("length") <= 0).alias("a"), F.sum("length").alias("total"), F.count_if(~inside).alias("c"), F.count_if("_same").alias("d"),
        (F.first("n") - F.count_distinct(F.when(inside, F.col("region")))).alias("missing"), F.first(size).alias("size"),
    )
    problems = F.array(
        F.when(F.col("a") > 0, "LENGTH"), F.when(F.col("total") != F.col("size"), "SUM"), F.when(F.col("c") > 0, "ID"),
        F.when(F.col("d") > 0, "NEIGHBOUR"), F.when(F.col("missing") > 0, "MISSING"),
    )
    return facts.select("image", F.explode(F.array_compact(problems)).alias("problem"))


def offset_violations(stores: DataFrame) -> DataFrame:
    """(image, problem) of member offsets (image, offsets, members, values): LENGTH, START, ORDER, END."""
    o = F.col("offsets")
    falls = F.exists(F.zip_with(F.slice(o, 2, F.greatest(F.size(o) - 1, F.lit(0))), o, lambda b, a: F.coalesce(b < a, F.lit(False))), lambda x: x)
    problems = F.array(
        F.when(F.size(o) != F.col("members") + 1, "LENGTH"), F.when(F.get(o, F.lit(0)) != 0, "START"), F.when(falls, "ORDER"),
        F.when(F.try_element_at(o, F.lit(-1)) != F.col("values"), "END"),
    )
    return stores.select("image", F.explode(F.array_compact(problems)).alias("problem"))


def label_violations(pixels: DataFrame) -> DataFrame:
    """(image, problem) of numeric label maps (image, region): POSITIVE (a label under 1), DENSE (labels are not 1 to K)."""
    facts = pixels.groupBy("image").agg(F.min("region").alias("low"), F.max("region").alias("high"), F.count_distinct("region").alias("n"))
    problems = F.array(F.when(F.col("low") < 1, "POSITIVE"), F.when((F.col("low") == 1) & (F.col("high") != F.col("n")) | (F.col("low") > 1), "DENSE"))
    return facts.select("image", F.explode(F.array_compact(problems)).alias("problem"))


def schema_problems(stored: DataFrame, required: dict[str, str]) -> list[str]:
    """Columns that a store lacks, holds with another type or holds beyond the required ones."""
    found = dict(stored.dtypes)
    missing = [f"missing {c}" for c in required if c not in found]
    other = [f"type of {c}: {found[c]}" for c, t in required.items() if c in found and found[c] != t]
    return [*missing, *other, *[f"extra {c}" for c in found if c not in required]]


def review_index(scored: DataFrame, groups: DataFrame, parents: DataFrame) -> DataFrame:
    """One row for each segment: its group (numbered by smallest member), the group's representative, the parent, scores and
    the edge flag."""
    best = Window.partitionBy("image", "group_id").orderBy(F.desc("quality"), F.desc("area"), "sid")
    number = F.dense_rank().over(Window.partitionBy("image").orderBy("group_id")).cast("long")
    joined = scored.join(groups.select("image", "sid", "group_id"), ["image", "sid"]).join(parents, ["image", "sid"], "left")
    return joined.select("image", "sid", number.alias("group_number"), F.first("sid").over(best).alias("representative"), "parent_sid", "quality", "priority", F.col("edge").cast("int").alias("edge"))
