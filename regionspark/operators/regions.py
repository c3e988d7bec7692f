"""Label maps: runs, features, adjacency and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio
from ..functions.documents import guide_disagreement


def label_runs(pixels: DataFrame) -> DataFrame:
    """Row-major runs of equal labels: run_idx from 0, label, [s, e)."""
    order = Window.partitionBy("image").orderBy("k")
    new = pixels.withColumn("new", F.when(F.lag("label").over(order).eqNullSafe(F.col("label")) & (F.lag("k").over(order) == F.col("k") - 1), 0).otherwise(1))
    island = new.withColumn("run_idx", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return island.groupBy("image", "run_idx").agg(F.first("label").alias("label"), F.min("k").alias("s"), (F.max("k") + 1).alias("e"))


def decode(runs: DataFrame) -> DataFrame:
    """The pixels of runs."""
    return runs.select("image", "label", F.explode(F.sequence("s", F.col("e") - 1)).alias("k"))


def region_at(runs: DataFrame, points: DataFrame) -> DataFrame:
    """The label under each flat index; points are few and go to every task."""
    found = runs.join(F.broadcast(points), (F.col("k") >= F.col("s")) & (F.col("k") < F.col("e")))
    return found.select("image", "k", "label")


def features(pixels: DataFrame, unit: int = 100) -> DataFrame:
    """Area, half-open box, centroid, and mean and population deviation of the gradient of every region.

    Gradients are counted in whole 1 / ``unit``, so sums are exact and do not depend on the order of the rows."""
    whole = F.round(F.col("grad") * unit).cast("decimal(18,0)")
    sums = pixels.withColumn("_g", whole).groupBy("image", "label").agg(
        F.count("*").alias("area"),
        F.min("x").alias("x0"),
        F.min("y").alias("y0"),
        (F.max("x") + 1).alias("x1"),
        (F.max("y") + 1).alias("y1"),
        F.avg("x").alias("cx"),
        F.avg("y").alias("cy"),
        F.sum("_g").alias("_one"),
        F.sum((F.col("_g") * F.col("_g")).cast("decimal(28,0)")).alias("_two"),
    )
    one, two, n = (F.col(c).cast("double") for c in ("_one", "_two", "area"))
    spread = (n * two - one * one) / (n * n)
    return sums.withColumn("mean_grad", one / n / unit).withColumn("std_grad", F.sqrt(F.greatest(spread, F.lit(0.0))) / unit).drop("_one", "_two")


def neighbours(pixels: DataFrame) -> DataFrame:
    """Each pixel with its right and lower neighbour: one shuffle by image and an equi-join on the place."""
    right = F.struct((F.col("x") + 1).alias("nx"), F.col("y").alias("ny"))
    below = F.struct(F.col("x").alias("nx"), (F.col("y") + 1).alias("ny"))
    towards = pixels.select("image", "label", "grad", F.explode(F.array(right, below)).alias("to"))
    a = towards.select("image", F.col("label").alias("la"), F.col("grad").alias("ga"), F.col("to.nx").alias("x"), F.col("to.ny").alias("y"))
    b = pixels.select("image", "x", "y", F.col("label").alias("lb"), F.col("grad").alias("gb"))
    return a.join(b, ["image", "x", "y"])


def adjacency(pixels: DataFrame, unit: int = 100) -> DataFrame:
    """Edges a < b between touching regions: shared length and mean gradient of the two sides, by exact sums as in
    ``features``."""
    both = F.round(F.col("ga") * unit).cast("long") + F.round(F.col("gb") * unit).cast("long")
    touching = neighbours(pixels).filter("la <> lb").withColumn("_g", both)
    edges = touching.groupBy("image", F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
    found = edges.agg(F.count("*").alias("shared_length"), F.sum("_g").alias("_sum"))
    return found.withColumn("mean_gradient", F.col("_sum").cast("double") / F.col("shared_length") / (2 * unit)).drop("_sum")


def boundary(pixels: DataFrame) -> DataFrame:
    """Pixels of each region with a 4-neighbour of another label or outside the map: neighbours come from the rows before
    and behind in a row and in a column, by one window each."""
    same = F.lit(0)
    rows, columns = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    seen = pixels.select("image", "x", "y", "label")
    for axis, order, step in (("x", rows, 1), ("x", rows, -1), ("y", columns, 1), ("y", columns, -1)):
        name = f"_{axis}{step + 1}"
        near = (F.lead(axis, 1) if step > 0 else F.lag(axis, 1)).over(order) == F.col(axis) + step
        alike = (F.lead("label", 1) if step > 0 else F.lag("label", 1)).over(order).eqNullSafe(F.col("label"))
        seen = seen.withColumn(name, F.coalesce(near & alike, F.lit(False)).cast("int"))
        same = same + F.col(name)
    return seen.groupBy("image", "label").agg(F.sum((same < 4).cast("long")).alias("boundary"))


def coverage(pixels: DataFrame, width: int) -> DataFrame:
    """Assigned share of the bounding canvas and spread of region areas."""
    areas = pixels.groupBy("image", "label").agg(F.count("*").alias("area"))
    stats = areas.groupBy("image").agg(
        F.sum("area").alias("assigned"), F.count("*").alias("regions"), F.min("area").alias("min_area"), F.max("area").alias("max_area"), F.median("area").cast("long").alias("median_area")
    )
    total = F.ceil(F.col("assigned") / width) * width
    return stats.withColumn("total", total).withColumn("assigned_ratio", ratio(F.col("assigned"), F.col("total")))


def even_samples(pixels: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` pixels of each region at evenly spaced ranks, first and last included."""
    own = Window.partitionBy("image", "label")
    ranked = pixels.withColumn("r", F.row_number().over(own.orderBy("k")) - 1).withColumn("n", F.count("*").over(own))
    step: Column = (F.col("n") - 1) / F.lit(float(most - 1))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * step))
    return ranked.filter((F.col("n") <= most) | F.array_contains(wanted, F.col("r").cast("long"))).select("image", "label", "k")


def merge_costs(edges: DataFrame, regions: DataFrame, color: float = 0.5, border: float = 0.3, size: float = 0.2) -> DataFrame:
    """Initial cost of each edge: differences of mean gradient, border gradient and area share, each over its largest."""
    a = regions.select("image", F.col("label").alias("a"), F.col("mean_grad").alias("ma"), F.col("area").alias("aa"))
    b = regions.select("image", F.col("label").alias("b"), F.col("mean_grad").alias("mb"), F.col("area").alias("ab"))
    own = Window.partitionBy("image")
    terms = edges.join(a, ["image", "a"]).join(b, ["image", "b"]).withColumn("c", F.abs(F.col("ma") - F.col("mb"))).withColumn("small", F.least("aa", "ab").cast("double"))

    def share(c: str) -> Column:
        most = F.max(c).over(own)
        return F.when(most <= 0, 0.0).otherwise(F.least(F.col(c) / most, F.lit(1.0)))

    return terms.select("image", "a", "b", (color * share("c") + border * share("mean_gradient") + size * share("small")).alias("cost"))


def dominant_guides(labels: DataFrame, signatures: DataFrame) -> DataFrame:
    """The best guide of each label (image, label), 0 with a score of 0 where there is none; signatures: image, label, sid,
    place, guide."""
    best = signatures.filter("place = 1").select("image", "label", F.col("sid").alias("_sid"), F.col("guide").alias("_guide"))
    found = labels.select("image", "label").join(best, ["image", "label"], "left")
    return found.select("image", "label", F.coalesce("_sid", F.lit(0)).cast("long").alias("guide_id"), F.coalesce("_guide", F.lit(0.0)).alias("guide_score"))


def first_costs(edges: DataFrame, regions: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The merge cost of each edge before any merge: the terms of ``plans.merging``, as expressions over edges joined with
    both regions (image, label, area, mean_grad, std_lum, guide_id, guide_score)."""

    def side(name: str) -> DataFrame:
        return regions.select("image", F.col("label").alias(name), *[F.col(c).alias(f"_{c}_{name}") for c in ("area", "mean_grad", "std_lum", "guide_id", "guide_score")])

    own = Window.partitionBy("image")
    gap = {c: F.col(f"_{c}_a") - F.col(f"_{c}_b") for c in ("mean_grad", "std_lum")}
    both = edges.join(side("a"), ["image", "a"]).join(side("b"), ["image", "b"])
    both = both.withColumn("_colour", F.abs(gap["mean_grad"])).withColumn("_texture", F.sqrt(gap["std_lum"] * gap["std_lum"] + gap["mean_grad"] * gap["mean_grad"]))

    def share(c: str) -> Column:
        most = F.max(c).over(own)
        return F.least(F.col(c) / F.when(most > 0, most).otherwise(1.0), F.lit(1.0))

    whole = regions.groupBy("image").agg(F.sum("area").alias("_whole"))
    terms = {
        "colour": share("_colour"),
        "texture": share("_texture"),
        "border": share("mean_gradient"),
        "guide": guide_disagreement(F.col("_guide_id_a"), F.col("_guide_score_a"), F.col("_guide_id_b"), F.col("_guide_score_b")),
        "size": F.least("_area_a", "_area_b") / F.greatest(F.col("_whole"), F.lit(1)),
    }
    cost = sum((weights[k] * v for k, v in terms.items()), F.lit(0.0))
    return both.join(whole, "image").select("image", "a", "b", cost.alias("cost"))
