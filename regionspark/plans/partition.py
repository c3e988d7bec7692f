"""From images to merge trees: base labels, connected regions, merged small regions, features, adjacency, hierarchy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions.colour import lab
from ..operators import raster, regions
from . import connected_components, small_regions_merged
from .flooding import watershed
from .merging import merge_hierarchy

LAB = ("light", "lab_a", "lab_b")

#: Kernels for base labels by name: pixels with channels and Lab colours, options -> (image, x, y, label). Others, as for
#: superpixels, are added here.
BACKENDS: dict[str, Callable[..., DataFrame]] = {"grid_watershed": lambda pixels, **options: watershed(pixels, fill_by=LAB, **options)}


class BackendUnavailable(RuntimeError):
    """A kernel that was asked for by name is not there."""


def base_labels(pixels: DataFrame, backend: str = "auto", **options: int) -> tuple[DataFrame, str]:
    """Labels by one kernel, and its name; ``auto`` takes superpixels (``slic``) if such a kernel is there."""
    if backend not in ("auto", "slic", "grid_watershed", *BACKENDS):
        raise ValueError(f"unknown backend {backend!r}")
    used = backend if backend != "auto" else "slic" if "slic" in BACKENDS else "grid_watershed"
    if used not in BACKENDS:
        raise BackendUnavailable(used)
    return BACKENDS[used](pixels, **options), used


def coloured(pixels: DataFrame) -> DataFrame:
    """Pixels (image, x, y, red, green, blue) with Lab colours and the gradient of the lightness."""
    light, a, b = lab(F.col("red"), F.col("green"), F.col("blue"))
    shaded = pixels.withColumn("light", light).withColumn("lab_a", a).withColumn("lab_b", b)
    return raster.gradient(shaded, "light").withColumnRenamed("gradient", "grad")


def leaf_features(pixels: DataFrame) -> DataFrame:
    """Features of the regions: those of ``regions.features`` for the gradient, and means and deviations of Lab."""
    sums = [f(c).alias(f"{kind}_{c}") for c in LAB for kind, f in (("mean", F.avg), ("std", F.stddev_pop))]
    found = regions.features(pixels).drop("std_grad")
    return found.join(pixels.groupBy("image", "label").agg(*sums), ["image", "label"]).withColumnRenamed("std_light", "std_lum")


def partition(pixels: DataFrame, guides: DataFrame | None = None, backend: str = "auto", min_area: int = 0, weights: dict[str, float] | None = None, **options: int) -> tuple[DataFrame, DataFrame]:
    """Labels (image, x, y, label from 1) that cover the images, and their merge trees.

    ``guides``: (image, label, guide_id, guide_score) of the final labels, if known. Rows that several steps use are
    written to the checkpoint folder once."""
    shades = cut(coloured(pixels))
    width = shades.groupBy("image").agg((F.max("x") + 1).alias("_w"))
    base, _ = base_labels(shades, backend, **options)
    placed = base.join(width, "image").select("image", "x", "y", (F.col("y") * F.col("_w") + F.col("x")).alias("k"), F.col("label").cast("string").alias("label"))
    apart = raster.connected_labels(connected_components(placed, diagonal=False)).select("image", "k", F.col("region").alias("label"))
    labelled = cut(apart.join(shades.join(width, "image").withColumn("k", F.col("y") * F.col("_w") + F.col("x")).drop("_w"), ["image", "k"]))
    if min_area > 1:
        means = labelled.groupBy("image", "label").agg(F.count("*").alias("area"), *[F.avg(c).alias(c) for c in LAB])
        merged = small_regions_merged(means, regions.adjacency(labelled), min_area, LAB)
        labelled = labelled.join(merged, ["image", "label"]).drop("label").withColumnRenamed("merged", "label")
    labelled = cut(raster.relabelled(labelled).drop("label").withColumnRenamed("region", "label"))
    leaves = leaf_features(labelled)
    if guides is None:
        leaves = leaves.withColumn("guide_id", F.lit(0)).withColumn("guide_score", F.lit(0.0))
    else:
        leaves = leaves.join(guides.select("image", "label", "guide_id", "guide_score"), ["image", "label"], "left")
    colours, spreads = tuple(f"mean_{c}" for c in LAB), ("std_lab_a", "std_lab_b")
    return labelled.select("image", "x", "y", "label"), merge_hierarchy(leaves, regions.adjacency(labelled), colours, spreads, weights)
