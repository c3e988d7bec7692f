"""Frames of propagated masks, as column-major intervals: metrics, change from the frame before, warnings, sequence checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio
from ..plans.packed import Masks, columns, joined_runs, shared, touching

#: Thresholds of the warnings.
LARGE, COMPONENTS, DROP, GROWTH, LOW_IOU = 0.80, 10, 0.25, 4.0, 0.05


def column_runs(masks: DataFrame, height: int) -> DataFrame:
    """Runs (image, sid, c, y0, y1) within one column each; y1 is exclusive."""
    spread = masks.withColumn("c", F.explode(F.sequence(F.floor(F.col("s") / height), F.floor((F.col("e") - 1) / height))))
    low = F.col("c") * height
    return spread.select("image", "sid", "c", (F.greatest("s", low) - low).alias("y0"), (F.least("e", low + height) - low).alias("y1"))


def component_counts(runs: DataFrame) -> DataFrame:
    """8-connected components of each frame, by union of the runs of adjacent columns that touch."""

    def of_run(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row of each frame and its number of components; rows are (image, sid, c, y0, y1) in order."""
        new = np.concatenate([[True], (table[1:, 0] != table[:-1, 0]) | (table[1:, 1] != table[:-1, 1])])
        frame = np.cumsum(new) - 1
        return np.flatnonzero(new), joined_runs(frame, *touching(frame, table[:, 2], table[:, 3], table[:, 4]))

    names = ("image", "sid", "c", "y0", "y1")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 5), dtype=np.int64)

        def made(table: np.ndarray) -> pa.RecordBatch:
            at, counts = of_run(table)
            return pa.RecordBatch.from_arrays([pa.array(table[at, 0]), pa.array(table[at, 1]), pa.array(counts)], names=["image", "sid", "components"])

        for part in parts:
            table = np.concatenate([held, np.stack([np.asarray(part.column(n)).astype(np.int64) for n in names], axis=1)])
            differs = np.flatnonzero((table[:, 0] != table[-1, 0]) | (table[:, 1] != table[-1, 1])) if len(table) else []
            upto = int(differs[-1]) + 1 if len(differs) else 0  # the last frame may go on
            if upto:
                yield made(table[:upto])
            held = table[upto:]
        if len(held):
            yield made(held)

    dealt = runs.select(*names).repartition("image", "sid").sortWithinPartitions(*names)
    return dealt.mapInArrow(run, "image long, sid long, components long")


def metrics(masks: DataFrame, frames: DataFrame, height: int, width: int) -> DataFrame:
    """Of every frame (image, sid): foreground pixels and share, inclusive box, centroid, components and the four edges
    that it touches; a frame without intervals has zero pixels and nulls."""
    runs = column_runs(masks, height)
    n = F.col("y1") - F.col("y0")
    sums = runs.groupBy("image", "sid").agg(
        F.sum(n).alias("foreground"), F.min("c").alias("x0"), F.min("y0").alias("y0"), F.max("c").alias("x1"), (F.max("y1") - 1).alias("y1"),
        F.sum(F.col("c") * n).alias("sx"), F.sum((F.col("y0") + F.col("y1") - 1) * n).alias("sy"),
    )
    counted = sums.join(component_counts(runs), ["image", "sid"])
    return described(frames.select("image", "sid").join(counted, ["image", "sid"], "left"), height, width)


def described(joined: DataFrame, height: int, width: int, *more: str) -> DataFrame:
    """The metrics from the sums over a frame's runs, which are null where it has none."""
    pixels = F.coalesce("foreground", F.lit(0).cast("long"))
    return joined.select(
        "image", "sid", pixels.alias("foreground"), ratio(pixels, F.lit(height * width)).alias("share"), "x0", "y0", "x1", "y1",
        (F.col("sx") / F.col("foreground")).alias("cx"), (F.col("sy") / (2 * F.col("foreground"))).alias("cy"),
        F.coalesce("components", F.lit(0).cast("long")).alias("components"),
        *[F.coalesce(hit, F.lit(False)).alias(name) for hit, name in (
            (F.col("y0") == 0, "top"), (F.col("y1") == height - 1, "bottom"), (F.col("x0") == 0, "left"), (F.col("x1") == width - 1, "right"))],
        *more,
    )


def changes(masks: DataFrame, measured: DataFrame, height: int) -> DataFrame:
    """The metrics with area ratio and IoU against the frame before (the next lower sid of the image): null for the first
    and after an empty frame, zero for an empty one."""
    own = Window.partitionBy("image").orderBy("sid")
    linked = measured.withColumn("_before", F.lag("sid").over(own)).withColumn("_pixels", F.lag("foreground").over(own))
    runs = column_runs(masks, height)
    now = runs.join(linked.select("image", "sid", "_before"), ["image", "sid"])
    then = runs.select("image", F.col("sid").alias("_before"), "c", F.col("y0").alias("_y0"), F.col("y1").alias("_y1"))
    met = (
        now.join(then, ["image", "_before", "c"])
        .filter((F.col("y0") < F.col("_y1")) & (F.col("_y0") < F.col("y1")))
        .groupBy("image", "sid")
        .agg(F.sum(F.least("y1", "_y1") - F.greatest("y0", "_y0")).alias("_shared"))
    )
    return compared(linked.join(met, ["image", "sid"], "left")).drop("_before")


def compared(joined: DataFrame) -> DataFrame:
    """Area ratio and IoU from the pixels of the frame before and those shared with it."""
    both = F.coalesce("_shared", F.lit(0).cast("long"))
    known = F.col("_pixels") > 0
    return (
        joined.withColumn("area_ratio", F.when(known, F.col("foreground") / F.col("_pixels")))
        .withColumn("iou", F.when(known, both / (F.col("foreground") + F.col("_pixels") - both)))
        .drop("_pixels", "_shared")
    )


SUMS = ("foreground", "x0", "y0", "x1", "y1", "sx", "sy", "components")


def followed(frames: DataFrame, starts: Column, ends: Column, height: int, width: int) -> DataFrame:
    """What ``metrics`` and ``changes`` say of frames (image, sid) whose masks are rising disjoint runs in two array columns.

    Frames come image by image in order of sid, and only the one before is held: runs are neither dealt nor joined, and
    frames that are dealt by image already stay where they are. The arrays are made after the order."""
    own = Window.partitionBy("image").orderBy("sid")
    ordered = frames.withColumn("_step", F.row_number().over(own)).select("image", "sid", "_step", starts.alias("_starts"), ends.alias("_ends"))

    def sums(masks: Masks) -> dict[str, pa.Array]:
        """By name the columns of SUMS; null where a frame has no pixels."""
        frame, c, y0, y1, at = columns(masks, height)
        out = {name: np.zeros(len(at) - 1, dtype=np.int64) for name in SUMS}
        some = at[1:] > at[:-1]
        if some.any():
            n, begins = y1 - y0, at[:-1][some]
            for name, values in (("foreground", n), ("sx", c * n), ("sy", (y0 + y1 - 1) * n)):
                out[name][some] = np.add.reduceat(values, begins)
            out["x0"][some], out["x1"][some] = c[begins], c[at[1:][some] - 1]
            out["y0"][some], out["y1"][some] = np.minimum.reduceat(y0, begins), np.maximum.reduceat(y1, begins) - 1
            first, many = touching(frame, c, y0, y1)
            # where no run touches two of the next column, each touch joins two components
            out["components"][some] = (at[1:] - at[:-1])[some] - np.add.reduceat(many, begins)
            for i in np.flatnonzero(some)[np.maximum.reduceat(many, begins) > 1]:
                a, b = at[i], at[i + 1]
                out["components"][i] = joined_runs(np.zeros(b - a, dtype=np.int64), first[a:b] - a, many[a:b])[0]
        return {name: pa.array(values, mask=~some) for name, values in out.items()}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = Masks(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(2, np.int64))
        for part in parts:
            if not part.num_rows:
                continue
            own = Masks.of(part.column("_starts"), part.column("_ends"))
            masks, i = before.then(own), np.arange(1, part.num_rows + 1)
            follows = part.column("_step").to_numpy() > 1
            more = {"_pixels": pa.array(masks.pixels()[:-1], mask=~follows), "_shared": pa.array(shared(masks, i, masks, i - 1), mask=~follows)}
            made = {"image": part.column("image"), "sid": part.column("sid"), **sums(own), **more}
            yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))
            before = own.part(part.num_rows - 1, part.num_rows)

    kinds = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    kind = ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in ("image", "sid", *SUMS, "_pixels", "_shared"))
    return compared(described(ordered.mapInArrow(run, kind), height, width, "_pixels", "_shared"))


def warning_codes(share: Column, components: Column, all_edges: Column, area_ratio: Column, iou: Column, foreground: Column) -> Column:
    """Warning codes in their fixed order. An empty frame has EMPTY_MASK and, after a frame that was not, LOW_IOU only."""
    low = F.when(iou < LOW_IOU, "LOW_IOU")
    empty = F.array(F.lit("EMPTY_MASK"), low)
    filled = F.array(
        F.when(share >= LARGE, "TOO_LARGE"),
        F.when(components > COMPONENTS, "MANY_COMPONENTS"),
        F.when(all_edges, "TOUCHES_ALL_EDGES"),
        F.when(area_ratio < DROP, "AREA_DROP").when(area_ratio > GROWTH, "AREA_GROWTH"),
        low,
    )
    return F.array_compact(F.when(foreground == 0, empty).otherwise(filled))


def stored_once(passes: DataFrame, key: str) -> DataFrame:
    """Of frames (pass_index, frame_index) that several passes yield, the first pass's row; what a row says of the frame
    before it in its own pass must be there already, since a dropped row is still a frame before."""
    order = Window.partitionBy(key, "frame_index").orderBy("pass_index")
    return passes.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def sequence_errors(entries: DataFrame, reference: DataFrame, most: int) -> DataFrame:
    """Error codes of each sequence of entries (seq_key, place, entry_key, width, height), whose reference holds one entry
    key each: FEW, DUPLICATE, NO_REFERENCE, MANY, SIZE; and the first entry whose size differs from the reference (from
    the first entry without one)."""
    joined = entries.join(reference.select("seq_key", F.col("entry_key").alias("_reference")), "seq_key", "left")
    told = F.struct(F.coalesce(F.col("entry_key") != F.col("_reference"), F.lit(True)).alias("other"), "place")
    base = joined.groupBy("seq_key").agg(F.min_by(F.struct("width", "height"), told).alias("_base"))
    sized = joined.join(base, "seq_key").withColumn("_differs", (F.col("width") != F.col("_base.width")) | (F.col("height") != F.col("_base.height")))
    n = F.count("*")
    facts = sized.groupBy("seq_key").agg(
        n.alias("n"), F.count_distinct("entry_key").alias("keys"), F.max(F.coalesce(F.col("entry_key") == F.col("_reference"), F.lit(False))).alias("found"),
        F.min_by(F.when(F.col("_differs"), F.col("entry_key")), F.when(F.col("_differs"), F.col("place"))).alias("first_other"),
    )
    codes = F.array(
        F.when(F.col("n") < 2, "FEW"), F.when(F.col("keys") < F.col("n"), "DUPLICATE"), F.when(~F.col("found"), "NO_REFERENCE"),
        F.when(F.col("n") > most, "MANY"), F.when(F.col("first_other").isNotNull(), "SIZE"),
    )
    return facts.select("seq_key", F.array_join(F.array_compact(codes), ",").alias("errors"), "first_other")


def reference_errors(masks: DataFrame, height: int, width: int) -> DataFrame:
    """Error codes of reference masks (image, mask_height, mask_width, low, high, other_values, foreground): SIZE, VALUES
    (others than 0 and 255), EMPTY or FULL."""
    codes = F.array(
        F.when((F.col("mask_height") != height) | (F.col("mask_width") != width), "SIZE"),
        F.when(F.col("other_values") > 0, "VALUES"),
        F.when(F.col("foreground") == 0, "EMPTY").when(F.col("foreground") == F.col("mask_height") * F.col("mask_width"), "FULL"),
    )
    return masks.select("image", F.array_join(F.array_compact(codes), ",").alias("errors"))
