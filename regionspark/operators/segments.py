"""Candidate segments: canonical order, scores, pairs, duplicate groups, parents and hits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio, touches_edge
from ..plans.packed import Masks, alike, classes, least_reachable, meeting, nearest, owners, shared, united, whole_groups
from . import intervals

DUPLICATE_IOU, CONTAINED, HIDDEN = 0.85, 0.95, 0.98


def canonical_ids(raw: DataFrame, tie_break: list[str]) -> DataFrame:
    """Numbers an image's segments from 1 by area, iou and stability falling, then box rising."""
    order = [F.desc("area"), F.desc("iou"), F.desc("stab"), "x", "y", "w", "h", *tie_break]
    return raw.withColumn("sid", F.row_number().over(Window.partitionBy("image").orderBy(*order)).cast("long"))


def scores(segments: DataFrame, width: int, height: int) -> DataFrame:
    """quality, edge flag and priority (0.60 area share of the largest, 0.25 quality, 0.15 edge)."""
    largest = F.max("area").over(Window.partitionBy("image"))
    edge = touches_edge(F.col("x"), F.col("y"), F.col("w"), F.col("h"), width, height)
    return (
        segments.withColumn("quality", F.col("iou") * F.col("stab"))
        .withColumn("edge", edge)
        .withColumn(
            "priority",
            0.60 * (F.col("area") / F.when(largest == 0, 1).otherwise(largest)) + 0.25 * F.col("quality") + 0.15 * F.col("edge").cast("double"),
        )
    )


def column_intervals(segments: DataFrame, height: int) -> DataFrame:
    """Intervals of boxes in column-major order."""
    spread = segments.select("image", "sid", "area", "y", "h", F.explode(F.sequence(F.col("x"), F.col("x") + F.col("w") - 1)).alias("c"))
    start = F.col("c") * height + F.col("y")
    return spread.select("image", "sid", start.alias("s"), (start + F.col("h")).alias("e"), "area")


def box_runs(of: Callable[[str], Column], height: int) -> tuple[Column, Column]:
    """Starts and ends of the column-major runs of a box as arrays; ``of`` gives its x, y, w and h."""
    x, y, w, h = (of(c).cast("int") for c in "xywh")
    first = x * height + y
    last = first + (w - 1) * height

    def places(more: Column) -> Column:
        return F.when((w > 0) & (h > 0), F.sequence(first + more, last + more, F.lit(height))).otherwise(F.array().cast("array<int>"))

    return places(F.lit(0)), places(h)


def box_pairs(segments: DataFrame) -> DataFrame:
    """Pairs of an image's segments whose boxes share a positive area."""
    a = segments.select("image", *[F.col(c).alias(f"{c}_i") for c in ("sid", "x", "y", "w", "h", "area")])
    b = segments.select("image", *[F.col(c).alias(f"{c}_j") for c in ("sid", "x", "y", "w", "h", "area")])
    meets: Column = F.col("sid_i") < F.col("sid_j")
    for axis, side in (("x", "w"), ("y", "h")):
        meets &= F.col(f"{axis}_i") < F.col(f"{axis}_j") + F.col(f"{side}_j")
        meets &= F.col(f"{axis}_j") < F.col(f"{axis}_i") + F.col(f"{side}_i")
    return a.join(b, "image").filter(meets)


def overlap_measures(segments: DataFrame, own: DataFrame) -> DataFrame:
    """Overlap, IoU and containment (overlap over the smaller area) of pairs that share pixels.

    Areas travel with the intervals, so that no join brings them back."""
    carried = own.join(segments.select("image", "sid", "area"), ["image", "sid"]) if "area" not in own.columns else own
    a = carried.select("image", F.col("sid").alias("sid_i"), F.col("area").alias("area_i"), "s", "e")
    b = carried.select("image", F.col("sid").alias("sid_j"), F.col("area").alias("area_j"), "s", "e")
    return measured(intervals.overlaps(a, b, "image", "sid_i", "sid_j", F.col("sid_i") < F.col("sid_j"), carried=("area_i", "area_j")))


def measured(overlaps: DataFrame) -> DataFrame:
    area_i, area_j = F.col("area_i"), F.col("area_j")
    return overlaps.select(
        "image",
        "sid_i",
        "sid_j",
        "area_i",
        "area_j",
        "overlap",
        ratio(F.col("overlap"), area_i + area_j - F.col("overlap")).alias("iou"),
        ratio(F.col("overlap"), F.least(area_i, area_j)).alias("containment"),
    )


def ordered_masks(segments: DataFrame, order: list[str | Column], carried: list[str], starts: Column, ends: Column) -> DataFrame:
    """Segments image by image in this order, which ``_step`` counts from 1, with their masks: rising disjoint runs in two
    array columns. Segments that are dealt by image already stay where they are; the arrays are made after they are put in
    order."""
    steps = segments.withColumn("_step", F.row_number().over(Window.partitionBy("image").orderBy(*order)))
    return steps.select("image", "sid", "_step", *carried, starts.alias("_starts"), ends.alias("_ends"))


def sql_types(segments: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in segments.schema.fields}


def overlap_measures_in_turn(segments: DataFrame, starts: Column, ends: Column) -> DataFrame:
    """What ``overlap_measures`` says of segments (image, sid, area) with masks of one row each. One image after another is
    compared by its runs; neither runs nor pairs are dealt or joined. A task holds one image's masks and some of its pairs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(parts):
            masks = Masks.of(table.column("_starts"), table.column("_ends"))
            for i, j, overlap in meeting(masks, owners(table.column("image"), at)):
                a, b = (table.select(["image", "sid", "area"]).take(pa.array(x)) for x in (i, j))
                columns = {"image": a["image"], "sid_i": a["sid"], "sid_j": b["sid"], "area_i": a["area"], "area_j": b["area"], "overlap": pa.array(overlap)}
                yield from pa.table(columns).to_batches(max_chunksize=1 << 16)

    kind = sql_types(segments)
    schema = f"image {kind['image']}, sid_i {kind['sid']}, sid_j {kind['sid']}, area_i {kind['area']}, area_j {kind['area']}, overlap long"
    return measured(ordered_masks(segments, ["sid"], ["area"], starts, ends).mapInArrow(run, schema))


def group_ids(segments: DataFrame, measures: DataFrame, threshold: float = DUPLICATE_IOU) -> DataFrame:
    """The smallest segment id reachable over pairs with IoU from the threshold on, for every segment.

    Components are found image by image, on the pairs that link only; an image's pairs are few."""
    linked = measures.filter(F.col("iou") >= threshold).select("image", "sid_i", "sid_j")

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs come sorted by image; one image's links are held at a time."""
        at: int | None = None
        up: dict[int, int] = {}

        def root(i: int) -> int:
            while up.setdefault(i, i) != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for part in batches:
            out: list[tuple[int, int, int]] = []
            for image, i, j in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if image != at:
                    out += [(at, sid, root(sid)) for sid in list(up)]
                    at, up = image, {}
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
            yield rows(out)
        yield rows([(at, sid, root(sid)) for sid in list(up)])

    def rows(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["image", "sid", "group_id"])

    dealt = linked.repartition("image").sortWithinPartitions("image")
    grouped = dealt.mapInArrow(closed, "image long, sid long, group_id long")
    joined = segments.join(grouped, ["image", "sid"], "left")
    return joined.withColumn("group_id", F.coalesce("group_id", "sid"))


def represented_in_turn(segments: DataFrame, starts: Column, ends: Column, order: list[str | Column], threshold: float = DUPLICATE_IOU) -> DataFrame:
    """The group of each segment (image, sid), as ``group_ids`` names it, and as its representative the member that comes
    first in ``order``. Masks are rows, as in ``overlap_measures_in_turn``, and images are worked on in the same way."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(parts):
            masks, sid = Masks.of(table.column("_starts"), table.column("_ends")), table.column("sid").to_numpy()
            first = classes(masks, owners(table.column("image"), at), threshold)
            least = sid.copy()
            np.minimum.at(least, first, sid)
            told = table.select(["image", "sid"]).append_column("group_id", pa.array(least[first])).append_column("representative", pa.array(sid[first]))
            yield from told.to_batches()

    kind = sql_types(segments)
    schema = f"image {kind['image']}, sid {kind['sid']}, group_id {kind['sid']}, representative {kind['sid']}"
    return ordered_masks(segments, order, [], starts, ends).mapInArrow(run, schema)


def group_counts_in_turn(segments: DataFrame, starts: Column, ends: Column, threshold: float = DUPLICATE_IOU) -> DataFrame:
    """Groups and members of each image, of segments and masks as in ``represented_in_turn``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(parts):
            masks = Masks.of(table.column("_starts"), table.column("_ends"))
            first = classes(masks, owners(table.column("image"), at), threshold)
            groups = np.add.reduceat(first == np.arange(len(first)), at[:-1], dtype=np.int64)
            columns = {"image": table.column("image").take(pa.array(at[:-1])), "groups": pa.array(groups), "members": pa.array(np.diff(at).astype(np.int64))}
            yield from pa.table(columns).to_batches()

    return ordered_masks(segments, ["sid"], [], starts, ends).mapInArrow(run, f"image {sql_types(segments)['image']}, groups long, members long")


def visible_in_turn(segments: DataFrame, starts: Column, ends: Column, covers: Column, threshold: float = DUPLICATE_IOU, least: float = HIDDEN) -> DataFrame:
    """What ``visible`` says of the representatives of segments (image, sid, area, quality, priority) that the union of the
    covering ones hides; these are not hidden. Masks are rising disjoint runs in two array columns.

    Image by image the segments are compared with each other by their runs, joined to groups, named, covered and ranked:
    neither runs nor pairs are dealt or joined, and segments that are dealt by image already stay where they are. The arrays
    are made after the segments are put in order."""
    own = Window.partitionBy("image").orderBy("sid")
    marks = [F.col(c).cast("double").alias(c) for c in ("area", "quality", "priority")]
    steps = segments.withColumn("_step", F.row_number().over(own))
    ordered = steps.select("image", "sid", "_step", *marks, F.coalesce(covers, F.lit(False)).alias("_covers"), starts.alias("_starts"), ends.alias("_ends"))

    def falling(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys, the last first, by which values fall and those that are missing come last."""
        return -values, np.isnan(values)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(parts):
            image, n = np.repeat(np.arange(len(at) - 1), np.diff(at)), table.num_rows
            area, quality, priority = (table.column(c).to_numpy() for c in ("area", "quality", "priority"))
            covering = table.column("_covers").to_numpy()
            masks = Masks.of(table.column("_starts"), table.column("_ends"))
            links = [np.zeros((2, 0), dtype=np.int64), *map(np.stack, alike(masks, image, threshold))]
            group = least_reachable(n, *np.concatenate(links, axis=1))
            # rows are in order of sid, which decides what is left
            order = np.lexsort((*falling(area), *falling(quality), group))
            leads = np.zeros(n, dtype=bool)
            leads[order[np.flatnonzero(np.diff(group[order], prepend=-1))]] = True
            cover = united(masks, np.where(covering, image, -1), len(at) - 1)
            covered = shared(masks, np.arange(n), cover, image) / np.where(area == 0, np.inf, area)
            shown = np.flatnonzero(leads & (covering | ~(covered >= least)))
            shown = shown[np.lexsort((*falling(priority[shown]), image[shown]))]
            first = np.searchsorted(image[shown], image[shown])
            told = table.select(["image", "sid"]).take(pa.array(shown)).append_column("shown_rank", pa.array(np.arange(len(shown)) - first + 1))
            yield from told.to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in segments.schema.fields}
    return ordered.mapInArrow(run, f"image {kinds['image']}, sid {kinds['sid']}, shown_rank long")


def representatives(grouped: DataFrame) -> DataFrame:
    """Of each group the member with the best quality, then the largest area, then the smallest id."""
    best = Window.partitionBy("image", "group_id").orderBy(F.desc("quality"), F.desc("area"), "sid")
    return grouped.withColumn("representative", F.first("sid").over(best)).withColumn("is_representative", F.col("sid") == F.col("representative"))


def nearest_parents(measures: DataFrame, threshold: float = DUPLICATE_IOU, contained: float = CONTAINED) -> DataFrame:
    """For a segment that lies in larger ones (containment from ``contained`` on, IoU below the threshold) the smallest
    of these, by area and id."""
    nested = measures.filter((F.col("iou") < threshold) & (F.col("containment") >= contained))
    smaller_j = (F.col("area_j") < F.col("area_i")) | ((F.col("area_j") == F.col("area_i")) & (F.col("sid_j") > F.col("sid_i")))
    pairs = nested.select(
        "image",
        F.when(smaller_j, F.col("sid_j")).otherwise(F.col("sid_i")).alias("sid"),
        F.when(smaller_j, F.struct(F.col("area_i").alias("area"), F.col("sid_i").alias("parent")))
        .otherwise(F.struct(F.col("area_j").alias("area"), F.col("sid_j").alias("parent")))
        .alias("p"),
    )
    return pairs.groupBy("image", "sid").agg(F.min("p").alias("p")).select("image", "sid", F.col("p.parent").alias("parent_sid"))


def nearest_parents_in_turn(segments: DataFrame, starts: Column, ends: Column, threshold: float = DUPLICATE_IOU, contained: float = CONTAINED) -> DataFrame:
    """What ``nearest_parents`` says of the pairs of ``overlap_measures_in_turn``, without making rows of these."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(parts):
            masks = Masks.of(table.column("_starts"), table.column("_ends"))
            # rows are in order of sid, which decides between equal areas
            inner, outer = nearest(meeting(masks, owners(table.column("image"), at)), table.column("area").to_numpy(), threshold, contained)
            told = table.select(["image", "sid"]).take(pa.array(inner))
            yield from told.append_column("parent_sid", table.column("sid").take(pa.array(outer))).to_batches()

    kind = sql_types(segments)
    return ordered_masks(segments, ["sid"], ["area"], starts, ends).mapInArrow(run, f"image {kind['image']}, sid {kind['sid']}, parent_sid {kind['sid']}")


def hits(segments: DataFrame, points: DataFrame, own: DataFrame, height: int) -> DataFrame:
    """Segments under each point, ranked by area and id; points are few and go to every task. Boxes sort out, and the exact
    column-major intervals decide."""
    inside = (
        (F.col("px") >= F.col("x")) & (F.col("px") < F.col("x") + F.col("w")) & (F.col("py") >= F.col("y")) & (F.col("py") < F.col("y") + F.col("h"))
    )
    boxed = segments.join(F.broadcast(points), inside).select("image", "sid", "area", "px", "py", (F.col("px").cast("long") * height + F.col("py")).alias("at"))
    found = boxed.join(own.select("image", "sid", "s", "e"), ["image", "sid"]).filter((F.col("at") >= F.col("s")) & (F.col("at") < F.col("e")))
    rank = F.row_number().over(Window.partitionBy("image", "px", "py").orderBy("area", "sid")).cast("long")
    return found.select("image", "px", "py", "sid", rank.alias("hit_rank"))


def visible(represented: DataFrame, covered: DataFrame, least: float = HIDDEN) -> DataFrame:
    """Representatives that are not covered, ranked by priority falling and id rising."""
    shown = represented.filter("is_representative").join(covered.filter(F.col("covered") >= least).select("image", "sid"), ["image", "sid"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("image").orderBy(F.desc("priority"), "sid")).cast("long")
    return shown.select("image", "sid", rank.alias("shown_rank"))
