"""Masks and label maps as pixel relations (image, x, y, ...): thresholds, morphology, resizing, painting, relabelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rules by which grey values become foreground.
RULES = {"mask": lambda v: v > 127, "staged": lambda v: v > 0, "cut": lambda v: v == 255, "candidate": lambda v: v >= 128}


def binarised(value: Column, rule: str = "mask") -> Column:
    """255 or 0 by one of the rules; a missing value, as of an unreadable mask, is 255."""
    return F.when(value.isNull() | RULES[rule](value), 255).otherwise(0)


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets of an elliptic kernel: of each row the half width that the ellipse has there, rounded half to even."""
    size = max(1, size)
    r = c = size // 2
    if r == 0:
        return [(0, 0)]
    out = []
    for i in range(size):
        dy = i - r
        if abs(dy) <= r:
            dx = round(c * ((r * r - dy * dy) / (r * r)) ** 0.5)
            out += [(x - c, dy) for x in range(max(c - dx, 0), min(c + dx + 1, size))]
    return out


def moved(mask: DataFrame, offsets: list[tuple[int, int]], width: int, height: int) -> DataFrame:
    """The foreground pixels (image, x, y), each at all offsets, inside the image."""
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
    at = mask.select("image", "x", "y", F.explode(steps).alias("d")).select("image", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"))
    return at.filter((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))


def dilated(mask: DataFrame, size: int, width: int, height: int) -> DataFrame:
    """Foreground pixels after dilation: all that the kernel reaches from the foreground."""
    return moved(mask, [(-dx, -dy) for dx, dy in ellipse(size)], width, height).distinct()


def eroded(mask: DataFrame, size: int, width: int, height: int) -> DataFrame:
    """Foreground pixels after erosion: those around which the whole kernel, as far as it is inside, is foreground."""
    offsets = ellipse(size)
    hits = moved(mask, [(-dx, -dy) for dx, dy in offsets], width, height).groupBy("image", "x", "y").agg(F.count("*").alias("n"))
    inside = sum(((F.col("x") + dx >= 0) & (F.col("x") + dx < width) & (F.col("y") + dy >= 0) & (F.col("y") + dy < height)).cast("int") for dx, dy in offsets)
    return hits.filter(F.col("n") == inside).select("image", "x", "y")


def closed(mask: DataFrame, size: int, width: int, height: int) -> DataFrame:
    """Foreground pixels after dilation and erosion, which closes small holes."""
    return eroded(dilated(mask, size, width, height), size, width, height)


def resized(pixels: DataFrame, old: tuple[int, int], new: tuple[int, int], *values: str) -> DataFrame:
    """Pixels at another size (width, height), each with the values of the nearest old one (the place, scaled and rounded
    down)."""

    def targets(axis: str, was: int, becomes: int) -> Column:
        """New places whose scaled place falls on the old one."""
        every = F.sequence(F.floor(F.col(axis) * becomes / was) - 1, F.floor((F.col(axis) + 1) * becomes / was) + 1)
        return F.filter(every, lambda t: (t >= 0) & (t < becomes) & (F.expr(f"int({was})") * t >= F.col(axis) * becomes) & (F.expr(f"int({was})") * t < (F.col(axis) + 1) * becomes))

    wide = pixels.withColumn("_x", F.explode(targets("x", old[0], new[0]))).withColumn("_y", F.explode(targets("y", old[1], new[1])))
    return wide.select("image", F.col("_x").alias("x"), F.col("_y").alias("y"), *values)


def relabelled(pixels: DataFrame) -> DataFrame:
    """Labels as numbers from 1, in the order of the labels."""
    numbers = pixels.select("image", "label").distinct().withColumn("region", F.dense_rank().over(Window.partitionBy("image").orderBy("label")).cast("long"))
    return pixels.join(numbers, ["image", "label"])


def in_circle(x: Column, y: Column, cx: int, cy: int, radius: int) -> Column:
    return (x - cx) * (x - cx) + (y - cy) * (y - cy) <= radius * radius


def in_rectangle(x: Column, y: Column, x0: int, y0: int, x1: int, y1: int) -> Column:
    """Inside a rectangle of two corners, both included; one without extent holds nothing."""
    if x0 == x1 or y0 == y1:
        return F.lit(False)
    return x.between(min(x0, x1), max(x0, x1)) & y.between(min(y0, y1), max(y0, y1))


def in_polygon(x: Column, y: Column, corners: list[tuple[int, int]]) -> Column:
    """Inside a polygon by the even-odd rule, or on its border; under three corners hold nothing."""
    if len(corners) < 3:
        return F.lit(False)
    crossed, border = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]], strict=True):
        side = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
        border |= (side == 0) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by))
        if ay != by:
            above = (F.lit(ay) > y) != (F.lit(by) > y)
            left = side < 0 if by > ay else side > 0
            crossed = crossed + (above & left).cast("int")
    return border | (crossed % 2 == 1)


def in_stroke(x: Column, y: Column, points: list[tuple[int, int]], radius: int) -> Column:
    """Within ``radius`` of a line through the points, ends included; one point is a circle, none hold nothing."""
    inside = F.lit(False)
    for px, py in points:
        inside |= in_circle(x, y, px, py, radius)
    for (ax, ay), (bx, by) in zip(points, points[1:], strict=False):
        dx, dy = bx - ax, by - ay
        along, across = (x - ax) * dx + (y - ay) * dy, (x - ax) * dy - (y - ay) * dx
        inside |= along.between(0, dx * dx + dy * dy) & (across * across <= radius * radius * (dx * dx + dy * dy))
    return inside


def gradient(pixels: DataFrame, value: str) -> DataFrame:
    """The pixels with ``gradient``, the length of the 3 x 3 Sobel gradient of a column; beyond the border the image is
    mirrored without repeating its edge. Sums along rows come first, then along columns: one window each."""

    def sides(column: str, order: Window) -> tuple[Column, Column]:
        before, behind = F.lag(column).over(order), F.lead(column).over(order)
        return F.coalesce(before, behind, F.col(column)), F.coalesce(behind, before, F.col(column))

    rows, columns = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    left, right = sides(value, rows)
    flat = pixels.withColumn("_d", right - left).withColumn("_s", left + 2 * F.col(value) + right)
    above, below = sides("_d", columns)
    flat = flat.withColumn("_gx", above + 2 * F.col("_d") + below)
    above, below = sides("_s", columns)
    flat = flat.withColumn("_gy", below - above)
    return flat.withColumn("gradient", F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))).drop("_d", "_s", "_gx", "_gy")


def painted(pixels: DataFrame, shape: Column, add: bool) -> DataFrame:
    """Pixels (value) with a shape painted into or out of the mask."""
    return pixels.withColumn("value", F.when(shape, 255 if add else 0).otherwise(F.col("value")))


def without_small(components: DataFrame, least: int) -> DataFrame:
    """Pixels of components (image, component) of at least so many pixels."""
    sizes = components.groupBy("image", "component").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return components.join(sizes.select("image", "component"), ["image", "component"], "left_semi")


def connected_labels(components: DataFrame) -> DataFrame:
    """Regions that are connected each, from components of equal labels (image, label, component): the largest component
    of a label keeps its place before the others, and all are numbered from 1, by label, size falling and component."""
    sizes = components.groupBy("image", "label", "component").agg(F.count("*").alias("_n"))
    largest = F.row_number().over(Window.partitionBy("image", "label").orderBy(F.desc("_n"), "component"))
    ranked = sizes.withColumn("_first", largest == 1)
    number = F.row_number().over(Window.partitionBy("image").orderBy(F.desc("_first"), "label", F.desc("_n"), "component")).cast("long")
    return components.join(ranked.select("image", "label", "component", number.alias("region")), ["image", "label", "component"])


def signatures(samples: DataFrame, boxes: DataFrame, segments: DataFrame, intervals: DataFrame, height: int, most: int = 4) -> DataFrame:
    """Of each label (image, label) the segments that hold most of its sample points (image, label, x, y): the share
    held, times the segment's scores as guide, the best ``most`` by guide, share and id. Segments whose box meets the
    label's are looked at, and their exact pixels decide."""
    meets = (F.col("x") < F.col("x1")) & (F.col("x0") < F.col("x") + F.col("w")) & (F.col("y") < F.col("y1")) & (F.col("y0") < F.col("y") + F.col("h"))
    pairs = boxes.join(segments, "image").filter(meets).select("image", "label", "sid", "iou", "stab")
    points = samples.select("image", "label", (F.col("x") * height + F.col("y")).alias("at"), F.col("x").alias("c"))
    n = points.groupBy("image", "label").agg(F.count("*").alias("n"))
    runs = intervals.withColumn("c", F.explode(F.sequence(F.floor(F.col("s") / height), F.floor((F.col("e") - 1) / height))))
    held = (
        points.join(pairs, ["image", "label"]).join(runs, ["image", "sid", "c"]).filter((F.col("at") >= F.col("s")) & (F.col("at") < F.col("e")))
        .groupBy("image", "label", "sid", "iou", "stab").agg(F.count("*").alias("inside"))
    )
    shares = held.join(n, ["image", "label"]).withColumn("share", F.col("inside") / F.col("n"))
    guided = shares.withColumn("guide", F.col("share") * F.col("iou") * F.col("stab"))
    rank = F.row_number().over(Window.partitionBy("image", "label").orderBy(F.desc("guide"), F.desc("share"), "sid")).cast("long")
    return guided.withColumn("place", rank).filter(F.col("place") <= most).select("image", "label", "sid", "place", "share", "guide")
