"""Set algebra on half-open intervals of a flat index.

A mask is a set of rows (image, s, e). All set operations are one sweep: starts and ends become events, running sums
over the events of a block of an image give how many members of each side cover each elementary interval, and a predicate
on those depths selects the result, whose touching pieces are joined. It sorts events once and never expands pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio
from ..plans.packed import Masks, whole_groups

#: Bits of the width of the buckets by which overlapping intervals meet in an equi-join.
SHIFT = 6
#: Bits of the width of the blocks that a sweep splits an image into.
SWEEP_SHIFT = 10


def run_counts(intervals: DataFrame, keys: list[str], size: Column, members: DataFrame | None = None) -> DataFrame:
    """Alternating background and foreground lengths of each member, starting with background. With the members, those
    without intervals are all background."""
    own = Window.partitionBy(*keys).orderBy("s")
    gaps = intervals.withColumn("gap", F.col("s") - F.coalesce(F.lag("e").over(own), F.lit(0)))
    grouped = gaps.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("s", "gap", (F.col("e") - F.col("s")).alias("n")))).alias("runs"), F.max("e").alias("end")
    )
    counts = F.flatten(F.transform("runs", lambda r: F.array(r["gap"], r["n"])))
    rest = size - F.col("end")
    found = grouped.select(*keys, F.when(rest > 0, F.concat(counts, F.array(rest))).otherwise(counts).alias("counts"))
    if members is None:
        return found
    return members.select(*keys).join(found, keys, "left").withColumn("counts", F.coalesce("counts", F.array(size.cast("long"))))


def decode_runs(members: DataFrame, keys: list[str], counts: str = "counts") -> DataFrame:
    """Intervals of the foreground runs of alternating lengths."""
    runs = members.select(*keys, F.posexplode(counts).alias("i", "n"))
    upto = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = runs.withColumn("e", F.sum("n").over(upto)).filter("i % 2 = 1 and n > 0")
    return ends.select(*keys, (F.col("e") - F.col("n")).alias("s"), "e")


def overlaps(a: DataFrame, b: DataFrame, group: str, a_id: str, b_id: str, extra: Column | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """Total overlap of members of a and b in a group: an equi-join on buckets of the flat index, with intervals clipped
    to the buckets so that no overlap counts twice. Columns to be ``carried`` hold one value for a member of their side."""

    def cut(df: DataFrame, s: str, e: str, i: str) -> DataFrame:
        first, last = F.shiftright("s", SHIFT), F.shiftright(F.col("e") - 1, SHIFT)
        own = [i, *[c for c in carried if c in df.columns]]
        spread = df.select(group, *own, "s", "e", F.explode(F.sequence(first, last)).alias("bucket"))
        low, high = F.shiftleft("bucket", SHIFT), F.shiftleft(F.col("bucket") + 1, SHIFT)
        return spread.select(group, *own, "bucket", F.greatest("s", low).alias(s), F.least("e", high).alias(e))

    left, right = cut(a, "s1", "e1", a_id), cut(b, "s2", "e2", b_id)
    met = left.join(right, [group, "bucket"]).filter((F.col("s1") < F.col("e2")) & (F.col("s2") < F.col("e1")))
    if extra is not None:
        met = met.filter(extra)
    part = F.least("e1", "e2") - F.greatest("s1", "s2")
    return met.groupBy(group, a_id, b_id, *carried).agg(F.sum(part).alias("overlap"))


def sweep(sides: dict[str, DataFrame], group: str = "image", shift: int = SWEEP_SHIFT) -> DataFrame:
    """Elementary intervals with the number of intervals of each side that cover them, where any does or did before in its
    block.

    Intervals are cut at the borders of blocks of the flat index, so that each block is swept by itself and an image that
    holds much of the data is many tasks. A side is read once; events at one place need no order, since the pieces between
    them are empty and drop out."""
    events = None
    for name, df in sides.items():
        blocks = F.explode(F.sequence(F.shiftright("s", shift), F.shiftright(F.col("e") - 1, shift))).alias("_block")
        spread = df.filter("s < e").select(group, "s", "e", blocks)
        low, high = F.greatest("s", F.shiftleft("_block", shift)), F.least("e", F.shiftleft(F.col("_block") + 1, shift))
        ends = F.explode(F.array(F.struct(low.alias("pos"), F.lit(1).alias("step")), F.struct(high.alias("pos"), F.lit(-1).alias("step"))))
        both = spread.select(group, "_block", ends.alias("_end"))
        own = both.select(group, "_block", F.col("_end.pos").alias("pos"), *[(F.col("_end.step") if n == name else F.lit(0)).alias(n) for n in sides])
        events = own if events is None else events.unionByName(own)
    order = Window.partitionBy(group, "_block").orderBy("pos")
    depth = order.rowsBetween(Window.unboundedPreceding, 0)
    out = events.select(group, F.col("pos").alias("s"), F.lead("pos").over(order).alias("e"), *[F.sum(n).over(depth).alias(n) for n in sides])
    return out.filter("s < e")


def combine(sides: dict[str, DataFrame], keep: Callable[[dict[str, Column]], Column], group: str = "image") -> DataFrame:
    """The intervals where ``keep`` holds, given by side whether it covers; touching pieces are one."""
    pieces = sweep(sides, group).filter(keep({n: F.col(n) > 0 for n in sides})).select(group, "s", "e")
    order = Window.partitionBy(group).orderBy("s")
    starts = pieces.withColumn("new", F.when(F.lag("e").over(order) == F.col("s"), 0).otherwise(1))
    islands = starts.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(group, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).select(group, "s", "e")


def union(intervals: DataFrame, group: str = "image") -> DataFrame:
    return combine({"a": intervals}, lambda c: c["a"], group)


def exclude(base: DataFrame, removed: DataFrame) -> DataFrame:
    return combine({"a": base, "b": removed}, lambda c: c["a"] & ~c["b"])


def added_removed(c: dict[str, Column]) -> Column:
    return (c["a"] | c["b"]) & ~c["c"]


def add_remove(base: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    return combine({"a": base, "b": added, "c": removed}, added_removed)


def side_counts(members: DataFrame, starts: Column, ends: Column, sides: dict[str, Column], group: str = "image") -> DataFrame:
    """Pixels of each group (one with pixels at least) by the sides that cover them: ``pixels[k]`` are covered by the sides
    whose bits are set in k, the first side's being the lowest. Members are rows with runs in two array columns; a side is
    the union of the members for which its column is true.

    One sweep over the members of one group after another gives what any predicates on the sides count (``counted``).
    Members that are dealt by group already stay where they are; the arrays are made after they are put in order."""
    bits, none = len(sides), F.lit(False)
    which = sum((F.when(F.coalesce(c, none), 1 << i).otherwise(0) for i, c in enumerate(sides.values())), F.lit(0))
    order = Window.partitionBy(group).orderBy("_which")
    placed = members.withColumn("_which", which).withColumn("_step", F.row_number().over(order))
    ordered = placed.select(group, "_step", "_which", starts.alias("_starts"), ends.alias("_ends"))

    def swept(masks: Masks, which: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Pixels by sides of each group, whose members are those from one of ``at`` to the next."""
        owner, of = np.repeat(np.arange(len(at) - 1), np.diff(at))[masks.owner], which[masks.owner]
        kept = (masks.starts < masks.ends) & (of > 0)
        owner, of, starts, ends = owner[kept], of[kept], masks.starts[kept], masks.ends[kept]
        out = np.zeros((len(at) - 1) << bits, dtype=np.int64)
        if len(owner):
            # an event is one number: group and place, then the sides, then whether a run ends
            span = int(ends.max()) + 1
            events = np.sort(np.concatenate([((owner * span + p) << (bits + 1)) | (of << 1) | last for p, last in ((starts, 0), (ends, 1))]))
            place, step = events >> (bits + 1), 1 - 2 * (events & 1)
            covering = np.zeros(len(events), dtype=np.int64)
            for i in range(bits):
                covering |= (np.cumsum(step * (events >> (i + 1) & 1)) > 0).astype(np.int64) << i
            size = np.diff(place)
            met = np.flatnonzero((size > 0) & (covering[:-1] > 0))
            np.add.at(out, (place[met] // span << bits) + covering[met], size[met])
        return out.reshape(-1, 1 << bits)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(parts):
            masks = Masks.of(table.column("_starts"), table.column("_ends"))
            found = swept(masks, np.asarray(table.column("_which")).astype(np.int64), at)
            some = np.flatnonzero(found.any(axis=1))
            if len(some):
                pixels = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) << bits, pa.array(found[some].ravel()))
                groups = table.column(group).take(pa.array(at[some])).combine_chunks()
                yield pa.RecordBatch.from_arrays([groups, pixels], names=[group, "pixels"])

    return ordered.mapInArrow(run, f"`{group}` {members.schema[group].dataType.simpleString()}, pixels array<long>")


def counted(sides: list[str], keep: Callable[[dict[str, bool]], bool]) -> Column:
    """Of ``pixels`` by sides, those where ``keep`` holds, given by side whether it covers."""
    out = F.lit(0).cast("long")
    for k in range(1, 1 << len(sides)):
        if keep({n: np.bool_(k >> i & 1) for i, n in enumerate(sides)}):
            out = out + F.get("pixels", F.lit(k))
    return out


def resolved_base(images: DataFrame, existing: DataFrame, size: int, whole: bool) -> DataFrame:
    """The base mask of each image: the existing one, else all of the canvas or nothing. An existing mask without
    foreground is a row of ``existing`` without extent (s = e); intervals beyond the canvas raise an error."""
    checked = existing.withColumn("e", F.when(F.col("e") <= size, F.col("e")).otherwise(F.raise_error(F.lit("the mask has another size")).cast("long")))
    if not whole:
        return checked.filter("s < e").select("image", "s", "e")
    missing = images.select("image").distinct().join(existing.select("image"), "image", "left_anti")
    full = missing.select("image", F.lit(0).cast("long").alias("s"), F.lit(size).cast("long").alias("e"))
    return checked.filter("s < e").select("image", "s", "e").unionByName(full)


def composed(mode: str, images: DataFrame, existing: DataFrame, kept: DataFrame, removed: DataFrame, size: int) -> DataFrame:
    """The final mask by mode: ``exclude_remove`` takes the removed members from the base (the whole canvas where it is
    missing), ``keep_only`` is the kept members, whatever is removed, ``add_remove`` adds the kept ones to the base (nothing
    where it is missing) and takes the removed ones away."""
    if mode == "exclude_remove":
        return exclude(resolved_base(images, existing, size, whole=True), removed)
    if mode == "keep_only":
        return union(kept)
    if mode == "add_remove":
        return add_remove(resolved_base(images, existing, size, whole=False), kept, removed)
    raise ValueError(f"unknown mode: {mode}")


def difference_counts(before: DataFrame, after: DataFrame, group: str = "image") -> DataFrame:
    """Pixels added, removed and kept between two masks."""
    size = F.col("e") - F.col("s")
    zero = F.lit(0).cast("long")
    return (
        sweep({"a": before, "b": after}, group)
        .groupBy(group)
        .agg(
            F.sum(F.when((F.col("a") <= 0) & (F.col("b") > 0), size).otherwise(zero)).alias("added"),
            F.sum(F.when((F.col("a") > 0) & (F.col("b") <= 0), size).otherwise(zero)).alias("removed"),
            F.sum(F.when((F.col("a") > 0) & (F.col("b") > 0), size).otherwise(zero)).alias("kept"),
        )
    )


def pixel_stats(mask: DataFrame, removed: DataFrame, size: int) -> DataFrame:
    """Foreground, removed and effective pixels (mask and not removed) and their shares of the canvas."""
    n = F.col("e") - F.col("s")
    zero = F.lit(0).cast("long")
    counts = (
        sweep({"a": mask, "b": removed})
        .groupBy("image")
        .agg(
            F.sum(F.when(F.col("a") > 0, n).otherwise(zero)).alias("base_pixels"),
            F.sum(F.when(F.col("b") > 0, n).otherwise(zero)).alias("removed_pixels"),
            F.sum(F.when((F.col("a") > 0) & (F.col("b") <= 0), n).otherwise(zero)).alias("effective_pixels"),
        )
    )
    return counts.withColumn("effective_ratio", ratio(F.col("effective_pixels"), F.lit(size)))


def covered_ratio(members: DataFrame, cover: DataFrame, areas: DataFrame) -> DataFrame:
    """Share of each member's area that a cover of disjoint intervals holds."""
    hit = overlaps(members, cover.withColumn("c", F.lit(0)), "image", "sid", "c").groupBy("image", "sid").agg(F.sum("overlap").alias("overlap"))
    joined = areas.join(hit, ["image", "sid"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0).cast("long")))
    return joined.select("image", "sid", ratio(F.col("overlap"), F.col("area")).alias("covered"))
