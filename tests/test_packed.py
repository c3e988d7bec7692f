"""Operators on masks of one row each: the same results as on rows of runs, and nothing dealt but the lines themselves."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionspark import catalogue
from regionspark.operators import frames, intervals
from regionspark.operators import segments as seg
from regionspark.plans import packed

DATA = "/root/testdata/sf0.001"


def some_masks(rng, height, width, empty=()):
    """Rows (image, sid, starts, ends) of random masks, several images of several batches' sizes."""
    rows = []
    for image, members in ((1, 1), (2, 30), (3, 2), (None, 4)):
        for sid in range(1, members + 1):
            mask = rng.random((height, width)) < (0.0 if sid in empty else rng.choice([0.2, 0.5, 0.9]))
            flat = np.flatnonzero(np.diff(np.concatenate([[0], mask.T.ravel().astype(int), [0]]))).reshape(-1, 2)
            rows.append((image, sid, flat[:, 0].tolist(), flat[:, 1].tolist()))
    return rows


def test_frames_in_one_pass(spark):
    height, width = 7, 9
    rows = some_masks(np.random.default_rng(4), height, width, empty=(5, 6))
    rows = [(i or 9, *rest) for i, *rest in rows]
    packed = spark.createDataFrame(rows, "image long, sid long, starts array<int>, ends array<int>")
    masks = spark.createDataFrame([(i, sid, s, e) for i, sid, a, b in rows for s, e in zip(a, b, strict=True)], "image long, sid long, s long, e long")
    want = frames.changes(masks, frames.metrics(masks, packed, height, width), height)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = frames.followed(packed, F.col("starts"), F.col("ends"), height, width)
        assert got.columns == want.columns
        assert sorted(got.collect()) == sorted(want.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("name", ["frame_changes", "frame_warnings", "mask_save_check", "seg_visible_sorted"])
def test_only_lines_are_dealt(spark, name):
    frame = catalogue.queries()[name](spark, DATA)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) == 1, plan
    assert "Join" not in plan


def test_counts_by_sides(spark):
    rng = np.random.default_rng(8)
    rows = [(*row, bool(rng.random() < 0.6), bool(rng.random() < 0.5), bool(rng.random() < 0.3)) for row in some_masks(rng, 30, 50)]
    rows += [(7, 1, [], [], True, True, True), (8, 1, [3], [9], False, False, False), (2, 31, None, None, True, False, False)]
    packed = spark.createDataFrame(rows, "image long, sid long, starts array<int>, ends array<int>, a boolean, b boolean, c boolean")
    pixels = {}
    for image, _, starts, ends, *sides in rows:
        for name, own in zip("abc", sides, strict=True):
            pixels.setdefault(image, {n: set() for n in "abc"})[name] |= {k for s, e in zip(starts or [], ends or [], strict=True) for k in range(s, e) if own}
    want = {}
    for image, of in pixels.items():
        after = (of["a"] | of["b"]) - of["c"]
        if of["a"] | of["b"] | of["c"]:
            want[image] = (len(after), len(after ^ of["a"]))
    keep = intervals.added_removed
    names = ["a", "b", "c"]
    for size in (1, 4, 10000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found = intervals.side_counts(packed, F.col("starts"), F.col("ends"), {n: F.col(n) for n in names})
            counts = found.select("image", intervals.counted(names, keep), intervals.counted(names, lambda c: keep(c) != c["a"])).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {r[0]: (r[1], r[2]) for r in counts} == want and len(counts) == len(want)


def test_visible_in_one_pass(spark):
    rng = np.random.default_rng(6)
    boxes = [(image, sid, int(rng.integers(0, 6)), int(rng.integers(0, 6)), int(rng.integers(1, 9)), int(rng.integers(1, 9))) for image, n in ((1, 90), (2, 1), (3, 7)) for sid in range(n, 0, -1)]
    # a chain: neighbours are alike, its ends are not
    boxes += [(4, 9 - i, i, 0, 20, 30) for i in range(5)] + [(5, 1, 0, 0, 9, 9), (5, 2, 0, 0, 9, 9), (5, 3, 20, 0, 9, 9)]
    segments = spark.createDataFrame(boxes, "image long, sid long, x long, y long, w long, h long").withColumn("area", F.col("w") * F.col("h"))
    # marks that tie, and some that are missing
    segments = segments.withColumn("quality", F.when(F.col("sid") % 7 > 0, F.col("sid") % 3 / 2)).withColumn("priority", F.when(F.col("sid") % 4 > 0, F.col("x") / 4))
    height = 40
    own = seg.column_intervals(segments, height)
    named = seg.representatives(seg.group_ids(segments, seg.overlap_measures(segments, own)))
    covers = F.col("sid") % 5 == 1
    covered = intervals.covered_ratio(own, intervals.union(own.filter("sid % 5 = 1")), segments).filter("sid % 5 <> 1")
    want = seg.visible(named, covered)
    assert 0 < want.count() < named.filter("is_representative").count() < segments.count()
    for size in (1, 8, 10000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = seg.visible_in_turn(segments, *seg.box_runs(F.col, height), covers)
            assert got.columns == want.columns
            assert sorted(got.collect()) == sorted(want.collect())
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_alike_in_parts():
    rng = np.random.default_rng(3)
    starts = rng.integers(0, 30, 300)
    masks, group = packed.Masks(starts, starts + rng.integers(0, 30, 300), np.arange(301)), np.sort(rng.integers(0, 4, 300))
    want = set()
    for i in range(300):
        for j in range(i):
            overlap = max(0, min(masks.ends[i], masks.ends[j]) - max(starts[i], starts[j]))
            if group[i] == group[j] and overlap and overlap / (masks.pixels()[i] + masks.pixels()[j] - overlap) >= 0.6:
                want.add((j, i))
    for most in (1, 50, 1 << 18):
        got = [(min(i, j), max(i, j)) for a, b in packed.alike(masks, group, 0.6, most) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("name", ["seg_representatives", "seg_group_counts", "seg_duplicate_groups", "seg_overlap_iou_containment", "seg_nearest_parent"])
def test_segments_are_compared_where_they_are(spark, name):
    test_only_lines_are_dealt(spark, name)


def some_segments(spark):
    """Boxes that overlap, an image of one, a chain whose ends are not alike, equal boxes, and an image without a key."""
    rng = np.random.default_rng(11)
    boxes = [(image, sid, int(rng.integers(0, 6)), int(rng.integers(0, 6)), int(rng.integers(1, 9)), int(rng.integers(1, 9))) for image, n in ((1, 90), (2, 1), (3, 7)) for sid in range(n, 0, -1)]
    boxes += [(4, 9 - i, i, 0, 20, 30) for i in range(5)] + [(5, 1, 0, 0, 9, 9), (5, 2, 0, 0, 9, 9), (5, 3, 20, 0, 9, 9), (6, 1, 0, 0, 20, 30), (6, 2, 3, 3, 4, 4), (6, 3, 2, 2, 9, 9), (6, 4, 2, 2, 9, 9)]
    boxes += [(None, 1, 0, 0, 9, 9), (None, 2, 0, 0, 9, 9), (None, 3, 1, 1, 2, 2)]
    segments = spark.createDataFrame(boxes, "image long, sid long, x long, y long, w long, h long").withColumn("area", F.col("w") * F.col("h"))
    return segments.withColumn("quality", F.when(F.col("sid") % 7 > 0, F.col("sid") % 3 / 2))


def same_in_batches(spark, want, make):
    want = want.cache()
    rows = sorted(want.collect(), key=repr)
    assert rows
    for size in (1, 8, 10000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = make()
            assert got.columns == want.columns
            assert sorted(got.collect(), key=repr) == rows
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_represented_in_one_pass(spark):
    segments, height = some_segments(spark), 40
    own = seg.column_intervals(segments, height)
    want = seg.representatives(seg.group_ids(segments, seg.overlap_measures(segments, own)))
    assert want.filter("representative <> group_id").count() and want.filter("group_id < sid").count()
    best_first = [F.desc("quality"), F.desc("area"), "sid"]
    same_in_batches(spark, want.select("image", "sid", "group_id", "representative"), lambda: seg.represented_in_turn(segments, *seg.box_runs(F.col, height), best_first))


def test_classes_in_parts():
    rng = np.random.default_rng(5)
    starts = np.sort(rng.integers(0, 900, 300))
    masks, group = packed.Masks(starts, starts + rng.integers(1, 40, 300), np.arange(301)), np.sort(rng.integers(0, 3, 300))
    whole = packed.classes(masks, group, 0.6)
    assert 20 < len(set(whole.tolist())) < 290
    for most in (1, 7):
        assert (packed.classes(masks, group, 0.6, most) == whole).all()


def test_group_counts_in_one_pass(spark):
    segments, height = some_segments(spark), 40
    grouped = seg.group_ids(segments, seg.overlap_measures(segments, seg.column_intervals(segments, height)))
    want = grouped.groupBy("image").agg(F.count_distinct("group_id").alias("groups"), F.count("*").alias("members"))
    assert want.filter("1 < groups and groups < members").count()
    same_in_batches(spark, want, lambda: seg.group_counts_in_turn(segments, *seg.box_runs(F.col, height)))


def test_measures_in_one_pass(spark):
    segments, height = some_segments(spark), 40
    want = seg.overlap_measures(segments, seg.column_intervals(segments, height))
    assert want.count() > 1000
    same_in_batches(spark, want, lambda: seg.overlap_measures_in_turn(segments, *seg.box_runs(F.col, height)))


def test_meeting_in_parts():
    rng = np.random.default_rng(9)
    at = np.concatenate([[0], np.cumsum(rng.integers(0, 4, 120))])
    # of each mask three rising disjoint runs at most, some of them empty
    starts = np.concatenate([10 * np.arange(n) + rng.integers(0, 12) + rng.integers(0, 3, n) for n in np.diff(at)])
    masks, group = packed.Masks(starts, starts + rng.integers(0, 7, len(starts)), at), np.sort(rng.integers(-2, 3, 120))
    own = [{k for r in range(at[i], at[i + 1]) for k in range(masks.starts[r], masks.ends[r])} for i in range(120)]
    want = {(i, j, len(own[i] & own[j])) for j in range(120) for i in range(j) if group[i] == group[j] and own[i] & own[j]}
    assert len(want) > 300
    for most in (1, 5, 1 << 20):
        got = [row for part in packed.meeting(masks, group, most) for row in zip(*(x.tolist() for x in part), strict=True)]
        assert set(got) == want and len(got) == len(want)
        sizes = [len(part[0]) for part in packed.meeting(masks, group, most)]
        assert max(sizes) <= most


def test_nearest_parents_in_one_pass(spark):
    segments, height = some_segments(spark), 40
    want = seg.nearest_parents(seg.overlap_measures(segments, seg.column_intervals(segments, height)))
    same_in_batches(spark, want, lambda: seg.nearest_parents_in_turn(segments, *seg.box_runs(F.col, height)))
    masks = packed.Masks(np.array([0, 0, 5, 5, 6, 50]), np.array([100, 20, 15, 15, 7, 51]), np.arange(7))
    for most in (1, 2, 100):
        inner, outer = packed.nearest(packed.meeting(masks, np.zeros(6, dtype=np.int64), most), masks.pixels(), 0.85, 0.95)
        assert dict(zip(inner.tolist(), outer.tolist(), strict=True)) == {1: 0, 2: 1, 3: 1, 4: 2, 5: 0}
