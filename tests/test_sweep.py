"""Set operations on masks against sets of pixels, over several blocks of the flat index."""

import random

from regionspark.operators import intervals


def test_set_operations_by_pixels(spark):
    rng = random.Random(9)
    sides = {name: [] for name in "abc"}
    for rows in sides.values():
        for image in range(4):
            for _ in range(rng.choice([0, 1, 6, 40])):
                start = rng.randrange(5000)
                rows.append((image, start, start + rng.choice([0, 1, 30, 1024, 2500])))
        rows += [(9, 0, 2048), (9, 1024, 3072), (9, 2048, 4096)]  # touch at the borders of blocks
    frames = {name: spark.createDataFrame(rows, "image long, s long, e long") for name, rows in sides.items()}
    pixels = {name: {(i, k) for i, s, e in rows for k in range(s, e)} for name, rows in sides.items()}

    def check(found, want):
        rows = sorted(tuple(r) for r in found.select("image", "s", "e").collect())
        assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(rows, rows[1:], strict=False))  # whole runs, none touch
        assert {(i, k) for i, s, e in rows for k in range(s, e)} == want

    check(intervals.union(frames["a"]), pixels["a"])
    check(intervals.exclude(frames["a"], frames["b"]), pixels["a"] - pixels["b"])
    check(intervals.add_remove(frames["a"], frames["b"], frames["c"]), (pixels["a"] | pixels["b"]) - pixels["c"])
    check(intervals.union(frames["a"].limit(0)), set())
    counts = {r.image: (r.added, r.removed, r.kept) for r in intervals.difference_counts(frames["a"], frames["b"]).collect()}
    for image, (added, removed, kept) in counts.items():
        a, b = ({k for i, k in pixels[n] if i == image} for n in "ab")
        assert (added, removed, kept) == (len(b - a), len(a - b), len(a & b))
