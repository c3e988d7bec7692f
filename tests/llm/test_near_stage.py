"""The near-duplicate stage on blocks that many texts share."""

import numpy as np
from pyspark.sql import functions as F

from regionspark.llm import simhash


def test_a_pair_that_shares_one_crowded_sketch_links(spark):
    rng = np.random.default_rng(3)
    names = (*simhash.WIDE_COLUMNS, *simhash.SIGNATURE_COLUMNS)
    rows = []
    for i in range(60):
        bits = rng.integers(-(1 << 62), 1 << 62, len(names)).tolist()
        keys = [7, *(1000 * i + c for c in range(1, simhash.SKETCHES))]  # all share the first sketch and no other
        rows.append([i, *bits, 100 + i, keys])
    for a, b, size in ((3, 50, 124), (10, 11, 100), (20, 40, 130)):
        rows[b][1:-2], rows[a][-2], rows[b][-2] = rows[a][1:-2], 100, size
    frame = spark.createDataFrame(rows, f"id long, {', '.join(f'{c} long' for c in names)}, size long, keys array<long>")
    for hot in (4096, 8):
        found = {(max(r.a, r.b), min(r.a, r.b)) for r in simhash.similar_links(frame, 0.8, hot)[0].collect()}
        assert {(50, 3), (11, 10)} <= found <= {(50, 3), (11, 10), (40, 20)}


def test_links_are_decided_by_the_sets(spark):
    """Pairs of similarity 176/216 go, pairs of 171/221 stay."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        rows.append((i, " ".join(words)))
        for k in range(4 if i < 60 else 5):
            words[10 + 30 * k] = f"new{i}x{k}"
        rows.append((1000 + i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (4096, 8):
        kept = {r.doc_id for r in simhash.drop_near_copies(frame, hot=hot).collect()}
        assert kept == {*range(120), *range(1060, 1120)}


def test_exact_forest_is_that_of_all_pairs():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(60)]
    links = simhash.exact_forest(np.zeros((60, simhash.SIGNED), np.uint64), sets, 0.5, 0)
    up = list(range(60))
    for j, i in links:
        up = [up[i] if x == up[j] else x for x in up]
    for i in range(60):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if shared >= 0.5 * (len(sets[i]) + len(sets[j]) - shared):
                assert up[i] == up[j]
    assert all(len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j])) for j, i in links)


def test_a_crowded_group_of_near_copies(spark):
    """Components against all pairs, where many copies of one text share all blocks; star or not."""
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 150)]
    rows = []
    for i in range(90):
        words = list(base) if i % 3 else base[:80] + [f"v{x}" for x in rng.integers(0, 10**6, 70)]
        for k in rng.choice(30, rng.integers(0, 5), replace=False):
            words[5 * k] = f"new{i}x{k}"
        rows.append((i, " ".join(words)))
    rows += [(200, rows[1][1]), (None, "x"), (300, None), (301, "")]
    sets = {i: set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for i, t in rows if i is not None}
    up = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((up[i], up[j]))
                up = {x: a if r == b else r for x, r in up.items()}
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    clashing = ("_kept_id", "_wanted", "id", "hub", "star", "m", "k", "keys", "size", "shingles")
    wide = frame.select("*", *[F.lit(1).alias(c) for c in clashing])
    for hot in (4096, 16, 4):
        left = simhash.drop_near_copies(wide, hot=hot)
        assert left.columns == wide.columns
        assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted({r for r in up.values()})
    assert simhash.drop_near_copies(frame.limit(0)).count() == 0
