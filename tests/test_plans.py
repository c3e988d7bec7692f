"""Merge trees, floods, partitions and jobs against brute force and small cases."""

import random

import numpy as np
import pandas as pd
import pytest

from regionspark.operators import jobs
from regionspark.plans import flooding, merging, partition


def brute_merges(leaves, edges):
    """Merges by scanning all offers ever made; an offer holds while both ends live and have seen no further merge."""
    nodes = {i: dict(r) for i, r in enumerate(leaves, 1)}
    seen, near = {i: 0 for i in nodes}, {i: {} for i in nodes}
    for a, b, length, gradient in edges:
        near[a][b] = near[b][a] = (length, length * gradient)
    total = sum(n["area"] for n in leaves)

    def gaps(a, b):
        x, y = nodes[a], nodes[b]
        colour = abs(x["mean_grad"] - y["mean_grad"])
        return colour, ((x["std_lum"] - y["std_lum"]) ** 2 + colour**2) ** 0.5

    most = [max([gaps(a, b)[i] for a, b, _, _ in edges], default=0) or 1 for i in (0, 1)]
    steepest = max([e[3] for e in edges], default=0) or 1

    def cost(a, b):
        x, y = nodes[a], nodes[b]
        length, total_gradient = near[a].get(b, (0, 0))
        border = total_gradient / length / steepest if length else 0
        strong = x["guide_id"] and y["guide_id"] and x["guide_score"] >= 0.15 and y["guide_score"] >= 0.15
        guide = 0.5 if not strong else 0 if x["guide_id"] == y["guide_id"] else 1
        colour, texture = gaps(a, b)
        return 0.3 * min(colour / most[0], 1) + 0.1 * min(texture / most[1], 1) + 0.3 * min(border, 1) + 0.25 * guide + 0.05 * min(x["area"], y["area"]) / total

    offers = [(cost(a, b), 0, 0, a, b) for a, b, _, _ in edges]
    alive, out = set(nodes), []
    while len(alive) > 1:
        holding = [o for o in offers if o[3] in alive and o[4] in alive and (seen[o[3]], seen[o[4]]) == o[1:3]]
        if holding:
            price, _, _, a, b = min(holding)
        else:
            price, (a, b) = 1.0, sorted(alive)[:2]
        c, x, y = len(nodes) + 1, nodes[a], nodes[b]
        area = x["area"] + y["area"]
        better = x if x["guide_score"] >= y["guide_score"] else y
        mean = {k: (x[k] * x["area"] + y[k] * y["area"]) / area for k in ("mean_grad", "std_lum")}
        nodes[c] = {"area": area, "guide_id": better["guide_id"], "guide_score": better["guide_score"]} | mean
        alive = alive - {a, b} | {c}
        seen[c], near[c] = 0, {}
        for n in (set(near[a]) | set(near[b])) - {a, b}:
            ends = [near[h][n] for h in (a, b) if n in near[h]]
            near[c][n] = near[n][c] = tuple(map(sum, zip(*ends, strict=True)))
            near[n].pop(a, None), near[n].pop(b, None)
            seen[n] += 1
        offers += [(cost(n, c), seen[n], 0, n, c) for n in near[c]]
        out.append((a, b, round(price, 9)))
    return out


def test_merge_trees(spark):
    rng, rows, links, want = random.Random(5), [], [], {}
    for image in range(12):
        n = rng.choice([1, 2, 5, 12, 30])
        own = [
            {"area": rng.randint(1, 9), "mean_grad": float(rng.randint(0, 4)), "std_lum": float(rng.randint(0, 2)), "guide_id": rng.randint(0, 2), "guide_score": rng.choice([0.1, 0.5])}
            for _ in range(n)
        ]
        edges = [(a, b, rng.randint(1, 5), float(rng.randint(0, 3))) for a in range(1, n + 1) for b in range(a + 1, n + 1) if rng.random() < 3 / n and (image % 3 or a % 2 == b % 2)]
        want[image] = brute_merges(own, edges)
        rows += [{"image": image, "label": i, "x0": i, "y0": 0, "x1": i + 1, "y1": 1, "cx": float(i), "cy": 0.0} | r for i, r in enumerate(own, 1)]
        links += [(image, *e) for e in edges]
    regions = spark.createDataFrame(pd.DataFrame(rows))
    graph = spark.createDataFrame(links, "image long, a long, b long, shared_length long, mean_gradient double")
    tree = merging.merge_hierarchy(regions, graph).toPandas()
    for image, own in tree.groupby("image"):
        own = own.sort_values("node_id")
        inner = own[own["left_id"].notna()]
        got = [(int(a), int(b), round(c, 9)) for a, b, c in zip(inner["left_id"], inner["right_id"], inner["merge_cost"], strict=True)]
        assert got == want[image]
        assert own["parent_id"].isna().sum() == 1  # the root
        root = own.iloc[-1]
        assert root["area"] == own[own["left_id"].isna()]["area"].sum()
    empty = merging.merge_hierarchy(regions.limit(0), graph)
    assert empty.count() == 0  # edges without regions


def test_seeds():
    assert flooding.seed_spacing(100, 80, None, 80) == 10
    assert flooding.seed_spacing(5, 5, 1) == 2
    seeds = flooding.grid_seeds(5, 9, 4)
    assert {(y, x): int(seeds[y, x]) for y, x in zip(*np.nonzero(seeds), strict=True)} == {(2, 2): 1, (2, 6): 2}
    assert flooding.grid_seeds(1, 1, 4).tolist() == [[1]]


def test_flood_stops_at_an_edge():
    image = np.zeros((7, 11, 3), dtype=np.int64)
    image[:, 6:] = 200
    seeds = np.zeros((7, 11), dtype=np.int64)
    seeds[3, 2], seeds[3, 9] = 1, 2
    labels = flooding.flooded(seeds, image)
    assert (labels[[0, -1]] == -1).all() and (labels[:, [0, -1]] == -1).all()
    inner = labels[1:-1, 1:-1]
    assert (inner[:, :4] == 1).all() and (inner[:, 6:] == 2).all()
    whole = flooding.filled(labels, image)
    assert (whole[:, :5] == 1).all() and (whole[:, 7:] == 2).all()


def brute_filled(labels, colours):
    labels = labels.copy()
    height, width = labels.shape
    for _ in range(height + width):
        took = {}
        for y, x in zip(*np.nonzero(labels <= 0), strict=True):
            near = [(y + dy, x + dx) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)) if 0 <= y + dy < height and 0 <= x + dx < width and labels[y + dy, x + dx] > 0]
            if near:
                took[y, x] = min((float(np.float32(np.linalg.norm(colours[y, x] - colours[p]))), labels[p]) for p in near)[1]
        for p, label in took.items():
            labels[p] = label
    return np.where(labels <= 0, 1, labels)


def test_filling():
    rng = np.random.default_rng(3)
    for height, width in ((1, 1), (1, 6), (7, 9), (12, 5)):
        labels = rng.choice([-1, 0, 1, 2, 3], size=(height, width), p=[0.4, 0.3, 0.1, 0.1, 0.1])
        colours = rng.integers(0, 3, size=(height, width, 3)).astype(np.float32)
        assert (flooding.filled(labels, colours) == brute_filled(labels, colours)).all()


def test_partition(spark):
    rows = [(i, x, y, 250 if x > 9 else 5, 10 * i, 250 if y > 7 else 9) for i in (1, 2) for y in range(16) for x in range(20)]
    pixels = spark.createDataFrame(rows, "image long, x long, y long, red long, green long, blue long")
    labels, tree = partition.partition(pixels, spacing=5, min_area=4)
    found, nodes = labels.toPandas(), tree.toPandas()
    assert len(found) == len(rows)
    for image, own in found.groupby("image"):
        count = own["label"].max()
        assert set(own["label"]) == set(range(1, count + 1))
        of_image = nodes[nodes["image"] == image]
        assert len(of_image) == 2 * count - 1
        assert of_image["area"].max() == 320
        assert own.groupby("label").size().min() >= 4
    with pytest.raises(partition.BackendUnavailable):
        partition.base_labels(pixels, "slic")
    with pytest.raises(ValueError):
        partition.base_labels(pixels, "other")
    assert partition.base_labels(partition.coloured(pixels), spacing=5)[1] == "grid_watershed"


def test_memoised(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    folder = str(tmp_path / "index")
    assert jobs.memoised(spark, folder, {"source": "a"}, build)[1] == "built"
    assert jobs.memoised(spark, folder, {"source": "a"}, build)[1] == "reused"
    rows, state = jobs.memoised(spark, folder, {"source": "b"}, build)
    assert (state, rows.count()) == ("built", 2)
    assert jobs.memoised(spark, folder, {"source": "b"}, build, force=True)[1] == "built"
    for part in (tmp_path / "index" / "rows").glob("*.parquet"):
        part.write_bytes(b"broken")
    assert jobs.memoised(spark, folder, {"source": "b"}, build)[1] == "built"
    assert len(calls) == 4
