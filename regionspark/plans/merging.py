"""Merge trees of regions: the neighbours that are cheapest to merge become one node, until an image is one node."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.documents import GUIDE_HIGH

#: Weights of the terms of a merge cost.
WEIGHTS = {"colour": 0.30, "texture": 0.10, "border": 0.30, "guide": 0.25, "size": 0.05}
#: Fixed value: the cost of a merge of nodes between which no priced edge is left.
FORCED = 1.0

PLAIN = ("area", "x0", "y0", "x1", "y1")
TREE = "image long, node_id long, left_id long, right_id long, parent_id long, level long, area long, x0 long, y0 long, x1 long, y1 long, cx double, cy double, merge_cost double"


class Forest:
    """The nodes of one image while they merge: leaves 0 to n - 1, then a node for each merge."""

    def __init__(self, leaves: pd.DataFrame, edges: pd.DataFrame, colours: tuple[str, ...], spreads: tuple[str, ...], weights: dict[str, float]) -> None:
        self.n, self.weights = len(leaves), weights
        most = 2 * self.n - 1
        self.columns = {c: np.zeros(most) for c in (*PLAIN, "cx", "cy", "std_lum", "mean_grad", *colours, *spreads)}
        for c, values in self.columns.items():
            values[: self.n] = leaves[c]
        self.colours, self.mixed = colours, ("cx", "cy", "std_lum", "mean_grad", *colours, *spreads)
        self.guide = [(int(i), float(s)) for i, s in zip(leaves["guide_id"].fillna(0), leaves["guide_score"].fillna(0.0), strict=True)]
        self.halves, self.parent, self.cost, self.level = [(-1, -1)] * self.n, [-1] * most, [0.0] * self.n, [0] * self.n
        self.seen = [0] * most  # how many merges next to it a node has seen
        self.near: dict[int, dict[int, np.ndarray]] = defaultdict(dict)  # border length and its gradient sum
        at = pd.Series(np.arange(self.n), index=leaves["label"])
        pairs = list(zip(at[edges["a"]].tolist(), at[edges["b"]].tolist(), edges["shared_length"], edges["mean_gradient"], strict=True))
        for a, b, length, gradient in pairs:
            self.near[a][b] = self.near[b][a] = np.array([length, gradient * length], dtype=np.float64)
        self.total = max(1.0, float(leaves["area"].sum()))
        gaps = [self._gaps(a, b) for a, b, _, _ in pairs]
        self.scale = [max(column, default=0.0) or 1.0 for column in ([g[0] for g in gaps], [g[1] for g in gaps], [p[3] for p in pairs])]
        self.offers: list[tuple] = []
        self.valid: dict[tuple[int, int], tuple] = {}  # the offer that holds for a pair
        self.of: dict[int, set[tuple[int, int]]] = defaultdict(set)  # pairs with an offer, of each node
        for a, b, _, _ in pairs:
            self.offer(min(a, b), max(a, b))

    def _gaps(self, a: int, b: int) -> tuple[float, float]:
        c = self.columns
        return math.sqrt(sum((c[k][a] - c[k][b]) ** 2 for k in self.colours)), math.hypot(c["std_lum"][a] - c["std_lum"][b], c["mean_grad"][a] - c["mean_grad"][b])

    def price(self, a: int, b: int) -> float:
        colour, texture = self._gaps(a, b)
        length, gradient = self.near[a].get(b, (0.0, 0.0))
        (id_a, score_a), (id_b, score_b) = self.guide[a], self.guide[b]
        strong = id_a and id_b and min(score_a, score_b) >= GUIDE_HIGH
        terms = {
            "colour": colour / self.scale[0],
            "texture": texture / self.scale[1],
            "border": gradient / length / self.scale[2] if length else 0.0,
            "guide": float(id_a != id_b) if strong else 0.5,
            "size": min(self.columns["area"][a], self.columns["area"][b]) / self.total,
        }
        return float(sum(self.weights[k] * min(v, 1.0) for k, v in terms.items()))

    def offer(self, a: int, b: int) -> None:
        made = (self.price(a, b), self.seen[a], self.seen[b], a, b)
        self.valid[a, b] = made
        self.of[a].add((a, b))
        self.of[b].add((a, b))
        heapq.heappush(self.offers, made)

    def expire(self, node: int) -> None:
        for pair in self.of.pop(node, ()):
            self.valid.pop(pair, None)

    def cheapest(self) -> tuple[float, int, int] | None:
        while self.offers:
            made = heapq.heappop(self.offers)
            if self.valid.get(made[3:]) is made:
                return made[0], made[3], made[4]
        return None

    def merge(self, a: int, b: int, cost: float) -> int:
        new, c = len(self.halves), self.columns
        area = c["area"][a] + c["area"][b]
        for k in self.mixed:
            c[k][new] = (c[k][a] * c["area"][a] + c[k][b] * c["area"][b]) / max(area, 1.0)
        c["area"][new] = area
        for k, better in (("x0", min), ("y0", min), ("x1", max), ("y1", max)):
            c[k][new] = better(c[k][a], c[k][b])
        self.guide.append(self.guide[a] if self.guide[a][1] >= self.guide[b][1] else self.guide[b])
        self.halves.append((a, b))
        self.cost.append(cost)
        self.level.append(max(self.level[a], self.level[b]) + 1)
        self.parent[a] = self.parent[b] = new
        around = self.near[new]
        for half, other in ((a, b), (b, a)):
            for n, border in self.near.pop(half, {}).items():
                if n != other:
                    self.near[n].pop(half)
                    around[n] = around[n] + border if n in around else border
            self.expire(half)
        for n, border in around.items():
            self.near[n][new] = border
            self.seen[n] += 1
            self.expire(n)
        for n in around:
            self.offer(n, new)
        return new

    def grow(self) -> None:
        roots = list(range(self.n))  # a heap of all that may still be a root
        for _ in range(self.n - 1):
            found = self.cheapest()
            if found is None:
                two: list[int] = []
                while len(two) < 2:
                    r = heapq.heappop(roots)
                    if self.parent[r] < 0:
                        two.append(r)
                cost, (a, b) = FORCED, two
            else:
                cost, a, b = found
            heapq.heappush(roots, self.merge(a, b, cost))


def merge_hierarchy(
    regions: DataFrame, edges: DataFrame, colours: tuple[str, ...] = ("mean_grad",), spreads: tuple[str, ...] = (), weights: dict[str, float] | None = None
) -> DataFrame:
    """The merge tree of each image: leaves 1 to K in the order of their labels, then a node for each merge, the root last.

    ``regions``: image, label, area, x0, y0, x1, y1, cx, cy, std_lum, mean_grad, colours, spreads, guide_id, guide_score
    (null: no guide); ``edges``: image, a, b, shared_length, mean_gradient. A merge costs the weighted sum of the
    differences of colour and texture and the border's gradient, each over its largest value among the first edges, the
    disagreement of the guides and the smaller area's share of the image, each 1 at most.

    The cheapest offer is taken, of equals the one whose ends have seen fewer merges next to them, then the lowest ids. After
    a merge all offers at the new node's neighbours expire and only those to the new node are made again, so the order is
    not that of all edges' costs. When no offer is left, the two lowest nodes merge at a cost of 1.

    Nodes without halves or parent have nulls there. Merging is sequential: an image's regions (never its pixels) are the
    rows of one task, and images are apart. Edges to labels that no region has are left out."""
    weights = WEIGHTS | (weights or {})
    extra = (*dict.fromkeys(("std_lum", "mean_grad", *colours, *spreads)),)
    names = [c.split()[0] for c in TREE.split(", ")]

    def run(leaves: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("label", ignore_index=True)
        if leaves.empty:
            return pd.DataFrame(columns=[*names, *extra])
        graph = graph[graph["a"].isin(leaves["label"]) & graph["b"].isin(leaves["label"])]
        forest = Forest(leaves, graph, colours, spreads, weights)
        forest.grow()
        ids = {"left_id": [a for a, _ in forest.halves], "right_id": [b for _, b in forest.halves], "parent_id": forest.parent}
        made = {c: pd.array([None if i < 0 else i + 1 for i in v], dtype="Int64") for c, v in ids.items()}
        count = len(forest.halves)
        plain = {c: forest.columns[c].astype(np.int64) for c in PLAIN}
        own = {c: forest.columns[c] for c in ("cx", "cy", *extra)}
        return pd.DataFrame({"image": leaves["image"].iloc[0], "node_id": np.arange(1, count + 1), **made, "level": forest.level, **plain, **own, "merge_cost": forest.cost})[[*names, *extra]]

    of_image = edges.select(F.col("image").alias("of_image"), "a", "b", F.col("shared_length").cast("double"), F.col("mean_gradient").cast("double"))
    wanted = regions.select(*dict.fromkeys(("image", "label", *PLAIN, "cx", "cy", *extra)), F.col("guide_id").cast("double"), F.col("guide_score").cast("double"))
    return wanted.groupBy("image").cogroup(of_image.groupBy("of_image")).applyInPandas(run, TREE + "".join(f", {c} double" for c in extra))
