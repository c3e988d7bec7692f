"""Kernels that are sequential within an image and parallel over images."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(pixels: DataFrame, diagonal: bool = True) -> DataFrame:
    """Components of equal labels (8-connected or 4-connected), numbered by their first pixel in raster order."""
    steps = [(1, 0), (0, 1), (1, 1), (-1, 1)] if diagonal else [(1, 0), (0, 1)]

    def run(px: pd.DataFrame) -> pd.DataFrame:
        px = px.sort_values(["y", "x"], ignore_index=True)
        at = {(x, y): i for i, (x, y) in enumerate(zip(px["x"], px["y"], strict=True))}
        labels, up = px["label"].tolist(), list(range(len(px)))

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for (x, y), i in at.items():
            for dx, dy in steps:
                j = at.get((x + dx, y + dy))
                if j is not None and labels[i] == labels[j]:
                    a, b = root(i), root(j)
                    up[max(a, b)] = min(a, b)
        roots = [root(i) for i in range(len(px))]
        number = {r: n + 1 for n, r in enumerate(sorted(set(roots)))}
        return px.assign(component=np.array([number[r] for r in roots], dtype=np.int64))[["image", "k", "label", "component"]]

    return pixels.select("image", "k", "x", "y", "label").groupBy("image").applyInPandas(run, "image long, k long, label string, component long")


def _ends(to: np.ndarray) -> np.ndarray:
    """Where a walk along ``to`` ends from each position: at a fixed point, or at the first position on a cycle."""
    steps, far = 1, to
    while steps < len(to):
        far, steps = far[far], 2 * steps
    stops = np.isin(np.arange(len(to)), far)  # all that is still reached: fixed points and cycles
    end = np.where(stops, np.arange(len(to)), to)
    while (end[end] != end).any():
        end = end[end]
    return end


def small_regions_merged(regions: DataFrame, edges: DataFrame, min_area: int, colours: tuple[str, ...], passes: int = 64) -> DataFrame:
    """For each region (image, label, area, mean colours) the label it goes to after merging regions under ``min_area``.

    In each pass every small region picks the neighbour (edges: image, a, b) nearest in colour, from those that are not
    small if it has any, of equals the lowest label, and goes where its chain of picks ends; a region on a cycle of
    picks stays in that pass, so two small regions that pick each other stay apart. Areas and colours then add up.
    Regions are few against pixels: an image's regions and edges are one task's rows, its pixels never are."""

    def run(table: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("label", ignore_index=True)
        if table.empty:  # edges without regions
            return table.reindex(columns=["image", "label", "merged"])
        number = pd.Series(np.arange(len(table)), index=table["label"])
        area = table["area"].to_numpy(dtype=np.int64)
        total = table[list(colours)].to_numpy(dtype=np.float64) * area[:, None]
        a, b = number[graph["a"]].to_numpy(dtype=np.int64), number[graph["b"]].to_numpy(dtype=np.int64)
        own, other = np.concatenate([a, b]), np.concatenate([b, a])
        place = np.arange(len(table))
        for _ in range(passes):
            mean = total / np.maximum(area, 1)[:, None]
            small = (area > 0) & (area < min_area)
            asks = small[own]
            far = np.sqrt(((mean[own] - mean[other]) ** 2).sum(axis=1))[asks]
            order = np.lexsort((other[asks], far, small[other[asks]], own[asks]))
            asking, first = np.unique(own[asks][order], return_index=True)
            to = np.arange(len(table))
            to[asking] = other[asks][order][first]
            end = _ends(to)
            if (end == np.arange(len(table))).all():
                break
            place, own, other = end[place], end[own], end[other]
            apart = own != other
            own, other = own[apart], other[apart]
            area = np.bincount(end, weights=area, minlength=len(table)).astype(np.int64)
            total = np.stack([np.bincount(end, weights=c, minlength=len(table)) for c in total.T], axis=1)
        return pd.DataFrame({"image": table["image"], "label": table["label"], "merged": table["label"].to_numpy()[place]})

    kind = regions.schema["label"].dataType.simpleString()
    pairs = edges.select(F.col("image").alias("of_image"), "a", "b").groupBy("of_image")  # both sides may come from the same pixels
    return regions.select("image", "label", "area", *colours).groupBy("image").cogroup(pairs).applyInPandas(run, f"image long, label {kind}, merged {kind}")


def tree_cut(nodes: DataFrame, target: int) -> DataFrame:
    """The visible nodes of each image's tree after splitting the node of the highest merge cost (lowest id of equals)
    until ``target`` are visible or none can be split. Columns: image, node_id, left_id, right_id, merge_cost."""

    def run(tree: pd.DataFrame) -> pd.DataFrame:
        halves = {n: (a, b) for n, a, b in zip(tree["node_id"], tree["left_id"], tree["right_id"], strict=True) if not pd.isna(a)}
        cost = dict(zip(tree["node_id"], tree["merge_cost"], strict=True))
        below = {c for pair in halves.values() for c in pair}
        shown = {n for n in cost if n not in below}
        heap = [(-cost[n], n) for n in shown if n in halves]
        heapq.heapify(heap)
        while heap and len(shown) < target:
            _, n = heapq.heappop(heap)
            shown.remove(n)
            for c in map(int, halves[n]):
                shown.add(c)
                if c in halves:
                    heapq.heappush(heap, (-cost[c], c))
        return pd.DataFrame({"image": tree["image"].iloc[0], "node_id": sorted(shown)})

    return nodes.groupBy("image").applyInPandas(run, "image long, node_id long")
