"""Flooding of label maps from seeds, and filling of what a flood leaves open. An image is the rows of one task."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed value: regions that seeds are placed for if nothing else is asked.
REGIONS = 800
OPEN, BORDER = 0, -1


def seed_spacing(height: int, width: int, spacing: int | None = None, count: int | None = None) -> int:
    """The distance of seeds: as given, or so that about ``count`` fit in; two at least."""
    if spacing and spacing > 0:
        return max(2, int(spacing))
    return max(2, round((height * width / max(1, int(count or REGIONS))) ** 0.5))


def grid_seeds(height: int, width: int, spacing: int) -> np.ndarray:
    """A map that is 0 but for the seeds, which stand at the middles of a grid and count from 1 by rows; a side that is too
    short for the grid has one seed in its middle."""
    rows, columns = (np.arange(spacing // 2, side, spacing) if side > spacing // 2 else np.array([side // 2]) for side in (height, width))
    seeds = np.zeros((height, width), dtype=np.int64)
    seeds[np.ix_(rows, columns)] = np.arange(1, len(rows) * len(columns) + 1).reshape(len(rows), len(columns))
    return seeds


def flooded(seeds: np.ndarray, image: np.ndarray) -> np.ndarray:
    """Meyer's flooding as image libraries do it: pixels join in the order of their largest channel difference to the
    neighbour that reached them, first come first served; a pixel that touches two labels is border (-1), as is the
    frame of the image."""
    height, width = seeds.shape
    wide = width + 2
    labels = np.full((height + 2, wide), BORDER, dtype=np.int64)
    labels[2:-2, 2:-2] = seeds[1:-1, 1:-1]
    cells = labels.ravel().tolist()
    colours = np.zeros((height + 2, wide, image.shape[2]), dtype=np.int64)
    colours[1:-1, 1:-1] = image
    values = [tuple(c) for c in colours.reshape(-1, image.shape[2]).tolist()]
    steps = (-1, 1, -wide, wide)
    waiting = [deque() for _ in range(256)]
    queued = bytearray(len(cells))

    def gap(a: int, b: int) -> int:
        return max(abs(x - y) for x, y in zip(values[a], values[b], strict=True))

    for at, label in enumerate(cells):
        if label == OPEN:
            beside = [gap(at, at + s) for s in steps if cells[at + s] > 0]
            if beside:
                waiting[min(beside)].append(at)
                queued[at] = 1
    level = 0
    while level < 256:
        if not waiting[level]:
            level += 1
            continue
        at = waiting[level].popleft()
        touching = {cells[at + s] for s in steps if cells[at + s] > 0}
        cells[at] = touching.pop() if len(touching) == 1 else BORDER
        if cells[at] == BORDER:
            continue
        for s in steps:
            to = at + s
            if cells[to] == OPEN and not queued[to]:
                far = gap(at, to)
                waiting[far].append(to)
                queued[to] = 1
                level = min(level, far)
    return np.array(cells).reshape(height + 2, wide)[1:-1, 1:-1]


def filled(labels: np.ndarray, colours: np.ndarray) -> np.ndarray:
    """Open pixels (0 or less) take the label of the 4-neighbour nearest in colour, of equals the lowest, round by round
    from outside; what no round reaches in as many as the sides are long becomes 1."""
    height, width = labels.shape
    held = np.zeros((height + 2, width + 2), dtype=np.int64)
    held[1:-1, 1:-1] = np.maximum(labels, 0)
    shade = np.zeros((height + 2, width + 2, colours.shape[2]), dtype=np.float32)
    shade[1:-1, 1:-1] = colours
    flat, paint = held.ravel(), shade.reshape(-1, colours.shape[2])
    steps = np.array([-(width + 2), width + 2, -1, 1])
    inside = np.zeros(held.shape, dtype=bool)
    inside[1:-1, 1:-1] = True
    left = np.flatnonzero(inside.ravel() & (flat == 0))
    for _ in range(height + width):
        beside = left[:, None] + steps
        label = flat[beside]
        reached = (label > 0).any(axis=1)
        if not reached.any():
            break
        at, beside, label = left[reached], beside[reached], label[reached]
        far = np.linalg.norm(paint[at][:, None] - paint[beside], axis=2)
        far[label == 0] = np.inf
        nearest = far == far.min(axis=1)[:, None]
        flat[at] = np.where(nearest & (label > 0), label, np.iinfo(np.int64).max).min(axis=1)
        left = left[~reached]
    flat[left] = 1
    return held[1:-1, 1:-1]


def grids(rows: pd.DataFrame, *columns: str) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Rows and columns of pixels (x, y), and the values as grids; places without a pixel hold 0."""
    x, y = (rows[c].to_numpy() - rows[c].min() for c in ("x", "y"))
    made = []
    for c in columns:
        grid = np.zeros((y.max() + 1, x.max() + 1))
        grid[y, x] = rows[c]
        made.append(grid)
    return x, y, tuple(made)


def watershed(
    pixels: DataFrame, channels: tuple[str, ...] = ("blue", "green", "red"), spacing: int | None = None, count: int | None = None, fill_by: tuple[str, ...] = ()
) -> DataFrame:
    """Labels (image, x, y, label) by flooding from a grid of seeds: -1 where floods meet, or, with columns to ``fill_by``,
    full labels by the rule of ``filled`` in the same task. ``pixels``: image, x, y and whole channel values from 0 to 255;
    images are rectangles."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x, y, made = grids(rows, *channels, *fill_by)
        height, width = made[0].shape
        seeds = grid_seeds(height, width, seed_spacing(height, width, spacing, count))
        labels = flooded(seeds, np.stack(made[: len(channels)], axis=2).astype(np.int64))
        if fill_by:
            labels = filled(labels, np.stack(made[len(channels) :], axis=2))
        return pd.DataFrame({"image": rows["image"], "x": rows["x"], "y": rows["y"], "label": labels[y, x]})

    wanted = dict.fromkeys(("image", "x", "y", *channels, *fill_by))
    return pixels.select(*wanted).groupBy("image").applyInPandas(run, "image long, x long, y long, label long")


def open_filled(pixels: DataFrame, colours: tuple[str, ...] = ("light", "lab_a", "lab_b")) -> DataFrame:
    """Labels (image, x, y, label) without open pixels, by the rule of ``filled``. ``pixels``: image, x, y, label, colours."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x, y, made = grids(rows, "label", *colours)
        labels = filled(made[0].astype(np.int64), np.stack(made[1:], axis=2))
        return pd.DataFrame({"image": rows["image"], "x": rows["x"], "y": rows["y"], "label": labels[y, x]})

    return pixels.select("image", "x", "y", "label", *colours).groupBy("image").applyInPandas(run, "image long, x long, y long, label long")
