"""Masks one row each, as arrays of rising disjoint runs: kernels over the masks of a batch, without one row for a run."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# the kernels go along with their tasks, whether or not workers find this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Masks:
    """Runs of masks one after another; of mask i those from ``at[i]`` to ``at[i + 1]``."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> None:
        self.starts, self.ends, self.at = starts, ends, at
        self.owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        self.below = np.concatenate([[0], np.cumsum(ends - starts)])

    @classmethod
    def of(cls, starts: pa.Array, ends: pa.Array) -> Masks:
        """From arrays of a column each; null is a mask without runs."""
        starts, ends = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (starts, ends))
        many = pc.fill_null(pc.list_value_length(starts), 0).to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
        return cls(*(x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (starts, ends)), at)

    def then(self, other: Masks) -> Masks:
        both = (np.concatenate([a, b]) for a, b in ((self.starts, other.starts), (self.ends, other.ends)))
        return Masks(*both, np.concatenate([self.at, self.at[-1] + other.at[1:]]))

    def part(self, low: int, high: int) -> Masks:
        """The masks from ``low`` to before ``high``."""
        own = slice(self.at[low], self.at[high])
        return Masks(self.starts[own], self.ends[own], self.at[low : high + 1] - self.at[low])

    def pixels(self) -> np.ndarray:
        return self.below[self.at[1:]] - self.below[self.at[:-1]]


def expanded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n of each i: i n times, and 0 to n - 1 beside it."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def shared(left: Masks, a: np.ndarray, right: Masks, b: np.ndarray) -> np.ndarray:
    """Pixels that mask a[i] of the left and mask b[i] of the right share: for each run of the one, the pixels of the other
    below its end less those below its start."""
    pair, nth = expanded(left.at[a + 1] - left.at[a])
    run = left.at[a][pair] + nth
    span = 1 + max((int(x.max()) for x in (left.ends, right.ends) if len(x)), default=0)
    firsts, lasts, base = right.owner * span + right.starts, right.owner * span + right.ends, b[pair] * span
    lasts = np.concatenate([[0], lasts])

    def upto(place: np.ndarray) -> np.ndarray:
        i = np.searchsorted(firsts, place)
        return right.below[i] - np.maximum(lasts[i] - place, 0)

    total = np.concatenate([[0], np.cumsum(upto(base + left.ends[run]) - upto(base + left.starts[run]))])
    upper = np.cumsum(left.at[a + 1] - left.at[a])
    return total[upper] - total[upper - (left.at[a + 1] - left.at[a])]


def columns(masks: Masks, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs cut at the borders of columns: mask, column, first row and the row after the last of each piece; and where
    each mask's pieces begin."""
    first = masks.starts // height
    many = np.where(masks.starts < masks.ends, (masks.ends - 1) // height - first + 1, 0)
    run, nth = expanded(many)
    c = first[run] + nth
    low = c * height
    y0, y1 = np.maximum(masks.starts[run], low) - low, np.minimum(masks.ends[run], low + height) - low
    return masks.owner[run], c, y0, y1, np.concatenate([[0], np.cumsum(many)])[masks.at]


def touching(frame: np.ndarray, c: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs in order of frame, column and row: the first run of the next column that each touches, by edge or corner, and
    how many it touches."""
    # a place that rises with frame, column and row, with a free column between frames
    most, wide = int(y1.max()) + 2, int(c.max()) + 2
    column = frame * wide + c
    first = np.searchsorted(column * most + y1, (column + 1) * most + y0)
    last = np.searchsorted(column * most + y0, (column + 1) * most + y1, side="right")
    return first, np.maximum(last - first, 0)


def joined_runs(frame: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Components of each frame by the runs that touch."""
    own = np.repeat(np.arange(len(frame)), many)
    other = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
    up = np.arange(len(frame))
    while True:
        least = up.copy()
        np.minimum.at(least, own, up[other])
        np.minimum.at(least, other, up[own])
        least = least[least]
        if (least == up).all():
            break
        up = least
    return np.bincount(frame[np.flatnonzero(up == np.arange(len(frame)))], minlength=frame[-1] + 1)


def whole_groups(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of rows that come group by group, with ``_step`` 1 where one begins: tables of whole groups, and where in them these
    begin and end."""

    def begins(table: pa.Table | pa.RecordBatch) -> np.ndarray:
        return np.flatnonzero(np.asarray(table.column("_step")) == 1)

    held: list[pa.Table] = []
    for part in parts:
        first = begins(part)
        if len(first):
            upto = int(first[-1])
            if held or upto:
                table = pa.concat_tables([*held, pa.Table.from_batches([part.slice(0, upto)])])
                yield table, np.append(begins(table), table.num_rows)
            held, part = [], part.slice(upto)
        held.append(pa.Table.from_batches([part]))  # the last group may go on
    if held:
        table = pa.concat_tables(held)
        yield table, np.append(begins(table), table.num_rows)


def united(masks: Masks, group: np.ndarray, groups: int) -> Masks:
    """The union of the masks of each group as one mask; ``group`` of a mask rises, or is negative if it takes no part."""
    owner = group[masks.owner]
    kept = (owner >= 0) & (masks.starts < masks.ends)
    owner, starts, ends = owner[kept], masks.starts[kept], masks.ends[kept]
    if not len(owner):
        return Masks(starts, ends, np.zeros(groups + 1, dtype=np.int64))
    span = int(ends.max()) + 1
    order = np.argsort(owner * span + starts)
    owner, first = owner[order], (owner * span + starts)[order]
    reach = np.maximum.accumulate(owner * span + ends[order])
    # an island begins behind all that comes before it, or with its group
    new = np.flatnonzero(np.concatenate([[True], (first[1:] > reach[:-1]) | (owner[1:] != owner[:-1])]))
    of, last = owner[new], np.append(new[1:], len(first)) - 1
    return Masks(first[new] - of * span, reach[last] - of * span, np.searchsorted(of, np.arange(groups + 1)))


def alike(masks: Masks, group: np.ndarray, threshold: float, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of masks of one group with an IoU from the threshold on. The IoU is at most the smaller area by the larger, so
    only masks of such areas are compared, and of these the ones whose extents meet; at most about ``most`` at a time."""
    areas = masks.pixels()
    order = np.lexsort((areas, group))
    g, a = group[order], areas[order]
    low, high = np.zeros(len(areas), dtype=np.int64), np.zeros(len(areas), dtype=np.int64)
    some = masks.at[1:] > masks.at[:-1]
    low[some], high[some] = masks.starts[masks.at[:-1][some]], masks.ends[masks.at[1:][some] - 1]
    # with areas rising, those from here on up to this one's area by the threshold
    wide = int(a.max(initial=0)) + 2
    bound = np.minimum(np.floor(a / threshold * (1 + 1e-9)).astype(np.int64), wide - 1)
    many = np.searchsorted(g * wide + a, g * wide + bound, side="right") - np.arange(len(a)) - 1
    total = np.concatenate([[0], np.cumsum(many)])
    begin = 0
    while begin < len(a):
        upto = max(begin + 1, int(np.searchsorted(total, total[begin] + most, side="right")) - 1)
        one, nth = expanded(many[begin:upto])
        i, j = order[one + begin], order[one + begin + 1 + nth]
        meets = (low[i] < high[j]) & (low[j] < high[i])
        i, j = i[meets], j[meets]
        overlap = shared(masks, i, masks, j)
        union = areas[i] + areas[j] - overlap
        same = (overlap > 0) & (overlap / np.maximum(union, 1) >= threshold)
        yield i[same], j[same]
        begin = upto


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of n places the smallest that links between a[i] and b[i] reach."""
    up = np.arange(n)
    while True:
        least = up.copy()
        np.minimum.at(least, a, up[b])
        np.minimum.at(least, b, up[a])
        least = least[least]
        if (least == up).all():
            return up
        up = least


def owners(keys: pa.ChunkedArray, at: np.ndarray) -> np.ndarray:
    """Which group each row is of, with groups from one of ``at`` to the next; rows without a key are of groups of their own,
    as a join finds no partner for them."""
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return np.where(np.asarray(keys.is_valid()), of, -1 - np.arange(len(of)))


def classes(masks: Masks, group: np.ndarray, threshold: float, most: int = 1 << 18) -> np.ndarray:
    """Of each mask the first that links of one group with an IoU from the threshold on reach. Links of some pairs at a time
    are folded into what is reached so far, so that their number doesn't matter."""
    up = np.arange(len(group))
    for a, b in alike(masks, group, threshold, most):
        if len(a):
            up = least_reachable(len(up), np.concatenate([np.arange(len(up)), a]), np.concatenate([up, b]))
    return up


def meeting(masks: Masks, group: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs i < j of masks of one group that share pixels, and how many. Only masks whose extents meet are compared, by
    about ``most`` runs at a time, however many pairs a group or a mask has."""
    some = np.flatnonzero(np.diff(masks.at))
    low, high = masks.starts[masks.at[some]], masks.ends[masks.at[some + 1] - 1]
    span = int(high.max(initial=0)) + 1
    order = np.lexsort((low, group[some]))
    some, base, low, high = some[order], group[some[order]] * span, low[order], high[order]
    # with extents in order of where they begin, those from here on that begin before this one ends
    many = np.maximum(np.searchsorted(base + low, base + high) - np.arange(len(some)) - 1, 0)
    runs = np.diff(masks.at)[some]
    total, work = (np.concatenate([[0], np.cumsum(x)]) for x in (many, many * runs))
    cuts = np.arange(most, work[-1], most)
    at = np.searchsorted(work, cuts, side="right") - 1
    bounds = np.unique(np.concatenate([[0], total[at] + (cuts - work[at]) // runs[at], total[-1:]]))
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        pair = np.arange(begin, end)
        one = np.searchsorted(total, pair, side="right") - 1
        i, j = some[one], some[one + 1 + pair - total[one]]
        overlap = shared(masks, i, masks, j)
        met = overlap > 0
        i, j, overlap = i[met], j[met], overlap[met]
        yield np.minimum(i, j), np.maximum(i, j), overlap


def nearest(pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], area: np.ndarray, threshold: float, contained: float) -> tuple[np.ndarray, np.ndarray]:
    """Of masks that lie in larger ones (containment from ``contained`` on, IoU below the threshold), and of these the
    smallest, the first of equal ones; of two of one area the later lies in the earlier. ``pairs`` are those that meet."""

    def ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.divide(part, whole, out=np.zeros(len(part)), where=whole != 0)

    inner, outer = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for i, j, overlap in pairs:
        nested = (ratio(overlap, area[i] + area[j] - overlap) < threshold) & (ratio(overlap, np.minimum(area[i], area[j])) >= contained)
        i, j = i[nested], j[nested]
        later = area[j] <= area[i]
        inner, outer = np.concatenate([inner, np.where(later, j, i)]), np.concatenate([outer, np.where(later, i, j)])
        order = np.lexsort((outer, area[outer], inner))
        inner, outer = inner[order], outer[order]
        first = np.flatnonzero(np.diff(inner, prepend=-1))
        inner, outer = inner[first], outer[first]
    return inner, outer
