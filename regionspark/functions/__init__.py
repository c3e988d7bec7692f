"""Scalar functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .naming import cache_id, natural_key, safe_name

__all__ = ["cache_id", "natural_key", "ratio", "safe_name", "scaled_side", "touches_edge"]


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0.0 where the whole is zero."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def touches_edge(x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> Column:
    """Whether a half-open box reaches a side of the canvas."""
    return (x <= 0) | (y <= 0) | (x + w >= width) | (y + h >= height)


def scaled_side(side: Column, longer: Column, most: int) -> Column:
    """A side after scaling so that the longer one is at most ``most`` (0: as it is), rounded half to even, 1 at least."""
    scaled = F.greatest(F.lit(1), F.bround(side * (F.lit(float(most)) / longer), 0).cast("long"))
    return F.when((F.lit(most) > 0) & (longer > most), scaled).otherwise(side.cast("long"))
