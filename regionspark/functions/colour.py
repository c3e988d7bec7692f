"""Colours as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shares of linear red, green and blue in X, Y and Z over those of the D65 white, and the borders of the curves.
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)
DARK, LOW = 0.04045, 0.008856


def lab(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    """Lightness, a and b of 8-bit sRGB as 8-bit values: lightness from 0 to 255, a and b around 128, rounded to whole
    numbers. Image libraries that use tables differ by 1 at most here and there."""

    def linear(c: Column) -> Column:
        v = c / F.lit(255.0)
        return F.when(v <= DARK, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    def curve(t: Column) -> Column:
        return F.when(t > LOW, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0)

    parts = [linear(c) for c in (red, green, blue)]
    x, y, z = (sum((p * k for p, k in zip(parts[1:], row[1:], strict=True)), parts[0] * row[0]) / w for row, w in zip(TO_XYZ, WHITE, strict=True))
    light = F.when(y > LOW, 116 * F.cbrt(y) - 16).otherwise(903.3 * y)
    shades = (light * 255 / 100, 500 * (curve(x) - curve(y)) + 128, 200 * (curve(y) - curve(z)) + 128)
    return tuple(F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0))) for c in shades)
