"""Column builders for normalised boxes (x, y, width, height in 0..1, origin top left)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def positive(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)


def box(alias: str, names: tuple[str, str, str, str] = ("x", "y", "width", "height")) -> tuple[Column, Column, Column, Column]:
    """Left, top, right and bottom edge of the box of ``alias``."""
    x, y, w, h = (F.col(f"{alias}.{n}" if alias else n) for n in names)
    return x, y, x + w, y + h


def overlap(a: tuple, b: tuple) -> Column:
    """Area that two boxes (as edges) share."""
    return positive(F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * positive(F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def containment(inner: tuple, outer: tuple) -> Column:
    """Share of ``inner`` that lies in ``outer``; 0 where either is degenerate or has no place."""
    area = positive(inner[2] - inner[0]) * positive(inner[3] - inner[1])
    shared = overlap(inner, outer)
    unplaced = F.isnull(inner[2] + inner[3]) | F.isnull(outer[2] + outer[3])
    return F.when(unplaced | (shared <= 0) | (area <= 0), F.lit(0.0)).otherwise(shared / area)


def area(width: Column, height: Column) -> Column:
    return positive(width) * positive(height)


def normalised(left: Column, top: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """Box in page units as a struct in 0..1; sides are at least 1e-6."""
    w, h = F.greatest(page_width.cast("double"), F.lit(1.0)), F.greatest(page_height.cast("double"), F.lit(1.0))
    side = lambda c: clamp(c, 1e-6)
    return F.struct(clamp(left / w).alias("x"), clamp(top / h).alias("y"), side(width / w).alias("width"), side(height / h).alias("height"))
