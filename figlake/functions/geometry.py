"""Box algebra as Column expressions. A box is a struct (x0, top, x1, bottom) of doubles; boxes may be degenerate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "top", "x1", "bottom")
Number = Column | float


def _col(value: Number) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def box(x0: Number, top: Number, x1: Number, bottom: Number) -> Column:
    return F.struct(*[_col(v).alias(n) for n, v in zip(SIDES, (x0, top, x1, bottom), strict=True)])


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["bottom"] - b["top"]


def area(b: Column) -> Column:
    return F.greatest(width(b), F.lit(0.0)) * F.greatest(height(b), F.lit(0.0))


def vertical_center(b: Column) -> Column:
    return (b["top"] + b["bottom"]) / F.lit(2.0)


def padded(b: Column, by: Number) -> Column:
    p = _col(by)
    return box(b["x0"] - p, b["top"] - p, b["x1"] + p, b["bottom"] + p)


def clamped(b: Column, to: Column) -> Column:
    """The part of b inside ``to``; degenerate if there is none."""
    return box(F.greatest(b["x0"], to["x0"]), F.greatest(b["top"], to["top"]), F.least(b["x1"], to["x1"]), F.least(b["bottom"], to["bottom"]))


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["top"], b["top"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["bottom"], b["bottom"]))


def hull(b: Column) -> Column:
    """Aggregate: the smallest box around all boxes."""
    return box(F.min(b["x0"]), F.min(b["top"]), F.max(b["x1"]), F.max(b["bottom"]))


def horizontal_overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))


def pixel_clamped(b: Column, wide: Column, high: Column) -> Column:
    zero = F.lit(0)
    inside = lambda v, most: F.greatest(zero, F.least(v, most))
    return F.struct(inside(b["x0"], wide).alias("x0"), inside(b["y0"], high).alias("y0"), inside(b["x1"], wide).alias("x1"), inside(b["y1"], high).alias("y1"))
