"""Rectangle arithmetic as Column expressions over flat x, y, w, h."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F


class Box(NamedTuple):
    """Four columns (or literals) describing one rectangle."""

    x: Column
    y: Column
    w: Column
    h: Column

    @property
    def x2(self) -> Column:
        return self.x + self.w

    @property
    def y2(self) -> Column:
        return self.y + self.h

    @property
    def area(self) -> Column:
        return self.w * self.h

    @property
    def cx(self) -> Column:
        return self.x + self.w / 2

    @property
    def cy(self) -> Column:
        return self.y + self.h / 2


def box(prefix: str = "") -> Box:
    """The rectangle held in ``{prefix}x, {prefix}y, {prefix}w, {prefix}h``."""
    return Box(*(F.col(prefix + c) for c in "xywh"))


def field_box(value: Column) -> Box:
    """The rectangle held in the fields of a struct value."""
    return Box(*(value[c] for c in "xywh"))


def half_up(value: Column, digits: int = 0) -> Column:
    """Round half toward +infinity."""
    if digits == 0:
        return F.floor(value + 0.5)
    return F.floor(value * float(10**digits) + 0.5) / float(10**digits)


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even."""
    scale = float(10**digits)
    return F.rint(value) if digits == 0 else F.rint(value * scale) / scale


def clamp(value: Column, low, high) -> Column:
    """Limit to [low, high]; when high < low the answer is low."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(value, high))


def overlap(a: Box, b: Box) -> Column:
    """Area shared by two rectangles."""
    zero = F.lit(0)
    wide = F.least(a.x2, b.x2) - F.greatest(a.x, b.x)
    tall = F.least(a.y2, b.y2) - F.greatest(a.y, b.y)
    return F.greatest(zero, wide) * F.greatest(zero, tall)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 where nothing is shared."""
    shared = overlap(a, b)
    union = a.area + b.area - shared
    return F.when((shared > 0) & (union > 0), shared / union).otherwise(F.lit(0.0))


def share_of(inner: Box, outer: Box) -> Column:
    """Part of ``inner`` that lies in ``outer``."""
    return overlap(inner, outer) / F.greatest(F.lit(1), inner.area)


def contains(outer: Box, inner: Box, tolerance: int = 4) -> Column:
    """Every edge of ``inner`` inside ``outer``, give or take the tolerance."""
    t = F.lit(tolerance)
    return (
        (inner.x >= outer.x - t)
        & (inner.y >= outer.y - t)
        & (inner.x2 <= outer.x2 + t)
        & (inner.y2 <= outer.y2 + t)
    )


def holds_point(outer: Box, px: Column, py: Column) -> Column:
    """Closed point-in-rectangle test."""
    return (px >= outer.x) & (px <= outer.x2) & (py >= outer.y) & (py <= outer.y2)


def axis_gaps(a: Box, b: Box) -> tuple[Column, Column]:
    """Empty distance along each axis, 0 when the projections meet."""
    zero = F.lit(0)
    gx = F.greatest(zero, F.greatest(a.x, b.x) - F.least(a.x2, b.x2))
    gy = F.greatest(zero, F.greatest(a.y, b.y) - F.least(a.y2, b.y2))
    return gx, gy


def gap(a: Box, b: Box) -> Column:
    """The larger of the two axis gaps."""
    return F.greatest(*axis_gaps(a, b))


def distance(a: Box, b: Box) -> Column:
    """Straight-line distance between edges, to 2 decimals."""
    gx, gy = axis_gaps(a, b)
    return half_up(F.sqrt((gx * gx + gy * gy).cast("double")), 2)


def expand(a: Box, px, py) -> Box:
    """The rectangle padded on all sides."""
    px = px if isinstance(px, Column) else F.lit(px)
    py = py if isinstance(py, Column) else F.lit(py)
    return Box(a.x - px, a.y - py, a.w + px * 2, a.h + py * 2)


def normalize(a: Box, width, height, min_size: int = 1) -> Box:
    """Round to pixels and push inside the page, never smaller than ``min_size``."""
    width = width if isinstance(width, Column) else F.lit(width)
    height = height if isinstance(height, Column) else F.lit(height)
    x = clamp(half_up(a.x), 0, F.greatest(F.lit(0), width - min_size))
    y = clamp(half_up(a.y), 0, F.greatest(F.lit(0), height - min_size))
    w = clamp(half_up(a.w), min_size, width - x)
    h = clamp(half_up(a.h), min_size, height - y)
    return Box(x, y, w, h)


def clip_to_page(a: Box, width: int, height: int) -> Box:
    """Cut a rectangle at the page edges; the result may be empty (w or h of 0)."""
    x1, y1 = clamp(a.x, 0, width), clamp(a.y, 0, height)
    x2, y2 = clamp(a.x2, 0, width), clamp(a.y2, 0, height)
    return Box(x1, y1, F.greatest(F.lit(0), x2 - x1), F.greatest(F.lit(0), y2 - y1))


def box_columns(b: Box, prefix: str = "") -> list[Column]:
    """Named columns for a rectangle."""
    return [c.alias(prefix + n) for c, n in zip(b, "xywh")]


def hull(prefix: str = "", out: str = "") -> list[Column]:
    """Aggregates giving the bounding rectangle of a group."""
    b = box(prefix)
    return [
        F.min(b.x).alias(out + "x"),
        F.min(b.y).alias(out + "y"),
        (F.max(b.x2) - F.min(b.x)).alias(out + "w"),
        (F.max(b.y2) - F.min(b.y)).alias(out + "h"),
    ]
