"""Box arithmetic as column expressions. A box is the four columns ``<p>x0, <p>y0, <p>x1, <p>y1``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _box(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")]


def area(prefix: str = "") -> Column:
    """Width times height; a side that is turned inside out counts as 0."""
    x0, y0, x1, y1 = _box(prefix)
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def intersection(a: str, b: str) -> Column:
    ax0, ay0, ax1, ay1 = _box(a)
    bx0, by0, bx1, by1 = _box(b)
    wide = F.greatest(F.least(ax1, bx1) - F.greatest(ax0, bx0), F.lit(0.0))
    high = F.greatest(F.least(ay1, by1) - F.greatest(ay0, by0), F.lit(0.0))
    return wide * high


def iou(a: str, b: str) -> Column:
    """Intersection over union; the union is at least 1e-9."""
    inter = intersection(a, b)
    return inter / F.greatest(area(a) + area(b) - inter, F.lit(1e-9))


def ios(a: str, b: str) -> Column:
    """Intersection over the smaller box, at least 1e-9."""
    return intersection(a, b) / F.greatest(F.least(area(a), area(b)), F.lit(1e-9))


def from_centre(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Normalised centre and size to corners in pixels."""
    return {"x0": (cx - w / 2) * width, "y0": (cy - h / 2) * height, "x1": (cx + w / 2) * width, "y1": (cy + h / 2) * height}
