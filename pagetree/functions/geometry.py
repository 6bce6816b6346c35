"""Box arithmetic as column expressions.  A box is a tuple (x1, y1, x2, y2) of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import TARGET_SIZE, VIEWPORT_HEIGHT, VIEWPORT_WIDTH

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", alias: str | None = None) -> Box:
    """The four columns ``<prefix>x1 … <prefix>y2``, optionally of an aliased frame."""
    stem = f"{alias}." if alias else ""
    return tuple(F.col(f"{stem}{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def scale_box(
    b: Box,
    width: float = VIEWPORT_WIDTH,
    height: float = VIEWPORT_HEIGHT,
    target: float = TARGET_SIZE,
) -> Box:
    """Viewport pixels to the square target space, clamped to [0, target]."""
    def fit(value: Column, extent: float) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(float(target)), value * F.lit(target / extent)))

    return fit(b[0], width), fit(b[1], height), fit(b[2], width), fit(b[3], height)


def box_area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection_area(a: Box, b: Box) -> Column:
    """Shared area; 0 when the boxes are disjoint or only touch."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def overlap_coefficient(a: Box, b: Box) -> Column:
    """Shared area over the smaller area; 0 when the boxes do not meet or an area is 0."""
    inter = intersection_area(a, b)
    smaller = F.least(box_area(a), box_area(b))
    return F.when((inter > 0) & (smaller != 0), inter / smaller).otherwise(F.lit(0.0))


def bbox_iou(a: Box, b: Box) -> Column:
    inter = intersection_area(a, b)
    union = (
        F.greatest(F.lit(0.0), box_area(a)) + F.greatest(F.lit(0.0), box_area(b)) - inter
    )
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def contains(outer: Box, inner: Box) -> Column:
    """Closed containment on all four edges."""
    return (
        (outer[0] <= inner[0])
        & (outer[1] <= inner[1])
        & (outer[2] >= inner[2])
        & (outer[3] >= inner[3])
    )


def box_to_xywh(b: Box) -> Column:
    return F.struct(
        b[0].cast("double").alias("x"),
        b[1].cast("double").alias("y"),
        (b[2] - b[0]).cast("double").alias("width"),
        (b[3] - b[1]).cast("double").alias("height"),
    )
