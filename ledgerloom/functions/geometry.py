"""Geometry of blocks and pages as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_of(polygon: Column) -> Column:
    """Bounding box of ARRAY<STRUCT<x,y>> (A1); null for a null or empty polygon."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return F.when(F.size(polygon) > 0, F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))


def union_box(prefix: str = "") -> list[Column]:
    """Aggregates for the box around all boxes of a group."""
    return [F.min(f"{prefix}x0").alias("x0"), F.min(f"{prefix}y0").alias("y0"), F.max(f"{prefix}x1").alias("x1"), F.max(f"{prefix}y1").alias("y1")]


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length of two intervals, 0 where they are apart."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def iou(a: str, b: str) -> Column:
    """Intersection over union of the boxes of two aliases, 0 where the union is empty."""
    c = lambda side, name: F.col(f"{side}.{name}")
    inter = overlap(c(a, "x0"), c(a, "x1"), c(b, "x0"), c(b, "x1")) * overlap(c(a, "y0"), c(a, "y1"), c(b, "y0"), c(b, "y1"))
    area = lambda s: F.greatest(F.lit(0.0), c(s, "x1") - c(s, "x0")) * F.greatest(F.lit(0.0), c(s, "y1") - c(s, "y0"))
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / F.when(union > 0, union)).otherwise(0.0)


def to_pdf(x: Column, y: Column, m: list[float]) -> tuple[Column, Column]:
    """Pixel point to page point by the affine (a, b, c, d, e, f): x' = ax + cy + e, y' = bx + dy + f."""
    a, b, c, d, e, f = m
    return x * a + y * c + e, x * b + y * d + f


def from_pdf(x: Column, y: Column, m: list[float]) -> tuple[Column, Column]:
    """Inverse of to_pdf; the matrix must be invertible."""
    a, b, c, d, e, f = m
    det = a * d - b * c
    if abs(det) <= 1e-12:
        raise ValueError("the transform is not invertible")
    return ((x - e) * d - (y - f) * c) / det, ((y - f) * a - (x - e) * b) / det


def compose(first: list[float], second: list[float]) -> list[float]:
    """The affine that applies first, then second."""
    a, b, c, d, e, f = first
    p, q, r, s, t, u = second
    return [a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u]


def quarter_turn(width: float, height: float, degrees: int) -> list[float]:
    """Affine of a clockwise turn of a width x height page by 0, 90, 180 or 270 degrees."""
    turns = {0: [1, 0, 0, 1, 0, 0], 90: [0, 1, -1, 0, height, 0], 180: [-1, 0, 0, -1, width, height], 270: [0, -1, 1, 0, 0, width]}
    return [float(v) for v in turns[degrees % 360]]


def crop_bounds(x0: Column, y0: Column, x1: Column, y1: Column, width: int, height: int) -> list[Column]:
    """Whole-pixel crop around a box (F26): inside the image and never empty."""

    def side(low: Column, high: Column, most: int) -> tuple[Column, Column]:
        first = F.greatest(F.lit(0), F.least(F.lit(most - 1), F.floor(low).cast("int")))
        return first, F.greatest(first + 1, F.least(F.lit(most), F.ceil(high).cast("int")))

    (left, right), (top, bottom) = side(x0, x1, width), side(y0, y1, height)
    return [left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")]


def clip(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Box inside the page, null where nothing of it is."""
    cx0, cy0, cx1, cy1 = F.greatest(x0, F.lit(0.0)), F.greatest(y0, F.lit(0.0)), F.least(x1, width), F.least(y1, height)
    return F.when((cx1 > cx0) & (cy1 > cy0), F.struct(cx0.alias("x0"), cy0.alias("y0"), cx1.alias("x1"), cy1.alias("y1")))


def font_size(y0: Column, y1: Column) -> Column:
    """Size of invisible text over a box: half its height, from 3 to 12 (K6)."""
    return F.greatest(F.lit(3.0), F.least((y1 - y0) / 2, F.lit(12.0)))


def box_text(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """'x0,y0,x1,y1' with up to six significant digits and no trailing zeros (F12), for values from 0.001 to 999999; a tie in the seventh digit rounds up."""

    def short(v: Column) -> Column:
        whole = F.greatest(F.floor(F.log10(F.greatest(F.abs(v), F.lit(1e-9)))) + 1, F.lit(1)).cast("int")
        text = F.when(whole >= 6, F.format_string("%.0f", v))
        for digits in range(1, 6):
            text = text.when(whole == digits, F.format_string(f"%.{6 - digits}f", v))
        return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")

    return F.concat_ws(",", *[short(v) for v in (x0, y0, x1, y1)])
