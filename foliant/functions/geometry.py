"""Matrices, polygons and spans: as columns where they are expressions, in plain Python where they loop."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

Point = tuple[float, float]
Rect = tuple[float, float, float, float]


def six(m: Column) -> list[Column]:
    return [m[i] for i in range(6)]


def multiply(first: Column, second: Column) -> Column:
    """The matrix (a b c d e f) that applies ``first`` and then ``second``."""
    (a, b, c, d, e, f), (g, h, i, j, k, m) = six(first), six(second)
    return F.array(a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + m)


def transformed(m: Column, x: Column, y: Column) -> Column:
    a, b, c, d, e, f = six(m)
    return F.struct((a * x + c * y + e).alias("x"), (b * x + d * y + f).alias("y"))


def inverted(m: Column) -> Column:
    """The inverse; null for a singular matrix."""
    a, b, c, d, e, f = six(m)
    det = a * d - b * c
    own = F.array(d / det, -b / det, -c / det, a / det, (c * f - d * e) / det, (b * e - a * f) / det)
    return F.when(F.abs(det) > 1e-12, own)


def polygon_area(points: Column) -> Column:
    """Area by the shoelace rule of an array of structs x, y; under three points none."""
    n = F.size(points)
    terms = F.transform(points, lambda p, i: p["x"] * F.element_at(points, (i + 1) % n + 1)["y"] - F.element_at(points, (i + 1) % n + 1)["x"] * p["y"])
    return F.when(n < 3, 0.0).otherwise(F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def gray_of(r: Column, g: Column, b: Column) -> Column:
    """Integer grey of 8-bit colours."""
    return F.shiftright(r * 77 + g * 150 + b * 29, 8)


def rgb_of(space: Column, v: Column) -> Column:
    """Red, green and blue (0 to 1) of grey, tint, RGB and CMYK values; null for another space."""
    at = lambda i: v[i]
    return (
        F.when(space == "gray", F.array(at(0), at(0), at(0)))
        .when(space == "tint", F.array(1 - at(0), 1 - at(0), 1 - at(0)))
        .when(space == "rgb", F.array(at(0), at(1), at(2)))
        .when(space == "cmyk", F.array(*[(1 - at(i)) * (1 - at(3)) for i in range(3)]))
    )


def curve(p0: Point, p1: Point, p2: Point, p3: Point, tolerance: float) -> list[Point]:
    """Points along a cubic at even steps, as many as its bend asks for: 1 to 256."""
    bend = max(math.dist((p0[0] - 2 * p1[0] + p2[0], p0[1] - 2 * p1[1] + p2[1]), (0, 0)), math.dist((p1[0] - 2 * p2[0] + p3[0], p1[1] - 2 * p2[1] + p3[1]), (0, 0)))
    n = min(256, max(1, math.ceil(math.sqrt(0.75 * bend / tolerance))))
    weights = [((1 - t) ** 3, 3 * (1 - t) ** 2 * t, 3 * (1 - t) * t * t, t**3) for t in (i / n for i in range(1, n + 1))]
    return [tuple(sum(w * p[axis] for w, p in zip(ws, (p0, p1, p2, p3), strict=True)) for axis in (0, 1)) for ws in weights]


def cut(polygon: list[Point], axis: int, limit: float, keep_less: bool) -> list[Point]:
    """The part of a polygon on one side of a line across an axis."""
    sign = 1 if keep_less else -1
    inside = lambda p: sign * (limit - p[axis]) >= 0
    out = []
    for p, q in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if inside(p):
            out.append(p)
        if inside(p) != inside(q):
            t = (limit - p[axis]) / (q[axis] - p[axis])
            out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return out


def area(points: list[Point]) -> float:
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1], strict=True))) / 2


def subtracted(polygon: list[Point], rect: Rect) -> list[list[Point]]:
    """What a rectangle leaves of a polygon: pieces to its left and right over the whole height, then under and over it."""
    l, t, r, b = rect
    middle = cut(cut(polygon, 0, l, False), 0, r, True)
    pieces = [cut(polygon, 0, l, True), cut(polygon, 0, r, False), cut(middle, 1, t, True), cut(middle, 1, b, False)]
    return [p for p in pieces if len(p) > 2 and area(p) > 1e-9]


def within(a: Point, b: Point, rect: Rect) -> tuple[float, float] | None:
    """The span of a segment, from 0 to 1, that lies in a rectangle."""
    low, high = 0.0, 1.0
    for axis in (0, 1):
        step = b[axis] - a[axis]
        for p, q in ((-step, a[axis] - rect[axis]), (step, rect[axis + 2] - a[axis])):
            if p == 0:
                if q < 0:
                    return None
            elif p < 0:
                low = max(low, q / p)
            else:
                high = min(high, q / p)
    return (low, high) if low < high else None


def segment_outside(a: Point, b: Point, rects: list[Rect]) -> list[tuple[Point, Point]]:
    """The parts of a segment outside all rectangles, in order."""
    at = lambda t: (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
    out, free = [], 0.0
    for low, high in sorted(s for r in rects if (s := within(a, b, r))):
        if low > free:
            out.append((at(free), at(low)))
        free = max(free, high)
    return out + [(at(free), b)] if free < 1 else out


def touches(polygon: list[Point], rect: Rect) -> bool:
    """Whether a polygon and a rectangle share a point: a corner of either within the other, or crossing edges."""
    l, t, r, b = rect
    if any(l <= x <= r and t <= y <= b for x, y in polygon):
        return True
    turns = 0
    for p, q in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if within(p, q, rect):
            return True
        side = (q[0] - p[0]) * (t - p[1]) - (l - p[0]) * (q[1] - p[1])
        if p[1] <= t < q[1] and side > 0:
            turns += 1
        elif q[1] <= t < p[1] and side < 0:
            turns -= 1
    return turns != 0


def corners(l: Column, t: Column, r: Column, b: Column) -> Column:
    """A rectangle as a polygon, an array of [x, y]."""
    return F.array(F.array(l, t), F.array(r, t), F.array(r, b), F.array(l, b))


def points_of(polygon) -> list[Point]:
    return [(float(x), float(y)) for x, y in polygon]


@F.pandas_udf(DoubleType())
def area_left(polygon: pd.Series, rect: pd.Series) -> pd.Series:
    """What a rectangle leaves of a polygon's area."""
    return pd.Series([sum(area(p) for p in subtracted(points_of(a), tuple(map(float, r)))) for a, r in zip(polygon, rect, strict=True)])


@F.pandas_udf(BooleanType())
def meet(polygon: pd.Series, rect: pd.Series) -> pd.Series:
    return pd.Series([touches(points_of(a), tuple(map(float, r))) for a, r in zip(polygon, rect, strict=True)])


@F.pandas_udf(DoubleType())
def length_outside(segment: pd.Series, rects: pd.Series) -> pd.Series:
    """The length of a segment (two points) outside of all rectangles."""
    out = []
    for s, held in zip(segment, rects, strict=True):
        a, b = points_of(s)
        out.append(sum(math.dist(p, q) for p, q in segment_outside(a, b, [tuple(map(float, r)) for r in held])))
    return pd.Series(out)


@F.pandas_udf(ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])))
def flattened(cubic: pd.Series, tolerance: pd.Series) -> pd.Series:
    """The points of a cubic, given by its four points."""
    return pd.Series([[{"x": x, "y": y} for x, y in curve(*points_of(c), t)] for c, t in zip(cubic, tolerance, strict=True)])
