"""Plane geometry as column expressions: everything stays in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def distance(x1, y1, x2, y2) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def along(px, py, x1, y1, x2, y2) -> Column:
    """Clamped parameter of the foot of a point on a segment; 0 for a segment without length."""
    length2 = (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    t = ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / length2
    return F.when(length2 == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))


def to_segment(px, py, x1, y1, x2, y2) -> Column:
    """Distance of a point from a segment."""
    t = along(px, py, x1, y1, x2, y2)
    return F.hypot(px - (x1 + t * (x2 - x1)), py - (y1 + t * (y2 - y1)))


def cross(ax, ay, bx, by) -> Column:
    return ax * by - ay * bx


def wrap(angle: Column) -> Column:
    """Angle in [-pi, pi)."""
    return F.pmod(angle + PI, F.lit(2 * PI)) - PI


def clamp_grid(value: Column, grid: int = 1000) -> Column:
    """Half-even rounding into [0, grid]."""
    return F.greatest(F.lit(0), F.least(F.lit(grid), F.bround(value, 0).cast("int")))


def snap(value: Column, grid: int = 50) -> Column:
    return (F.bround(value / grid, 0) * grid).cast("int")


def polygon_area(points: Column) -> Column:
    """Signed area of array<struct<x,y>> (shoelace)."""
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    terms = F.zip_with(points, following, lambda p, q: cross(p.x, p.y, q.x, q.y).cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) / 2


def in_polygon(px: Column, py: Column, points: Column) -> Column:
    """Even-odd ray cast over array<struct<x,y>>."""
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    hits = F.zip_with(
        points, following,
        lambda p, q: ((p.y > py) != (q.y > py)) & (px < (q.x - p.x) * (py - p.y) / F.nullif(q.y - p.y, F.lit(0)) + p.x),
    )
    return F.size(F.filter(hits, lambda h: F.coalesce(h, F.lit(False)))) % 2 == 1


def arc_points(x1, y1, x2, y2, curvature: Column, n: int = 24) -> Column:
    """The n+1 points of the circular arc whose signed height is curvature * chord / 2; two points where it is straight.

    With half-angle a = 2 atan(|curvature|) the arc sweeps 4 atan(|curvature|) about a centre on the far side of its apex.
    """
    chord = F.hypot(x2 - x1, y2 - y1)
    half = 2 * F.atan(F.abs(curvature))
    radius = chord / (2 * F.sin(half))
    side = F.signum(curvature)
    mx, my = (x1 + x2) / 2, (y1 + y2) / 2
    nx, ny = -(y2 - y1) / chord, (x2 - x1) / chord
    back = radius * F.cos(half) * side
    cx, cy = mx - back * nx, my - back * ny
    start = F.atan2(y1 - cy, x1 - cx)
    point = lambda k: F.struct(
        (cx + radius * F.cos(start - side * 2 * half * k / n)).alias("x"), (cy + radius * F.sin(start - side * 2 * half * k / n)).alias("y")
    )
    ends = F.array(*(F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in ((x1, y1), (x2, y2))))
    return F.when((chord < 1e-6) | (F.abs(curvature) < 1e-3), ends).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n)), point))


def fit_curvature(points: Column) -> Column:
    """Signed height ratio of a polyline (array<struct<x,y>>) over its chord: 2 h / L, by the farthest point."""
    a, b = F.element_at(points, 1), F.element_at(points, -1)
    chord = F.hypot(b.x - a.x, b.y - a.y)
    offset = lambda p: (cross(b.x - a.x, b.y - a.y, p.x - a.x, p.y - a.y) / chord)
    inner = F.transform(F.slice(points, 2, F.greatest(F.size(points) - 2, F.lit(0))), lambda p: F.struct(F.abs(offset(p)).alias("d"), offset(p).alias("h")))
    best = F.array_max(inner)
    return F.when((F.size(points) < 3) | (chord < 1e-6), F.lit(0.0)).otherwise(2 * best.h / chord)


def turned(x, y, degrees: Column, about_x=0, about_y=0) -> tuple[Column, Column]:
    """A point rotated about another, as x and y."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    dx, dy = x - about_x, y - about_y
    return about_x + dx * c - dy * s, about_y + dx * s + dy * c


def to_pixel(x, y, scale, origin_x, origin_y, height) -> tuple[Column, Column]:
    """Model millimetres (y up) to image pixels (y down)."""
    return (x - origin_x) * scale, height - (y - origin_y) * scale
