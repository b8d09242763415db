"""Planar geometry and map projection as Column expressions.

A polygon is ``rings: array<array<struct<x,y>>>``; holes and parts are further rings and a
point is inside when a ray from it crosses the edges an odd number of times.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col


def box_rings(x0, y0, x1, y1) -> Column:
    """Rings of an axis-aligned box."""
    x0, y0, x1, y1 = (v if isinstance(v, Column) else F.lit(float(v)) for v in (x0, y0, x1, y1))

    def pt(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    return F.array(F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0)))


def ring_edges(rings: str | Column) -> Column:
    """All edges as one array of (x1, y1, x2, y2); open rings are closed, closed ones have no edge of length 0 for it."""
    def edges(ring):
        size, last = F.size(ring), F.get(ring, F.size(ring) - 1)
        closed = (size > 1) & (F.get(ring, F.lit(0))["x"] == last["x"]) & (F.get(ring, F.lit(0))["y"] == last["y"])
        return F.transform(F.slice(ring, F.lit(1), size - F.coalesce(closed, F.lit(False)).cast("int")), lambda p, i: F.struct(
            p["x"].alias("x1"), p["y"].alias("y1"),
            F.get(ring, (i + 1) % size)["x"].alias("x2"),
            F.get(ring, (i + 1) % size)["y"].alias("y2")))

    return F.flatten(F.transform(as_col(rings), edges))


def odd_crossings(edges: Column, x: Column, y: Column) -> Column:
    def crosses(e):
        spans = (e["y1"] > y) != (e["y2"] > y)
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return F.coalesce(spans & (x < at), F.lit(False))

    return F.size(F.filter(edges, crosses)) % 2 == 1


def on_any_edge(edges: Column, x: Column, y: Column) -> Column:
    def touches(e):
        cross = (x - e["x1"]) * (e["y2"] - e["y1"]) - (y - e["y1"]) * (e["x2"] - e["x1"])
        return ((cross == 0)
                & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
                & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))

    return F.exists(edges, touches)


def strictly_within(edges: Column, x: Column, y: Column) -> Column:
    """Inside and not on the boundary."""
    return odd_crossings(edges, x, y) & ~on_any_edge(edges, x, y)


def point_segment_distance(px, py, x1, y1, x2, y2) -> Column:
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, ((px - x1) * dx + (py - y1) * dy) / F.nullif(length2, F.lit(0.0))
               ).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def segment_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Distance of two segments, 0 where they cross."""
    ax1, ay1, ax2, ay2 = a
    bx1, by1, bx2, by2 = b

    def side(ox, oy, px, py, qx, qy):
        return F.signum((px - ox) * (qy - oy) - (py - oy) * (qx - ox))

    crossing = (
        (side(ax1, ay1, ax2, ay2, bx1, by1) * side(ax1, ay1, ax2, ay2, bx2, by2) < 0)
        & (side(bx1, by1, bx2, by2, ax1, ay1) * side(bx1, by1, bx2, by2, ax2, ay2) < 0))
    ends = F.least(
        point_segment_distance(ax1, ay1, *b), point_segment_distance(ax2, ay2, *b),
        point_segment_distance(bx1, by1, *a), point_segment_distance(bx2, by2, *a))
    return F.when(crossing, F.lit(0.0)).otherwise(ends)


def to_metres(lon: str | Column, lat: str | Column, central_meridian: float = 39.0,
              south: bool = True) -> Column:
    """Transverse Mercator on WGS 84 as (x, y) in metres; the default is zone 37 South.

    Kruger's series to third order, good to about a millimetre inside a zone.
    """
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    radius = k0 * a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    alpha = (n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16, 13 * n ** 2 / 48 - 3 * n ** 3 / 5,
             61 * n ** 3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, dl = F.radians(as_col(lat)), F.radians(as_col(lon) - F.lit(central_meridian))
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi)))
    xi = F.atan2(t, F.cos(dl))
    eta = F.atanh(F.sin(dl) / F.sqrt(F.lit(1.0) + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, start=1):
        x = x + F.lit(c) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        y = y + F.lit(c) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
    return F.struct((x * radius + 500_000.0).alias("x"),
                    (y * radius + (10_000_000.0 if south else 0.0)).alias("y"))
