"""Plane geometry as Column expressions: an equal-area projection, distances, and points in rings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Albers conic with two parallels for Australia (EPSG:9473) on the GRS80 ellipsoid.
RADIUS, FLATTENING = 6378137.0, 1 / 298.257222101
PARALLELS, CENTRE = (-18.0, -36.0), 132.0

E2 = 2 * FLATTENING - FLATTENING**2
E1 = math.sqrt(E2)


def _q(s: float) -> float:
    return (1 - E2) * (s / (1 - E2 * s * s) - math.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1))


def _constants() -> tuple[float, float, float]:
    (s1, m1), (s2, m2) = ((math.sin(p), math.cos(p) / math.sqrt(1 - E2 * math.sin(p) ** 2)) for p in map(math.radians, PARALLELS))
    n = (m1**2 - m2**2) / (_q(s2) - _q(s1))
    c = m1**2 + n * _q(s1)
    return n, c, RADIUS * math.sqrt(c) / n


N, C, RHO0 = _constants()


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres east and north. N is below 0 for southern parallels, and so is the radius."""
    s = F.sin(F.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1))
    rho = RADIUS * F.sqrt(C - N * q) / N
    theta = N * F.radians(lon - CENTRE)
    return rho * F.sin(theta), RHO0 - rho * F.cos(theta)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def round1(c: Column) -> Column:
    """One decimal, halves to even."""
    return F.rint(c * 10) / 10


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size)


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """From a point to the nearest point of a segment; a segment may be a point."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    along = F.when(square > 0, ((x - x1) * dx + (y - y1) * dy) / square).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return distance(x, y, x1 + t * dx, y1 + t * dy)


def ring_edges(rings: Column) -> Column:
    """All edges, as struct(a, b) of points, of rings: array<array<struct<x,y>>>, each closed."""
    edges = lambda ring: F.transform(F.slice(ring, F.lit(2), F.size(ring)), lambda b, i: F.struct(F.get(ring, i).alias("a"), b.alias("b")))
    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 1), edges))


def inside_edges(x: Column, y: Column, edges: Column) -> Column:
    """Whether a point is strictly inside by the even-odd rule, holes and parts alike; on an edge it isn't. Of the edges only
    those are needed that reach the point's height."""

    def seen(e: Column) -> Column:
        a, b = e["a"], e["b"]
        crosses = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        on = (cross == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        # On an edge: more than all crossings together.
        return F.when(on, F.lit(1 << 40)).otherwise(F.when(crosses & (x < at), 1).otherwise(0)).cast("long")

    crossed = F.aggregate(edges, F.lit(0).cast("long"), lambda n, e: n + seen(e))
    return (crossed < (1 << 40)) & (crossed % 2 == 1)


def inside_rings(x: Column, y: Column, rings: Column) -> Column:
    return inside_edges(x, y, ring_edges(rings))
