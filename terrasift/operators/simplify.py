"""Polygon simplification: each ring by itself, ends fixed, never below a triangle, and never across another edge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _distances(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = b - a
    square = float(d @ d)
    if square == 0:
        return np.hypot(*(p - a).T)
    t = np.clip(((p - a) @ d) / square, 0, 1)
    return np.hypot(*(p - a - t[:, None] * d).T)


def _marked(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points Douglas-Peucker keeps, from a stack instead of recursion. A ring is split at the point farthest from
    its start first."""
    keep = np.zeros(len(ring), bool)
    keep[[0, -1]] = True
    far = int(np.argmax(np.hypot(*(ring - ring[0]).T)))
    keep[far] = True
    stack = [(0, far), (far, len(ring) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = _distances(ring[a + 1 : b], ring[a], ring[b])
        k = int(np.argmax(d))
        if d[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def _crosses(ring: np.ndarray) -> bool:
    """Whether two edges of a closed ring that aren't neighbours meet."""
    a, b = ring[:-1], ring[1:]
    n = len(a)
    side = lambda p, q, r: np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))
    for i in range(n - 2):
        j = np.arange(i + 2, n - (i == 0))
        if len(j) and ((side(a[i], b[i], a[j]) * side(a[i], b[i], b[j]) < 0) & (side(a[j], b[j], a[i]) * side(a[j], b[j], b[i]) < 0)).any():
            return True
    return False


def simplify_ring(points: np.ndarray, tolerance: float) -> np.ndarray:
    """With a smaller tolerance where the full one makes the ring cross itself or fall flat; the ring itself at last."""
    if len(points) <= 4:
        return points
    while tolerance > 1e-12:
        out = points[_marked(points, tolerance)]
        if len(out) >= 4 and not _crosses(out):
            return out
        tolerance /= 2
    return points


def simplify(regions: DataFrame, tolerance: float, rings: str = "rings") -> DataFrame:
    """regions with simplified rings; NULL stays NULL. Regions are simplified one by one: shared borders may part."""
    columns = regions.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.copy()
            pdf[rings] = [
                None if shape is None else [[{"x": x, "y": y} for x, y in simplify_ring(np.array([(p["x"], p["y"]) for p in ring]), tolerance).tolist()] for ring in shape]
                for shape in pdf[rings]
            ]
            yield pdf[columns]

    return regions.mapInPandas(run, regions.schema)
