"""Spatial joins as equi-joins on grid cells with an exact predicate on top: no nested loops.

Regions are rows of a code and rings (array<array<struct<x double, y double>>>, closed). Points have x and y.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.functions.geo import cell, distance, inside_edges, inside_rings, ring_edges, round1, segment_distance


def _bounds(points: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)


def _cells(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column, size: float, names: tuple[str, str]) -> DataFrame:
    across = df.withColumn(names[0], F.explode(F.sequence(cell(x0, size), cell(x1, size))))
    return across.withColumn(names[1], F.explode(F.sequence(cell(y0, size), cell(y1, size))))


def within(points: DataFrame, regions: DataFrame, code: str, x: str = "x", y: str = "y", rings: str = "rings", size: float = 1.0) -> DataFrame:
    """points with the code of each region they lie strictly inside of. size is about a region's extent or less.

    A cell of a region's box has its code and box alone. The edges are cut into bands of a cell's height, and a point in a
    box meets only the edges of its own band."""
    boxed = regions.select(code, *(c.alias(n) for c, n in zip(_bounds(F.flatten(rings)), ("__x0", "__x1", "__y0", "__y1"), strict=True)))
    tiles = _cells(boxed, F.col("__x0"), F.col("__x1"), F.col("__y0"), F.col("__y1"), size, ("__cx", "__cy"))
    edges = regions.select(code, F.explode(ring_edges(F.col(rings))).alias("__e"))
    spanned = F.sequence(cell(F.least("__e.a.y", "__e.b.y"), size), cell(F.greatest("__e.a.y", "__e.b.y"), size))
    bands = edges.withColumn("__cy", F.explode(spanned)).groupBy(code, "__cy").agg(F.collect_list("__e").alias("__edges"))
    placed = points.withColumns({"__cx": cell(F.col(x), size), "__cy": cell(F.col(y), size)})
    near = placed.join(tiles, ["__cx", "__cy"]).where(F.col(x).between(F.col("__x0"), F.col("__x1")) & F.col(y).between(F.col("__y0"), F.col("__y1")))
    return near.join(bands, [code, "__cy"]).where(inside_edges(F.col(x), F.col(y), F.col("__edges"))).select(*points.columns, code)


def first_region(matched: DataFrame, key: str, code: str) -> DataFrame:
    """One region per point where regions overlap: the first by code."""
    return matched.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(code))).where("__r = 1").drop("__r")


def nearest(points: DataFrame, regions: DataFrame, key: str, code: str, cap: float, x: str = "x", y: str = "y", rings: str = "rings") -> DataFrame:
    """key, code, distance (one decimal) of the nearest region within cap, measured to its edges; of several as near the
    first by code. Coordinates are planar, in the cap's unit."""
    size = cap * 1.001
    edges = regions.select(code, F.explode(ring_edges(F.col(rings))).alias("e"))
    edges = edges.select(code, F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))
    # An edge is walked column by column: in each only the cells around its stretch there, not those of its whole box.
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")
    walked = edges.withColumn("__cx", F.explode(F.sequence(cell(left - cap, size), cell(right + cap, size))))
    begin, end = F.greatest(left, F.col("__cx") * size - cap), F.least(right, (F.col("__cx") + 1) * size + cap)
    height = lambda at: F.col("y1") + (F.col("y2") - F.col("y1")) * (at - F.col("x1")) / (F.col("x2") - F.col("x1"))
    upright = F.col("x1") == F.col("x2")
    ya, yb = F.when(upright, F.col("y1")).otherwise(height(begin)), F.when(upright, F.col("y2")).otherwise(height(end))
    slack = cap * 1.0001
    tiles = walked.withColumn("__cy", F.explode(F.sequence(cell(F.least(ya, yb) - slack, size), cell(F.greatest(ya, yb) + slack, size))))
    placed = points.select(key, F.col(x).alias("__x"), F.col(y).alias("__y"), cell(F.col(x), size).alias("__cx"), cell(F.col(y), size).alias("__cy"))
    apart = segment_distance(*(F.col(c) for c in ("__x", "__y", "x1", "y1", "x2", "y2")))
    close = placed.join(tiles, ["__cx", "__cy"]).withColumn("d", apart).where(F.col("d") <= cap)
    by_region = close.groupBy(key, code).agg(F.min("d").alias("d"))
    best = Window.partitionBy(key).orderBy("d", code)
    return by_region.withColumn("__r", F.row_number().over(best)).where("__r = 1").select(key, code, round1(F.col("d")).alias("distance"))


def distance_join(left: DataFrame, right: DataFrame, radius: float, left_xy: tuple[str, str] = ("x", "y"), right_xy: tuple[str, str] = ("sx", "sy")) -> DataFrame:
    """All pairs at most radius apart, with the exact distance d. The right side is copied to the cells around its own."""
    size = radius * 1.001
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    spread = right.withColumn("__n", F.explode(around)).withColumns({"__cx": cell(F.col(right_xy[0]), size) + F.col("__n.i"), "__cy": cell(F.col(right_xy[1]), size) + F.col("__n.j")}).drop("__n")
    placed = left.withColumns({"__cx": cell(F.col(left_xy[0]), size), "__cy": cell(F.col(left_xy[1]), size)})
    d = distance(*(F.col(c) for c in (*left_xy, *right_xy)))
    return placed.join(spread, ["__cx", "__cy"]).withColumn("d", d).where(F.col("d") <= radius).drop("__cx", "__cy")


def agreement(points: DataFrame, regions: DataFrame, code: str, label: str, x: str = "x", y: str = "y", rings: str = "rings") -> DataFrame:
    """Per label (how the region was assigned): points, and those inside the region whose code they carry."""
    joined = points.join(regions.select(F.col(code).alias("__code"), rings), F.col(code) == F.col("__code"), "left")
    inside = F.col("__code").isNotNull() & inside_rings(F.col(x), F.col(y), F.col(rings))
    return joined.groupBy(label).agg(F.count("*").alias("points"), F.count(F.when(inside, 1)).alias("inside"))
