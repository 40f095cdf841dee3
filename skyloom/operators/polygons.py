"""Points and legs against a table of polygons: a grid covers each polygon, most points need no ray.

Polygons are vertices (designator, ring, k, lon, lat), each ring in the order of k, closed by itself; rings inside rings are holes, several outer ones are parts
of one polygon. A point on a border is in no polygon. Cells that no edge touches lie inside or outside as a whole; only
points in the other cells are tried, and only against the edges of their row of cells that don't end to the left of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trajectory import checked_broadcast


def rings(polygons: DataFrame) -> DataFrame:
    """(designator, edges) of vertices: all edges of a polygon, the one that closes each ring included. Vertices without a place don't count."""
    v = polygons.dropna(subset=["designator", "lon", "lat"])
    ring = v.groupBy("designator", "ring").agg(F.array_sort(F.collect_list(F.struct("k", "lon", "lat"))).alias("v"))
    after = lambda i: F.get("v", (i + 1) % F.size("v"))
    edge = lambda p, i: F.struct(p["lon"].cast("double").alias("x1"), p["lat"].cast("double").alias("y1"), after(i)["lon"].cast("double").alias("x2"), after(i)["lat"].cast("double").alias("y2"))
    return ring.groupBy("designator").agg(F.flatten(F.collect_list(F.transform("v", edge))).alias("edges"))


def crossed(edges: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the right crosses an odd number of edges."""
    hit = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    return F.size(F.filter(edges, hit)) % 2 == 1


def on_edge(edges: Column, x: Column, y: Column) -> Column:
    """Whether the point lies on an edge."""
    between = lambda v, a, b: (v >= F.least(a, b)) & (v <= F.greatest(a, b))
    return F.exists(edges, lambda e: ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"])) & between(x, e["x1"], e["x2"]) & between(y, e["y1"], e["y2"]))


def cover(polygons: DataFrame, cell: float = 1.0) -> DataFrame:
    """(designator, cx, cy, inner, edges): the cells that each polygon meets; ``inner`` ones lie inside as a whole and carry no edges."""
    low = lambda c: F.array_min(F.transform("edges", lambda e: F.least(e[f"{c}1"], e[f"{c}2"])))
    high = lambda c: F.array_max(F.transform("edges", lambda e: F.greatest(e[f"{c}1"], e[f"{c}2"])))
    span = lambda c: F.sequence(F.floor(low(c) / cell), F.floor(high(c) / cell))
    # a row of cells first, with the edges that reach it, then its cells
    rows = rings(polygons).select("designator", "edges", span("x").alias("_xs"), F.explode(span("y")).alias("cy"))
    bottom, top = F.col("cy") * cell, (F.col("cy") + 1) * cell
    rows = rows.withColumn("edges", F.filter("edges", lambda e: (F.least(e["y1"], e["y2"]) <= top) & (F.greatest(e["y1"], e["y2"]) >= bottom)))
    cells = rows.select("designator", "cy", "edges", F.explode("_xs").alias("cx"))
    left, right = F.col("cx") * cell, (F.col("cx") + 1) * cell

    def meets(e: Column) -> Column:
        # boxes overlap, and the corners of the cell aren't all strictly on one side of the edge's line
        side = lambda x, y: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        corners = [side(x, y) for x in (left, right) for y in (bottom, top)]
        apart = (F.least(*corners) > 0) | (F.greatest(*corners) < 0)
        return (F.least(e["x1"], e["x2"]) <= right) & (F.greatest(e["x1"], e["x2"]) >= left) & ~apart

    ahead = F.filter("edges", lambda e: F.greatest(e["x1"], e["x2"]) >= left)
    cells = cells.withColumn("border", F.exists("edges", meets)).withColumn("edges", ahead)
    middle = crossed(F.col("edges"), left + cell / 2, bottom + cell / 2)
    kept = cells.withColumn("inner", ~F.col("border") & middle).filter("border or inner")
    return kept.select("designator", "cx", "cy", "inner", F.when(F.col("border"), F.col("edges")).alias("edges"))


def located(points: DataFrame, polygons: DataFrame, lon: str = "lon", lat: str = "lat", cell: float = 1.0) -> DataFrame:
    """Points with the designator of every polygon that they lie in; points in none go."""
    cells = checked_broadcast(cover(polygons, cell).select("designator", "inner", "edges", F.col("cx").alias("_cx"), F.col("cy").alias("_cy")))
    at = points.withColumns({"_cx": F.floor(F.col(lon) / cell), "_cy": F.floor(F.col(lat) / cell)})
    tried = at.join(cells, ["_cx", "_cy"])
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    inside = tried.filter(F.col("inner") | (crossed(F.col("edges"), x, y) & ~on_edge(F.col("edges"), x, y)))
    return inside.select(*[f"`{c}`" for c in points.columns], "designator")


def legs_by_polygon(legs: DataFrame, polygons: DataFrame, key: str = "leg_id", cell: float = 1.0) -> DataFrame:
    """(key, designator, both): legs with an end inside a polygon; both: with both ends."""
    ends = F.array(*[F.struct(F.col(f"{e}_lon").alias("lon"), F.col(f"{e}_lat").alias("lat"), F.lit(k).alias("end")) for k, e in enumerate(("from", "to"))])
    found = located(legs.select(key, F.explode(ends).alias("p")).select(key, "p.*"), polygons, cell=cell)
    return found.groupBy(key, "designator").agg((F.count_distinct("end") == 2).alias("both"))
