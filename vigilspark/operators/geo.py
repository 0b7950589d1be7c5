"""Points in polygons: a grid of tiles pairs each point with the few polygons whose box meets its tile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Degrees of a tile; a polygon meets at most 36 x 18 of them.
TILE = 10
EPSILON = 1e-6


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether a ring (array of [lon, lat]) holds a point: an odd number of edges lies east of it."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == 1, n).otherwise(i - 1))
        x, y, rise = a[0], a[1], b[1] - a[1]
        return (F.abs(rise) >= EPSILON) & ((y > lat) != (b[1] > lat)) & (lon < F.try_divide((b[0] - x) * (lat - y), rise) + x)

    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), n), crosses)) % 2 == 1).otherwise(False)


def in_polygon(lon: Column, lat: Column, rings: Column) -> Column:
    """Inside the first ring and in none of the others, which are holes."""
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    return F.when(F.size(rings) > 0, in_ring(lon, lat, F.get(rings, F.lit(0))) & ~F.exists(holes, lambda r: in_ring(lon, lat, r))).otherwise(False)


def _tile(x: Column) -> Column:
    return F.floor(x / TILE).cast("int")


def within(points: DataFrame, polygons: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(the points' columns, polygon) for each polygon (polygon, rings) that holds a point."""
    ends = lambda k, of: of(F.transform(F.get("rings", F.lit(0)), lambda p: p[k]))
    boxes = polygons.select("polygon", "rings", *[ends(k, of).alias(name) for name, k, of in (("x0", 0, F.array_min), ("x1", 0, F.array_max), ("y0", 1, F.array_min), ("y1", 1, F.array_max))]).filter("x0 is not null and y0 is not null")
    span = lambda low, high: F.explode(F.sequence(_tile(F.col(low)), _tile(F.col(high))))
    tiles = boxes.select("polygon", "x0", "x1", "y0", "y1", span("x0", "x1").alias("__tx")).select("*", span("y0", "y1").alias("__ty"))
    keyed = points.withColumns({"__tx": _tile(F.col(lon)), "__ty": _tile(F.col(lat))})
    near = keyed.join(tiles, ["__tx", "__ty"]).filter(F.col(lon).between(F.col("x0") - EPSILON, F.col("x1") + EPSILON) & F.col(lat).between(F.col("y0") - EPSILON, F.col("y1") + EPSILON))
    return near.join(polygons.select("polygon", "rings"), "polygon").filter(in_polygon(F.col(lon), F.col(lat), F.col("rings"))).select(*points.columns, "polygon")
