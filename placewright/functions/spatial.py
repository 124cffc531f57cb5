"""Geometry as column expressions. Distances are along the spheroid of WGS 84 (geodesic.py)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geodesic import MEAN, distance, sphere, within

__all__ = ["distance", "sphere", "within"]

#: Distances in metres and their weights in a score; a place within 1 m is within all of them.
BANDS = ((1, 10000), (10, 1000), (100, 100), (1000, 10), (10000, 1))


def band_score(metres: Column, bands=BANDS) -> Column:
    out = F.lit(0)
    for limit, weight in bands:
        out = out + (metres <= limit).cast("int") * weight
    return out


def within_box(x: Column, y: Column, west: Column, east: Column, south: Column, north: Column) -> Column:
    """Inside, not on an edge."""
    return (x > west) & (x < east) & (y > south) & (y < north)


def _edges(ring: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, i + 1).alias("b")))


def crosses(ax: Column, ay: Column, bx: Column, by: Column, x: Column, y: Column) -> Column:
    """Whether a ray from the point to the east crosses the edge."""
    slope = (bx - ax) / F.nullif(by - ay, F.lit(0.0))
    return F.coalesce(((ay > y) != (by > y)) & (x < slope * (y - ay) + ax), F.lit(False))


def contains(mpoly: Column, x: Column, y: Column) -> Column:
    """Whether the multipolygon holds the point: even-odd over all rings, so holes are outside."""
    edges = F.flatten(F.transform(F.filter(F.flatten(mpoly), lambda r: F.size(r) >= 2), _edges))
    return F.size(F.filter(edges, lambda e: crosses(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"], x, y))) % 2 == 1


def area(ring: Column) -> Column:
    """Shoelace area of a closed ring, in square units of its coordinates."""
    return F.abs(F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def polygon_area(polygon: Column) -> Column:
    """The outer ring less its holes."""
    return area(F.get(polygon, 0)) - F.aggregate(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.lit(0.0), lambda s, r: s + area(r))


def centroid(ring: Column) -> Column:
    """Centroid of a closed ring as a struct of x and y."""
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, e: Column) -> Column:
        p, q = e["a"], e["b"]
        k = p["x"] * q["y"] - q["x"] * p["y"]
        return F.struct((s["a"] + k).alias("a"), (s["x"] + k * (p["x"] + q["x"])).alias("x"), (s["y"] + k * (p["y"] + q["y"])).alias("y"))

    return F.aggregate(_edges(ring), start, add, lambda s: F.struct((s["x"] / (3 * F.nullif(s["a"], F.lit(0.0)))).alias("x"), (s["y"] / (3 * F.nullif(s["a"], F.lit(0.0)))).alias("y")))


def box(mpoly: Column) -> Column:
    """Bounding box as a struct of west, east, south, north."""
    points = F.flatten(F.flatten(mpoly))
    of = lambda agg, c: agg(F.transform(points, lambda p: p[c]))
    return F.struct(of(F.array_min, "x").alias("west"), of(F.array_max, "x").alias("east"), of(F.array_min, "y").alias("south"), of(F.array_max, "y").alias("north"))


def box_polygon(west: Column, east: Column, south: Column, north: Column) -> Column:
    """A box as a multipolygon of one closed ring."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(F.array(F.array(point(west, south), point(east, south), point(east, north), point(west, north), point(west, south))))


def as_multipolygon(polygon: Column) -> Column:
    return F.array(polygon)


def axes(lat: Column, lon: Column) -> list[Column]:
    """Metres from the centre of the sphere along three axes."""
    flat = F.cos(F.radians(lat)) * MEAN
    return [flat * F.cos(F.radians(lon)), flat * F.sin(F.radians(lon)), F.sin(F.radians(lat)) * MEAN]


def cube(lat: Column, lon: Column, radius: float, wide: float = 2) -> Column:
    """The cube, two radiuses wide or as many as said, that a point lies in. Cubes know no poles and no date line."""
    return F.struct(*[F.floor(v / (wide * radius)).alias(f"c{i}") for i, v in enumerate(axes(lat, lon))])


def cubes_near(lat: Column, lon: Column, radius: float, wide: float = 2) -> Column:
    """The cubes that hold all points within the radius: no coordinate differs by more than the way along the sphere, which is within a percent of the spheroid's."""
    reach = radius * 1.01 + 1e-3
    span = lambda v: F.sequence(F.floor((v - reach) / (wide * radius)), F.floor((v + reach) / (wide * radius)))
    x, y, z = (span(v) for v in axes(lat, lon))
    return F.flatten(F.flatten(F.transform(x, lambda a: F.transform(y, lambda b: F.transform(z, lambda c: F.struct(a.alias("c0"), b.alias("c1"), c.alias("c2")))))))


def from_web_mercator(x: Column, y: Column) -> Column:
    """lon and lat of a point in web mercator metres, whose sphere has the radius of the equator."""
    turn = F.lit(6378137.0)
    return F.struct(F.degrees(x / turn).alias("lon"), F.degrees(F.atan(F.sinh(y / turn))).alias("lat"))


def geojson(mpoly: Column, lon: Column, lat: Column) -> Column:
    """GeometryCollection of the point and, if there is one, the polygon; a single polygon isn't a MultiPolygon."""
    pair = lambda x, y: F.array(F.round(x, 6), F.round(y, 6))
    coordinates = F.transform(mpoly, lambda poly: F.transform(poly, lambda ring: F.transform(ring, lambda p: pair(p["x"], p["y"]))))
    point = F.to_json(F.struct(pair(lon, lat).alias("coordinates"), F.lit("Point").alias("type")))
    single = F.to_json(F.struct(F.get(coordinates, 0).alias("coordinates"), F.lit("Polygon").alias("type")))
    many = F.to_json(F.struct(coordinates.alias("coordinates"), F.lit("MultiPolygon").alias("type")))
    shape = F.when(F.size(mpoly) == 1, single).when(F.size(mpoly) > 1, many)
    return F.concat(F.lit('{"geometries": ['), F.concat_ws(", ", point, shape), F.lit('], "type": "GeometryCollection"}'))
