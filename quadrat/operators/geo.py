"""Points, boxes, distances and polygons on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.sites import let

EARTH_M = 6371008.8
MILE_M = 1609.344
MOST_MILES = 50
DEGREE_MILES = EARTH_M * math.pi / 180 / MILE_M


def distance_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_M / MILE_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def radius(points: DataFrame, lat: float, lon: float, miles: float, limit: int = 1000) -> DataFrame:
    """Points (id, lat, lon) within the radius (50 miles at most), nearest first. A box that the scan can use comes before the distance."""
    miles = min(miles, MOST_MILES)
    d_lat = miles / DEGREE_MILES * 1.001
    d_lon = d_lat / max(0.01, math.cos(math.radians(min(89.0, abs(lat) + d_lat))))
    box = points.where(F.col("lat").between(lat - d_lat, lat + d_lat) & F.col("lon").between(lon - d_lon, lon + d_lon))
    near = box.withColumn("miles", distance_miles(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).where(F.col("miles") <= miles)
    return near.withColumn("miles", F.round("miles", 3)).orderBy("miles", "id").limit(limit)


def in_box(points: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    return points.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def by_precedence(*layers: DataFrame, key: str = "id") -> DataFrame:
    """Union of layers; a key in an earlier layer keeps it out of later ones."""
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer.join(out.select(key).distinct(), key, "left_anti"))
    return out


def area_and_centroid(ring: Column) -> Column:
    """struct(area, x, y) of a closed ring, an array of struct(x, y), by the shoelace formula; the mean of its points if it has no area."""
    return let(ring, _area_and_centroid)


def _area_and_centroid(ring: Column) -> Column:
    pairs = F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda p, q: F.struct((p.x * q.y - q.x * p.y).alias("c"), (p.x + q.x).alias("x"), (p.y + q.y).alias("y")))
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda a, s: a + f(s))
    twice = total(lambda s: s.c)
    mean = lambda c: F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[c]) / F.nullif(F.size(ring), F.lit(0))
    x, y = (F.when(twice != 0, total(lambda s, c=c: s.c * s[c]) / (3 * twice)).otherwise(mean(c)) for c in ("x", "y"))
    return F.struct((F.abs(twice) / 2).alias("area"), x.alias("x"), y.alias("y"))


def ring_of(*points: tuple[Column, Column]) -> Column:
    """A closed ring of corners."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(*(corner(x, y) for x, y in (*points, points[0])))


def box_ring(west: Column, south: Column, east: Column, north: Column) -> Column:
    return ring_of((west, south), (east, south), (east, north), (west, north))


def _edges(ring: Column) -> Column:
    return F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def edge_miles(ring: Column, lat: float, lon: float) -> Column:
    """Miles from a point to a closed ring's nearest edge, 0 inside; on a plane that touches the earth at the point, which is good to a part in a thousand within 50 miles."""
    east = DEGREE_MILES * math.cos(math.radians(lat))
    near = F.transform(ring, lambda p: F.struct(((p["x"] - lon) * east).alias("x"), ((p["y"] - lat) * DEGREE_MILES).alias("y")))

    def apart(e: Column) -> Column:
        p, dx, dy = e["p"], e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
        long = dx * dx + dy * dy
        t = F.when(long == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(p["x"] * dx + p["y"] * dy) / long)))
        x, y = p["x"] + t * dx, p["y"] + t * dy
        return F.sqrt(x * x + y * y)

    def crossed(e: Column) -> Column:
        """Does the ray to the east meet the edge?"""
        p, q = e["p"], e["q"]
        return ((p["y"] > 0) != (q["y"] > 0)) & (p["x"] - p["y"] * (q["x"] - p["x"]) / (q["y"] - p["y"]) > 0)

    edges = _edges(near)
    inside = F.size(F.filter(edges, lambda e: F.when(e["p"]["y"] != e["q"]["y"], crossed(e)).otherwise(False))) % 2 == 1
    return F.when(inside, 0.0).otherwise(F.array_min(F.transform(edges, apart)))


def radius_of_shapes(shapes: DataFrame, lat: float, lon: float, miles: float, limit: int | None = None) -> DataFrame:
    """Shapes (id, ring of struct(x, y)) whose nearest edge is within the radius (50 miles at most), nearest first; all of them, unless a caller's page has a limit. Boxes around them are compared before edges."""
    miles = min(miles, MOST_MILES)
    d_lat = miles / DEGREE_MILES * 1.001
    d_lon = d_lat / max(0.01, math.cos(math.radians(min(89.0, abs(lat) + d_lat))))
    of = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    box = (of(F.array_max, "x") >= lon - d_lon) & (of(F.array_min, "x") <= lon + d_lon) & (of(F.array_max, "y") >= lat - d_lat) & (of(F.array_min, "y") <= lat + d_lat)
    near = shapes.where(box).withColumn("miles", edge_miles(F.col("ring"), lat, lon)).where(F.col("miles") <= miles)
    ordered = near.withColumn("miles", F.round("miles", 3)).orderBy("miles", "id")
    return ordered if limit is None else ordered.limit(limit)


def _cut_by(ring: Column, axis: str, at: Column, sign: int) -> Column:
    """What of a closed ring lies on one side of a line, closed again."""
    other = "y" if axis == "x" else "x"
    at = at.cast("double") if isinstance(at, Column) else F.lit(float(at))

    def kept(e: Column) -> Column:
        p, q = e["p"], e["q"]
        a, b = (p[axis] - at) * sign, (q[axis] - at) * sign
        between = p[other] + a / F.when(a != b, a - b) * (q[other] - p[other])
        meets = F.struct(*(c.alias(n) for n, c in sorted({axis: at, other: between}.items())))
        none = F.array().cast("array<struct<x:double,y:double>>")
        return F.when((a >= 0) & (b >= 0), F.array(q)).when(a >= 0, F.array(meets)).when(b >= 0, F.array(meets, q)).otherwise(none)

    return let(let(ring, lambda r: F.flatten(F.transform(_edges(r), kept))), lambda points: F.concat(points, F.slice(points, 1, 1)))


def clipped(ring: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """What of a closed ring lies in a box, closed again; empty if nothing does. One side of the box cuts after the other."""
    for axis, at, sign in (("x", west, 1), ("x", east, -1), ("y", south, 1), ("y", north, -1)):
        ring = _cut_by(ring, axis, at, sign)
    return ring


def union_of_sections(rows: DataFrame, by: str, key: str, ring: str) -> DataFrame:
    """Per ``by``: rings of its different sections, which share edges at most, and the box around them."""
    once = rows.dropDuplicates([by, key])
    of = lambda f, c: f(F.transform(ring, lambda p: p[c]))
    return once.groupBy(by).agg(F.collect_list(ring).alias("rings"), F.min(of(F.array_min, "x")).alias("west"), F.min(of(F.array_min, "y")).alias("south"), F.max(of(F.array_max, "x")).alias("east"), F.max(of(F.array_max, "y")).alias("north"))
