"""Queries of shapes: overlaps, unions, units in their sections, and points linked to sections. Shapes are made of the tables' numbers, on a plane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.operators import geo, shapes
from quadrat.plans.catalogue import query
from quadrat.plans.domain import table
from quadrat.sources import boundaries


def _ring(*points: tuple[Column, Column]) -> Column:
    return geo.ring_of(*points)


def _diamond(x: Column, y: Column, r: Column) -> Column:
    return _ring((x + r, y), (x, y + r), (x - r, y), (x, y - r))


_INSIDE = "len(list_filter(range(1, len({1}) + 1), lambda i: ({1}[i % len({1}) + 1].x - {1}[i].x) * ({0}.y - {1}[i].y) - ({1}[i % len({1}) + 1].y - {1}[i].y) * ({0}.x - {1}[i].x) < 0)) = 0"

_OVERLAPS = f"""
WITH a AS (SELECT c_custkey AS a, [{{'x': x, 'y': y}}, {{'x': x + w, 'y': y}}, {{'x': x, 'y': y + h}}] AS ap FROM (SELECT c_custkey, (c_custkey * 7919 % 4000)::DOUBLE AS x, (c_custkey * 104729 % 4000)::DOUBLE AS y, (c_custkey % 7 + 3) * CASE WHEN c_custkey % 50 = 0 THEN 60 ELSE 1 END AS w, c_custkey % 5 + 2 AS h FROM customer)),
b AS (SELECT s_suppkey AS b, [{{'x': x + r, 'y': y}}, {{'x': x, 'y': y + r}}, {{'x': x - r, 'y': y}}, {{'x': x, 'y': y - r}}] AS bp FROM (SELECT s_suppkey, (s_suppkey * 7919 % 4000)::DOUBLE AS x, (s_suppkey * 104729 % 4000)::DOUBLE AS y, s_suppkey % 60 + 40 AS r FROM supplier)),
near AS (SELECT * FROM a JOIN b ON list_min([p.x FOR p IN ap]) <= list_max([p.x FOR p IN bp]) AND list_min([p.x FOR p IN bp]) <= list_max([p.x FOR p IN ap]) AND list_min([p.y FOR p IN ap]) <= list_max([p.y FOR p IN bp]) AND list_min([p.y FOR p IN bp]) <= list_max([p.y FOR p IN ap])),
e AS (SELECT a, b, ap[i] AS p, ap[i % len(ap) + 1] AS q, bp[j] AS u, bp[j % len(bp) + 1] AS v FROM near, unnest(range(1, len(ap) + 1)) s(i), unnest(range(1, len(bp) + 1)) t(j)),
d AS (SELECT *, (q.x - p.x) * (v.y - u.y) - (q.y - p.y) * (v.x - u.x) AS d, (u.x - p.x) * (v.y - u.y) - (u.y - p.y) * (v.x - u.x) AS t, (u.x - p.x) * (q.y - p.y) - (u.y - p.y) * (q.x - p.x) AS s FROM e),
pts AS (SELECT a, b, p.x AS x, p.y AS y FROM (SELECT a, b, bp, unnest(ap) AS p FROM near) WHERE {_INSIDE.format('p', 'bp')} UNION SELECT a, b, p.x, p.y FROM (SELECT a, b, ap, unnest(bp) AS p FROM near) WHERE {_INSIDE.format('p', 'ap')}
  UNION SELECT a, b, p.x + t / d * (q.x - p.x), p.y + t / d * (q.y - p.y) FROM d WHERE d <> 0 AND t / d BETWEEN 0 AND 1 AND s / d BETWEEN 0 AND 1),
turned AS (SELECT a, b, x - mx AS x, y - my AS y, row_number() OVER w AS i, count(*) OVER (PARTITION BY a, b) AS n FROM (SELECT *, avg(x) OVER (PARTITION BY a, b) AS mx, avg(y) OVER (PARTITION BY a, b) AS my FROM pts) WINDOW w AS (PARTITION BY a, b ORDER BY atan2(y - my, x - mx)))
SELECT p.a, p.b, round(abs(sum(p.x * q.y - p.y * q.x)) / 2, 6) + 0 AS area FROM turned p JOIN turned q ON p.a = q.a AND p.b = q.b AND q.i = p.i % p.n + 1 GROUP BY ALL
"""


@query("spatial_overlaps", _OVERLAPS)
def _(spark, sf_dir) -> DataFrame:
    """Triangles of customers, a few of them wide, and diamonds of suppliers: the pairs that share a point, with the area they share."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    x, y, w, h = c * 7919 % 4000, c * 104729 % 4000, (c % 7 + 3) * F.when(c % 50 == 0, 60).otherwise(1), c % 5 + 2
    left = table(spark, sf_dir, "customer").select(c.alias("id"), shapes.ring_edges(_ring((x, y), (x + w, y), (x, y + h))).alias("edges"))
    right = table(spark, sf_dir, "supplier").select(s.alias("id"), shapes.ring_edges(_diamond(s * 7919 % 4000, s * 104729 % 4000, s % 60 + 40)).alias("edges"))
    return shapes.spatial_join(left, right).select("a", "b", (F.round("area", 6) + 0.0).alias("area"))


_DISSOLVED = """
WITH RECURSIVE cell AS (SELECT DISTINCT c_nationkey AS g, c_custkey % 72 // 6 AS x, c_custkey % 6 AS y FROM customer),
every AS (SELECT e.g, e.x, e.y, cell.g IS NOT NULL AS full_ FROM (SELECT g, x, y FROM (SELECT DISTINCT g FROM cell), range(-1, 13) s(x), range(-1, 7) t(y)) e LEFT JOIN cell ON e.g = cell.g AND e.x = cell.x AND e.y = cell.y),
step AS (SELECT p.g, p.x, p.y, q.x AS nx, q.y AS ny FROM every p JOIN every q ON p.g = q.g AND p.full_ = q.full_ AND abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 AND (NOT p.full_ OR p.x = q.x OR p.y = q.y)),
walk AS (SELECT g, x, y, x AS rx, y AS ry FROM every UNION SELECT walk.g, walk.x, walk.y, nx, ny FROM walk JOIN step ON walk.g = step.g AND rx = step.x AND ry = step.y),
least AS (SELECT g, x, y, min((rx, ry)) AS part FROM walk GROUP BY ALL)
SELECT g AS cluster, count(*) FILTER (full_)::DOUBLE AS area, count(DISTINCT part) FILTER (full_) AS parts, count(DISTINCT part) FILTER (NOT full_) - 1 AS holes FROM least JOIN every USING (g, x, y) GROUP BY g
"""


@query("dissolved_sections", _DISSOLVED)
def _(spark, sf_dir) -> DataFrame:
    """Each nation's customers as squares of a grid, dissolved: squares side by side are one part, squares that touch at a corner are two."""
    k = F.col("c_custkey") % 72
    x, y = F.floor(k / 6), k % 6
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("cluster"), k.alias("section"), shapes.ring_edges(geo.box_ring(x, y, x + 1, y + 1)).alias("edges")).dropDuplicates(["cluster", "section"])
    rings = shapes.dissolved(rows, "cluster")
    return rings.groupBy("cluster").agg(F.round(F.sum("area"), 6).alias("area"), F.count_if(F.col("area") > 0).alias("parts"), F.count_if(F.col("area") < 0).alias("holes"))


_UNITS = """
WITH u AS (SELECT s_suppkey AS id, s_suppkey % 6 + 2 AS r, s_suppkey % 2 AS h FROM supplier),
s AS (SELECT DISTINCT l_suppkey AS id, l_partkey % 16 - 8 AS x, l_orderkey % 16 - 8 AS y FROM lineitem WHERE l_quantity > 45 AND l_linenumber = 1),
k AS (SELECT id, r, h, greatest(x, -x - 1) + greatest(y, -y - 1) AS k FROM u JOIN s USING (id)),
i AS (SELECT id, sum(CASE WHEN r >= k + 2 THEN 1 WHEN r = k + 1 THEN 0.5 ELSE 0 END - CASE WHEN h >= k + 2 THEN 1 WHEN h = k + 1 THEN 0.5 ELSE 0 END)::DOUBLE AS area FROM k GROUP BY id)
SELECT id, CASE WHEN area > 0 THEN 'sections' ELSE 'unit' END AS part, CASE WHEN area > 0 THEN area ELSE 2 * r * r - 2 * h * h END::DOUBLE AS area FROM u LEFT JOIN i USING (id)
"""


@query("units_in_sections", _UNITS)
def _(spark, sf_dir) -> DataFrame:
    """Suppliers' diamonds, every other one with a hole, inside the squares that their lines name, or whole."""
    s, r, zero = F.col("s_suppkey"), F.col("s_suppkey") % 6 + 2, F.lit(0)
    outer, hole = _diamond(zero, zero, r), _diamond(zero, zero, s % 2)
    units = table(spark, sf_dir, "supplier").select(s.alias("id"), shapes.polygon_edges(F.when(s % 2 == 1, F.array(outer, hole)).otherwise(F.array(outer))).alias("edges"))
    x, y = F.col("l_partkey") % 16 - 8, F.col("l_orderkey") % 16 - 8
    named = table(spark, sf_dir, "lineitem").where("l_quantity > 45 and l_linenumber = 1").select(F.col("l_suppkey").alias("id"), F.struct(x.alias("x"), y.alias("y")).alias("section"), shapes.ring_edges(geo.box_ring(x, y, x + 1, y + 1)).alias("edges"))
    return shapes.located_in_unit(units, named).groupBy("id", "part").agg(F.round(F.sum("area"), 6).alias("area"))


_LINKS = """
WITH p AS (SELECT c_custkey AS id, c_custkey * 7919 % 2000 / 2.0::DOUBLE AS x, c_custkey * 104729 % 2000 / 2.0::DOUBLE AS y FROM customer),
s AS (SELECT s_suppkey AS section, (s_suppkey * 7919 % 990)::DOUBLE AS w, (s_suppkey * 104729 % 990)::DOUBLE AS s, s_suppkey % 3 * 10 + 10 AS size FROM supplier),
d AS (SELECT id, section, sqrt(pow(greatest(w - x, 0, x - w - size), 2) + pow(greatest(s - y, 0, y - s - size), 2)) AS d FROM p, s)
SELECT id, arg_min(section, (d, section)) AS section, min(d) = 0 AS inside, round(min(d), 6) AS distance FROM d GROUP BY id
"""


@query("section_links", _LINKS)
def _(spark, sf_dir) -> DataFrame:
    """Customers as points, many on edges, and suppliers' squares: the square that holds each point, else the nearest."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    points = table(spark, sf_dir, "customer").select(c.alias("id"), (c * 7919 % 2000 / F.lit(2.0)).alias("x"), (c * 104729 % 2000 / F.lit(2.0)).alias("y"))
    w, south, size = s * 7919 % 990, s * 104729 % 990, s % 3 * 10 + 10
    squares = table(spark, sf_dir, "supplier").select(s.alias("id"), shapes.ring_edges(geo.box_ring(w, south, w + size, south + size)).alias("edges"))
    return shapes.section_links(points, squares).select("id", "section", "inside", F.round("distance", 6).alias("distance"))


_BOUNDARIES = """
WITH s AS (SELECT s_suppkey AS id, s_suppkey % 5 AS kind, s_suppkey % 7 + 1 AS w FROM supplier)
SELECT 'u' || id || CASE WHEN kind < 2 OR kind = 3 THEN '.kml' ELSE '.geojson' END AS path, CASE kind WHEN 0 THEN w * 2 WHEN 1 THEN w * 2 - 0.25 WHEN 2 THEN w * 2 + 1.5 END::DOUBLE AS area, CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 END::INT AS rings,
  CASE kind WHEN 3 THEN 'not in California; its projection may not be declared' WHEN 4 THEN 'no polygon in it' END AS problem FROM s
"""


@query("boundary_files", _BOUNDARIES)
def _(spark, sf_dir) -> DataFrame:
    """Boundary files of suppliers, in hundredths of a degree: boxes in KML, with a hole or not, boxes that overlap in GeoJSON, boxes elsewhere, and points."""
    s = F.col("s_suppkey")
    kind, wide = s % 5, s % 7 + 1
    west = F.when(kind == 3, 10.0).otherwise(-121.0)
    corner = lambda x, y: F.concat((west + x / 100).cast("decimal(12,6)").cast("string"), F.lit(","), (38 + y / 100).cast("decimal(12,6)").cast("string"))
    box = lambda x0, y0, x1, y1: (corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))
    n = F.lit
    lines = lambda tag, ring: (n(f"<{tag}><LinearRing><coordinates>"), F.concat_ws(",0 ", *ring), n(f"</coordinates></LinearRing></{tag}>"))
    hole = F.when(kind == 1, F.concat(*lines("innerBoundaryIs", box(n(0.25), n(0.25), n(0.75), n(0.75))))).otherwise("")
    kml = F.concat(n('<kml xmlns="http://www.opengis.net/kml/2.2"><Placemark><Polygon>'), *lines("outerBoundaryIs", box(n(0), n(0), wide, n(2))), hole, n("</Polygon></Placemark></kml>"))
    ring = lambda r: F.concat(n("[[["), F.concat_ws("],[", *r), n("]]]"))
    both = F.concat(n('{"type":"MultiPolygon","coordinates":['), ring(box(n(0), n(0), wide, n(2))), n(","), ring(box(wide - 0.5, n(1), wide + 0.5, n(3))), n("]}"))
    point = F.concat(n('{"type":"Point","coordinates":['), corner(n(0), n(0)), n("]}"))
    content = F.when((kind < 2) | (kind == 3), kml).when(kind == 2, both).otherwise(point)
    files = table(spark, sf_dir, "supplier").select(F.concat(n("u"), s.cast("string"), F.when((kind < 2) | (kind == 3), ".kml").otherwise(".geojson")).alias("path"), content.cast("binary").alias("content"))
    return boundaries.read_boundaries(files).select("path", F.round(shapes.area(F.col("edges")) * 10_000, 6).alias("area"), F.size("rings").alias("rings"), "problem")
