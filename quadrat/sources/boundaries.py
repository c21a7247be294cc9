"""Boundaries of units from KML, KMZ, GeoJSON and zipped shapefiles, as rings in degrees.

A file is one row and is read by one task; it may hold ``FILE_BYTES``. Polygons
that overlap or cross themselves are united. Lines and points are no boundary.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
from collections import defaultdict
from collections.abc import Iterator
from math import asin, atan2, cos, hypot, log, pi, radians, sin, sqrt, tan
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.operators.geo import _edges
from quadrat.operators.shapes import POINT
from quadrat.sources.files import ARCHIVE_BYTES, BAD, EAST, NORTH, SOUTH, WEST

FILE_BYTES = 50 << 20
#: Decimals of a degree that corners are rounded to.
DECIMALS = 9
RINGS = f"array<array<{POINT}>>"

Polygon = list[list[tuple[float, float]]]


class NoBoundary(ValueError):
    """Why a file gives no boundary."""


def _kml(stream) -> Iterator[Polygon]:
    """Polygons as they end; the outer ring comes first, whatever the order in the file."""
    outer, inner, depth, within = [], [], 0, "outer"
    for event, e in ElementTree.iterparse(stream, ("start", "end")):
        name = e.tag.rpartition("}")[2]
        if event == "start":
            if name == "Polygon":
                outer, inner, depth = [], [], depth + 1
            elif name in ("outerBoundaryIs", "innerBoundaryIs"):
                within = name[:5]
            continue
        if name == "coordinates" and depth:
            ring = [tuple(map(float, c.split(",")[:2])) for c in (e.text or "").split() if c.count(",")]
            if len(ring) >= 3:
                (outer if within == "outer" and not outer else inner).append(ring)
        elif name == "Polygon":
            depth, within = depth - 1, "outer"
            if outer:
                yield outer + inner
        if name != "coordinates":
            e.clear()


def _geojson(node) -> Iterator[Polygon]:
    if not isinstance(node, dict):
        return
    kind = node.get("type")
    if kind == "FeatureCollection":
        for f in node.get("features") or []:
            yield from _geojson(f)
    elif kind == "Feature":
        yield from _geojson(node.get("geometry"))
    elif kind == "GeometryCollection":
        for g in node.get("geometries") or []:
            yield from _geojson(g)
    elif kind in ("Polygon", "MultiPolygon"):
        for rings in [node["coordinates"]] if kind == "Polygon" else node["coordinates"]:
            yield [[(float(p[0]), float(p[1])) for p in r] for r in rings]


def _shp(raw: bytes) -> Iterator[Polygon]:
    """Polygons of a .shp file. Its outer rings run clockwise; a hole goes to the outer ring before it."""
    if len(raw) < 100 or struct.unpack(">i", raw[:4])[0] != 9994:
        raise NoBoundary("not a .shp file")
    at = 100
    while at + 8 <= len(raw):
        size = 2 * struct.unpack(">i", raw[at + 4 : at + 8])[0]
        record, at = raw[at + 8 : at + 8 + size], at + 8 + size
        if len(record) < size:
            raise NoBoundary("the .shp file is cut off")
        if size < 44 or struct.unpack("<i", record[:4])[0] not in (5, 15, 25):
            continue
        parts, points = struct.unpack("<ii", record[36:44])
        begins = [*struct.unpack(f"<{parts}i", record[44 : 44 + 4 * parts]), points]
        xy = np.frombuffer(record, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
        polygon: Polygon = []
        for a, b in zip(begins, begins[1:], strict=False):
            ring = [tuple(p) for p in xy[a:b].tolist()]
            if polygon and _twice(ring) < 0:
                yield polygon
                polygon = []
            polygon.append(ring)
        if polygon:
            yield polygon


def _wkt_numbers(wkt: str) -> dict[str, float]:
    """Parameters of a projection by name, in lower case with blanks."""
    found = re.findall(r'PARAMETER\s*\[\s*"([^"]+)"\s*,\s*(-?[\d.]+(?:[eE][-+]?\d+)?)', wkt, re.I)
    return {name.lower().replace("_", " "): float(v) for name, v in found}


#: Names that a parameter goes by.
_NAMES = {
    "lat0": ("latitude of origin", "latitude of center", "latitude of false origin"),
    "lon0": ("central meridian", "longitude of center", "longitude of false origin"),
    "lat1": ("standard parallel 1", "latitude of 1st standard parallel"),
    "lat2": ("standard parallel 2", "latitude of 2nd standard parallel"),
    "east": ("false easting", "easting at false origin"),
    "north": ("false northing", "northing at false origin"),
}


def inverse(wkt: str | None):
    """From a .prj's coordinates to degrees: None if they are degrees. Conic projections, equal-area or conformal, on any ellipsoid."""
    if not wkt or not re.match(r"\s*PROJ(CS|CRS)\b", wkt, re.I):
        return None
    numbers = _wkt_numbers(wkt)
    get = lambda key, default=None: next((numbers[n] for n in _NAMES[key] if n in numbers), default)
    method = re.search(r'(?:PROJECTION|METHOD)\s*\[\s*"([^"]+)"', wkt, re.I)
    ball = re.search(r'(?:SPHEROID|ELLIPSOID)\s*\[\s*"[^"]*"\s*,\s*([\d.]+)\s*,\s*([\d.]+)', wkt, re.I)
    kind = (method[1] if method else "").lower()
    if ball is None or get("lat1") is None or not ("albers" in kind or "lambert" in kind and "conformal" in kind):
        raise NoBoundary(f"no inverse of the projection {method[1] if method else 'without a name'}")
    a, f = float(ball[1]), (1 / float(ball[2]) if float(ball[2]) else 0.0)
    e = sqrt(f * (2 - f))
    units = re.findall(r'(?:LENGTH)?UNIT\s*\[\s*"[^"]*(?:met|foot|feet)[^"]*"\s*,\s*([\d.]+)', wkt, re.I)
    unit = float(units[-1]) if units else 1.0
    lat0, lat1, lat2 = (radians(get(k, d)) for k, d in (("lat0", 0.0), ("lat1", 0.0), ("lat2", get("lat1"))))
    lon0, east, north = radians(get("lon0", 0.0)), get("east", 0.0), get("north", 0.0)
    m = lambda p: cos(p) / sqrt(1 - (e * sin(p)) ** 2)

    if "albers" in kind:
        own = lambda s: s / (1 - (e * s) ** 2) - (log((1 - e * s) / (1 + e * s)) / (2 * e) if e else -s)
        q = lambda p: (1 - e * e) * own(sin(p))
        n = (m(lat1) ** 2 - m(lat2) ** 2) / (q(lat2) - q(lat1)) if lat1 != lat2 else sin(lat1)
        c = m(lat1) ** 2 + n * q(lat1)
        r0 = a * sqrt(c - n * q(lat0)) / n

        def latitude(r: float) -> float:
            target = (c - (r * n / a) ** 2) / n
            p = asin(max(-1.0, min(1.0, target / 2)))
            for _ in range(20):
                s = sin(p)
                step = (1 - (e * s) ** 2) ** 2 / (2 * cos(p)) * (target - q(p)) / (1 - e * e)
                p += step
                if abs(step) < 1e-13:
                    break
            return p
    else:
        t = lambda p: tan(pi / 4 - p / 2) / ((1 - e * sin(p)) / (1 + e * sin(p))) ** (e / 2)
        n = (log(m(lat1)) - log(m(lat2))) / (log(t(lat1)) - log(t(lat2))) if lat1 != lat2 else sin(lat1)
        c = m(lat1) / (n * t(lat1) ** n)
        r0 = a * c * t(lat0) ** n

        def latitude(r: float) -> float:
            target = (abs(r) / (a * c)) ** (1 / n)
            p = pi / 2 - 2 * np.arctan(target)
            for _ in range(20):
                new = pi / 2 - 2 * np.arctan(target * ((1 - e * sin(p)) / (1 + e * sin(p))) ** (e / 2))
                p, done = new, abs(new - p) < 1e-13
                if done:
                    break
            return float(p)

    def back(x: float, y: float) -> tuple[float, float]:
        x, y = x * unit - east * unit, r0 - (y * unit - north * unit)
        sign = 1 if n > 0 else -1
        return (lon0 + atan2(sign * x, sign * y) / n) * 180 / pi, latitude(hypot(x, y)) * 180 / pi

    return back


def _member(z: zipfile.ZipFile, *ends: str) -> str | None:
    return next((n for n in z.namelist() if n.lower().endswith(ends) and "__MACOSX" not in n), None)


def _polygons(name: str, raw: bytes) -> list[Polygon]:
    low = name.lower()
    if low.endswith(".kml"):
        return list(_kml(io.BytesIO(raw)))
    if low.endswith((".geojson", ".json")):
        return list(_geojson(json.loads(raw.decode("utf-8-sig", "replace"))))
    if not low.endswith((".kmz", ".zip")):
        raise NoBoundary("not a boundary file")
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        if sum(i.file_size for i in z.infolist()) > ARCHIVE_BYTES:
            raise NoBoundary(f"expands to more than {ARCHIVE_BYTES} bytes")
        shp = _member(z, ".shp") if low.endswith(".zip") else None
        if shp:
            prj = next((n for n in z.namelist() if n.lower() == f"{shp[:-4]}.prj".lower()), None)
            back = inverse(z.read(prj).decode("utf-8", "replace") if prj else None)
            found = list(_shp(z.read(shp)))
            return [[[back(*p) for p in r] for r in polygon] for polygon in found] if back else found
        kml = _member(z, ".kml", ".kmz") if low.endswith(".zip") else _member(z, ".kml")
        if kml is None:
            raise NoBoundary("no boundary file in the archive")
        return _polygons(kml, z.read(kml))


def _twice(ring: list[tuple[float, float]]) -> float:
    """Twice the signed area of a ring, closed or not."""
    x0, y0 = ring[0]
    return sum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))


def united(polygons: list[Polygon]) -> list[list[tuple[float, float]]]:
    """Closed rings of the union of polygons: outer ones counter-clockwise, holes clockwise, each from its smallest corner on.

    Edges are cut where they meet; a piece stays if there is an inside on just
    one of its sides, an inside being what the polygons wind around more than
    their holes do. A ring goes on with the sharpest left turn.
    """
    edges: list[tuple] = []
    for rings in polygons:
        for i, ring in enumerate(rings):
            p = [(round(x, DECIMALS), round(y, DECIMALS)) for x, y in ring]
            p = [a for a, b in zip(p, [*p[1:], p[0]], strict=True) if a != b]
            if len(p) >= 3:
                p = p if (_twice(p) > 0) == (i == 0) else p[::-1]
                edges += zip(p, [*p[1:], p[0]], strict=True)
    if not edges:
        return []
    net: dict[tuple, int] = defaultdict(int)
    for p, q in _cut(np.array(edges, float).reshape(-1, 4)):
        low, high = min(p, q), max(p, q)
        if low != high:
            net[low, high] += 1 if p < q else -1
    pieces = [(p, q, n) for (p, q), n in net.items() if n]
    xy = np.array([(*p, *q) for p, q, _ in pieces]).reshape(-1, 4)
    n = np.array([n for *_, n in pieces])
    kept: dict[tuple, list[tuple]] = defaultdict(list)
    for (p, q, own), (x, y) in zip(pieces, (xy[:, :2] + xy[:, 2:]) / 2, strict=True):
        along = 0 if p[1] != q[1] else 1  # a ray to the east, or to the north of level pieces
        u, v, at, far = (xy[:, 1], xy[:, 3], y, x) if along == 0 else (xy[:, 0], xy[:, 2], x, y)
        s, t = (xy[:, 0], xy[:, 2]) if along == 0 else (xy[:, 1], xy[:, 3])
        hit = np.flatnonzero((np.minimum(u, v) <= at) & (np.maximum(u, v) > at))
        beyond = hit[s[hit] + (at - u[hit]) / (v[hit] - u[hit]) * (t[hit] - s[hit]) > far + 1e-15 * abs(far)]
        beyond = beyond[[pieces[i][:2] != (p, q) for i in beyond]]
        # pieces run from their smaller end; one that rises has its inside to the west, one that goes east to the north
        ahead = int((n[beyond] * np.where(v[beyond] > u[beyond], 1, -1)).sum()) * (1 if along == 0 else -1)
        rises = own * (1 if q[1] > p[1] else -1) if along == 0 else own
        behind = ahead + rises if along == 0 else ahead - rises
        if (ahead > 0) != (behind > 0):
            left = (behind if along == 0 else ahead) if (q[1] > p[1] or along == 1) else ahead
            a, b = (p, q) if left > 0 else (q, p)
            kept[a].append(b)
    return _rings(kept)


def _cut(e: np.ndarray) -> Iterator[tuple[tuple[float, float], tuple[float, float]]]:
    """Pieces of directed edges, cut where they meet others; those whose boxes overlap are compared."""
    low, high = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
    order = np.argsort(low[:, 0], kind="stable")
    starts = low[order, 0]
    longest = (high[:, 0] - low[:, 0]).max()
    for i in range(len(e)):
        near = order[np.searchsorted(starts, low[i, 0] - longest) : np.searchsorted(starts, high[i, 0], "right")]
        near = near[(high[near, 0] >= low[i, 0]) & (high[near, 1] >= low[i, 1]) & (low[near, 1] <= high[i, 1]) & (near != i)]
        x, y, dx, dy = e[i, 0], e[i, 1], e[i, 2] - e[i, 0], e[i, 3] - e[i, 1]
        f = e[near]
        fx, fy = f[:, 2] - f[:, 0], f[:, 3] - f[:, 1]
        det = dx * fy - dy * fx
        beside = lambda p: np.abs((p[:, 0] - x) * dy - (p[:, 1] - y) * dx) <= 1e-12 * hypot(dx, dy)
        first, second = beside(f[:, :2]), beside(f[:, 2:])
        with np.errstate(all="ignore"):
            t = ((f[:, 0] - x) * fy - (f[:, 1] - y) * fx) / det
            s = ((f[:, 0] - x) * dy - (f[:, 1] - y) * dx) / det
        cross = (det != 0) & (t > 0) & (t < 1) & (s > 0) & (s < 1) & ~first & ~second
        # the point of two edges is that of the one with the smaller number
        own = near[cross] > i
        met = np.where(own[:, None], np.column_stack([x + t[cross] * dx, y + t[cross] * dy]), f[cross, :2] + s[cross, None] * np.column_stack([fx, fy])[cross])
        met = np.concatenate([np.round(met, DECIMALS), f[first, :2], f[second, 2:]])
        at = ((met[:, 0] - x) * dx + (met[:, 1] - y) * dy) / (dx * dx + dy * dy)
        inner = (at > 0) & (at < 1)
        points = [(x, y), *(met[inner][np.argsort(at[inner], kind="stable")]), (e[i, 2], e[i, 3])]
        points = [(float(a), float(b)) for a, b in points]
        yield from zip(points, points[1:], strict=False)


def _rings(after: dict[tuple, list[tuple]]) -> list[list[tuple[float, float]]]:
    rings = []
    for first in sorted(after):
        while after[first]:
            ring, p = [first], after[first].pop(0)
            while p != first or len(ring) < 3:
                back = atan2(ring[-1][1] - p[1], ring[-1][0] - p[0])
                ways = after[p]
                q = min(ways, key=lambda q: (back - atan2(q[1] - p[1], q[0] - p[0]) - 1e-12) % (2 * pi))
                ways.remove(q)
                ring.append(p)
                p = q
            # a corner that goes straight on is none
            c = [b for a, b, d in zip([ring[-1], *ring[:-1]], ring, [*ring[1:], ring[0]], strict=True) if abs((b[0] - a[0]) * (d[1] - b[1]) - (b[1] - a[1]) * (d[0] - b[0])) > 1e-18]
            if len(c) >= 3:
                k = c.index(min(c))
                rings.append([*c[k:], *c[:k], c[k]])
    return rings


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    for b in batches:
        for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rings, problem = None, None
            try:
                if raw is None or len(raw) > FILE_BYTES:
                    raise NoBoundary("no content" if raw is None else f"more than {FILE_BYTES} bytes")
                rings = united(_polygons(path or "", raw))
                if not rings:
                    raise NoBoundary("no polygon in it")
                x, y = ([p[i] for r in rings for p in r] for i in (0, 1))
                if max(x) < WEST or min(x) > EAST or max(y) < SOUTH or min(y) > NORTH:
                    raise NoBoundary("not in California; its projection may not be declared")
            except (*BAD, IndexError, TypeError, ArithmeticError, struct.error) as e:
                rings, problem = None, str(e) if isinstance(e, NoBoundary) else f"can't be read: {e}"
            shown = None if rings is None else [[{"x": px, "y": py} for px, py in r] for r in rings]
            yield pa.record_batch([pa.array([path], pa.string()), pa.array([shown], kind), pa.array([problem], pa.string())], ["path", "rings", "problem"])


def read_boundaries(files: DataFrame) -> DataFrame:
    """(path, rings, edges, problem) for each of the files (path, content): closed rings in degrees, outer ones counter-clockwise, and their edges as a shape; or what is wrong with the file, and no rings. A file that can't be read ends nothing."""
    rows = files.select("path", "content").mapInArrow(_read, f"path string, rings {RINGS}, problem string")
    return rows.withColumn("edges", F.flatten(F.transform("rings", _edges)))


def boundaries(spark: SparkSession, path: str) -> DataFrame:
    """``read_boundaries`` of the files below a path."""
    return read_boundaries(spark.read.format("binaryFile").load(path))


def geojson_shapes(shapes: DataFrame, *properties: str, rings: str = "rings") -> DataFrame:
    """One GeoJSON feature a row, of rings as ``read_boundaries`` gives them: each a polygon's outer ring, or a hole of the smallest outer ring before it that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if rings is None else json.dumps({"type": "MultiPolygon", "coordinates": _nested([[(p["x"], p["y"]) for p in r] for r in rings])}) for rings in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(out, pa.string())], ["properties", "geometry"])

    rows = shapes.select(F.to_json(F.struct(*properties)).alias("properties"), F.col(rings).alias("rings")).mapInArrow(run, "properties string, geometry string")
    return rows.select(F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce("geometry", F.lit("null")), F.lit(',"properties":'), "properties", F.lit("}")).alias("feature"))


def _nested(rings: list[list[tuple[float, float]]]) -> list[list]:
    outer = sorted((r for r in rings if _twice(r[:-1]) > 0), key=_twice)
    polygons = [[r] for r in outer]
    for hole in (r for r in rings if _twice(r[:-1]) < 0):
        x, y = ((hole[0][i] + hole[1][i]) / 2 for i in (0, 1))
        home = next((p for p in polygons if _winds(p[0], x, y)), None)
        (home if home is not None else polygons[-1]).append(hole)
    return polygons


def _winds(ring: list[tuple[float, float]], x: float, y: float) -> bool:
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:], strict=False)) % 2 == 1
