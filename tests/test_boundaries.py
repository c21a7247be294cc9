"""Boundary files of every kind, unions of their polygons, and what is wrong with a file."""

import io
import json
import math
import random
import struct
import zipfile

import pytest

from quadrat.operators import shapes
from quadrat.sources import boundaries as b

RING = [(-120.90, 40.30), (-120.85, 40.30), (-120.85, 40.34), (-120.90, 40.34), (-120.90, 40.30)]
HOLE = [(-120.89, 40.31), (-120.88, 40.31), (-120.88, 40.32), (-120.89, 40.32), (-120.89, 40.31)]
KML = """<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><Point><coordinates>-121,41,0</coordinates></Point>
<Polygon><innerBoundaryIs><LinearRing><coordinates>{hole}</coordinates></LinearRing></innerBoundaryIs><outerBoundaryIs><LinearRing><coordinates>
{ring}</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>"""
ALBERS = """PROJCS["NAD83 / California Albers",GEOGCS["NAD83",DATUM["North_American_Datum_1983",SPHEROID["GRS 1980",6378137,298.257222101]],UNIT["degree",0.0174532925199433]],PROJECTION["Albers_Conic_Equal_Area"],
PARAMETER["latitude_of_center",0],PARAMETER["longitude_of_center",-120],PARAMETER["standard_parallel_1",34],PARAMETER["standard_parallel_2",40.5],PARAMETER["false_easting",0],PARAMETER["false_northing",-4000000],UNIT["metre",1]]"""
ALBERS_2 = """PROJCRS["NAD83 / California Albers",BASEGEOGCRS["NAD83",DATUM["North American Datum 1983",ELLIPSOID["GRS 1980",6378137,298.257222101,LENGTHUNIT["metre",1]]],PRIMEM["Greenwich",0]],CONVERSION["California Albers",METHOD["Albers Equal Area",ID["EPSG",9822]],
PARAMETER["Latitude of false origin",0],PARAMETER["Longitude of false origin",-120],PARAMETER["Latitude of 1st standard parallel",34],PARAMETER["Latitude of 2nd standard parallel",40.5],PARAMETER["Easting at false origin",0],PARAMETER["Northing at false origin",-4000000]],CS[Cartesian,2],LENGTHUNIT["metre",1]]"""
CONFORMAL = """PROJCS["zone",GEOGCS["NAD83",DATUM["D",SPHEROID["GRS 1980",6378137,298.257222101]],UNIT["degree",0.0174532925199433]],PROJECTION["Lambert_Conformal_Conic_2SP"],PARAMETER["latitude_of_origin",37.66666666666666],PARAMETER["central_meridian",-122],
PARAMETER["standard_parallel_1",39.83333333333334],PARAMETER["standard_parallel_2",38.33333333333334],PARAMETER["false_easting",6561666.667],PARAMETER["false_northing",1640416.667],UNIT["US survey foot",0.3048006096012192]]"""


def text(ring):
    return " ".join(f"{x},{y},0" for x, y in ring)


def kml(ring=RING, hole=HOLE):
    return KML.format(ring=text(ring), hole=text(hole)).encode()


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, raw in files.items():
            z.writestr(name.replace("_", "."), raw)
    return out.getvalue()


def shp(*records):
    """A .shp file of polygons, each a list of rings as they are."""
    body = b"".join(struct.pack(">ii", i + 1, len(r) // 2) + r for i, r in enumerate(records))
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + body


def polygon(*rings):
    begins = [sum(map(len, rings[:i])) for i in range(len(rings))]
    points = [v for r in rings for p in r for v in p]
    return struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(rings), len(points) // 2) + struct.pack(f"<{len(begins)}i", *begins) + struct.pack(f"<{len(points)}d", *points)


def albers(lon, lat):
    """Forward, by the series-free formula of the ellipsoid."""
    a, f = 6378137.0, 1 / 298.257222101
    e = math.sqrt(f * (2 - f))
    rad = math.radians
    m = lambda p: math.cos(p) / math.sqrt(1 - e * e * math.sin(p) ** 2)
    q = lambda p: (1 - e * e) * (math.sin(p) / (1 - e * e * math.sin(p) ** 2) + math.atanh(e * math.sin(p)) / e)
    p1, p2 = rad(34), rad(40.5)
    n = (m(p1) ** 2 - m(p2) ** 2) / (q(p2) - q(p1))
    c = m(p1) ** 2 + n * q(p1)
    rho = lambda p: a * math.sqrt(c - n * q(p)) / n
    t = n * rad(lon + 120)
    return rho(rad(lat)) * math.sin(t), rho(0) - rho(rad(lat)) * math.cos(t) - 4_000_000


def conformal(lon, lat):
    a, f, rad = 6378137.0, 1 / 298.257222101, math.radians
    e = math.sqrt(f * (2 - f))
    m = lambda p: math.cos(p) / math.sqrt(1 - e * e * math.sin(p) ** 2)
    t = lambda p: math.exp(-math.atanh(math.sin(p)) + e * math.atanh(e * math.sin(p)))
    p1, p2, p0 = rad(39.83333333333334), rad(38.33333333333334), rad(37.66666666666666)
    n = math.log(m(p1) / m(p2)) / math.log(t(p1) / t(p2))
    rho = lambda p: a * m(p1) / n * (t(p) / t(p1)) ** n
    foot = 0.3048006096012192
    return rho(rad(lat)) * math.sin(n * rad(lon + 122)) / foot + 6561666.667, (rho(p0) - rho(rad(lat)) * math.cos(n * rad(lon + 122))) / foot + 1640416.667


def area(rings):
    return sum(b._twice(r[:-1]) for r in rings) / 2


CASES = {
    "unit.kml": kml(), "unit.kmz": zipped(doc_kml=kml()), "in.zip": zipped(readme_txt=b"x", doc_kml=kml()), "deep.zip": zipped(unit_kmz=zipped(doc_kml=kml())),
    "unit.geojson": json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [RING, HOLE]}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [0, 0]}}, {"type": "Feature", "geometry": None}]}).encode(),
    "geometry.json": json.dumps({"type": "GeometryCollection", "geometries": [{"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, {"type": "MultiPolygon", "coordinates": [[RING, HOLE]]}]}).encode(),
    "degrees.zip": zipped(a_shp=shp(polygon(RING[::-1], HOLE)), a_prj=b'GEOGCS["GCS_WGS_1984"]'), "albers.zip": zipped(a_shp=shp(polygon([albers(*p) for p in RING[::-1]], [albers(*p) for p in HOLE])), a_prj=ALBERS.encode()),
    "albers2.zip": zipped(A_shp=shp(struct.pack("<i", 0), polygon([albers(*p) for p in RING[::-1]], [albers(*p) for p in HOLE])), a_prj=ALBERS_2.encode()), "conformal.zip": zipped(a_shp=shp(polygon([conformal(*p) for p in RING[::-1]], [conformal(*p) for p in HOLE])), a_prj=CONFORMAL.encode()),
}
PROBLEMS = {
    "bad.kml": (kml([(x + 130, y) for x, y in RING], []), "not in California"), "flat.zip": (zipped(a_shp=shp(polygon([albers(*p) for p in RING[::-1]]))), "not in California"), "mercator.zip": (zipped(a_shp=shp(polygon(RING)), a_prj=ALBERS.replace("Albers_Conic_Equal_Area", "Transverse_Mercator").encode()), "no inverse"),
    "none.zip": (zipped(a_txt=b"x"), "no boundary file"), "points.geojson": (b'{"type": "Point", "coordinates": [1, 2]}', "no polygon"), "broken.json": (b'{"type": ', "can't be read"), "cut.kml": (kml()[:200], "can't be read"), "cut.zip": (zipped(a_shp=shp(polygon(RING))[:-50]), "cut off"),
    "notes.txt": (b"x", "not a boundary file"), "false.zip": (b"PK no zip", "can't be read"), "odd.geojson": (b'{"type": "Polygon", "coordinates": [[["a", 1]]]}', "can't be read"), "empty.kml": (b"", "can't be read"), "list.json": (b"[1, 2]", "no polygon"), "null.kml": (None, "no content"), "head.zip": (zipped(a_shp=b"x" * 200), "not a .shp"),
}


def test_files(spark, tmp_path):
    rows = [(n, bytearray(c)) for n, c in CASES.items()] + [(n, None if c is None else bytearray(c)) for n, (c, _) in PROBLEMS.items()]
    got = {r.path: r for r in b.read_boundaries(spark.createDataFrame(rows, "path string, content binary")).collect()}
    want = 0.05 * 0.04 - 0.01 * 0.01
    for n in CASES:
        rings = [[(p.x, p.y) for p in r] for r in got[n].rings]
        assert got[n].problem is None and len(rings) == 2 and area(rings) == pytest.approx(want, rel=1e-6), n
        assert [p for r in rings for p in r] == [pytest.approx(p, abs=2e-9) for p in (*RING, HOLE[0], HOLE[3], HOLE[2], HOLE[1], HOLE[0])], n
        assert len(got[n].edges) == 8
    for n, (_, says) in PROBLEMS.items():
        assert got[n].rings is None and got[n].edges is None and says in got[n].problem, (n, got[n].problem)
    (tmp_path / "unit.kml").write_bytes(kml())
    assert b.boundaries(spark, f"file://{tmp_path}").select(shapes.area(b.F.col("edges"))).first()[0] == pytest.approx(want)


def test_unions():
    """Random squares on a grid, overlapping in every way, and turned ones: the union's area is that of the covered cells."""
    rng = random.Random(6)
    for turn in ((1.0, 0.0), (0.6, 0.8)):
        at = lambda x, y: (-121 + (x * turn[0] - y * turn[1]) / 1000, 39 + (x * turn[1] + y * turn[0]) / 1000)  # noqa: E731, B023
        for _ in range(60):
            boxes = [(rng.randrange(8), rng.randrange(8), rng.randrange(1, 5), rng.randrange(1, 5)) for _ in range(rng.randrange(1, 7))]
            cells = {(x + i, y + j) for x, y, w, h in boxes for i in range(w) for j in range(h)}
            polygons = [[[at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h)][:: rng.choice([1, -1])]] for x, y, w, h in boxes]
            rings = b.united(polygons)
            assert area(rings) == pytest.approx(len(cells) / 1e6, rel=1e-4)
            assert all(r[0] == r[-1] == min(r) for r in rings)
    bow = b.united([[[(-121, 39), (-120, 40), (-120, 39), (-121, 40)]]])
    assert sum(abs(b._twice(r[:-1])) for r in bow) / 2 <= 0.5
    assert b.united([]) == [] and b.united([[[(1, 1), (2, 2)]]]) == [] and b.united([[[(1, 1), (2, 2), (3, 3)]]]) == []


def test_geojson_shapes(spark):
    df = b.read_boundaries(spark.createDataFrame([("unit.kml", bytearray(kml())), ("bad.txt", bytearray(b"x"))], "path string, content binary"))
    got = {f["properties"]["path"]: f for (t,) in b.geojson_shapes(df, "path").collect() for f in [json.loads(t)]}
    assert [len(p) for p in got["unit.kml"]["geometry"]["coordinates"]] == [2] and got["bad.txt"]["geometry"] is None
    again = b.read_boundaries(spark.createDataFrame([("a.geojson", bytearray(json.dumps(got["unit.kml"]).encode()))], "path string, content binary"))
    assert again.first().rings == df.where("path = 'unit.kml'").first().rings
