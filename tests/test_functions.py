"""Scalar rules on literal cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quadrat.functions import classify, names, sites, units, web
from quadrat.operators import geo, traffic
from quadrat.sources import tabular


@pytest.fixture
def value(spark):
    """The value of a column over one row of strings."""

    def get(build, *args):
        cols = [F.lit(a) if a is not None else F.lit(None).cast("string") for a in args]
        return spark.range(1).select(build(*cols).alias("x")).first().x

    return get


@pytest.mark.parametrize(
    "raw, code, confidence",
    [
        ("291223", "M29N12E23", "high"), ("341003", "M34N10E03", "high"), ("29R1125", "M29N11E25", "high"), ("T29N R12E Section 23", "M29N12E23", "verified"), ("M29N11E23", "M29N11E23", "verified"), ("29N 11E 23", "M29N11E23", "verified"),
        ("", None, None), ("  ", None, None), ("abcdef", None, None), ("290000", None, None), ("291299", None, None), ("999999", None, None), ("29Z1125", None, None), (None, None, None),
    ],
)
def test_site_ids(value, raw, code, confidence):
    s = value(lambda c: sites.decode_site_id(c, F.lit(True)), raw)
    assert (s and s.confidence) == confidence
    assert value(lambda c: F.when(sites.decode_site_id(c).isNotNull(), sites.mtrs(sites.decode_site_id(c))), raw) == code


def test_site_confidence_without_county(value):
    assert value(sites.decode_site_id, "291123").confidence == "medium"


@pytest.mark.parametrize("raw, code", [("M28NO8E01", "M28N08E01"), ("M28NO9E06", "M28N09E06"), ("M28N O8E01", "M28N08E01"), ("garbage", None)])
def test_mtrs_repairs(value, raw, code):
    s = value(sites.parse_mtrs, raw)
    assert (s and s.confidence) == (code and "high")
    assert value(lambda c: F.when(sites.parse_mtrs(c).isNotNull(), sites.mtrs(sites.parse_mtrs(c))), raw) == code


@pytest.mark.parametrize("a, b, near", [("341003", "341004", True), ("341003", "341010", True), ("341031", "331006", True), ("341003", "351026", False)])
def test_adjacent_sections(value, a, b, near):
    assert value(lambda x, y: sites.adjacent(sites.decode_site_id(x), sites.decode_site_id(y)), a, b) is near


@pytest.mark.parametrize("site, mtrs, result", [("280801", "M28N08E01", "agree"), ("280801", "M28N09E01", "conflict"), ("280801", "garbage", "site_only"), ("x", "M28N08E01", "mtrs_only"), ("x", "y", "none")])
def test_cross_check(value, site, mtrs, result):
    assert value(lambda a, b: sites.cross_check(sites.decode_site_id(a), sites.parse_mtrs(b)), site, mtrs) == result


@pytest.mark.parametrize("code, federal", [("M29N12E23", "CA210290N0120E0SN230"), ("M28N08E01", "CA210280N0080E0SN010")])
def test_federal_ids(value, code, federal):
    assert value(lambda c: sites.federal_section_id(sites.parse_mtrs(c)), code) == federal


@pytest.mark.parametrize(
    "name, key",
    [("W.M. Beaty & Associates, Inc.", "WM BEATY & ASSOC"), ("WM BEATY AND ASSOC.", "WM BEATY & ASSOC"), ("W M Beaty & Associates", "WM BEATY & ASSOC"), ("R.R.F. Lassen-Plumas LLC", "RRF LASSEN PLUMAS"), ("Beaty & Co", "BEATY"), ("The Trust", "THE TRUST"), (None, ""), ("  ", "")],
)
def test_company_keys(value, name, key):
    assert value(names.company_key, name) == key


def test_company_scores(value):
    score = lambda a, b: value(lambda x, y: names.company_score(names.company_key(x), names.company_key(y)), a, b)
    assert score("Acme Svcs", "ACME SERVICES") == 1.0
    assert score("Beaty Timber", "Timber Beaty Inc") == 0.97
    assert score("Beaty Timber Group", "Beaty") >= 0.9
    assert score("North Forest", "Zeta Helicopters") < names.REJECT and score("", "x") == 0


def test_person_keys(value):
    assert value(names.person_key, "Dr. Jane Q Roe, Jr") == value(names.person_key, "ROE JANE Q") or value(names.person_key, "Roe, Jane Q") == value(names.person_key, "Jane Q Roe")


@pytest.mark.parametrize(
    "amount, unit, product, family, gallons, pounds",
    [
        ("2", "Gallon", "", "volume", 2.0, None), ("3", "Pounds", "", "mass", None, 3.0), ("12", "Ounce", "X", "unknown", None, None), ("16", "oz", "VELPAR DF", "mass", None, 1.0), ("128", "oz", "ROTARY 2 SL", "volume", 1.0, None), ("128", "oz", "MSO", "volume", 1.0, None),
        ("1", "OUNCE (DRY)", "", "unknown", None, None), ("1", "FL. OZ", "", "unknown", None, None), (None, "Gallon", "", "unknown", None, None), ("5", None, "", "unknown", None, None), ("4", "each", "", "count", None, None),
    ],
)
def test_quantities(value, amount, unit, product, family, gallons, pounds):
    q = value(lambda a, u, p: units.normalize_quantity(a.cast("double"), u, units.formulation_state(p)), amount, unit, product)
    assert (q.family, q.gallons, q.pounds) == (family, gallons, pounds)


def test_active_ingredient(value):
    none = F.lit(None).cast("double")
    assert value(lambda: units.active_ingredient_pounds(none, F.lit(914.0), F.lit(75.0), none)).pounds == 685.5
    assert value(lambda: units.active_ingredient_pounds(F.lit(2.0), none, F.lit(75.0), none)) == (None, "density unknown")


@pytest.mark.parametrize("text, method", [("Ground", "ground"), ("Aircraft", "aerial"), ("Air/Ground", "aerial"), (None, "unknown"), ("", "unknown"), ("boat", "other")])
def test_methods(value, text, method):
    assert value(classify.method, text) == method


@pytest.mark.parametrize("code, name, category, confidence", [("30000-0", "x", "forestry", "verified"), (None, "FOREST, TMBRLND", "forestry", "high"), ("", "RIGHTS OF WAY", "rights_of_way", "high"), ("", "WATER AREA", "aquatic", "high"), ("", "NOXIOUS WEED CONTROL", "invasive_plant", "high"), ("", "ALMOND", "unknown", "low"), ("", "FORESTRY", "unknown", "low")])
def test_site_categories(value, code, name, category, confidence):
    assert value(classify.site_category, code, name) == (category, confidence)


@pytest.mark.parametrize("text, outcome", [("No violations", "violation"), ("not in compliance", "in_compliance"), ("No", "not_stated"), (None, "not_stated")])
def test_outcomes(value, text, outcome):
    assert value(classify.outcome, text) == outcome


@pytest.mark.parametrize("n, seen, records, letter", [(20, 10, "obtained", "A"), (20, 6, "obtained", "B"), (20, 3, "obtained", "C"), (20, 1, "obtained", "D"), (20, 0, "obtained", "F"), (20, 10, "requested", None), (12, 0, "county_reports_none", "F"), (0, 0, "obtained", None)])
def test_grades(value, n, seen, records, letter):
    assert value(lambda r: classify.grade(F.lit(n), F.lit(seen), r) if n else F.when(F.lit(False), "x"), records) == letter


def test_rodenticides(value):
    bait = lambda i, p: value(lambda x, y: classify.is_rodenticide(F.array(x), y), i, p)
    assert bait("Strychnine", None) and bait("x", "GOPHER BAIT 50") and not bait("glyphosate", "ROUNDUP")


def test_traffic_helpers(value):
    assert value(web.is_bot, "Googlebot/2.1 xx") and value(web.is_bot, None) and not value(web.is_bot, "Mozilla/5.0 (X11; Linux)")
    assert value(lambda u: web.referrer_host(u, "me.org"), "https://www.Example.com/x?y") == "example.com" and value(lambda u: web.referrer_host(u, "www.me.org"), "http://me.org/") is None
    assert value(web.clean_path, "near-me?q=1#z") == "/near-me"
    hashed = lambda d: value(lambda i, a: web.visitor_hash(i, a, F.lit(d).cast("date"), "s"), "1.2.3.4", "ua")
    assert hashed("2024-01-01") != hashed("2024-01-02") and len(hashed("2024-01-01")) == 32


def test_values(value):
    assert value(tabular.split_amount_units, "63 ACRES") == (63.0, "ACRES") and value(tabular.parse_float, "1,050") == 1050.0
    assert value(tabular.parse_date, "07/01/2021 6:30") == dt.date(2021, 7, 1) and value(tabular.parse_date, "2020-13-01") is None
    assert [value(tabular.base_registration, x) for x in ("62719-259-AA", "62719-259", "AA", None)] == ["62719-259", "62719-259", None, None]
    assert value(lambda x: traffic.incremental_window(x.cast("date")), "2020-01-05") == dt.date(2020, 1, 1) and value(lambda x: traffic.incremental_window(x.cast("date")), None) == dt.date(2020, 1, 1)


def test_geometry(value):
    assert value(lambda: geo.distance_miles(F.lit(40.0), F.lit(-120.0), F.lit(41.0), F.lit(-120.0))) == pytest.approx(69.09, abs=0.01)
    ring = lambda *ps: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ps))
    assert value(lambda: geo.area_and_centroid(ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0)))) == (4.0, 1.0, 1.0)


def test_compare_people(spark):
    from quadrat.functions import names

    cases = [
        ("Shane Compton", "Compton, Shane", 0.95), ("Shane A Compton", "Compton, Shane B", 0.75), ("S. Carnegie", "Scott Carnegie", 0.8), ("Ann Lee", "Bob Lee", 0.5), ("Compton, Jr", "Shane Compton", 0.5), (None, "A B", 0.0), ("Dr. Shane Compton III", "shane compton", 0.95),
        ("Jo Carnegie-West", "Jo Carnegie West", 0.95), ("Jo Smithsonian", "Jo Smithsonien", 0.95), ("Jo Smith", "Jo Jones", 0.2), ("12", "Jo Jones", 0.0),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = {r.i: (r.score, r.matched) for r in names.compare_people(df, "a", "b").collect()}
    assert got == {i: (s, s == 0.95) for i, (_, _, s) in enumerate(cases)}
