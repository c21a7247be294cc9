"""Parsers of document text, flags and decisions, on texts of their own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quadrat.functions import finder, policy
from quadrat.operators import chemistry, overlay
from quadrat.plans import catalogue
from quadrat.sources import forms

FORM = """Pesticide Use Report
Report Status:        Done
Submittal Status: Sent

Permittee/Permit Operator     Operator ID/Permit Number    Document number
Pine Ridge Land               77012                        WEB1

County No   Section   Township   Range   Meridian   App Method/Fume Code   Commercial Applicator (if any)
18          7         30N        12E     M          Air                    SKY COPTERS, INC

Product Name             EPA Reg No     Quantity Used   Quantity Units
GREEN THING DF           100-1-AA       3               Pounds
BLUE THING SL            200-2          4
"""
PERMIT = """RESTRICTED MATERIALS PERMIT: 09-22-123
Operator: PINE RIDGE LAND # 1
Issued on:1/5/2022
Valid as of:1/6/2022
Expires on:12/31/2023
CONTACT LIST
Name
 | Phone
 | License
 | Expiration
 | Contact Type
 | A PERSON
 | (530) 000-1111
 |
 |
 | AR
 | PESTICIDES LIST
Number
 | Pesticide
 | Pests
 | Forms
 | Methods
 | Applicators
 | 1
 | STRYCHNINE
 | RATS
 | Bait
 | Ground
 | PCB
 | 2
 | NON-RESTRICTED USE
 | ANY
 | All
 | Ground
 | PCB
 | SITES LIST
300101 | | 9 | M30N01E01 | FOREST, TMBRLND / 30000-0 | 12.5 ACRES | |
OPERATION-WIDE CONDITIONS
"""


def test_forms(spark):
    got = {r.path: r for r in forms.forms(spark.createDataFrame([("a", FORM), ("b", None)], "path string, text string")).collect()}
    f = got["a"].fields
    assert (f["operator_name"], f["township"], f["method"], f["applicator_name"]) == ("Pine Ridge Land", "30N", "Air", "SKY COPTERS, INC")
    assert [p["product_name"] for p in got["a"].products] == ["GREEN THING DF", "BLUE THING SL"] and got["b"].problem


def test_permits_and_their_flags(spark):
    got = forms.permits(spark.createDataFrame([("a", PERMIT), ("b", "")], "path string, text string"))
    p = got.where("path = 'a'").first()
    assert p.number == "09-22-123" and p.expires == dt.date(2023, 12, 31) and [c["kind"] for c in p.contacts] == ["AR"]
    assert p.sites == [{"site_id": "300101", "name": "", "district": "9", "mtrs": "M30N01E01", "commodity": "FOREST, TMBRLND", "code": "30000-0", "acres": "12.5"}]
    assert got.where("path = 'b'").first().problem
    named = got.where("path = 'a'").select(F.lit(1).alias("id"), F.explode("materials").alias("m")).select("id", F.col("m")["name"].alias("name"))
    watched = spark.createDataFrame([(1, "hexazinone"), (1, "Hexazinone"), (1, "water")], "id int, name string")
    s = chemistry.flag_summary(chemistry.permit_flags(named).unionByName(chemistry.watchlist_flags(watched))).first()
    assert (s.flags, s.highest, s.restricted, s.watched, s.headline.subject) == (2, "red", True, True, "STRYCHNINE")


def test_enforcement_and_investigations(spark):
    text = "Case No: 7-A\nThe county proposes to fine Acme $1,250 for a viola-\ntion."
    e = forms.enforcement(spark.createDataFrame([("a", text)], "path string, text string")).first()
    assert (e.action_type, e.stage, e.case_number, e.penalty, e.headline) == ("nopa", "proposed", "7-A", 1250.0, "Notice of Proposed Action (alleged) — proposed — not decided")
    i = forms.investigations(spark.createDataFrame([("a", "County: Lassen\nMTRS M29N11E23, APN 013-120-05, License No. 12345\n1. Wind was high\n2) No sign")], "path string, text string")).first()
    assert (i.county, i.mtrs, i.apns, i.licenses, i.findings) == ("Lassen", ["M29N11E23"], ["013-120-05"], ["12345"], ["Wind was high", "No sign"])


@pytest.mark.parametrize("kind, value, business, want", [("business_email", "jo@gmail.com", True, "restricted"), ("business_email", "jo@acme.com", False, "review"), ("business_email", "info@acme.com", False, "public"), ("professional_photo", "https://x.com/a.png", True, "restricted"), ("owner_mailing_address", "", False, "restricted"), ("website", "", True, "public"), ("personal_phone", "", True, "restricted")])
def test_dispositions(spark, kind, value, business, want):
    assert spark.range(1).select(policy.fact_disposition(F.lit(kind), F.lit(value), F.lit(business)).alias("x")).first().x == want


def test_land_managers(spark):
    got = spark.createDataFrame([("USFS", "Lassen"), (None, "x"), ("UND", "x"), ("QQ", None)], "c string, u string").select(policy.land_manager(F.col("c"), F.col("u")).alias("m")).collect()
    assert [tuple(r.m) for r in got] == [("national_forest", "National forest", "Lassen National Forest"), ("not_public", "Not federal or state land", None), ("not_public", "Not federal or state land", None), ("other", "Managed by QQ", None)]


def test_websites(spark):
    rows = spark.createDataFrame([("Call (530) 243-2783 now",), ("Beaty timber pages",), ("nothing",)], "html string")
    got = rows.select(finder.verdict(F.col("html"), F.lit("Beaty Timber Services LLC"), F.lit("1-530-243-2783")).alias("v")).collect()
    assert [r.v for r in got] == ["verified", "likely", "not_found"]
    assert spark.range(1).select(finder.candidate_domains(F.lit("Beaty Timber Services LLC")).alias("d")).first().d[:2] == ["beatytimberservices.com", "beatytimberservices.net"]


def test_parcels_and_projects(spark):
    rows = [(1, "Pine Ridge LLC", None, "PINE RIDGE", "a"), (1, "Pine Ridge LLC", None, "OTHER", "b"), (2, "Pine Ridge", None, "ZEBRA CO", "c"), (3, "X", None, None, None), (4, None, None, "Y", "d")]
    got = {r.id: (r.outcome, r.selected, r.review_reason) for r in overlay.select_parcels(spark.createDataFrame(rows, "id int, owner string, landowner string, parcel_owner string, apn string")).collect()}
    assert got == {1: ("matched", ["a"], None), 2: ("needs_review", [], "no_parcel_owner_match"), 3: ("no_candidates", [], "no_parcel_candidates"), 4: ("needs_review", [], "missing_owner")}
    plans = [(1, "Acme", "p", "Old Mill", "ACME INC"), (2, "Acme", "p", "A", "Acme"), (2, "Acme", "q", "B", "Acme"), (3, "Acme", "p", "C", "Zebra"), (4, "Acme", "p", None, "Acme")]
    got = {r.id: (r.project, r.review_reason) for r in overlay.project_name(spark.createDataFrame(plans, "id int, owner string, plan string, name string, landowner string")).collect()}
    assert got == {1: ("Old Mill", None), 2: (None, "multiple_possible_projects"), 3: (None, "project_owner_mismatch"), 4: (None, None)}


def test_parcels_of_areas(spark, sf):
    apps = spark.createDataFrame([(1, 1, "Pine Ridge LLC", None), (2, 1, "Pine Ridge", None), (3, 2, "X", None), (4, 1, None, None), (5, 1, "Q", "Zebra"), (6, None, "Q", None), (7, 1, "Alder Hill Ridge Oaks", None)], "id int, area int, owner string, landowner string")
    parcels = spark.createDataFrame([(1, "PINE RIDGE", "a"), (1, "OTHER", "b"), (1, "ZEBRA CO", "c"), (1, "Pine Ridge Inc", "d"), (1, "Alder Hill Rigde Oaks", "e"), (1, None, "f")], "area int, parcel_owner string, apn string")
    want = overlay.select_parcels(apps.join(parcels, "area", "left"))
    got = overlay.select_parcels_of_area(apps, parcels)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.review_reason for r in got.collect()} == {None, "no_parcel_candidates", "missing_owner", "ambiguous_parcel"}


def test_every_customer_gets_parcels(spark, sf):
    assert catalogue.QUERIES["parcel_selection"](spark, sf).count() == spark.read.parquet(f"{sf}/customer.parquet").count()


def test_decisions(spark):
    clusters = spark.createDataFrame([(1, "ready"), (2, "needs_review"), (3, "ready")], "id int, status string")
    after = overlay.published(clusters, spark.createDataFrame([(1,), (2,)], "id int"))
    assert {r.id: r.status for r in after.collect()} == {1: "published", 2: "needs_review", 3: "ready"}
    assert [tuple(r) for r in overlay.audit(clusters, after, "id", "status").collect()] == [(1, "ready", "published")]
