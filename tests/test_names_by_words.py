"""Pairs whose words decide them go without a comparison of letters."""

import datetime as dt

from pyspark.sql import functions as F

from quadrat.functions import names
from quadrat.operators import linkage


def test_words_tell_or_bound_a_score(spark):
    keys = ["", "ACME", "ACME TIMBER", "TIMBER ACME", "ACME TIMBER & RANCH", "ACME FOREST TIMBER", "ACNE TIMBER", "SUPPLIER 000000001", "SUPPLIER 000000002", "OF AT", "BIG ACME FOREST TIMBER LAND"]
    pairs = spark.createDataFrame([(a, b) for a in keys for b in keys], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = pairs.select("a", "b", F.round(names.company_score(a, b), 4).alias("s"), *(names.likeness_by_words(a, b, x).alias(n) for n, x in (("low", names.REJECT), ("high", names.MATCH)))).collect()
    for r in got:
        assert r.high is not None or r.s >= 0.7, r
        assert r.low is None or (r.low >= names.REJECT) == (r.s >= names.REJECT) and (r.low >= names.MATCH) == (r.s >= names.MATCH), r
        assert r.high is None or (r.high >= names.MATCH) == (r.s >= names.MATCH), r
    assert {(r.a, r.b): r.low for r in got}["SUPPLIER 000000001", "SUPPLIER 000000002"] == 0.6 / 3


def test_letters_are_compared_where_words_leave_it_open(spark, monkeypatch):
    asked, keep = [], linkage.kept
    monkeypatch.setattr(linkage, "kept", lambda df, name: (lambda out: (asked.extend(map(tuple, out.collect())) if name == "alike" else None) or out)(keep(df, name)))
    day = dt.date(2024, 5, 1)
    owners = ["Customer#01", "Customer#02", "Big Acme Forest Timber Land", "Big Acme Forest Timber Lands Lot", "Old Acme Forest Timber Land"]
    records = [(i, o, "use_report", day, day, f"Supplier#{i}", ["p"], None, f"Adviser {i}", None, 2024, 1) for i, o in enumerate(owners)]
    df = spark.createDataFrame(records, "id int, owner string, kind string, start date, ended date, applicator string, products array<string>, place int, pca string, permit string, year int, operator_id int")
    got = {(r.a, r.b): (r.score, r.outcome) for r in linkage.scored_candidates(df).collect()}
    keys = [r.k for r in spark.createDataFrame([(i, o) for i, o in enumerate(owners)], "i int, o string").select("i", names.company_key(F.col("o")).alias("k")).sort("i").collect()]
    pairs = spark.createDataFrame([(a, b, keys[a], keys[b]) for a, b in got], "a int, b int, k string, l string")
    scores = {(r.a, r.b): r.s for r in pairs.select("a", "b", F.round(names.company_score(F.col("k"), F.col("l")), 4).alias("s")).collect()}
    for (a, b), (points, outcome) in got.items():
        s = scores[a, b]
        assert points == 35 + 40 * (s >= names.MATCH) and outcome == ("separate" if s < names.REJECT or points < linkage.REVIEW else "auto" if points >= linkage.AUTO else "review")
    assert len(got) == 10 and 0 < len(asked) <= 3 and all("CUSTOMER" not in k + l for k, l, _ in asked)


def test_keys_of_odd_signs(spark):
    """Signs, blanks and letters of other alphabets, with and without words that a key changes."""
    rows = {"Customer#0001": "CUSTOMER 0001", "straße": "STRASSE", "(x1) [yz]_Ünï~": "X1 YZ UNI", "THE": "THE", "Q2&A2 &": "Q2 & A2", "and": ""}
    df = spark.createDataFrame([(k,) for k in rows], "n string")
    assert {r.n: r.k for r in df.select("n", names.plain_key(F.col("n")).alias("k")).collect()} == rows
