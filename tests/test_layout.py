"""Permit tables by where their cells stand: rows over several lines and pages, blank cells, shifted cells."""

from quadrat.sources import forms, layout

PERMIT = """RESTRICTED MATERIALS PERMIT: 18-24-4500033
Operator: PINE RIDGE LAND CO # 1
Issued on: 1/5/2024
Expires on: 12/31/2026

CONTACT LIST
Name                        Phone            License   Expiration   Contact Type
Ridge, Ann                  (530) 000-1111                          AR
NORTHERN HELICOPTER         (530) 000-2222   30717     12/31/2024   PCM
SERVICES OF
THE VALLEY
Brook, Lee                  530-000-3333     99101     1/31/2025    PCA
PESTICIDES LIST
Number   Pesticide            Pests           Forms      Methods      Applicators
100      2,4-D                WEEDS           Liquid     Air/Ground   PCB
359      STRYCHNINE           POCKET          Bait       Ground       QAL
                              GOPHERS
Page 2 of 3
Number   Pesticide            Pests           Forms      Methods      Applicators
0        NON-RESTRICTED        BRUSH          All Reg.   Ground       PCB
         MATERIALS
SITES LIST
Site ID   Site Name           District   MTRS         Commodity                   Acres
280801    EAST BLOCK                     M28N08E01    FOREST, TMBRLND/30000-0     645.00 ACRES
280802    WEST BLOCK UPPER    9          M28N08E02    FOREST,                     1,020.5 ACRES
          SLOPE                                       TMBRLND/30000-0
28A103                        9          M28N08E03    UNCULTIVATED AG/66000-0     12 ACRES
OPERATION-WIDE CONDITIONS
1        Keep out             of             streams
"""


def test_three_tables(spark):
    got = forms.permits(spark.createDataFrame([("a", PERMIT), ("b", PERMIT.replace("  ", " "))], "path string, text string"))
    p = got.where("path = 'a'").first()
    assert p.number == "18-24-4500033" and p.operator.strip() == "PINE RIDGE LAND CO" and str(p.expires) == "2026-12-31"
    assert [(c["name"], c["phone"], c["license"], c["expires"], c["kind"]) for c in p.contacts] == [
        ("Ridge, Ann", "(530) 000-1111", "", "", "AR"), ("NORTHERN HELICOPTER SERVICES OF THE VALLEY", "(530) 000-2222", "30717", "12/31/2024", "PCM"), ("Brook, Lee", "530-000-3333", "99101", "1/31/2025", "PCA"),
    ]
    assert [(m["number"], m["name"], m["pests"], m["forms"], m["methods"], m["applicators"]) for m in p.materials] == [
        ("100", "2,4-D", "WEEDS", "Liquid", "Air/Ground", "PCB"), ("359", "STRYCHNINE", "POCKET GOPHERS", "Bait", "Ground", "QAL"), ("0", "NON-RESTRICTED MATERIALS", "BRUSH", "All Reg.", "Ground", "PCB"),
    ]
    assert [(s["site_id"], s["name"], s["district"], s["mtrs"], s["commodity"], s["code"], s["acres"]) for s in p.sites] == [
        ("280801", "EAST BLOCK", "", "M28N08E01", "FOREST, TMBRLND", "30000-0", "645.00"), ("280802", "WEST BLOCK UPPER SLOPE", "9", "M28N08E02", "FOREST, TMBRLND", "30000-0", "1,020.5"), ("28A103", "", "9", "M28N08E03", "UNCULTIVATED AG", "66000-0", "12"),
    ]


def test_cells_and_columns():
    assert layout.cells("a b   c\td") == [(0, "a b"), (6, "c"), (8, "d")]
    assert layout.columns(["x    y     z", "x     y    z", "     q"], [0]) == [0, 5, 11]
    assert layout.table("no titles here\n1  2", ("a", "b"), ("One", "Two"), r"\d") == [] and layout.table("", ("a",), ("One",), r"\d") == []
    assert layout.table("One   Two\n\n1     x y\n      z\n2", ("a", "b"), ("One", "Two"), r"\d") == [{"a": "1", "b": "x y z"}, {"a": "2", "b": ""}]
