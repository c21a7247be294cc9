"""File sources, sinks and streams on small files."""

import datetime as dt
import zipfile

from pyspark.sql import functions as F

from quadrat.operators import linkage, tallies
from quadrat.sources import files, tabular
from quadrat.streaming import incremental


def test_use_records(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("Title\n\nPermit #\tPermitee\tSite ID\tMeridian\tTownship\tRange\tSection\tApplication Date\tProduct Name\tQuantity Used\tQuantity Units\tEPA Reg No\tOdd\n4500033\t\"Acme\"\t341003\tM\t34N\t10E\t3\t07/01/2021\tX DF\t1,050\tPounds\t62719-259-AA\tz\n\t\t\n")
    (tmp_path / "b.csv").write_text("just,some,cells\n1,2,3\n")
    got = tabular.use_records(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].mtrs == "M34N10E03" and got[0].quantity == 1050 and got[0].operator_name == "Acme" and got[0].base_reg_no == "62719-259" and got[0].line == 4 and got[0].application_date == dt.date(2021, 7, 1)
    assert tabular.records(spark, str(tmp_path)).first().fields["Odd"] == "z"


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>A &amp; B</w:t></w:p><w:tc><w:t>c</w:t></w:tc>")
    with zipfile.ZipFile(tmp_path / "in.zip", "w") as z:
        z.writestr("p.html", "<p>Hi <b>you</b></p><script>no</script>")
        z.write(tmp_path / "x.docx", "x.docx")
        z.writestr("bad.docx", "not a zip")
    (tmp_path / "x.docx").unlink()
    got = {r.path.rpartition("!")[2]: r for r in files.source_files(spark, str(tmp_path)).collect()}
    assert got["p.html"].text == "Hi you" and got["x.docx"].text == "A & B\nc|" and got["bad.docx"].problem and got["bad.docx"].text is None
    key = spark.range(1).select(files.blob_key(F.lit(got["p.html"].sha256), F.lit("HTML")).alias("k")).first().k
    assert key.startswith("sources/" + got["p.html"].sha256[:2]) and key.endswith(".html")


def test_inspections_and_stations(spark, tmp_path):
    log = tmp_path / "log.csv"
    log.write_text("Insp Date,Type,Site No.,Permit,Operator,Inspector,Result,Violations,Weather\n07/01/2021,Use Monitoring,34 10 03,45,Acme,Roe,No violations,2,dry\n,,,,,,,,\n")
    got = files.inspections(spark, str(log)).collect()
    assert len(got) == 1 and got[0].inspection_type == "use_monitoring" and got[0].outcome == "violation" and got[0].violations_count == 2 and got[0].extra == {"Weather": "dry"} and got[0].site_id == "341003"
    csv = tmp_path / "s.csv"
    csv.write_text("name,operator,latitude,longitude,herbicides_tested\na,o,38,-121,yes\na,o,39,-121,no\nb,o,10,10,yes\n")
    stations = files.water_stations(spark, str(csv)).collect()
    assert [(r.name, r.latitude, r.herbicides_tested) for r in stations] == [("a", 39.0, False)]


def test_filled_in(spark):
    old = spark.createDataFrame([(1, "a", None), (2, " ", "y")], "k int, a string, b string")
    new = spark.createDataFrame([(1, "z", "b"), (2, "c", "n"), (3, "d", "e")], "k int, a string, b string")
    assert sorted(map(tuple, files.filled_in(old, new, "k").collect())) == [(1, "a", "b"), (2, "c", "y"), (3, "d", "e")]


def test_outliers_need_three_lines(spark):
    line = lambda n, q: (n, n, "P", "Pounds", "mass", float(q))
    rows = spark.createDataFrame([line(1, 290), line(2, 300), line(3, 280), line(4, 29025)], "id int, line int, product string, unit string, family string, quantity double")
    held = lambda df: [r.id for r in tallies.judged(df, F.lit(83.0)).where("held_out").collect()]
    assert held(rows) == [4] and held(rows.where("id in (1, 4)")) == []


def test_archive_too_large_to_unpack_is_named(monkeypatch):
    import io
    import zipfile

    import pyarrow as pa

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a.txt", "x" * 100)
    monkeypatch.setattr(files, "ARCHIVE_BYTES", 50)
    [row] = [r for b in files._expand([pa.record_batch([pa.array(["f.zip"]), pa.array([raw.getvalue()])], ["path", "content"])]) for r in b.to_pylist()]
    assert row["path"] == "f.zip" and row["content"] == raw.getvalue() and row["text"] is None and "50 bytes" in row["problem"]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(40, 41)], "a long, b long")
    got = {r.id: r.component for r in linkage.components(edges, spark.range(1, 43)).collect()}
    assert got == {i: 1 if i <= 30 else 40 if i in (40, 41) else i for i in range(1, 43)}


def test_pair_scores_of_spellings_permits_and_advisers(spark):
    day = dt.date(2024, 5, 1)
    row = lambda i, owner, permit=None, pca=None, start=day, applicator="Sky", place=None: (i, owner, "use_report", start, start, applicator, ["p"], place, pca, permit, 2024, i)
    rows = [
        row(1, "W.M. Beaty & Associates, Inc.", " 45 ", "Jo Day"), row(2, "WM Beaty", "45", "Jo Day"), row(3, "Zebra Ranch", "45", "Jo Day"), row(4, None, "45", None, day + dt.timedelta(20), "Other", 7), row(5, "WM Beaty", " ", None, day, "Other", 8), row(6, "WM Beaty", "46", None, day, "Other"),
    ]
    records = spark.createDataFrame(rows, "id int, owner string, kind string, start date, ended date, applicator string, products array<string>, place int, pca string, permit string, year int, operator_id int")
    assert sorted(map(tuple, linkage.record_pairs(records).collect())) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (4, 5), (5, 6)], "a int, b int")
    got = {(r.a, r.b): (r.score, r.outcome) for r in linkage.scored(pairs, records).collect()}
    assert got == {(1, 2): (110, "auto"), (1, 3): (70, "separate"), (2, 4): (30, "separate"), (4, 5): (40, "separate"), (5, 6): (85, "auto")}


def test_limiter_forgets_refused_hits(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    hits = spark.createDataFrame([("a", t0 + dt.timedelta(seconds=s)) for s in (0, 10, 20, 65, 66)], "key string, ts timestamp")
    hits.coalesce(1).write.parquet(str(tmp_path / "h"))
    stream = spark.readStream.schema(hits.schema).parquet(str(tmp_path / "h"))
    got = incremental.run_now(incremental.limited(stream, "key", 60, 2), "append").orderBy("ts").collect()
    assert [r.allowed for r in got] == [True, True, False, True, False]


def test_pull_skips_known_files(spark):
    f = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "2")], "name string, sha256 string")
    known = spark.createDataFrame([("1",)], "sha256 string")
    assert [r.sha256 for r in incremental.pull(f, known).collect()] == ["2"]


def test_quoted_cells(spark, tmp_path):
    (tmp_path / "q.csv").write_text('Use report\n"Permit #",Operator Name,Site ID,"Appl Date",Product,Quantity,Units\n45,"SMITH, JOHN",301001,7/1/2021,"X ""Plus""",2,Gal\n46,"Two\nlines",301002,7/2/2021,Y,"1,000",Gal\n')
    got = tabular.use_records(spark, str(tmp_path)).orderBy("permit_number").collect()
    assert [(r.permit_number, r.operator_name, r.product_name, r.quantity) for r in got] == [("45", "SMITH, JOHN", 'X "Plus"', 2.0), ("46", "Two\nlines", "Y", 1000.0)]


def test_separate_places_and_times(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("County\tTownship\tRange\tSection\tDate Applied\tTime Applied\tEnd Date/Time Applied\tProduct Name\nHumboldt\t7\t2\t3\t07/01/2021\t6:30 PM\t7/1/2021 8:05 PM\tX\nPlumas\tT29N\tR11W\t23\t2021-07-02\t0615\t\tX\n\tx\t11\t23\t2021-07-02\t99\t\tX\n")
    got = tabular.use_records(spark, str(tmp_path)).orderBy("line").collect()
    assert [r.mtrs for r in got] == ["H07N02E03", "M29N11W23", None]
    assert [str(r.started) for r in got] == ["2021-07-01 18:30:00", "2021-07-02 06:15:00", "2021-07-02 00:00:00"] and str(got[0].ended) == "2021-07-01 20:05:00"


def workbook(path, sheets):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r + 1}" s="1"><v>{v}</v></c>' if isinstance(v, float) else f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{v}</t></is></c>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows)) + "</sheetData></worksheet>")


def test_best_sheet(spark, tmp_path):
    head = ["Permit #", "Operator Name", "Site ID", "Application Date", "Product", "Quantity"]
    workbook(tmp_path / "w.xlsx", {"Summary": [["Permit #", "of the county"], ["x"]], "Data": [["County export"], head, ["45", "Acme", "301001", 44378.0, "X", None], ["46", None, "301002", 44379.5, "Y", "3"]], "Key": [["a"]]})
    got = tabular.use_records(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r.permit_number, r.operator_name, str(r.application_date), r.quantity) for r in got] == [("45", "Acme", "2021-07-01", None), ("46", None, "2021-07-02", 3.0)]
    assert "County export" in files.source_files(spark, str(tmp_path)).first().text


def test_broken_members_give_problems(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("good.txt", "fine")
        z.writestr("bad.txt", "spoiled " * 50)
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    raw[raw.rindex(b"spoiled ", 0, raw.index(b"PK\x01\x02"))] ^= 1
    (tmp_path / "a.zip").write_bytes(bytes(raw))
    (tmp_path / "b.ods").write_bytes(b"x")
    (tmp_path / "c.xlsx").write_bytes(b"not a workbook")
    got = {r.path.rpartition("/")[2]: r for r in files.source_files(spark, str(tmp_path)).collect()}
    assert got["a.zip!good.txt"].text == "fine" and "unpacked" in got["a.zip!bad.txt"].problem and got["b.ods"].problem and got["c.xlsx"].problem


def test_duplicates_by_the_rules(spark):
    day = dt.date(2021, 7, 1)
    row = lambda i, file, mtrs="M30N10E01", site="301001", doc=None, acres=10.0, county="x", start=day: (i, county, "use_report", start, mtrs, site, doc, file, acres)
    rows = [
        row(1, 1), row(2, 2), row(3, 1), row(4, 3, acres=10.5), row(5, 4, acres=11.2), row(6, 5, mtrs="M30N10E02"), row(7, 6, mtrs=None, site="30-10-01"), row(8, 7, doc="A-1", acres=99.0), row(9, 8, doc="a1"), row(10, 9, doc="B"),
        row(11, 10, county=None), row(12, 11, county=None), row(13, 12, start=None), row(14, 13, mtrs=None, site=None), row(15, 14),
    ]
    records = spark.createDataFrame(rows, "id int, county string, kind string, start date, mtrs string, site string, document string, file int, acres double")
    items = [(i, "p", 1.0) for i in range(1, 15)] + [(15, "q", 1.0), (2, "r", 2.0), (7, "r", 2.0)]
    got = {tuple(r) for r in linkage.duplicate_records(records, spark.createDataFrame(items, "id int, product string, quantity double")).collect()}
    assert got == {(1, 4), (3, 4), (2, 7), (8, 9), (11, 12), (1, 9), (1, 10), (1, 15), (3, 9), (3, 10), (3, 15), (4, 9), (4, 10), (4, 15), (9, 15), (10, 15)}


def test_snapshot_is_built_once(spark, tmp_path):
    from quadrat.operators import ingest

    rows, built = spark.range(5).withColumn("day", F.lit("2024-01-01")), []
    make = lambda: built.append(1) or rows
    for _ in range(2):
        assert ingest.snapshot(spark, f"file://{tmp_path}", ingest.fingerprint(rows, "day"), make).count() == 5
    assert ingest.snapshot(spark, f"file://{tmp_path}", ingest.fingerprint(rows.limit(4), "day"), make).count() == 5 and len(built) == 2


def test_record_sink(spark, tmp_path):
    from quadrat.operators import ingest

    records = spark.createDataFrame([(1, 2021, "a", None, "f.csv"), (2, 2022, "b", 3.0, "f.csv")], "id int, year int, owner string, acres double, file string")
    lines = spark.createDataFrame([(1, "X"), (2, "Y"), (2, "Z")], "id int, product string")
    ingest.write_records(records, lines, str(tmp_path), "id", "file", "owner", "acres")
    assert spark.read.parquet(f"{tmp_path}/records").where("year = 2022").count() == 1 and spark.read.parquet(f"{tmp_path}/lines").count() == 3
    assert sorted((r.id, r.field, r.value) for r in spark.read.parquet(f"{tmp_path}/provenance").collect()) == [(1, "owner", "a"), (2, "acres", "3.0"), (2, "owner", "b")]


def test_detected_formats(spark):
    from quadrat.sources import detect

    rows = [("a.pdf", "Pesticide Use Report\nNotice of Intent", 0), ("b.pdf", "Pesticide use report. Restricted materials permit, sites list", 0), ("c.TXT", "decision and order", 6), ("d.txt", "decision and order", 3), ("e", "decision and order", 0), ("f.docx", None, 0)]
    got = spark.createDataFrame(rows, "name string, text string, n int").select("name", detect.detected(F.col("name"), F.col("text"), F.col("n")).alias("x")).collect()
    assert {r.name: (r.x.profile, r.x.score) for r in got} == {
        "a.pdf": ("pur_form", 0.75), "b.pdf": ("restricted_materials_permit", 0.8), "c.TXT": ("tabular_use_records", 0.7), "d.txt": ("tabular_use_records", 0.55), "e": (None, 0.0), "f.docx": (None, 0.0),
    }
