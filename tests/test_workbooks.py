"""One sheet in .csv, .xlsx, .xls and .ods gives the same rows; broken workbooks give problems."""

import io
import struct
import zipfile

import pytest

from quadrat.sources import files, oldbooks, tabular, workbooks

HEAD = ["Permit #", "Operator Name", "Site ID", "Appl Date", "Product", "Quantity", "Units"]
ROWS = [["County export"], [], HEAD, ["45", "Smith & Sons", "301001", 44378, "X Plus", 2, "Gal"], ["46", "漢字 Ranch " + "long " * 60, "301002", 44379.5, "Y", 1000.25, "Gal"], ["", "", "", "", "", "", ""], ["47", "Owner", "301003", 44380, "Z", -3.5, "Lb"]]


def date(v):
    return f"2021-07-{int(v) - 44377:02d} {'12' if v % 1 else '00'}:00:00"


def want():
    return [[date(c) if i > 2 and j == 3 and c != "" else str(c) for j, c in enumerate(r)] for i, r in enumerate(ROWS)]


def xlsx():
    def cell(i, j, c):
        at = f"{chr(65 + j)}{i + 1}"
        text = str(c).replace("&", "&amp;")
        return f'<c r="{at}" s="{int(j == 3)}"><v>{c}</v></c>' if isinstance(c, (int, float)) else f'<c r="{at}" t="inlineStr"><is><t>{text}</t></is></c>'

    rows = "".join(f'<row r="{i + 1}">' + "".join(cell(i, j, c) for j, c in enumerate(r) if c != "") + "</row>" for i, r in enumerate(ROWS))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="Use" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/styles.xml", '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


def ods():
    def cell(i, j, c):
        if c == "":
            return "<t:table-cell/>"
        if isinstance(c, (int, float)):
            return f'<t:table-cell o:value-type="date" o:date-value="{date(c).replace(" ", "T") if c % 1 else date(c)[:10]}"><p>shown</p></t:table-cell>' if j == 3 else f'<t:table-cell o:value-type="float" o:value="{c}"><p>shown</p></t:table-cell>'
        return f'<t:table-cell o:value-type="string"><x:p xmlns:x="x">{str(c).replace("&", "&amp;")}</x:p></t:table-cell>'

    rows = "".join("<t:table-row>" + "".join(cell(i, j, c) for j, c in enumerate(r)) + '<t:table-cell t:number-columns-repeated="16000"/></t:table-row>' for i, r in enumerate(ROWS))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", f'<d xmlns:t="t" xmlns:o="o"><t:table t:name="Notes"><t:table-row t:number-rows-repeated="2"><t:table-cell t:number-columns-repeated="3"><p>n</p></t:table-cell></t:table-row></t:table><t:table t:name="Use">{rows}<t:table-row t:number-rows-repeated="1048000"><t:table-cell t:number-columns-repeated="16384"/></t:table-row></t:table></d>')
    return out.getvalue()


def record(kind, body=b""):
    return struct.pack("<HH", kind, len(body)) + body


def unicode_(s, wide):
    return s.encode("utf-16-le" if wide else "latin-1")


def xls(pad=0, epoch=0):
    """A BIFF8 stream in a compound file; ``pad`` bytes make it long enough to leave the mini stream."""
    strings = sorted({c for r in ROWS for c in r if isinstance(c, str) and c})
    sst, parts, cut = struct.pack("<II", 99, len(strings)), [], False
    for s in strings:
        wide = any(ord(c) > 255 for c in s)
        sst += struct.pack("<HB", len(s), int(wide))
        body = unicode_(s, wide)
        if wide and not cut:  # the characters go on in the next record, narrow there
            k = s.rindex("漢") + 10
            parts.append(sst + unicode_(s[:k], True))
            sst, cut = b"\x00" + s[k:].encode("latin-1"), True
        else:
            sst += body
    parts.append(sst)
    sheet = record(0x809, struct.pack("<HHHHII", 0x600, 0x10, 0, 0, 0, 0))
    for i, r in enumerate(ROWS):
        for j, c in enumerate(r):
            at = struct.pack("<HHH", i, j, int(j == 3))
            if c == "":
                continue
            if isinstance(c, str):
                sheet += record(0xFD, at + struct.pack("<I", strings.index(c)))
            elif j == 3:
                v = c - epoch
                sheet += record(0x27E, at + struct.pack("<I", v << 2 | 2)) if isinstance(v, int) else record(0x06, at + struct.pack("<d", v) + bytes(8))
            else:
                sheet += record(0xBD, struct.pack("<HHHIH", i, j, 0, (int(c * 100) << 2 | 3) & 0xFFFFFFFF, j)) if c != 1000.25 else record(0x203, at + struct.pack("<d", c))
    sheet += record(0x0A)
    head = record(0x809, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0)) + record(0x22, struct.pack("<H", int(epoch > 0))) + record(0x41E, struct.pack("<HHB", 164, 10, 0) + b"yyyy\\-mm\\-d"[:10])
    head += record(0xE0, struct.pack("<HH", 0, 0) + bytes(16)) + record(0xE0, struct.pack("<HH", 0, 164) + bytes(16)) + (record(0x5C, bytes(pad)) if pad else b"")
    rest = record(0xFC, parts[0]) + b"".join(record(0x3C, p) for p in parts[1:]) + record(0x0A)
    name = b"Use"
    start = len(head) + 4 + 8 + len(name) + len(rest)
    stream = head + record(0x85, struct.pack("<IBBBB", start, 0, 0, len(name), 0) + name) + rest + sheet
    return compound(stream)


def compound(stream):
    small = len(stream) < 4096
    entry = lambda name, kind, at, size: (name.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + bytes(48) + struct.pack("<IQ", at, size)
    fill = lambda b, n: b + bytes(-len(b) % n)
    body = fill(stream, 64 if small else 512)
    data = fill(body, 512)
    n = len(data) // 512
    # sectors: 0 FAT, 1 folder, 2 mini FAT, 3... data
    chain = [i + 1 for i in range(3, 3 + n - 1)] + [0xFFFFFFFE]
    fat = struct.pack("<128I", *([0xFFFFFFFD, 0xFFFFFFFE, 0xFFFFFFFE, *chain] + [0xFFFFFFFF] * 128)[:128])
    tiny = len(body) // 64
    mini = struct.pack("<128I", *([*range(1, tiny), 0xFFFFFFFE] + [0xFFFFFFFF] * 128)[:128]) if small else b"\xff" * 512
    folder = fill(entry("Root Entry", 5, 3, len(body)) + entry("Workbook", 2, 0 if small else 3, len(stream)), 512)
    head = oldbooks.MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<9I", 0, 1, 1, 0, 4096, 2, 1, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return head.ljust(512, b"\0") + fat + folder + mini + data


BOOKS = {"a.xlsx": xlsx(), "b.xls": xls(), "c.xls": xls(5000), "d.xls": xls(epoch=1462), "e.ods": ods()}


@pytest.mark.parametrize("name", list(BOOKS))
def test_rows(name):
    got = workbooks.best_sheet(BOOKS[name], lambda row: len({f for c in row if (f := tabular.match_label(c))}), 15)
    trim = lambda rows: [r[: max((j + 1 for j, c in enumerate(r) if c), default=0)] for r in rows]
    assert trim(got) == trim(want())


def test_four_formats(spark, tmp_path):
    import csv

    for name, raw in BOOKS.items():
        (tmp_path / name).write_bytes(raw)
    with open(tmp_path / "f.csv", "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows(want())
    (tmp_path / "bad.xls").write_bytes(oldbooks.MAGIC + b"\xff" * 600)
    (tmp_path / "short.ods").write_bytes(b"PK")
    got = {}
    for r in tabular.use_records(spark, str(tmp_path)).collect():
        got.setdefault(r.file.rpartition("/")[2], []).append((r.line, r.permit_number, r.operator_name, str(r.application_date), str(r.started), r.product_name, r.quantity))
    assert set(got) == {*BOOKS, "f.csv"} and all(sorted(v) == sorted(got["f.csv"]) for v in got.values()) and len(got["f.csv"]) == 3
    seen = {r.path.rpartition("/")[2]: r for r in files.source_files(spark, str(tmp_path)).collect()}
    assert seen["bad.xls"].problem and seen["short.ods"].problem and seen["b.xls"].problem is None and "Smith & Sons" in seen["b.xls"].text and "Smith & Sons" in seen["e.ods"].text


def test_broken_compound_files():
    """Cut or circular chains end in an error, not in a loop."""
    whole = xls(5000)
    for at in range(0, 600, 7):
        broken = whole[:at] + b"\x01\x00\x00\x00" + whole[at + 4 :]
        try:
            list(workbooks.sheets(broken))
        except (ValueError, KeyError, IndexError, struct.error, zipfile.BadZipFile):
            pass
    with pytest.raises(ValueError):
        oldbooks.workbook_stream(whole[:512] + struct.pack("<128I", *range(128)) + whole[1024:])
