"""Rows of spreadsheets: .xlsx and .ods workbooks, read from their XML parts, and .xls ones."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from quadrat.sources import oldbooks

#: Numbers of built-in date and time formats.
DATE_FORMATS = {*range(14, 23), 45, 46, 47}
_EPOCH = dt.datetime(1899, 12, 30)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _parts(z: zipfile.ZipFile, name: str, wanted: str) -> Iterator[ElementTree.Element]:
    """Elements of a part, one after the other; none if the part isn't there."""
    if name in z.namelist():
        with z.open(name) as f:
            for _, e in ElementTree.iterparse(f):
                if _local(e.tag) == wanted:
                    yield e
                    e.clear()


def _text(e: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in e.iter() if _local(x.tag) == "t")


def _dates(z: zipfile.ZipFile) -> set[int]:
    """Styles that show a number as a date."""
    own = {int(e.get("numFmtId")) for e in _parts(z, "xl/styles.xml", "numFmt") if re.search("[ydh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", e.get("formatCode", "").lower()))}
    for e in _parts(z, "xl/styles.xml", "cellXfs"):
        return {i for i, x in enumerate(e) if int(x.get("numFmtId", 0)) in own | DATE_FORMATS}
    return set()


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference.upper())[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _shown(value: str, is_date: bool) -> str:
    if is_date and re.fullmatch(r"-?\d+(\.\d+)?", value):
        return str(_EPOCH + dt.timedelta(seconds=round(float(value) * 86400)))
    return value[:-2] if re.fullmatch(r"-?\d+\.0", value) else value


def _rows(z: zipfile.ZipFile, part: str, strings: list[str], dates: set[int]) -> Iterator[list[str]]:
    for row in _parts(z, part, "row"):
        cells: list[str] = []
        for c in row:
            at = _column(c.get("r", "")) if c.get("r") else len(cells)
            cells += [""] * (at + 1 - len(cells))
            kind, v = c.get("t"), next((x.text or "" for x in c if _local(x.tag) == "v"), "")
            cells[at] = strings[int(v)] if kind == "s" and v else _text(c) if kind == "inlineStr" else _shown(v, kind in (None, "n") and int(c.get("s", 0)) in dates)
        yield cells


#: Cells of a row of an .ods sheet, beyond which blank or repeated ones are padding.
WIDEST = 16384


def _ods(z: zipfile.ZipFile) -> Iterator[tuple[str, Iterator[list[str]]]]:
    """(name, rows) of an .ods workbook's sheets. Repeated cells and rows are written out, blank ones only before others that aren't."""
    name, rows, skipped = "", [], 0
    with z.open("content.xml") as f:
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            kind = _local(e.tag)
            get = lambda e, key: next((v for k, v in e.items() if _local(k) == key), None)
            if kind == "table":
                if event == "end":
                    yield name, iter(rows)
                    e.clear()
                name, rows, skipped = get(e, "name") or "", [], 0
            elif kind == "table-row" and event == "end":
                cells, blank = [], 0
                for c in e:
                    if _local(c.tag) not in ("table-cell", "covered-table-cell"):
                        continue
                    text = _ods_text(c, get)
                    n = min(int(get(c, "number-columns-repeated") or 1), WIDEST)
                    if text:
                        cells += [""] * blank + [text] * n
                        blank = 0
                    else:
                        blank += n
                n = int(get(e, "number-rows-repeated") or 1)
                if cells:
                    rows += [[] for _ in range(skipped)] + [list(cells) for _ in range(n)]
                    skipped = 0
                else:
                    skipped += n
                e.clear()


def _ods_text(c: ElementTree.Element, get) -> str:
    kind = get(c, "value-type")
    if kind == "date":
        return (get(c, "date-value") or "").replace("T", " ") if "T" in (get(c, "date-value") or "") else f"{get(c, 'date-value')} 00:00:00"
    if kind in ("float", "percentage", "currency"):
        return _shown(get(c, "value") or "", False)
    if kind == "boolean":
        return str(int(get(c, "boolean-value") == "true"))
    return "\n".join("".join(p.itertext()) for p in c.iter() if _local(p.tag) == "p")


def sheets(raw: bytes) -> Iterator[tuple[str, Iterator[list[str]]]]:
    """(name, rows) of each sheet in the workbook's order."""
    if raw[: len(oldbooks.MAGIC)] == oldbooks.MAGIC:
        yield from oldbooks.sheets(raw, DATE_FORMATS, _shown)
        return
    z = zipfile.ZipFile(io.BytesIO(raw))
    if "content.xml" in z.namelist():
        yield from _ods(z)
        return
    strings = [_text(e) for e in _parts(z, "xl/sharedStrings.xml", "si")]
    targets = {e.get("Id"): e.get("Target") for e in _parts(z, "xl/_rels/workbook.xml.rels", "Relationship")}
    for e in list(_parts_kept(z, "xl/workbook.xml", "sheet")):
        target = targets[next(v for k, v in e.items() if _local(k) == "id")]
        yield e["name"], _rows(z, target.lstrip("/") if target.startswith("/") else f"xl/{target}", strings, _dates(z))


def _parts_kept(z: zipfile.ZipFile, name: str, wanted: str) -> Iterator[dict[str, str]]:
    for e in _parts(z, name, wanted):
        yield dict(e.attrib)


def best_sheet(raw: bytes, score: Callable[[list[str]], int], lines: int) -> list[list[str]]:
    """Rows of the sheet one of whose first lines has the highest score; the first of equal ones."""
    best, most = [], -1
    for _, rows in sheets(raw):
        rows = list(rows)
        got = max((score(r) for r in rows[:lines]), default=0)
        if got > most:
            best, most = rows, got
    return best
