"""Parsers of document text: use-report forms, permits, investigations and enforcement papers.

Forms and permits are positional, so they are parsed text by text over Arrow
batches; a text that can't be parsed gives a problem, not an end. The other two
are columns of regular expressions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions import policy
from quadrat.sources import layout
from quadrat.sources.tabular import parse_date

#: Labels of the form, and fields they give.
FORM_LABELS = {
    "permittee/permit operator": "operator_name", "operator id/permit number": "permit_number", "document number": "document_number", "county no": "county_no", "section": "section", "township": "township", "range": "range", "meridian": "meridian", "app method/fume code": "method",
    "commercial applicator (if any)": "applicator_name", "site identification number": "site_id", "planted area - units": "planted_area", "location": "location", "block id": "block_id", "pre-plant application": "pre_plant", "start date/time applied": "started", "end date/time applied": "ended",
    "treated area - units": "treated_area", "commodity treated": "commodity", "product name": "product_name", "epa reg no": "epa_reg_no", "quantity used": "quantity", "quantity units": "quantity_units",
}
_CELL = re.compile(r"\S+(?: \S+)*")


def form_fields(text: str) -> tuple[dict[str, str], list[dict[str, str]]]:
    """Fields, and product lines, of a grid form: a row of labels stands over rows of values, each cut where a label begins; other lines are 'label: value'."""
    fields: dict[str, str] = {}
    products: list[dict[str, str]] = []
    heads: list[tuple[int, str | None]] = []
    for line in text.splitlines():
        cells = [(m.start(), m[0]) for m in _CELL.finditer(line)]
        known = [FORM_LABELS.get(c.lower()) for _, c in cells]
        if cells and sum(k is not None for k in known) * 2 >= len(cells) and any(known):
            heads = [(at, k) for (at, _), k in zip(cells, known)]
        elif heads and cells:
            cuts = [at for at, _ in heads] + [len(line) + 1]
            row = {k: line[cuts[i] : cuts[i + 1]].strip() for i, (_, k) in enumerate(heads) if k}
            if "product_name" in row:
                products.append(row)
                continue
            for k, v in row.items():
                if v:
                    fields.setdefault(k, v)
            heads = []
        elif not cells:
            heads = []
        elif m := re.match(r"\s*([A-Z][\w /]+):\s*(.+)", line):
            fields.setdefault(m[1].strip().lower().replace(" ", "_"), m[2].strip())
    return fields, products


_CONTACT = ("name", "phone", "license", "expires", "kind")
_MATERIAL = ("number", "name", "pests", "forms", "methods", "applicators")


def permit_parts(text: str) -> dict:
    """Number, dates, contacts, materials and sites of a permit with its cells set off by |, one or several a line, or by where they stand."""
    found = lambda p: (m := re.search(p, text)) and m[1].strip()
    out = {"number": found(r"PERMIT:\s*(\S+)"), "operator": found(r"Operator:\s*([^#\n]+)"), "issued": found(r"Issued on:\s*([\d/]+)"), "valid": found(r"Valid as of:\s*([\d/]+)"), "expires": found(r"Expires on:\s*([\d/]+)")}

    def cells(head: str, end: str) -> list[str]:
        m = re.search(rf"{head}(.*?)(?:{end}|\Z)", text, re.S)
        return [c.strip() for c in m[1].replace("\n", " \n").split("|")] if m else []

    def table(head: str, end: str, names: tuple[str, ...], titles: int) -> list[dict]:
        body = cells(head, end)[titles:]
        rows = [dict(zip(names, body[i : i + len(names)])) for i in range(0, len(body) - len(names) + 1, len(names))]
        return [r for r in rows if any(r.values())]

    if "|" not in text:
        return out | _by_layout(text)
    out["contacts"] = table("CONTACT LIST", "PESTICIDES LIST", _CONTACT, len(_CONTACT))
    out["materials"] = table("PESTICIDES LIST", "SITES LIST", _MATERIAL, len(_MATERIAL))
    sites = re.search(r"SITES LIST(.*?)(?:OPERATION-WIDE|\Z)", text, re.S)
    row = r"(\w+)\s*\|\s*([^|\n]*)\|\s*(\d*)\s*\|\s*([MHS]\w+)\s*\|\s*([^|/]*)/\s*([\d-]+)\s*\|\s*([\d.,]+)\s*ACRES"
    out["sites"] = [dict(zip(("site_id", "name", "district", "mtrs", "commodity", "code", "acres"), (x.strip() for x in m))) for m in re.findall(row, sites[1])] if sites else []
    return out


#: A permit's tables, with their titles and what begins a row.
_TABLES = {
    "contacts": ("CONTACT LIST", _CONTACT, ("Name", "Phone", "License", "Expiration", "Contact Type"), r"\S.*", False),
    "materials": ("PESTICIDES LIST", _MATERIAL, ("Number", "Pesticide", "Pests", "Forms", "Methods", "Applicators"), r"\d{1,4}", True),
    "sites": ("SITES LIST", ("site_id", "name", "district", "mtrs", "commodity", "acres"), ("Site ID", "Site Name", "District", "MTRS", "Commodity", "Acres"), r"\w*\d\w*", True),
}


def _by_layout(text: str) -> dict:
    """The three tables of a permit without separators; each ends where the next heading stands."""
    heads = [h for h, *_ in _TABLES.values()] + ["SITES REQUIRING SCHOOLSITE NOTIFICATION", "OPERATION-WIDE CONDITIONS"]
    parts = re.split(rf"(?m)^[ \t]*({'|'.join(heads)})[ \t]*$", text)
    body: dict[str, str] = {}
    for head, part in zip(parts[1::2], parts[2::2], strict=True):
        body[head] = body.get(head, "") + part
    out = {name: layout.table(body.get(head, ""), *how) for name, (head, *how) in _TABLES.items()}
    for s in out["sites"]:
        commodity, _, code = s["commodity"].rpartition("/")
        s |= {"commodity": commodity.strip() or s["commodity"], "code": code.strip() if commodity else "", "acres": (re.match(r"[\d.,]+", s["acres"]) or [""])[0]}
    return out


def forms(texts: DataFrame) -> DataFrame:
    """(path, fields map, products array of maps, problem) of use-report forms (path, text)."""

    def parse(batches):
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"]):
                fields, products = form_fields(text or "")
                rows.append((path, fields, products, None if fields else "no form field found"))
            yield pd.DataFrame(rows, columns=["path", "fields", "products", "problem"])

    return texts.select("path", "text").mapInPandas(parse, "path string, fields map<string,string>, products array<map<string,string>>, problem string")


def permits(texts: DataFrame) -> DataFrame:
    """(path, number, operator, issued, valid, expires, contacts, materials, sites, problem) of permits (path, text)."""

    def parse(batches):
        for b in batches:
            rows = [permit_parts(t or "") | {"path": p} for p, t in zip(b["path"], b["text"])]
            frame = pd.DataFrame(rows, columns=["path", "number", "operator", "issued", "valid", "expires", "contacts", "materials", "sites"])
            frame["problem"] = [None if n else "no permit number found" for n in frame["number"]]
            yield frame

    many = "array<map<string,string>>"
    out = texts.select("path", "text").mapInPandas(parse, f"path string, number string, operator string, issued string, valid string, expires string, contacts {many}, materials {many}, sites {many}, problem string")
    return out.withColumns({c: parse_date(F.col(c)) for c in ("issued", "valid", "expires")})


def _after(text: Column, label: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?i){label}[ \t]*[:#]?[ \t]*([^\n|]+)", 1)), F.lit(""))


def investigations(texts: DataFrame) -> DataFrame:
    """(path, case_number, county, mtrs, apns, licenses, findings) of investigation reports (path, text)."""
    t = F.col("text")
    return texts.select(
        "path", _after(t, "(?:case|investigation) (?:no\\.?|number)").alias("case_number"), _after(t, "county").alias("county"), F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b[MHS]\d{1,2}[NS]\d{1,2}[EW]\d{1,2}\b"), 0)).alias("mtrs"),
        F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b\d{3}-\d{3}-\d{2,3}(?:-\d{3})?\b"), 0)).alias("apns"), F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?i)licen[sc]e\s*(?:no\.?|#|number)?\s*:?\s*(\d{4,6})"), 1)).alias("licenses"), F.regexp_extract_all(t, F.lit(r"(?m)^\s*\d+[.)]\s+(.+)$"), 1).alias("findings"),
    )


def enforcement(texts: DataFrame) -> DataFrame:
    """(path, action_type, stage, case_number, penalty, headline) of enforcement papers (path, text); curly quotes and hyphenated line ends are mended first."""
    t = F.regexp_replace(F.translate("text", "‘’“”", "''\"\""), r"(\w)-\n(\w)", "$1$2")
    rows = texts.select("path", t.alias("t")).select(
        "path", policy.action_type(F.col("t")).alias("action_type"), policy.action_stage(F.col("t")).alias("stage"), _after(F.col("t"), "(?:file|case|docket) (?:no\\.?|number)").alias("case_number"), F.replace(F.regexp_extract("t", r"\$\s?([\d,]+(?:\.\d{2})?)", 1), F.lit(",")).try_cast("double").alias("penalty")
    )
    return rows.withColumn("headline", policy.action_headline(F.col("action_type"), F.col("stage")))
