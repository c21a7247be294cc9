"""Delimited exports read by the meaning of their headers, and the values in them."""

from __future__ import annotations

import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import sites
from quadrat.sources.delimited import split_rows

#: Delimiters in the order in which ties are broken, and the lines looked at.
DELIMITERS = ("\t", ",", ";", "|")
SNIFFED_LINES, HEADER_LINES, LEAST_LABELS = 40, 15, 4
#: Spellings of each field's label; a field's own name is one too.
SYNONYMS = {
    "document_number": ("document number", "document #", "document no", "doc #", "doc number", "use report number", "record id"),
    "permit_number": ("permit #", "permit number", "permit no", "operator id/permit number", "operator id permit number", "permit", "operator id"),
    "operator_id": ("operator id", "operator #", "grower id"),
    "county_code": ("county no", "county number", "county code", "county cd"),
    "county_name": ("county", "county name"),
    "site_district": ("site district", "district", "county district #", "county district"),
    "operator_name": ("permitee", "permittee", "permittee/permit operator", "permit operator", "operator", "grower", "grower name", "operator name", "property operator"),
    "applicator_name": ("applicator name", "applicator", "commercial applicator (if any)", "commercial applicator", "applicator business", "pest control business"),
    "applicator_license": ("applicator license #", "applicator license", "applicator license no", "license #", "license number", "pcb license", "operator license"),
    "applicator_license_type": ("applicator license type", "license type", "contact type"),
    "applicator_address": ("applicator address", "applicator business address"),
    "pca_name": ("pca", "pca name", "pest control adviser", "pest control advisor", "recommendation by", "written recommendation by"),
    "location_text": ("location", "site name", "location | site name", "location/site name", "property", "property name", "ranch name", "field name"),
    "site_id": ("site id", "site identification number", "site identification no", "site_id", "site id number", "site no", "site number", "site"),
    "mtrs_text": ("mtrs", "section (mtrs)", "section mtrs", "legal description", "plss"),
    "township": ("township", "twp", "tship"),
    "township_dir": ("township direction", "tship dir", "twp dir"),
    "range": ("range", "rge", "rng"),
    "range_dir": ("range direction", "range dir", "rge dir"),
    "section": ("section", "sec"),
    "meridian": ("meridian", "base ln mer", "base line meridian", "bl mer", "mer"),
    "application_date": ("application date", "date applied", "appl date", "date of application", "app date", "use date"),
    "application_time": ("application time", "time applied", "appl time", "app time"),
    "start_datetime": ("start date/time applied", "start date time applied", "start date applied", "begin date/time applied", "start date", "date/time started"),
    "end_datetime": ("end date/time applied", "end date time applied", "end date applied", "finish date/time applied", "end date", "date/time ended"),
    "method": ("appl. method", "appl method", "application method", "app method", "app method/fume code", "app method fume code", "method", "method of application"),
    "fume_code": ("fume code",),
    "commodity": ("commodity", "commodity treated", "crop", "site treated", "crop/site", "commodity name", "commodity name/code"),
    "commodity_code": ("commodity code", "crop code", "site code"),
    "planted_amount": ("planted amount", "planted area", "planted area - units", "area planted"),
    "planted_units": ("planted units", "planted amount units"),
    "treated_amount": ("treated amount", "treated area", "treated area - units", "area treated", "acres treated", "amount treated"),
    "treated_units": ("treated units", "treated amount units"),
    "block_id": ("block id", "block"),
    "product_name": ("product name", "product", "pesticide name", "pesticide", "trade name", "material", "material name"),
    "epa_reg_no": ("epa reg no", "epa reg #", "epa registration number", "epa registration no", "reg no", "registration number", "epa/dpr reg no", "product reg no", "dpr reg no"),
    "quantity": ("quantity used", "quantity", "amount used", "total used", "qty"),
    "quantity_units": ("quantity units", "unit", "units", "quantity uom", "amount units"),
    "registration_expired": ("registration expired", "reg expired"),
    "submittal_status": ("submittal status", "sub status", "status"),
    "report_status": ("report status",),
    "school_notification": ("school notify", "schoolsite notification", "school notification"),
    "entered_by": ("entered by", "data entry by"),
    "pre_plant": ("pre-plant application", "pre plant application", "preplant"),
    "source_system": ("source", "source system"),
}
#: Date shapes in the order in which they are tried.
DATES = ("MM/dd/yyyy", "M/d/yyyy", "yyyy-MM-dd", "MM-dd-yyyy", "M/d/yy", "MMM d, yyyy", "MMMM d, yyyy", "d-MMM-yyyy", "yyyy/MM/dd", "yyyyMMdd")


def label_key(label: str | None) -> str:
    return re.sub(r"[^a-z0-9]+", " ", (label or "").lower().replace("&", " and ")).strip()


#: A field's own name first, then the first field that has a spelling.
_FIELD: dict[str, str] = {label_key(field): field for field in SYNONYMS}
for _name, _spelled in SYNONYMS.items():
    for _label in _spelled:
        _FIELD.setdefault(label_key(_label), _name)


def match_label(label: str | None) -> str | None:
    return _FIELD.get(label_key(label))


def parse_date(text: Column) -> Column:
    """The first shape that fits the whole text, or its first word."""
    t = F.trim(text)
    head = F.substring_index(t, " ", 1)
    return F.coalesce(*(F.try_to_date(t, f) for f in DATES), *(F.try_to_date(head, f) for f in DATES if " " not in f))


def parse_minutes(text: Column) -> Column:
    """Minutes since midnight of a time such as '6:00 AM', '0600', '18:30:00' or '6 p.m.'."""
    t = F.regexp_replace(F.upper(F.trim(text)), "[. ]", "")
    shape = r"^(\d{1,2}):?(\d{2})?(?::\d{2})?([AP]M)?$"
    hour, minute, half = F.regexp_extract(t, shape, 1).try_cast("int"), F.coalesce(F.regexp_extract(t, shape, 2).try_cast("int"), F.lit(0)), F.regexp_extract(t, shape, 3)
    told = t.rlike(r"^\d{1,2}:?\d{2}|[AP]M$")  # a bare number of one or two digits is no time
    ok = told & (minute < 60) & F.when(half == "", hour < 24).otherwise(hour.between(1, 12))
    return F.when(ok, F.when(half == "", hour).otherwise(hour % 12 + F.when(half == "PM", 12).otherwise(0)) * 60 + minute)


def parse_datetime(text: Column, time: Column | None = None) -> Column:
    """Date and time of one cell, or of a date's cell and a time's; midnight where no time is told; null without a date."""
    inside = parse_minutes(F.regexp_extract(text, r"(?i)(\d{1,2}:\d{2}\s*(?:[AP]M)?)", 1))
    minutes = F.coalesce(*([parse_minutes(time)] if time is not None else []), inside, F.lit(0))
    return F.timestamp_seconds(F.unix_timestamp(parse_date(text).cast("timestamp")) + minutes * 60)


def parse_float(text: Column) -> Column:
    """The first number of a text; thousands may be set off by commas."""
    return F.replace(F.regexp_extract(text, r"-?\d[\d,]*\.?\d*|-?\.\d+", 0), F.lit(",")).try_cast("double")


def split_amount_units(text: Column) -> Column:
    """struct(amount, units) of texts such as '63 ACRES'."""
    units = F.trim(F.regexp_replace(text, r"^\s*-?[\d,]*\.?\d*", ""))
    return F.struct(parse_float(text).alias("amount"), F.when(units != "", units).alias("units"))


def parse_bool(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("y", "yes", "true", "1", "x"), True).when(t.isin("n", "no", "false", "0"), False)


def base_registration(number: Column) -> Column:
    """A registration number without the distributor's suffix; null if nothing numeric is left."""
    n = F.regexp_replace(F.upper(F.trim(number)), "(-[^-]*[^0-9-][^-]*|-)+$", "")
    return F.nullif(F.regexp_replace(n, "^[^-]*[^0-9-][^-]*$", ""), F.lit(""))


def _sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, line, cells) of the best sheet of workbooks. A line's number is that of its row."""
    from quadrat.sources.workbooks import best_sheet

    for b in batches:
        for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            try:
                best = best_sheet(raw, lambda row: len({f for c in row if (f := match_label(c))}), HEADER_LINES)
            except (KeyError, ValueError, IndexError, struct.error, zipfile.BadZipFile, ElementTree.ParseError):
                continue
            rows = [[c.strip() for c in row] for row in best]
            for i in range(0, len(rows), 5000):
                part = rows[i : i + 5000]
                yield pa.record_batch([pa.array([path] * len(part)), pa.array(range(i + 1, i + len(part) + 1), pa.int32()), pa.array(part, pa.list_(pa.string()))], ["file", "line", "cells"])


def grid(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, cells) of delimited files, which are read by splits, and of the best sheet of .xlsx, .xls and .ods workbooks, which a task reads whole; one that can't be read gives nothing, and ``files.source_files`` says why."""
    book = F.lower("_metadata.file_name").rlike(r"\.(xls[xm]?|ods)$")
    books = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(xls[xm]?|ods)$")).select("path", "content").mapInArrow(_sheets, "file string, line int, cells array<string>")
    return split_rows(spark, path, DELIMITERS, SNIFFED_LINES, ~book).unionByName(books)


def field_of(label: Column) -> Column:
    """The field that a label stands for, as ``match_label`` has it; null for other labels."""
    labels = F.create_map(*(F.lit(x) for kv in _FIELD.items() for x in kv))
    return F.try_element_at(labels, F.trim(F.regexp_replace(F.replace(F.lower(label), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " ")))


def _headers(rows: DataFrame) -> DataFrame:
    """(file, line, cells) of each file's header, for files that have one."""
    known = F.size(F.array_distinct(F.array_compact(F.transform("cells", field_of))))
    heads = rows.where(F.col("line") <= HEADER_LINES).withColumn("known", known).where(F.col("known") >= LEAST_LABELS)
    return heads.groupBy("file").agg(F.min_by(F.struct("line", "cells"), F.struct(-F.col("known"), "line")).alias("h")).select("file", "h.*")


def problems(spark: SparkSession, path: str) -> DataFrame:
    """(file, problem) of delimited files and workbooks with rows, but without a header that ``records`` knows."""
    rows = grid(spark, path).where(F.col("line") <= HEADER_LINES)
    none = rows.select("file").distinct().join(_headers(rows), "file", "left_anti")
    return none.select("file", F.lit(f"no line with {LEAST_LABELS} known labels among the first {HEADER_LINES}").alias("problem"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, fields map): rows below each file's header, cells under their field's name, others under their label.

    The header is the line among the first fifteen with the most known labels,
    four at least; a field's first column counts. Blank rows give nothing, nor
    does a file without a header, which ``problems`` lists.
    """
    rows = grid(spark, path)
    heads = _headers(rows).select("file", F.col("line").alias("head"), F.transform("cells", lambda c: F.coalesce(field_of(c), c)).alias("names"))
    body = rows.join(heads, "file").where("line > head").where(F.exists("cells", lambda c: c != ""))
    pairs = F.filter(F.arrays_zip(F.col("names").alias("k"), F.col("cells").alias("v")), lambda p: p["k"].isNotNull() & (p["k"] != "") & p["v"].isNotNull())
    once = F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), lambda a, p: F.when(F.exists(a, lambda q: q["k"] == p["k"]), a).otherwise(F.concat(a, F.array(F.struct(p["k"].alias("k"), p["v"].alias("v"))))))
    return body.select("file", "line", F.map_from_entries(once).alias("fields"))


def use_records(spark: SparkSession, path: str) -> DataFrame:
    """Product lines of use-record exports, typed: one row a line of the file. The place comes from the MTRS column, or from separate ones with the county's usual values."""
    f = lambda name: F.nullif(F.trim(F.try_element_at("fields", F.lit(name))), F.lit(""))
    plain = tuple(c for c in SYNONYMS if c not in ("application_date", "application_time", "start_datetime", "end_datetime", "quantity", "treated_amount", "planted_amount", "epa_reg_no", "method", "mtrs_text", "township", "township_dir", "range", "range_dir", "section", "meridian"))
    letter = lambda c, of: F.nullif(F.regexp_extract(F.upper(c), f"[{of}]", 0), F.lit(""))
    number = lambda c: F.nullif(F.regexp_extract(c, r"\d+", 0), F.lit(""))
    apart = sites.decode_structured(number(f("township")), number(f("range")), number(f("section")), F.coalesce(f("township_dir"), letter(f("township"), "NS")), F.coalesce(f("range_dir"), letter(f("range"), "EW")), f("meridian"), f("county_name"))
    place = F.coalesce(sites.parse_mtrs(f("mtrs_text")), apart)
    start = F.coalesce(parse_datetime(f("start_datetime")), parse_datetime(f("application_date"), f("application_time")))
    return records(spark, path).select(
        "file", "line", *(f(c).alias(c) for c in plain), F.to_date(start).alias("application_date"), start.alias("started"), parse_datetime(f("end_datetime")).alias("ended"), parse_float(f("quantity")).alias("quantity"),
        parse_float(f("treated_amount")).alias("treated_amount"), parse_float(f("planted_amount")).alias("planted_amount"), f("epa_reg_no").alias("epa_reg_no"), base_registration(f("epa_reg_no")).alias("base_reg_no"), f("method").alias("method_text"), sites.mtrs(place).alias("mtrs"),
    )
