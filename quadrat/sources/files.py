"""Other file sources: archives, word-processor documents, inspection logs and water stations; and file sinks."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.sources.tabular import DELIMITERS, SNIFFED_LINES, parse_bool, parse_date
from quadrat.sources.workbooks import sheets

#: Limits of archives and of kept text, and the box of the state.
ARCHIVE_BYTES, ARCHIVE_DEPTH, TEXT_BYTES = 500 << 20, 2, 2_000_000
WEST, SOUTH, EAST, NORTH = -124.6, 32.4, -114.0, 42.1


#: What a file that is no good raises.
BAD = (KeyError, ValueError, IndexError, struct.error, RuntimeError, NotImplementedError, EOFError, zlib.error, zipfile.BadZipFile, ElementTree.ParseError)
#: Suffixes without a reader.
UNREAD = (".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff")


def _members(name: str, raw: bytes, depth: int) -> Iterator[tuple[str, bytes, str | None]]:
    """(name, content, problem) of a file, or of an archive's members; of the archive itself if it is too large or too deep to unpack, or broken."""
    if not (name.lower().endswith(".zip") and zipfile.is_zipfile(io.BytesIO(raw))):
        yield name, raw, f"no reader for {name[name.rindex('.'):].lower()}" if name.lower().endswith(UNREAD) else None
        return
    if depth >= ARCHIVE_DEPTH:
        yield name, raw, f"an archive more than {ARCHIVE_DEPTH} deep; not unpacked"
        return
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        if sum(i.file_size for i in z.infolist()) > ARCHIVE_BYTES:
            yield name, raw, f"expands to more than {ARCHIVE_BYTES} bytes; not unpacked"
            return
        for i in z.infolist():
            if not i.is_dir():
                try:
                    content = z.read(i)
                except BAD as e:
                    yield f"{name}!{i.filename}", b"", f"can't be unpacked: {e}"
                    continue
                yield from _members(f"{name}!{i.filename}", content, depth + 1)


def docx_text(raw: bytes) -> str:
    """Text of a .docx: paragraphs as lines, table cells apart by |."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        xml = z.read("word/document.xml").decode("utf-8", "replace")
    xml = re.sub(r"</w:tc>", "|", xml)
    xml = re.sub(r"</w:p>|<w:br[^>]*/>", "\n", xml)
    text = re.sub(r"<[^>]+>", "", xml)
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = text.replace(entity, sign)
    return text


def html_text(raw: str) -> str:
    return re.sub(r"[ \t]+", " ", re.sub(r"<[^>]+>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", raw))).strip()


def _text(name: str, raw: bytes) -> str | None:
    low = name.lower()
    if low.endswith(".docx"):
        return docx_text(raw)
    if low.endswith((".xlsx", ".xlsm", ".xls", ".ods")):
        return "\n".join("\t".join(row) for _, rows in sheets(raw) for row in rows)
    if low.endswith((".html", ".htm")):
        return html_text(raw.decode("utf-8", "replace"))
    return raw.decode("utf-8", "replace") if low.endswith((".txt", ".csv", ".tsv", ".md")) else None


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for name, raw, problem in _members(path, content, 0):
                text = None
                try:
                    text = _text(name, raw)
                except BAD as e:
                    problem = str(e) or type(e).__name__
                yield pa.record_batch([pa.array([name]), pa.array([raw], pa.binary()), pa.array([text], pa.string()), pa.array([problem], pa.string())], ["path", "content", "text", "problem"])


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes, text, truncated, problem) of files and of members of zip archives up to two deep. One bad file gives a problem, not an end. Kept text is at most two million bytes."""
    files = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_expand, "path string, content binary, text string, problem string")
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("bytes"), F.when(F.octet_length("text") > TEXT_BYTES, F.left("text", F.lit(TEXT_BYTES))).otherwise(F.col("text")).alias("text"), F.coalesce(F.octet_length("text") > TEXT_BYTES, F.lit(False)).alias("truncated"), "problem")


def blob_key(sha256: Column, extension: Column) -> Column:
    """Where a file of a hash is kept."""
    return F.concat(F.lit("sources/"), F.substring(sha256, 1, 2), F.lit("/"), F.substring(sha256, 3, 2), F.lit("/"), sha256, F.lit("."), F.lower(extension))


def inspection_type(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.rlike("use monitor|application"), "use_monitoring").when(t.rlike("record"), "records").when(t.rlike("headquarter|hq"), "headquarters").when(t.rlike("pre-?app"), "pre_application").when(F.coalesce(t, F.lit("")) != "", "other")


def inspections(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an inspection log with a header of known labels; other columns under extra."""
    known = {"insp date": "day", "date": "day", "type": "type", "site no.": "site", "site id": "site", "permit": "permit", "operator": "operator", "inspector": "inspector", "result": "result", "violations": "violations"}
    head = "\n".join(r.value for r in spark.read.text(path).limit(SNIFFED_LINES).collect())
    rows = spark.read.csv(path, header=True, multiLine=True, sep=max((",", *DELIMITERS), key=head.count))
    named = {known[c.strip().lower()]: c for c in reversed(rows.columns) if c.strip().lower() in known}
    col = lambda n: F.col(f"`{named[n]}`") if n in named else F.lit(None).cast("string")
    rest = [c for c in rows.columns if c not in named.values()]
    extra = F.map_filter(F.create_map(*(x for c in rest for x in (F.lit(c), F.col(f"`{c}`").cast("string")))), lambda _, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    filled = F.coalesce(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in rows.columns))
    from quadrat.functions.classify import outcome

    return rows.where(filled.isNotNull()).select(
        parse_date(col("day")).alias("inspected_on"), inspection_type(col("type")).alias("inspection_type"), col("type").alias("inspection_type_raw"), F.regexp_replace(col("site"), r"\s", "").alias("site_id"), col("permit").alias("permit_number"), col("operator").alias("operator_name"),
        col("inspector").alias("inspector_name"), outcome(col("result")).alias("outcome"), F.regexp_extract(col("violations"), r"\d+", 0).try_cast("int").alias("violations_count"), extra.alias("extra"),
    )


def water_stations(spark: SparkSession, path: str) -> DataFrame:
    """Stations inside the state's box, the last row of each name and operator."""
    rows = spark.read.csv(path, header=True).withColumn("_n", F.monotonically_increasing_id())
    rows = rows.withColumns({"latitude": F.col("latitude").try_cast("double"), "longitude": F.col("longitude").try_cast("double"), "herbicides_tested": parse_bool(F.col("herbicides_tested"))})
    rows = rows.where(F.col("latitude").between(SOUTH, NORTH) & F.col("longitude").between(WEST, EAST))
    fields = [c for c in rows.columns if c not in ("name", "operator", "_n")]
    last = rows.groupBy("name", "operator").agg(F.max_by(F.struct(*fields), "_n").alias("x"))
    return last.select("name", "operator", "x.*")


def filled_in(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with nulls and blanks filled from new; new keys added, nothing overwritten."""
    cols = [c for c in old.columns if c != key]
    n = new.select(key, *(F.col(c).alias(f"_{c}") for c in cols))
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    return old.join(n, key, "full").select(key, *(F.when(blank(c), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in cols))


def geojson(points: DataFrame, *properties: str) -> DataFrame:
    """One GeoJSON feature a row."""
    shape = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))
