"""Damaged and cut archives, and clashing columns."""

import io

import pytest
from pyspark.sql import functions as F

from quadrat.llm import warc

RECORDS = [warc.record(i, f"http://x/{i}", (f"<p>page {i}</p>" * (1 + 40 * i)).encode()) for i in range(5)]
WHOLE = b"".join(RECORDS)


def read(raw, split=1 << 20):
    return [r for a in range(0, len(raw), split) for r in warc.RecordReader(io.BytesIO(raw), a, min(len(raw), a + split), len(raw))]


@pytest.mark.parametrize("split", [7, 50, 101, 333, 1 << 20])
def test_ranges(split):
    assert [int(warc.parse(r)[0]["WARC-Record-ID"][len("<urn:page:") : -1]) for r in read(WHOLE, split)] == list(range(5))


@pytest.mark.parametrize("split", [101, 1 << 20])
def test_damage_is_an_error(split):
    starts = [sum(map(len, RECORDS[:i])) for i in range(5)]
    for where in (starts[2] + len(RECORDS[2]) - 6, starts[2] + len(RECORDS[2]) // 2 + 10, starts[2] + len(RECORDS[2]) - 12):
        bad = bytearray(WHOLE)
        bad[where] ^= 0x55
        with pytest.raises(ValueError):
            read(bytes(bad), split)
    for cut in (1, 10, 25):
        with pytest.raises(ValueError):
            read(WHOLE[:-cut], split)


def test_lost_records_are_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>") for i in range(9)], "page_id long, url string, html string")
    files = warc.write_archives(pages, f"file://{tmp_path}/w")
    assert warc.checked(warc.read_archives(files), files).count() == 9
    with pytest.raises(ValueError, match="9 records were read and 10 written"):
        warc.checked(warc.read_archives(files), files.unionByName(files.limit(1).select("path", F.lit(0).cast("long").alias("size"), F.lit(1).cast("long").alias("records"))))


def test_clashing_columns_and_nulls(spark):
    rows = [(1, "a", "<p>", 1), (1, "a", "<p>", 2), (2, "b", "<p>", 3), (None, "c", "<p>", 4), (3, None, None, 5), (4, None, "", 6), (5, "x", "long " * 300_000, 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, d long")
    for c in ("largest", "refers_to", "revisit", "_id", "_d", "path", "bytes"):
        pages = pages.withColumn(c, F.lit(1))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    assert got == sorted([(1, 3, "revisit", 2)] * 2 + [(2, 3, "response", None), (None, 3, "revisit", 2), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 1_500_000, "response", None)], key=str)
