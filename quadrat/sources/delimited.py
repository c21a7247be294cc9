"""Quoted delimited files of any size, read by splits.

Lines come from Spark's text scan, whose splits begin at line breaks that may
lie inside a quoted cell. A task doesn't know whether its split begins inside
one, nor the file's delimiter, so it follows its lines under both states for
each delimiter, and notes for every line whether it begins and ends a record
there, and its record's number so far. What a split does to the state is one of
four functions of two states; their composition over a file's splits needs the
last split that sets the state and the parity of those that turn it since, so
windows over splits, not lines, settle every split's state and first number.
Only lines of records that go over several lines are brought together.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrat.operators.storage import kept

#: Lines that a record may take. If a quote isn't closed by then, quotes are dropped and each of the lines is a record, of one number.
MOST_LINES = 1000
#: Lines of one batch.
PART = 10_000


def ends_quoted(line: str, delimiter: str, quoted: bool) -> bool:
    """Is a cell's quote open after the line, if it was before? Quotes count at a cell's beginning only; within quotes two of them are one."""
    at = 0
    if not quoted and '"' not in line:
        return False
    while True:
        if not quoted:
            # the next cell that begins with a quote
            while not line.startswith('"', at):
                at = line.find(delimiter, at) + 1
                if not at:
                    return False
            at += 1
        while True:
            close = line.find('"', at)
            if close < 0:
                return True
            at = close + 1
            if not line.startswith('"', at):
                break
            at += 1
        quoted = False
        at = line.find(delimiter, at) + 1
        if not at:
            return False


def _followed(delimiters: tuple[str, ...]):
    """(file, start, i, line, begins, ends, n): bits and numbers of each delimiter's two states, not quoted and quoted."""

    def batch(file: str, start: int, i: int, lines: list[str], begins: list[int], ends: list[int], n: list[list[int]]) -> pa.RecordBatch:
        k = len(lines)
        counts = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * 2 * len(delimiters), pa.int32()), pa.array(np.array(n, np.int64).reshape(-1), pa.int64()))
        return pa.record_batch([pa.array([file] * k), pa.array([start] * k, pa.int64()), pa.array(range(i, i + k), pa.int64()), pa.array(lines), pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), counts], ["file", "start", "i", "line", "begins", "ends", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, i = None, 0
        states = [s == 1 for _ in delimiters for s in (0, 1)]
        n = [0] * len(states)
        for b in batches:
            part: tuple[list, list, list, list] = ([], [], [], [])
            for file, start, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if (file, start) != at or len(part[0]) == PART:
                    if part[0]:
                        yield batch(*at, i - len(part[0]), *part)
                        part = ([], [], [], [])
                    if (file, start) != at:
                        at, i = (file, start), 0
                        states, n = [s == 1 for _ in delimiters for s in (0, 1)], [0] * len(states)
                if i == 0 and start == 0:
                    line = line.removeprefix("﻿")
                begins = sum(1 << k for k, q in enumerate(states) if not q)
                n = [v + (not q) for v, q in zip(n, states, strict=True)]
                if '"' in line:
                    states = [ends_quoted(line, delimiters[k // 2], q) for k, q in enumerate(states)]
                for column, v in zip(part, (line, begins, sum(1 << k for k, q in enumerate(states) if not q), n), strict=True):
                    column.append(v)
                i += 1
            if part[0]:
                yield batch(*at, i - len(part[0]), *part)

    return run


def _bit(mask: str, k: str) -> Column:
    return F.expr(f"shiftright({mask}, {k}) & 1") == 1


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(1 << 30)
    for b in batches:
        cells = []
        for text, delimiter in zip(b.column("text").to_pylist(), b.column("delimiter").to_pylist(), strict=True):
            rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)) if '"' in text else [text.split(delimiter)]
            cells.append([c.strip() for c in rows[0]] if rows and text else [])
        yield pa.record_batch([b.column("file"), b.column("number").cast(pa.int32()), pa.array(cells, pa.list_(pa.string()))], ["file", "line", "cells"])


def split_rows(spark: SparkSession, path: str, delimiters: tuple[str, ...], sniffed: int, where: Column | None = None) -> DataFrame:
    """(file, line, cells) of the delimited files below a path: ``line`` is the record's number in its file, from 1.

    A file's delimiter is the one that its first ``sniffed`` lines have most of,
    ties to the first. Cells are stripped; line breaks within them are \\n. An
    empty line is a record without cells. ``where``: which files, by their
    ``_metadata``.
    """
    scan = spark.read.text(path)
    scan = scan if where is None else scan.where(where)
    scan = scan.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    lines = kept(scan.mapInArrow(_followed(delimiters), "file string, start long, i long, line string, begins int, ends int, n array<long>"), "lines")
    count = lambda c: F.sum(F.length("line") - F.length(F.replace("line", F.lit(c))))
    most = F.array(*(F.struct(count(c).alias("n"), F.lit(-k).alias("k")) for k, c in enumerate(delimiters)))
    heads = lines.where((F.col("start") == 0) & (F.col("i") < sniffed)).groupBy("file").agg((-F.array_max(most)["k"]).alias("d"))

    # a split ends unquoted from either state, quoted from either, as it began, or the other way
    last = lines.groupBy("file", "start").agg(F.max_by(F.struct("ends", "n"), "i").alias("z")).join(heads, "file").select("file", "start", "d", F.col("z.ends").alias("ends"), F.col("z.n").alias("n"))
    ends = last.withColumns({"from0": (~_bit("ends", "2 * d")).cast("int"), "from1": (~_bit("ends", "2 * d + 1")).cast("int")})
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    turned = ends.withColumn("turns", F.sum(((F.col("from0") == 1) & (F.col("from1") == 0)).cast("int")).over(upto))
    turned = turned.withColumn("set", F.when(F.col("from0") == F.col("from1"), (F.col("from0") + F.col("turns")) % 2))
    state = (F.coalesce(F.last("set", ignorenulls=True).over(before), F.lit(0)) + F.coalesce(F.lag("turns").over(Window.partitionBy("file").orderBy("start")), F.lit(0))) % 2
    splits = turned.withColumn("k", (2 * F.col("d") + state).cast("int"))
    splits = kept(splits.withColumn("first", F.coalesce(F.sum(F.expr("n[k]")).over(before), F.lit(0))).select("file", "start", "d", "k", "first"), "splits")

    at = lines.join(splits, ["file", "start"])
    signs = F.array(*map(F.lit, delimiters))
    at = at.select("file", "start", "i", "line", F.get(signs, F.col("d")).alias("delimiter"), _bit("begins", "k").alias("begins"), _bit("ends", "k").alias("ends"), (F.col("first") + F.get("n", F.col("k"))).alias("number"))
    whole = at.where("begins and ends").select("file", "number", "delimiter", F.col("line").alias("text"))
    parts = at.where("not (begins and ends)")
    sizes = parts.groupBy("file", "number").agg(F.count("*").alias("lines"))
    joined = parts.join(sizes.where(F.col("lines") <= MOST_LINES), ["file", "number"]).groupBy("file", "number").agg(F.first("delimiter").alias("delimiter"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "i", "line"))), lambda p: p["line"]), "\n").alias("text"))
    out = whole.unionByName(joined.select("file", "number", "delimiter", "text"))
    loose = parts.join(sizes.where(F.col("lines") > MOST_LINES), ["file", "number"]).select("file", "number", "delimiter", F.replace("line", F.lit('"'), F.lit("")).alias("text"))
    return out.unionByName(loose).select("file", "number", "delimiter", "text").mapInArrow(_parsed, "file string, line int, cells array<string>")
