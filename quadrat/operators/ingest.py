"""Intake of records: sinks with provenance, what of a batch may be published, its summary, derived figures, and snapshots kept by fingerprint."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions.policy import in_coverage
from quadrat.plans.domain import exact_sum

#: File types that can hold use records.
USE_FILE_TYPES = ("pdf", "csv", "tsv", "txt", "xlsx", "xls", "xlsm", "docx")


def importable(file_type: Column, name: Column) -> Column:
    """By the declared type, or by the name's end."""
    declared = F.regexp_replace(F.lower(F.coalesce(file_type, F.lit(""))), r"^\.+", "")
    return declared.isin(*USE_FILE_TYPES) | F.lower(name).rlike(r"\.(" + "|".join(USE_FILE_TYPES) + ")$")


def publishable(records: DataFrame) -> DataFrame:
    """records (start, site_published) with ``outcome``: published, out_of_coverage, or not_forestry. Only the first are clustered."""
    covered = in_coverage(F.col("start"))
    return records.withColumn("outcome", F.when(~covered, "out_of_coverage").when(F.coalesce("site_published", F.lit(False)), "published").otherwise("not_forestry"))


def provenance(records: DataFrame, key: str, source: str, *fields: str) -> DataFrame:
    """(key, field, value, source): a row for each field of a record that has a value, and where it came from."""
    values = F.filter(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields)), lambda x: x["value"].isNotNull())
    return records.select(key, F.explode(values).alias("x"), F.col(source).alias("source")).select(key, "x.field", "x.value", "source")


def write_records(records: DataFrame, lines: DataFrame, folder: str, key: str, source: str, *fields: str) -> None:
    """Append records, their product lines and their provenance as three tables below ``folder``; records by year, so that later scans read the years they ask for."""
    records.write.mode("append").partitionBy("year").parquet(f"{folder}/records")
    lines.write.mode("append").parquet(f"{folder}/lines")
    provenance(records, key, source, *fields).write.mode("append").parquet(f"{folder}/provenance")


def updated_from(rows: DataFrame, other: DataFrame, key: str, *fields: str) -> DataFrame:
    """rows with null fields taken from ``other`` (one row a key); rows without a partner stay."""
    o = other.select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    return rows.join(o, key, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in fields}).drop(*(f"_{c}" for c in fields))


def batch_summary(files: DataFrame, records: DataFrame, reasons: DataFrame) -> DataFrame:
    """A row a batch: files by status, records by outcome, and a map of review reasons to counts. files: batch, status; records: batch, outcome, duplicate; reasons: batch, reason."""
    f = files.groupBy("batch").agg(F.count("*").alias("files_processed"), F.count_if(F.col("status") == "duplicate").alias("files_duplicate"), F.count_if(F.col("status") == "failed").alias("files_failed"))
    r = records.groupBy("batch").agg(F.count("*").alias("records_extracted"), F.count_if("duplicate").alias("records_duplicate"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("published", "out_of_coverage", "not_forestry")))
    q = reasons.groupBy("batch", "reason").agg(F.count("*").alias("n")).groupBy("batch").agg(F.sum("n").alias("needs_review"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("review_reasons"))
    both = f.join(r, "batch", "full").join(q, "batch", "full")
    return both.select("batch", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*f.columns[1:], *r.columns[1:], "needs_review")), "review_reasons")


def recomputed(members: DataFrame) -> DataFrame:
    """Derived figures of clusters (cluster, start, ended, acres, method) after records moved: no acreage of product lines is used, and a method other than aerial is the least of the members'."""
    acres = F.when(F.count("acres") > 0, F.round(exact_sum(F.col("acres")), 2))
    return members.groupBy("cluster").agg(
        F.min("start").alias("first"), F.max(F.coalesce("ended", "start")).alias("last"), acres.alias("acres"), (F.count("acres") != F.count("*")).alias("partial"),
        (F.count_distinct(F.when(F.col("method") != "unknown", F.col("method"))) > 1).alias("mixed"), F.when(F.bool_or(F.col("method") == "aerial"), "aerial").otherwise(F.min("method")).alias("method"),
    )


def fingerprint(rows: DataFrame, changed: str) -> DataFrame:
    """(n, last): how many rows there are and when the last of them changed; equal as long as nothing did."""
    return rows.agg(F.count("*").alias("n"), F.max(changed).cast("string").alias("last"))


def snapshot(spark: SparkSession, folder: str, mark: DataFrame, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` makes, as a table below ``folder`` named after the fingerprint; made once and read until the data change."""
    n, last = mark.first()
    at = f"{folder.rstrip('/')}/{hashlib.sha256(f'{n}|{last}'.encode()).hexdigest()[:32]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        build().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def title(override: Column, project: Column, landowner: Column, owner: Column, place: Column) -> Column:
    """struct(title, basis): a person's title, else the project's, else the owner's, else the place."""
    blank = lambda c: F.nullif(c, F.lit(""))
    named = F.coalesce(blank(landowner), blank(owner))
    text = F.coalesce(blank(override), blank(project), named, F.concat(F.lit("Application at "), place), F.lit("Unidentified application"))
    basis = F.when(blank(override).isNotNull(), "override").when(blank(project).isNotNull(), "project").when(named.isNotNull(), "owner").otherwise("location")
    return F.struct(text.alias("title"), basis.alias("basis"))
