"""Headline figures, break-downs, county lists, and the filtered grid with its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.plans.domain import exact_sum

PAGE_CAPS = {"public": 50, "subscriber": 500}
PAGE_SIZE = 25


def headline(apps: DataFrame) -> DataFrame:
    aerial, ground = F.count_if(F.col("method") == "aerial"), F.count_if(F.col("method") == "ground")
    return apps.agg(
        F.count("*").alias("applications"), F.coalesce(exact_sum(F.col("acres")), F.lit(0.0)).alias("acres"), aerial.alias("aerial"), ground.alias("ground"), F.min("start").alias("first"), F.max("start").alias("last"), F.round(F.try_divide(aerial, aerial + ground), 4).alias("aerial_share")
    )


def chemicals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("product").agg(exact_sum(F.col("gallons")).alias("gallons"), exact_sum(F.col("pounds")).alias("pounds"), F.count("*").alias("lines"), F.count_if(F.col("gallons").isNull() & F.col("pounds").isNull()).alias("unresolved_lines"))


def breakdown(apps: DataFrame, by: str, lines: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Applications and acres per key. A key of lines is brought down to one row for each key and application first, so acres aren't added twice; ``compat`` adds distinct acreages instead, as older figures did."""
    rows = apps if lines is None else apps.join(lines.select("id", by).distinct(), "id")
    acres = F.sum_distinct(F.col("acres").cast("decimal(28,6)")).cast("double") if compat else exact_sum(F.col("acres"))
    return rows.groupBy(by).agg(F.count_distinct("id").alias("applications"), acres.alias("acres"))


def counties(apps: DataFrame) -> DataFrame:
    return apps.groupBy("county", "district").agg(F.count("*").alias("applications"), F.min("start").alias("first"), F.max("start").alias("last"), exact_sum(F.col("acres")).alias("acres"))


def grid(apps: DataFrame, lines: DataFrame | None = None, *, county=None, year=None, method=None, owner=None, flagged=None, chemical=None, text=None, since=None, until=None) -> DataFrame:
    """apps that meet every filter given. Dates ask for overlap of [start, ended], each for its own side; an application without lines ends when it starts. ``since`` adds the column ended. ``chemical`` and ``text`` look into lines by semi-joins."""
    for column, value in (("county", county), ("year", year), ("method", method), ("flagged", flagged)):
        if value is not None:
            apps = apps.where(F.col(column) == value)
    if owner:
        apps = apps.where(F.col("operator").ilike(f"%{owner}%"))
    if since:
        ended = lines.groupBy("id").agg(F.max("ended").alias("ended"))
        apps = apps.join(ended, "id", "left").withColumn("ended", F.coalesce("ended", "start")).where(F.col("ended") >= F.lit(since).cast("date"))
    if until:
        apps = apps.where(F.col("start") <= F.lit(until).cast("date"))
    if chemical:
        apps = apps.join(lines.where(F.col("ingredient").ilike(f"%{chemical}%")), "id", "left_semi")
    if text:
        named = lines.where(F.col("product").ilike(f"%{text}%")).select("id").distinct().withColumn("named", F.lit(True))
        like = [F.col(c).ilike(f"%{text}%") for c in ("operator", "county", "category")]
        apps = apps.join(named, "id", "left").where(like[0] | like[1] | like[2] | F.coalesce("named", F.lit(False))).drop("named")
    return apps


def page_size(asked: Column, tier: Column) -> Column:
    """The asked size within 1 and the tier's cap; the default if none was asked."""
    cap = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in PAGE_CAPS.items() for x in kv)), tier), F.lit(PAGE_CAPS["public"]))
    return F.least(F.greatest(F.coalesce(asked, F.lit(PAGE_SIZE)), F.lit(1)), cap)


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """Newest first, undated last, by id where dates are equal."""
    return rows.orderBy(F.desc_nulls_last("start"), "id").offset((number - 1) * size).limit(size)


def detail(lines: DataFrame) -> DataFrame:
    """Per application its distinct products and ingredients, as sorted lists in text."""
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "; ")
    return lines.groupBy("id").agg(join("product").alias("products"), join("ingredient").alias("ingredients"), F.count("*").alias("lines"))
