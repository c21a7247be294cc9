"""Inspection coverage per county and year, grades and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.classify import grade
from quadrat.plans.domain import exact_sum


def inspected(apps: DataFrame, inspections: DataFrame) -> DataFrame:
    """Ids of apps with an inspection of their county and category from a day before they start to a day after they end. (apps: id, county, category, start, ended; inspections: county, category, day.)"""
    week = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01")) / 7)
    first, last = F.date_sub("start", 1), F.date_add(F.coalesce("ended", "start"), 1)
    # each side is dealt by county, category and week, so that a county's years don't meet in one task
    a = apps.select("id", "county", "category", first.alias("first"), last.alias("last")).where("first <= last")
    a = a.select("*", F.explode(F.sequence(week(F.col("first")), week(F.col("last")))).alias("week"))
    i = inspections.select("county", "category", "day", week(F.col("day")).alias("week")).distinct()
    met = a.join(i, ["county", "category", "week"]).where("day between first and last")
    return met.select("id").distinct()


def year_metrics(apps: DataFrame, inspections: DataFrame) -> DataFrame:
    """Per county and year of applications or inspections: counts of both, priority ones and those inspected, violations at least one for an inspection with any."""
    seen = inspected(apps, inspections).withColumn("seen", F.lit(True))
    a = apps.join(seen, "id", "left").groupBy("county", "year").agg(
        F.count("*").alias("applications"), F.count_if("priority").alias("priority"), F.count_if(F.col("priority") & F.col("seen")).alias("priority_inspected"), exact_sum(F.col("acres")).alias("acres")
    )
    i = inspections.groupBy("county", F.year("day").alias("year")).agg(F.count("*").alias("inspections"), F.sum(F.when(F.col("violations") > 0, F.greatest("violations", F.lit(1))).otherwise(0)).alias("violations"))
    both = a.join(i, ["county", "year"], "full")
    return both.select("county", "year", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("applications", "priority", "priority_inspected")), F.coalesce("acres", F.lit(0.0)).alias("acres"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("inspections", "violations")))


def graded(metrics: DataFrame) -> DataFrame:
    """metrics (and records, the status of the county's records) with coverage and letter."""
    coverage = F.when(F.col("priority") > 0, F.col("priority_inspected") / F.col("priority"))
    return metrics.withColumn("coverage", F.round(coverage, 6)).withColumn("letter", grade(F.col("priority"), F.col("priority_inspected"), F.col("records")))


def ranking(grades: DataFrame) -> DataFrame:
    """Each county's latest letter, worst first, counties without one last."""
    last = grades.groupBy("county").agg(F.max_by("letter", F.when(F.col("letter").isNotNull(), F.col("year"))).alias("letter"), F.max(F.when(F.col("letter").isNotNull(), F.col("year"))).alias("year"))
    return last.withColumn("place", F.coalesce(F.array_position(F.array(*map(F.lit, "FDCBA")), F.col("letter")), F.lit(6)).cast("int"))
