"""First-party traffic: views and distinct visitors by window, day, path, referrer and country."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(views: DataFrame, *by) -> DataFrame:
    """Views and distinct visitors; a visitor of several days counts once a day, as the pseudonym changes."""
    return views.groupBy(*by).agg(F.count("*").alias("views"), F.count_distinct("visitor", "day").alias("visitors"))


def windows(views: DataFrame, last: str, days: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Views and visitors of the last n days up to a day."""
    d = F.array(*(F.lit(n) for n in days))
    rows = views.select("*", F.explode(d).alias("days")).where((F.col("day") > F.date_sub(F.lit(last).cast("date"), F.col("days"))) & (F.col("day") <= F.lit(last).cast("date")))
    return counted(rows, "days")


def per_day(views: DataFrame, first: str, last: str) -> DataFrame:
    """Every day of the range, those without views with zeros."""
    spark = views.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return spine.join(counted(views, "day"), "day", "left").select("day", F.coalesce("views", F.lit(0)).alias("views"), F.coalesce("visitors", F.lit(0)).alias("visitors"))


def top(views: DataFrame, by: str, n: int) -> DataFrame:
    return counted(views.where(F.col(by).isNotNull()), by).orderBy(F.desc("views"), by).limit(n)


def within_limit(hits: DataFrame, key: str, seconds: int, limit: int) -> DataFrame:
    """hits with allowed: no more than ``limit`` hits of the key in the ``seconds`` up to and with it, refused ones counted."""
    w = Window.partitionBy(key).orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-seconds, 0)
    return hits.withColumn("recent", F.count("*").over(w)).withColumn("allowed", F.col("recent") <= limit)


def within_budget(calls: DataFrame, limit: int, *order: str) -> DataFrame:
    """calls (ts, ...) with used (how many of the month so far) and granted (not beyond the limit). The order begins with ts. Hours are numbered apart, after what the month's earlier hours hold, so that a month isn't one task's."""
    rows = calls.withColumns({"_month": F.date_format("ts", "yyyy-MM"), "_hour": F.date_trunc("hour", "ts")})
    earlier = Window.partitionBy("_month").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = rows.groupBy("_month", "_hour").agg(F.count("*").alias("_n")).select("_month", "_hour", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_month", "_hour").orderBy(*order)))
    used = own.join(hours, ["_month", "_hour"]).withColumn("used", (F.col("_before") + F.col("_r")).cast("int"))
    return used.withColumn("granted", F.col("used") <= limit).drop("_month", "_hour", "_before", "_r")


def incremental_window(last: Column, days: int = 14, floor: str = "2020-01-01") -> Column:
    """Where the next pull begins: some days before the last one, not before coverage starts; coverage start if there was none."""
    start = F.lit(floor).cast("date")
    return F.coalesce(F.greatest(F.date_sub(last, days), start), start)
