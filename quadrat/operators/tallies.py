"""Yearly tallies that never add incompatible units, count acres once per application, and hold outliers apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.operators.storage import kept
from quadrat.plans.domain import exact_sum

OUTLIER_FACTOR = 10
OUTLIER_LEAST_LINES = 3


def judged(lines: DataFrame, acres: Column) -> DataFrame:
    """lines with rate, the median rate of (product, unit), and held_out: a rate of more than ten times the median of at least three lines. Unresolved units and lines without acres aren't judged."""
    rate = F.when(F.col("family").isin("volume", "mass") & (acres > 0), F.col("quantity") / acres)
    rated = lines.withColumn("rate", rate)
    typical = medians(rated.select(F.upper("product").alias("_product"), F.col("unit").alias("_unit"), "rate"), "rate", "_product", "_unit").withColumnsRenamed({"median": "typical", "n": "_n"})
    met = rated.join(typical, F.upper("product").eqNullSafe(F.col("_product")) & F.col("unit").eqNullSafe(F.col("_unit")), "left").drop("_product", "_unit")
    held = F.coalesce((F.col("_n") >= OUTLIER_LEAST_LINES) & (F.col("rate") > OUTLIER_FACTOR * F.col("typical")), F.lit(False))
    return met.withColumn("held_out", held).drop("_n")


def medians(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, n, median) of the values that aren't null, exactly; keys without any are missing. Nulls are a key.

    Rows are dealt by ranges of key and value, so a key of many rows fills many
    tasks. Each task numbers its own; what a key has in earlier ranges is added,
    and the middle one or two are taken.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_k{i}" for i in range(len(keys))]
    narrow = rows.where(F.col(value).isNotNull()).select(*(F.col(k).alias(c) for k, c in zip(keys, names, strict=True)), F.col(value).alias("_v"))
    narrow = kept(narrow.repartitionByRange(n, *names, "_v").withColumn("_p", F.spark_partition_id()), "ranges")
    key = Window.partitionBy(*names)
    parts = narrow.groupBy(*names, "_p").agg(F.count("*").alias("_c"))
    parts = parts.select(*(F.col(c).alias(f"{c}b") for c in names), F.col("_p").alias("_q"), "_c", F.sum("_c").over(key).alias("n"), (F.sum("_c").over(key.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_before"))
    # only ranges that hold a middle value go on
    low, high = F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2)
    parts = parts.where((F.col("_before") < high) & (low <= F.col("_before") + F.col("_c")))
    same = F.col("_p") == F.col("_q")
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}b"))
    met = narrow.join(parts, same).withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_p", *names).orderBy("_v")))
    middle = met.where((F.col("_r") == low) | (F.col("_r") == high)).groupBy(*names).agg(F.first("n").alias("n"), F.avg("_v").alias("median"))
    return middle.select(*(F.col(c).alias(k) for k, c in zip(keys, names, strict=True)), "n", "median")


def tally(apps: DataFrame, lines: DataFrame, *by: str) -> DataFrame:
    """Per key: applications, acres (once each), gallons, pounds, unresolved amount and line counts. Keys are columns of apps or of lines; lines are summed per application first, so both sides are narrow when they meet."""
    of_apps = [k for k in by if k in apps.columns]
    of_lines = [k for k in by if k not in apps.columns]
    per = lines.groupBy("id", *of_lines).agg(
        exact_sum(F.col("gallons")).alias("gallons"), exact_sum(F.col("pounds")).alias("pounds"), exact_sum(F.when(F.col("family") == "unknown", F.col("quantity"))).alias("unresolved"),
        F.count("*").alias("lines"), F.count_if(F.col("family") == "unknown").alias("unresolved_lines"),
    )
    both = apps.select("id", "acres", *of_apps).join(per, "id")
    return both.groupBy(*by).agg(
        F.count("*").alias("applications"), exact_sum(F.col("acres")).alias("acres"), exact_sum(F.col("gallons")).alias("gallons"), exact_sum(F.col("pounds")).alias("pounds"), exact_sum(F.col("unresolved")).alias("unresolved"), F.sum("lines").alias("lines"), F.sum("unresolved_lines").alias("unresolved_lines")
    )


def with_mix(apps: DataFrame, lines: DataFrame) -> DataFrame:
    """apps with mix: the sorted distinct ingredients of their herbicide lines, joined by ' + '."""
    mix = lines.where("kind = 'herbicide'").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("ingredient")), " + ").alias("mix"))
    return apps.join(mix, "id")


def all_years(apps: DataFrame, lines: DataFrame) -> DataFrame:
    """tally by year and over all years, as a rollup; all_years marks the total."""
    per = lines.groupBy("id").agg(exact_sum(F.col("gallons")).alias("g"), exact_sum(F.col("pounds")).alias("p"))
    return apps.join(per, "id").rollup("year").agg(F.count("*").alias("applications"), exact_sum(F.col("acres")).alias("acres"), exact_sum(F.col("g")).alias("gallons"), exact_sum(F.col("p")).alias("pounds"), F.grouping("year").cast("int").alias("all_years"))


def unresolved(lines: DataFrame) -> DataFrame:
    return lines.where("family = 'unknown'").groupBy("unit").agg(exact_sum(F.col("quantity")).alias("amount"), F.count("*").alias("lines"))


def modal(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Per key its most frequent value, the greatest of equally frequent ones."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", value)).alias(value), F.max("n").alias("n"))


def largest(tallies: DataFrame, n: int, *ties: str) -> DataFrame:
    """The n largest by gallons, then pounds, then applications."""
    return tallies.orderBy(F.desc_nulls_last("gallons"), F.desc_nulls_last("pounds"), F.desc("applications"), *ties).limit(n)


def top_of_each(tallies: DataFrame, key: str, label: str, n: int) -> DataFrame:
    """The n labels of most lines of each key, ranked."""
    w = Window.partitionBy(key).orderBy(F.desc("lines"), label)
    return tallies.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def folded(tallies: DataFrame, year: str, label: str, amount: str, n: int) -> DataFrame:
    """Per year the n labels that are largest overall, and 'Other'."""
    totals = tallies.groupBy(label).agg(exact_sum(F.col(amount)).alias("t"))
    top = totals.orderBy(F.desc_nulls_last("t"), label).limit(n).select(label, F.lit(True).alias("top"))
    named = tallies.join(F.broadcast(top), label, "left").withColumn("series", F.when(F.col("top"), F.col(label)).otherwise("Other"))
    return named.groupBy(year, "series").agg(exact_sum(F.col(amount)).alias(amount))
