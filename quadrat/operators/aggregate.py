"""Record-level and line-level totals by a dimension, leader boards and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.units import active_ingredient_pounds
from quadrat.plans.domain import exact_sum, millionths, of_millionths

METRICS = ("applications", "acres", "gallons", "pounds")
#: Lines that a task of totals by a dimension of lines holds, in the mean.
LINES_A_TASK = 250_000


def aggregate(apps: DataFrame, lines: DataFrame, dimension: str | Column | None = None, compat: bool = False) -> DataFrame:
    """Totals per key of a record. A dimension of lines (product, applicator) gives a record several keys: quantities go to their own key, and acres to each. ``compat`` gives every key all of the record, once a line, as older figures did."""
    key = F.lit("all") if dimension is None else dimension if isinstance(dimension, Column) else F.col(dimension)
    ai = active_ingredient_pounds(F.col("gallons"), F.col("pounds"), F.col("percent"), F.col("density"))
    on_lines = isinstance(dimension, str) and dimension in lines.columns
    if not on_lines or compat:
        sums = [exact_sum(F.col("gallons")).alias("gallons"), exact_sum(F.col("pounds")).alias("pounds"), exact_sum(ai["pounds"]).alias("ai_pounds"), F.count(ai["gap"]).alias("ai_gaps"), F.count("*").alias("lines")]
        rows = lines.groupBy("id").agg(*sums)
    if not on_lines:
        return _by_key(apps.join(rows, "id").withColumn("key", key.cast("string")))
    n = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), lines.count() // LINES_A_TASK + 1)
    if compat:
        return _by_operator(apps.join(lines.select("id", F.col(dimension).alias("key")).repartition(n, "id").join(rows, "id"), "id").withColumn("first", F.lit(True)), n)
    each = lines.select("id", F.col(dimension).alias("key"), "gallons", "pounds", ai["pounds"].alias("ai_pounds"), ai["gap"].isNotNull().cast("long").alias("ai_gaps"), F.lit(1).cast("long").alias("lines"))
    each = each.repartition(n, "id").withColumn("first", F.row_number().over(Window.partitionBy("id", "key").orderBy(F.lit(1))) == 1)
    return _by_operator(apps.join(each, "id"), n)


def _by_key(rows: DataFrame) -> DataFrame:
    """Totals of records' rows."""
    return rows.groupBy("key").agg(
        F.count("*").alias("applications"), F.count_if("planned").alias("planned"), F.count_if(F.col("method") == "aerial").alias("aerial"), exact_sum(F.col("acres")).alias("acres"), F.min("start").alias("first"), F.max("start").alias("last"),
        F.count_distinct("county").alias("counties"), F.count_distinct("operator_id").alias("operators"), *(exact_sum(F.col(c)).alias(c) for c in ("gallons", "pounds", "ai_pounds")), F.sum("ai_gaps").alias("ai_gaps"), F.sum("lines").alias("lines"),
    )


def _by_operator(rows: DataFrame, n: int) -> DataFrame:
    """The same of lines' rows, of which the ``first`` of a record and key counts for the record: by operators of a key in n tasks, then by keys, so that no task holds more than its share of the pairs."""
    exact = {"acres": F.when(F.col("first"), F.col("acres"))} | {c: F.col(c) for c in ("gallons", "pounds", "ai_pounds")}
    parts = [F.sum(x).alias(f"{c}_{k}") for c, v in exact.items() for k, x in zip(("high", "low"), millionths(v))]
    groups = rows.repartition(n, "key", "operator_id").groupBy("key", "operator_id", "county").agg(
        F.count_if("first").alias("applications"), F.count_if(F.col("first") & F.col("planned")).alias("planned"), F.count_if(F.col("first") & (F.col("method") == "aerial")).alias("aerial"),
        F.min("start").alias("start"), F.max("start").alias("last"), *parts, F.sum("ai_gaps").alias("ai_gaps"), F.sum("lines").alias("lines"),
    )
    groups = groups.withColumn("nth", F.row_number().over(Window.partitionBy("key", "operator_id").orderBy("county")))
    total, whole = lambda c: F.sum(c).alias(c), lambda c: of_millionths(F.sum(f"{c}_high"), F.sum(f"{c}_low")).alias(c)
    return groups.groupBy("key").agg(
        total("applications"), total("planned"), total("aerial"), whole("acres"), F.min("start").alias("first"), F.max("last").alias("last"), F.count_distinct("county").alias("counties"),
        F.count_if(F.col("operator_id").isNotNull() & (F.col("nth") == 1)).alias("operators"), whole("gallons"), whole("pounds"), whole("ai_pounds"), total("ai_gaps"), total("lines"),
    )


def leaderboard(groups: DataFrame, metric: str, limit: int = 10) -> DataFrame:
    if metric not in METRICS:
        raise ValueError(f"no metric {metric!r}")
    return groups.orderBy(F.desc_nulls_last(metric), "key").limit(limit).select("key", metric)


def shares(apps: DataFrame, by: str) -> DataFrame:
    """Applications of each key and their share of all, to four places."""
    counts = apps.groupBy(by).agg(F.count("*").alias("applications"))
    total = counts.agg(F.sum("applications").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(by, "applications", F.round(F.col("applications") / F.col("total"), 4).alias("share"))
