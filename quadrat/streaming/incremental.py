"""Structured Streaming over files: daily windows, deduplication under a watermark, a sliding limiter, exactly-once pulls."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.operators.storage import scratch


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """New Parquet files of a folder, or one file, as a stream; ts becomes a timestamp, as watermarks need."""
    schema = spark.read.parquet(path).schema
    folder, name = os.path.split(path.rstrip("/"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet")
    at = path if len(spark.read.parquet(path).inputFiles()) > 1 else folder
    stream = stream.option("pathGlobFilter", name if at == folder else "*.parquet").parquet(at)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_views(events: DataFrame) -> DataFrame:
    """Views by tumbling day."""
    return events.withWatermark("ts", "14 days").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("views")).select(F.to_date("window.start").alias("day"), "views")


def daily_visits(events: DataFrame, late: str = "40 days") -> DataFrame:
    """The first view of each visitor, day and type; state is kept as long as rows may be late. Exact distinct counts of a stream are counts of these."""
    return events.withColumn("day", F.to_date("ts")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type", "day"]).select("user_id", "event_type", "day")


def limited(hits: DataFrame, key: str = "key", seconds: int = 60, limit: int = 60) -> DataFrame:
    """(key, ts, allowed) of (key string, ts timestamp): a hit passes if fewer than ``limit`` passed in the seconds before; refused hits don't count. Sequential per key, so the state holds the times of passed hits."""

    def judge(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        passed = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for t in rows["ts"]:
            now = t.timestamp()
            passed = [p for p in passed if p > now - seconds]
            out.append(len(passed) < limit)
            if out[-1]:
                passed.append(now)
        state.update((passed,))
        yield pd.DataFrame({"key": k[0], "ts": rows["ts"].to_numpy(), "allowed": out})

    return hits.groupBy(F.col(key).alias("key")).applyInPandasWithState(judge, "key string, ts timestamp, allowed boolean", "passed array<double>", "append", "NoTimeout")


def pull(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files not known by their hash, each once; a later window may overlap an earlier one without harm."""
    return files.dropDuplicates(["sha256"]).join(known.select("sha256"), "sha256", "left_anti")


def ingest(stream: DataFrame, checkpoint: str, known: Callable[[], DataFrame], write: Callable[[DataFrame], None]):
    """Run a pull over what a stream has now. The checkpoint moves on only when ``write`` ended well."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: write(pull(batch, known()))).trigger(availableNow=True).start()


def run_now(stream: DataFrame, mode: str) -> DataFrame:
    """Process all that a stream has now, and return its result as a table in the shared folder. Each batch writes a part of its own, over what a failed try of it left; in complete mode a batch replaces the ones before."""
    spark = stream.sparkSession
    at = scratch(spark, "stream")
    spark.createDataFrame([], stream.schema).write.parquet(f"{at}/out/part-none")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/part-{'all' if mode == 'complete' else number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out/part-*")
