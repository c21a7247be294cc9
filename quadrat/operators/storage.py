"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where that is unset, a local folder is set if all tasks run in this process; on a cluster it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quadrat-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lost executors lose no lineage."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def release(spark: SparkSession, hours: float = 24) -> list[str]:
    """Delete what runs left in the shared folder, corpus operators' tables among it, and hasn't changed for so many hours; the names of what went.

    Results are read from these tables, so it is called when they have been
    written elsewhere, or regularly with more hours than any run takes. Nothing
    else in the folder is touched: tables of runs end in 32 hexadecimal digits.
    """
    fs = spark._jvm.org.apache.hadoop.fs
    folder = fs.Path(shared_folder(spark))
    system, gone = folder.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for s in system.listStatus(folder):
        name = s.getPath().getName()
        if re.search("-[0-9a-f]{32}(-windows)?$", name) and s.getModificationTime() / 1000 <= time.time() - 3600 * hours:
            system.delete(s.getPath(), True)
            gone.append(name)
    return sorted(gone)
