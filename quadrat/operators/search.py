"""Free-text search by a trigram index kept beside the tables.

``ILIKE '%x%'`` reads every row of every field. The index holds the rows of each
field with their values' numbers, and for each trigram of values in lower case
the different values that hold it, in order, so that a search reads the row
groups of its own trigrams. A pattern's rarest trigrams are intersected, and
what is left is compared with the whole pattern, so the rows are those of the
scan. Rows are written as they come, without a shuffle; only different values
are sorted.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.operators.storage import kept

GRAM = 3
#: Trigrams of a pattern that are intersected: the rarest.
INTERSECTED = 4


def grams(text: Column) -> Column:
    """Distinct trigrams of a text in lower case; none of a shorter one."""
    low = F.lower(text)
    places = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(GRAM))))


def literals(pattern: str) -> list[str]:
    """Trigrams that a text must hold, in lower case, to match a pattern of LIKE; its wildcards hold none."""
    parts = re.split(r"[%_]|\\.", pattern)
    return sorted({p[i : i + GRAM] for p in (p.lower() for p in parts) for i in range(len(p) - GRAM + 1)})


class TrigramIndex:
    """An index in a folder that all executors share: ``rows`` (field, vid, value, id), ``postings`` (gram, vid), ``sizes`` (gram, n)."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")

    def add(self, rows: DataFrame) -> None:
        """Index rows (field, id, value), beside those that are there. Null and empty values match nothing and are left out; a row that comes again is found once."""
        n, at = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"{self.at}/rows/{uuid.uuid4().hex}"
        rows = rows.where("value <> ''").select("field", F.xxhash64("field", "value").alias("vid"), "value", "id")
        rows.write.parquet(at)
        values = kept(self.spark.read.schema(rows.schema).parquet(at).select("vid", "value").distinct(), "values")
        postings = values.select(F.explode(grams(F.col("value"))).alias("gram"), "vid")
        postings.repartitionByRange(n, "gram", "vid").sortWithinPartitions("gram", "vid").write.mode("append").parquet(f"{self.at}/postings")
        postings.groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange(n, "gram").sortWithinPartitions("gram").write.mode("append").parquet(f"{self.at}/sizes")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.at}/{name}")

    def search(self, text: str, *fields: str) -> DataFrame:
        """(id) of the rows of which a field, any or one of ``fields``, is ILIKE '%text%'. A text without three letters in a row reads all values."""
        rows = self._read("rows").where(F.col("value").ilike(f"%{text}%"))
        rows = rows.where(F.col("field").isin(*fields)) if fields else rows
        wanted = literals(text)
        if wanted:
            sizes = dict(self._read("sizes").where(F.col("gram").isin(*wanted)).groupBy("gram").agg(F.sum("n").alias("n")).collect())  # a row a trigram of the text
            if len(sizes) < len(wanted):
                return rows.where("false").select("id")
            chosen = sorted(wanted, key=lambda g: (sizes[g], g))[:INTERSECTED]
            met = self._read("postings").where(F.col("gram").isin(*chosen)).groupBy("vid").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(chosen))
            rows = rows.join(met, "vid", "left_semi")
        return rows.select("id").distinct()


def long_form(rows: DataFrame, key: str, *fields: str) -> DataFrame:
    """(field, id, value) of the fields of rows, for ``TrigramIndex.add``."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    return rows.select(F.col(key).alias("id"), each.alias("x")).select("x.field", "id", "x.value")
