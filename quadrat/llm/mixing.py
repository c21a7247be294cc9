"""Mixing sources to target weights by repetition rates.

Word counts are summed per source; a water level over the sources sorted by
capacity for their weight gives each its target, no more than ``MOST`` times
its size. A document of a source with rate r = target / size is taken floor(r)
times, and once more with probability r - floor(r).

Each document's draw is its own: its doc_id's hash, turned by the seed of its
source, is compared with the fraction. A source tries ``SEEDS`` seeds, all in
one pass over narrow rows, and takes the one whose words come nearest to its
target, so that a small source isn't missed where a few documents hold most of
its words: the miss of one draw is about a standard deviation, and the least of
64 about a fiftieth of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spill import written

WEIGHTS = (1, 2, 3)
MOST = 3
SALT = "mix-2"
#: Seeds that a source tries.
SEEDS = 64
_UNIT = float(1 << 48)


def n_words(text: str = "text") -> Column:
    """Words of a text; a null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _number(c: Column) -> Column:
    """48 bits of the digest of a string."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 12), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, docs, source_size, target, rate of (source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn. The
    window over sources holds one row each.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")).withColumn("cap", most * F.col("source_size"))
    filled = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    per = per.select("*", F.coalesce(F.sum("cap").over(filled), F.lit(0)).alias("before"), (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(filled), F.lit(0))).alias("rest"), F.sum("source_size").over(whole).alias("total"))
    per = per.withColumn("full", F.col("cap").cast("double") * F.col("rest") <= F.col("w").cast("double") * (F.col("total") - F.col("before")))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))
    share = F.col("w") * left.cast("double") / F.sum(F.when(~F.col("full"), F.col("w"))).over(whole).cast("double")
    per = per.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    return per.select("source", "docs", "source_size", "target", rate.alias("rate"))


def _once(seed: Column, part: Column) -> Column:
    """1 with probability ``part``: the document's number, turned by the seed, is below it."""
    turned = F.col("_u") + seed / float(SEEDS)
    return F.when(turned - F.floor(turned) < part, 1).otherwise(0)


def _with_number(rows: DataFrame, salt: str) -> DataFrame:
    return rows.withColumn("_u", _number(F.concat_ws(":", F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) / _UNIT)


def _seeds(sizes: DataFrame, salt: str) -> DataFrame:
    """_of (a source), source_size, target, rate and _seed, a row a source, of sizes (doc_id, source, size)."""
    known = written(targets(sizes.select("source", "size")), "targets").withColumnRenamed("source", "_of")
    of = F.col("source").eqNullSafe(F.col("_of"))
    part = F.col("rate") - F.floor("rate")
    rows = _with_number(sizes, salt).join(known.select("_of", "rate"), of)
    tries = rows.groupBy("source").agg(*(F.sum(F.col("size") * _once(F.lit(i), part)).alias(f"s{i}") for i in range(SEEDS)))
    tries = tries.join(known, of).withColumn("tries", F.array(*(F.abs(F.col("source_size") * F.floor("rate") + F.col(f"s{i}") - F.col("target")) for i in range(SEEDS))))
    return written(tries.select("_of", "source_size", "target", "rate", (F.array_position("tries", F.array_min("tries")) - 1).alias("_seed")), "seeds")


def _drawn(rows: DataFrame, sizes: DataFrame, salt: str) -> DataFrame:
    """rows (doc_id, source, ...) with source_size, target and copies."""
    rows = _with_number(rows, salt).join(_seeds(sizes, salt), F.col("source").eqNullSafe(F.col("_of")), "left")
    return rows.withColumn("copies", (F.floor("rate") + _once(F.col("_seed"), F.col("rate") - F.floor("rate"))).cast("int"))


def _sizes(docs: DataFrame) -> DataFrame:
    return written(docs.select("doc_id", "source", n_words().alias("size")), "sizes")


def mix_plan(docs: DataFrame, salt: str = SALT) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs (doc_id, text, source).

    A null or wordless text has size 0 and takes nothing; a null source is a
    source. A source without words has target 0. Rows that share a doc_id, equal
    ones too, have the same draw. The same rows give the same answers; of seeds
    that come as near, the first is taken. No rows give no rows.
    """
    rows = _sizes(docs)
    return _drawn(rows, rows, salt).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, salt: str = SALT) -> DataFrame:
    """docs, each row as often as it is taken (0 to 3 times). Columns stay as they are, whatever their names.

    A document without words is copied at its source's rate like others, and
    takes no words. Counting and drawing read doc_id, source and the number of
    words only; texts are read once more for the copies and not shuffled while
    the table of sources is small enough to be sent to tasks.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select("doc_id", "source", row.alias("row"))
    taken = _drawn(rows, _sizes(docs), salt).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, count(*) AS docs, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS w, {MOST} * source_size AS cap FROM per
), filled AS (
  SELECT *, coalesce(sum(cap) OVER f, 0)::BIGINT AS before, (sum(w) OVER () - coalesce(sum(w) OVER f, 0))::BIGINT AS rest, (sum(source_size) OVER ())::BIGINT AS total
  FROM weighed WINDOW f AS (ORDER BY cap::DOUBLE / w::DOUBLE, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), judged AS (
  SELECT *, cap::DOUBLE * rest <= w::DOUBLE * (total - before) AS is_full FROM filled
), aimed AS (
  SELECT source, docs, source_size, CASE WHEN is_full THEN cap::DOUBLE
    ELSE w * (total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0))::DOUBLE / (sum(CASE WHEN NOT is_full THEN w END) OVER ())::DOUBLE END AS target FROM judged
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN least({MOST}.0, target / source_size) ELSE 0.0 END AS rate FROM aimed
), dealt AS (
  SELECT d.doc_id, d.size, r.*, ('0x' || substr(md5(concat_ws(':', '{SALT}', coalesce(d.doc_id::VARCHAR, ''))), 1, 12))::BIGINT / {_UNIT} AS u, rate - floor(rate) AS part
  FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
), tried AS (
  SELECT source, i, abs(any_value(source_size) * floor(any_value(rate)) + sum(CASE WHEN u + i / {SEEDS}.0 - floor(u + i / {SEEDS}.0) < part THEN size ELSE 0 END)::BIGINT - any_value(target)) AS miss
  FROM dealt, range({SEEDS}) t(i) GROUP BY source, i
), seeded AS (SELECT source, arg_min(i, (miss, i)) AS i FROM tried GROUP BY source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u + i / {SEEDS}.0 - floor(u + i / {SEEDS}.0) < part THEN 1 ELSE 0 END))::BIGINT AS taken
FROM dealt d JOIN seeded s ON d.source IS NOT DISTINCT FROM s.source
"""
