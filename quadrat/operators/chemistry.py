"""Products resolved by priority, and flags of applications with their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels from the gravest, and entries of the watch list with their spellings.
LEVELS = ("red", "orange", "yellow")
WATCHED = {"2,4-D": ("2,4-D", "2,4-D, 2-ethylhexyl ester", "2,4-D choline salt", "2,4-D dimethylamine salt"), "Hexazinone": ("Hexazinone",)}
SIGNAL_WORDS = {"DANGER": ("signal_word_danger", "yellow"), "WARNING": ("signal_word_warning", "yellow")}


def resolved(products: DataFrame, *sources: tuple[str, DataFrame], key: str = "base_reg_no") -> DataFrame:
    """products with ingredient and source: of the first of the sources (name, (key, ingredient)) that knows the key, else 'unresolved'."""
    names, values = [], []
    for name, known in sources:
        products = products.join(known.select(key, F.col("ingredient").alias(f"_{name}")), key, "left")
        names.append(F.when(F.col(f"_{name}").isNotNull(), F.lit(name)))
        values.append(F.col(f"_{name}"))
    out = products.withColumn("ingredient", F.coalesce(*values)).withColumn("source", F.coalesce(*names, F.lit("unresolved")))
    return out.drop(*(f"_{n}" for n, _ in sources))


def never_downgraded(old: DataFrame, new: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """Rows of both, of each key the one of higher rank, the old one if equal."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c != key]
    best = both.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(F.col(rank).isNull().alias("none"), (-F.col(rank)).alias("r"), "_new")).alias("_x"))
    return best.select(*(F.col(key) if c == key else F.col(f"_x.{c}").alias(c) for c in old.columns))


def permit_flags(materials: DataFrame) -> DataFrame:
    """Flags of the materials that a permit names, but for placeholders of unrestricted use. (id, name.)"""
    named = materials.where((F.trim("name") != "") & ~F.upper(F.trim("name")).startswith("NON-RESTRICTED"))
    return named.select("id", F.trim("name").alias("subject"), F.lit("california_restricted_material").alias("reason"), F.lit("red").alias("level"), F.lit(True).alias("regulatory"))


def watchlist_flags(ingredients: DataFrame, watchlist: DataFrame | None = None) -> DataFrame:
    """Flags of ingredients (id, name) on the publisher's watch list under any of their spellings; never regulatory. ``watchlist``: name, spelling; the list as published by default."""
    if watchlist is None:
        watchlist = ingredients.sparkSession.createDataFrame([(name, s) for name, spelled in WATCHED.items() for s in spelled], "name string, spelling string")
    known = watchlist.select(F.upper(F.trim("spelling")).alias("_key"), F.col("name").alias("subject")).dropDuplicates(["_key"])
    met = ingredients.withColumn("_key", F.upper(F.trim("name"))).join(known, "_key")
    return met.select("id", "subject", F.lit("publisher_watchlist").alias("reason"), F.lit("red").alias("level"), F.lit(False).alias("regulatory"))


def label_flags(labels: DataFrame) -> DataFrame:
    """Flags of products' signal words. (id, name, signal_word.)"""
    kind = F.try_element_at(F.create_map(*(x for w, (r, lv) in SIGNAL_WORDS.items() for x in (F.lit(w), F.struct(F.lit(r).alias("reason"), F.lit(lv).alias("level"))))), F.upper(F.trim("signal_word")))
    return labels.select("id", F.col("name").alias("subject"), kind.alias("k")).where("k is not null").select("id", "subject", "k.reason", "k.level", F.lit(False).alias("regulatory"))


def flag_summary(flags: DataFrame) -> DataFrame:
    """Per id: flags once for each reason and subject, the gravest level, and the headline: a regulatory red first, then any red, then the gravest."""
    f = flags.withColumn("_s", F.upper("subject")).dropDuplicates(["id", "reason", "_s"]).withColumn("rank", F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")))
    first = F.struct("rank", F.when(F.col("regulatory"), 0).otherwise(1), "reason", "_s")
    return f.groupBy("id").agg(F.count("*").alias("flags"), F.min_by("level", "rank").alias("highest"), F.min_by(F.struct("reason", "subject"), first).alias("headline"), F.bool_or(F.col("regulatory") & (F.col("level") == "red")).alias("restricted"), F.bool_or((F.col("reason") == "publisher_watchlist")).alias("watched"))
