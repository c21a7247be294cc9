"""SpotSigs document fingerprints with DataFrame functions only.

A signature is a chain: a common word (the anchor), the content word right
after it, and the next content word within ``REACH`` words. A document's
fingerprint is its set of signatures, as 32-bit hashes. Fingerprints are
compared by Jaccard similarity. In the join of a table it is pruned by set
length: sets are partitioned by length so that a set that can reach
``SIMILARITY`` with another is in the same partition or a neighbouring one, and
others aren't intersected. For given pairs (``likeness``) it is exact, whatever
the lengths.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spill import partitions, written

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his in is it its not of on or she that the their they this to was were which will with you "
    "au aux avec ce cette dans des du elle en est et il la le les mais ne nous ou par pas pour que qui sa se son sur un une "
    "als auch auf aus bei das dem den der die ein eine einer es für ich im ist mit nach nicht sich sie so und von war wie wird zu zum "
    "al como con de del el ella entre era fue ha hay las lo los más no para pero por sin su sus una y"
).split()
REACH = 3
SIMILARITY = 0.8
_SIGNS = "\t\n\x0b\f\r.,;:!?\"'()[]{}|/*#<>=+-_&%$~`^@\\"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.lower(text), _SIGNS, " " * len(_SIGNS)), " "), lambda w: w != "")


def with_signatures(rows: DataFrame, text: str, out: str) -> DataFrame:
    """rows with the sorted array ``out`` of distinct signatures of the string column ``text``.

    A text with words but no chain has one signature, the hash of its words; a
    text without words, or a null, has none.
    """
    rows = rows.withColumn("_w", _words(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.withColumn("_c", F.transform("_w", lambda w: F.when(~w.isin(*ANCHORS), w)))

    def chain(w: Column, i: Column) -> Column:
        after = F.coalesce(*(F.get("_c", i + d) for d in range(1, REACH + 1)), F.lit(""))
        return F.when((i > 0) & w.isNotNull() & F.get("_c", i - 1).isNull(), F.hash(F.get("_w", i - 1), w, after))

    found = F.array_sort(F.array_distinct(F.array_compact(F.transform("_c", chain))))
    rows = rows.withColumn("_f", found)
    none = F.when(F.size("_w") > 0, F.array(F.hash("_w"))).otherwise(F.array().cast("array<int>"))
    return rows.withColumn(out, F.when(F.size("_f") > 0, F.col("_f")).otherwise(none)).drop("_w", "_c", "_f")


def partition(n: Column, least: float) -> Column:
    """Number of the length partition: sets whose sizes' ratio is at least ``least`` are in the same or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / -math.log(least) + 1e-9)


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two signature sets; 1 for two empty ones."""
    na, nb = F.size(a), F.size(b)
    common = F.size(F.array_intersect(a, b))
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(common / (na + nb - common))


def shown(a: str) -> Column:
    """A fingerprint as a string."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))), " ")


def _chained(docs: DataFrame) -> DataFrame:
    """(k, prev_doc_id, prev, half): of each document's key, the document before it in ascending order, the last for the first, and half that one's length.

    Places are found in ranges of doc_id, of narrow rows; one row of each range
    goes through a common window.
    """
    ids = docs.groupBy("doc_id", "k").agg(F.first("n").alias("n"))
    ids = written(ids.repartitionByRange(partitions(docs.sparkSession), "doc_id", "k").withColumn("p", F.spark_partition_id()), "ids")
    me = F.struct("doc_id", "k", "n")
    lasts = ids.groupBy("p").agg(F.max(me).alias("last"))
    end = Window.partitionBy(F.lit(0))
    lasts = lasts.select("p", F.coalesce(F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("p")), F.max("last").over(end)).alias("before"))
    own = ids.select("p", "k", F.lag(me).over(Window.partitionBy("p").orderBy("doc_id", "k")).alias("b"))
    both = own.join(lasts, "p").select("k", F.coalesce("b", "before").alias("b"))
    return written(both.select("k", F.col("b.doc_id").alias("prev_doc_id"), F.col("b.k").alias("prev"), F.floor(F.col("b.n") / 2).cast("int").alias("half")), "chained")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs (doc_id, text).

    The edited text: the last floor(n_chars / 2) code points are replaced by as
    many first ones, or all, of the next document's. A null text is empty. Rows
    that share a doc_id follow each other by the hash of their text; rows equal
    in both are one document, and each gets its results. A lone document is its
    own next one. A null doc_id comes first. No rows give none.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = rows.select("k", "text")
    chained = _chained(rows.select("doc_id", "k", F.length("text").alias("n")))
    sent = with_signatures(texts.join(chained, "k"), "text", "next_sigs")
    sent = sent.select(F.col("prev").alias("k"), F.col("prev_doc_id").alias("doc_id"), "half", F.expr("left(text, half)").alias("head"), "next_sigs").dropDuplicates(["k"])
    both = texts.join(sent, "k").withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - half as int))"), "head"))
    both = with_signatures(with_signatures(both, "text", "sigs"), "edited", "edited_sigs")
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), shown("sigs").alias("fingerprint"), shown("edited_sigs").alias("edited_fingerprint"), likeness("sigs", "edited_sigs").alias("near_edited"), likeness("sigs", "next_sigs").alias("near_next")
    )


def near_pairs(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(x, y, likeness), x < y: documents of different signature sets that are at least so similar. (doc_id long, text.)

    Documents with one set count as one, the least doc_id of them; ``x`` and
    ``y`` are those. Sets are partitioned by length so that a partner is in the
    same or the next partition; in them, sets meet at their rarest signatures,
    as many as suffice to share one with any partner. Texts without words have
    no partner.
    """
    sets = with_signatures(docs.select("doc_id", "text"), "text", "sigs").where(F.size("sigs") > 0)
    sets = written(sets.groupBy("sigs").agg(F.min("doc_id").alias("id")).withColumn("n", F.size("sigs")), "sets")
    cells = sets.select("id", "n", F.explode("sigs").alias("s"))
    often = cells.groupBy("s").agg(F.count("*").alias("df"))
    ranked = cells.join(often, "s").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("g"))
    first = F.slice("g", 1, (F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).cast("int"))
    block = written(ranked.select("id", "n", partition(F.col("n"), similarity).alias("band"), F.explode(first).alias("f")).select("id", "n", "band", "f.s"), "block")
    low = block.select("s", F.col("id").alias("a"), F.col("n").alias("a_n"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), F.col("band").alias("a_band"))
    high = block.select("s", F.col("id").alias("b"), F.col("n").alias("b_n"), "band")
    fits = (F.least("a_n", "b_n") >= similarity * F.greatest("a_n", "b_n") - 1e-9) & ((F.col("a_band") < F.col("band")) & (F.col("a") != F.col("b")) | (F.col("a") < F.col("b")))
    pairs = low.join(high, ["s", "band"]).where(fits).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    side = lambda c: sets.select(F.col("id").alias(c), F.col("sigs").alias(f"{c}_sigs"))
    return pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", likeness("x_sigs", "y_sigs").alias("likeness")).where(F.col("likeness") >= similarity - 1e-9)
