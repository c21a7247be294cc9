"""Exact n-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are classes of documents with one shingle set,
columns are shingles. The product of the matrix with its transpose counts
overlaps; size-derived bounds discard most of it before it is formed:

* a row of which more than n - ceil(t n) shingles occur nowhere else cannot
  reach the threshold with anything. That is counted over a residue class of
  the shingles first (a count over fewer shingles is still a lower bound), and
  for the rows that stay over all of them;
* columns are ordered by (frequency, hash), those of one row first. Two rows
  that reach the threshold share a column of the larger one's first
  n - ceil(t n) + 1 and of the smaller one's first n - ceil(2t / (1 + t) n) + 1:
  only this leading block is multiplied first, and where its first common
  column stands bounds the overlap from above;
* for the pairs that are left the product is formed over all columns. They are
  dealt into blocks of hash ranges, as many as a row's size asks for; a block of
  one row meets the same block of its partner, the partial overlap counts are
  summed by pair, and pairs below the least overlap for their sizes go.

Only connected groups are asked for, so the leading block is multiplied in two
steps: first each column's most central row by its others; then, for columns
whose rows are still in several groups, rows of different groups, in tiles of
at most ``TILE`` by ``TILE`` rows. A group of many near copies is joined by its
first star, not by all of its pairs; pages of one template whose own parts are
too large to link have no column in the smaller one's leading block, and so
form no pair at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmaps import bitmap, has
from .components import components
from .kernel import LOWER, U, Words, chunks, mix, signed
from .spill import bounded_batches, written

N = 3
PERCENT = 90
#: Shingles of a row in a block of columns, about.
WIDE = 4096
#: Rows of a column in a block of rows.
TILE = 2048


def _set_of(words: Words, grams: np.ndarray, row: int, n: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text of a slice."""
    a, b = int(words.of[row]), int(words.of[row + 1])
    if b - a >= n:
        g = np.sort(grams[a : b - n + 1])
        return g[np.append(True, g[1:] != g[:-1])]
    if b == a:
        return np.zeros(0, U)
    return mix(np.array([sum(int(h) * 3**i for i, h in enumerate(words.hash[a:b])) % 2**64], U) + U(b - a))


def _digests(g: np.ndarray) -> tuple[int, int]:
    return int(mix(g).sum(dtype=U)), int(mix(g ^ U(0xD6E8FEB86659FD93)).sum(dtype=U))


def _profiles(n: int):
    """Set size and two digests of the set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, at in chunks(b.column(1)):
                w = Words(data, at, case=LOWER)
                grams = w.grams(n)
                size, digest = [], []
                for row in range(j - i):
                    g = _set_of(w, grams, row, n)
                    size.append(len(g))
                    digest.append(_digests(g))
                d = np.array(digest, U).reshape(-1, 2)
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(signed(d[:, 0])), pa.array(signed(d[:, 1]))], ["doc_id", "n", "cid", "check"])

    return run


def _text_cells(n: int, share: int):
    """(cid, h): the class of each text and its shingles of one residue class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, at in chunks(b.column(0)):
                w = Words(data, at, case=LOWER)
                grams = w.grams(n)
                cids, hs = [], []
                for row in range(j - i):
                    g = _set_of(w, grams, row, n)
                    cids.append(_digests(g)[0])
                    hs.append(g[g % U(share) == 0])
                cid = np.repeat(np.array(cids, U), [len(h) for h in hs])
                yield pa.record_batch([pa.array(signed(cid)), pa.array(signed(np.concatenate(hs)))], ["cid", "h"])

    return run


def _sets(n: int, wanted):
    """Class and whole set of the texts whose key the bitmap has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.flatnonzero(has(wanted.value, b.column(0).to_numpy().view(U)))
            if not len(keep):
                continue
            for i, j, data, at in chunks(b.column(1).take(pa.array(keep))):
                w = Words(data, at, case=LOWER)
                grams = w.grams(n)
                sets = [g for row in range(j - i) if len(g := _set_of(w, grams, row, n))]
                if sets:
                    ends = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
                    cid = signed(np.array([_digests(g)[0] for g in sets], U))
                    yield pa.record_batch([pa.array(cid), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.concatenate(sets))))], ["cid", "n", "grams"])

    return run


def _apart(percent: int) -> str:
    """How many shingles a row of n may have that its partner lacks."""
    return f"(n - cast((n * {percent} + 99) div 100 as bigint))"


def _low(percent: int) -> str:
    """The same for the smaller row of a pair."""
    return f"(n - cast((2 * n * {percent} + {99 + percent}) div {100 + percent} as bigint))"


def _bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """(x, y, x_n, y_n) of pairs (a_*, b_*) at a common column: sizes, and the columns from there on, must allow the least overlap."""
    least = f"({percent} * (a_n + b_n) + {99 + percent}) div {100 + percent}"
    ok = pairs.where(f"least(a_n - a_pos, b_n - b_pos) >= {least}")
    first = F.col("a_cid") < F.col("b_cid")
    a, b = F.struct(F.col("a_cid").alias("cid"), F.col("a_n").alias("n")), F.struct(F.col("b_cid").alias("cid"), F.col("b_n").alias("n"))
    ok = ok.select(F.when(first, a).otherwise(b).alias("x"), F.when(first, b).otherwise(a).alias("y"))
    return ok.select(F.col("x.cid").alias("x"), F.col("y.cid").alias("y"), F.col("x.n").alias("x_n"), F.col("y.n").alias("y_n")).distinct()


def _level(n: str) -> Column:
    """A row of n shingles has 2 ** level blocks of columns."""
    return F.expr(f"cast(ceil(log2(greatest(1D, ({n}) / {WIDE}D))) as int)")


def _column_blocks(ordered: DataFrame, percent: int) -> DataFrame:
    """(cid, level, b, cols): each row's columns by block, at the level of its size and at that of the largest partner it may have. Most rows have one block."""
    at = ordered.select("cid", "grams", F.explode(F.array_distinct(F.array(_level("n"), _level(f"n * 100 div {percent}")))).alias("level"))
    one = at.where("level = 0").select("cid", "level", F.lit(0).alias("b"), F.col("grams").alias("cols"))
    cells = at.where("level > 0").select("cid", "level", F.explode("grams").alias("h")).withColumn("b", F.expr("cast(shiftrightunsigned(h, 64 - level) as int)"))
    return one.unionByName(cells.groupBy("cid", "level", "b").agg(F.collect_list("h").alias("cols")))


def _product(pairs: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """Pairs whose overlap, summed over the blocks of columns, reaches the threshold. Shingles of one row only are in no block; no overlap has them."""
    pairs = pairs.withColumn("level", _level("greatest(x_n, y_n)"))
    side = lambda c: blocks.select(F.col("cid").alias(c), "level", "b", F.col("cols").alias(f"{c}_cols"))
    met = pairs.join(side("x"), ["x", "level"]).join(side("y"), ["y", "level", "b"])
    partial = met.select("x", "y", "x_n", "y_n", F.size(F.array_intersect("x_cols", "y_cols")).alias("o"))
    summed = partial.groupBy("x", "y", "x_n", "y_n").agg(F.sum("o").alias("o"))
    return summed.where(f"100 * o >= {percent} * (x_n + y_n - o)").select("x", "y")


def _tiles(open_: DataFrame, percent: int) -> DataFrame:
    """Pairs of rows of different labels at common columns, the larger row with a smaller one in whose leading block the column is. A column's rows are dealt into blocks, and pairs of blocks meet."""
    blocks = open_.groupBy("h").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"), F.max("low").alias("any"))
    rows = open_.join(blocks.where("any").drop("any"), "h").withColumn("blk", F.pmod(F.hash("cid"), F.col("blocks")))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    side = lambda t, p: t.select("h", "i", "j", *(F.col(c).alias(f"{p}_{c}") for c in ("cid", "n", "pos", "label")))
    larger = rows.select("*", F.col("blk").alias("i"), every.alias("j"))
    smaller = rows.where("low").select("*", F.col("blk").alias("j"), every.alias("i"))
    met = side(larger, "a").join(side(smaller, "b"), ["h", "i", "j"])
    return met.where("a_label <> b_label and (b_n < a_n or (b_n = a_n and b_cid < a_cid))")


def classes_and_links(docs: DataFrame, n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, classes, labels): per row doc_id, n, cid; per set cid, rep; per linked set node, label."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    share = max(1, 60 // max(1, 100 - percent))
    profiles = written(docs.mapInArrow(_profiles(n), f"doc_id {kind}, n long, cid long, check long"), "profiles")
    classes = written(profiles.where("n > 0").groupBy("cid", "check", "n").agg(F.min("doc_id").alias("rep")), "classes")
    cells = docs.select("text").mapInArrow(_text_cells(n, share), "cid long, h long")
    own = cells.groupBy("h").agg(F.min("cid").alias("cid"), F.max("cid").alias("other")).where("cid = other")
    stay = classes.join(own.groupBy("cid").agg(F.count("*").alias("u")), "cid", "left").where(f"coalesce(u, 0) <= {_apart(percent)}")
    stay = written(stay.select("cid", F.xxhash64("rep").alias("k")), "stay")
    wanted = spark.sparkContext.broadcast(bitmap(stay.select("k")))
    sets = docs.select(F.xxhash64("doc_id").alias("k"), "text").mapInArrow(_sets(n, wanted), "cid long, n long, grams array<long>")
    sets = written(sets.join(stay.select("cid").distinct(), "cid", "left_semi").groupBy("cid").agg(F.first("n").alias("n"), F.first("grams").alias("grams")), "sets")
    cells = sets.select("cid", F.explode("grams").alias("h"))
    often = cells.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    rows = cells.join(often, "h").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("g"))
    ordered = rows.join(sets.select("cid", "n"), "cid").select("cid", "n", F.col("g.h").alias("grams")).withColumn("u", F.col("n") - F.size("grams"))
    ordered = written(ordered.where(f"u <= {_apart(percent)}"), "ordered")
    blocks = written(_column_blocks(ordered, percent), "columns")
    block = ordered.select("cid", "n", "u", F.posexplode(F.expr(f"slice(grams, 1, cast({_apart(percent)} + 1 - u as int))")).alias("i", "h"))
    block = block.select("cid", "n", "u", "h", (F.col("u") + F.col("i")).alias("pos")).withColumn("low", F.expr(f"pos <= {_low(percent)}"))
    block = written(block, "block")

    side = lambda t, p: t.select("h", *(F.col(c).alias(f"{p}_{c}") for c in t.columns if c != "h"))
    pivots = block.groupBy("h").agg(F.min(F.struct("u", "n", "cid", "pos")).alias("p"), F.count("*").alias("c")).where("c > 1").select("h", "p.cid", "p.n", "p.pos")
    stars = side(block, "a").join(side(pivots, "b"), "h").where("a_cid <> b_cid")
    links = written(_product(_bounded(stars, percent), blocks, percent), "links")
    labelled = block.join(components(links).withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    labelled = written(labelled, "labelled")
    mixed = labelled.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h")
    open_ = written(labelled.join(mixed, "h", "left_semi"), "open")
    more = _product(_bounded(_tiles(open_, percent), percent), blocks, percent)
    return profiles.select("doc_id", "n", "cid"), classes.select("cid", "rep"), components(links.unionByName(more))


def ngram_components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id long, text; other columns are not read).

    A text shorter than n words is one shingle, its whole sequence. A null or
    empty text, or one of spaces only, has no shingle and is its own component.
    Rows with equal sets, repeated rows among them, are linked. Rows that share
    a doc_id are judged each by its own text. No rows give no rows. Shingles are
    told apart by 64-bit hashes, sets by 128 bits and their size.
    """
    profiles, classes, labels = classes_and_links(docs, n, percent)
    groups = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    groups = written(groups, "groups")
    least = groups.groupBy("label").agg(F.min("rep").alias("component_id"))
    of = written(groups.join(least, "label").select("cid", "component_id"), "of")
    out = profiles.join(of, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group of linked rows: that of the least doc_id, and among rows of one doc_id that of the least text hash; of rows equal in both, any. Rows without words stay. Columns stay as they are, whatever their names.

    Only rows that a bitmap takes for rejected or repeated are shuffled; a task
    gets their keys, not their texts.
    """
    key = F.struct("doc_id", F.xxhash64("doc_id", "text").alias("h"))
    found = written(ngram_components(docs.select(key.alias("doc_id"), "text"), n, percent), "found").withColumn("k", F.col("doc_id.h"))
    gone = written(found.where("not doc_id <=> component_id").select("k").distinct(), "gone")
    repeated = found.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(written(gone.unionByName(repeated), "suspects")))

    @F.arrow_udf("boolean")
    def suspect(k: pa.Array) -> pa.Array:
        return pa.array(has(bits.value, k.to_numpy(zero_copy_only=False).view(U)))

    rows = docs.select(F.xxhash64("doc_id", "text").alias("k"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("suspect", suspect("k"))
    judged = rows.where("suspect").join(gone, "k", "left_anti").dropDuplicates(["k"])
    return rows.where("not suspect").unionByName(judged).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


__all__ = ["classes_and_links", "ngram_components", "one_of_each"]
