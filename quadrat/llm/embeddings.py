"""Near-duplicate embeddings by spherical-cap filters.

A filter is a direction; a vector passes it when their inner product exceeds a
bound, that is, when it lies in the cap around it. Directions form a product
code: after a random rotation a vector is halved, each half has a code of K
random unit vectors, and the K * K pairs of them are the filters. So a vector's
filters are list-decoded from 2 K inner products: half codes sorted by score,
a prefix of the second for each of the first. Near vectors share caps; they
are joined on filters and verified in double precision.

K grows with the number of vectors so that a filter's list stays small. The
bound comes from simulated pairs at the threshold, run through the codes that
are used: ``RECALL`` of them share a filter, whatever K and the dimension. Where
that takes more than ``LIMIT`` filters a vector, as in low dimensions, K is
halved, which makes lists longer and loses nothing. A vector with fewer than
``LEAST`` filters has the best one of each code. A pair is counted under
the smallest filter both have, and by groups, so no pairs are emitted: a list
yields for each vector how many partners it has there, and one link to its
group. Lists longer than ``BLOCK`` are dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log2, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .spill import bounded_batches, partitions, written

COSINE = 0.9
#: Codes, and the part of pairs at the threshold that share a filter of any of them.
TABLES = 8
RECALL = 0.995
#: Pairs that the bound is fitted on, and half codes of each pair that are tried for its best filter.
PAIRS, TRIED = 2000, 96
#: Filters of a vector, and half codes: filters of all codes are numbered in 32 bits.
LIMIT, WIDEST = 128, 1 << 14
LEAST = 2
#: Vectors for a filter that K is chosen for.
LOAD = 16
BLOCK = 1024
#: Smaller filters that are compared at once.
COLUMNS = 2048
SEED = 5


@lru_cache(maxsize=4 * TABLES)
def code(dim: int, k: int, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rotation and the half codes for vectors of a length (at least 2)."""
    rng = np.random.default_rng([SEED, dim, k, table])
    turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    halves = []
    for d in (dim // 2, dim - dim // 2):
        c = rng.standard_normal((k, d))
        halves.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return turn, *halves


def _scores(unit: np.ndarray, k: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    turn, a, b = code(unit.shape[1], k, table)
    x = unit @ turn
    half = unit.shape[1] // 2
    return x[:, :half] @ a.T, x[:, half:] @ b.T


def _best(x: np.ndarray, y: np.ndarray, k: int, table: int) -> np.ndarray:
    """For each pair the largest bound at which both pass a common filter of a code; less at most, as only the ``TRIED`` half codes nearest to both are looked at."""
    x1, x2 = _scores(x, k, table)
    y1, y2 = _scores(y, k, table)
    top = min(TRIED, k)
    i = np.argpartition(-(x1 + y1), top - 1, 1)[:, :top]
    j = np.argpartition(-(x2 + y2), top - 1, 1)[:, :top]
    one, other = (np.take_along_axis(p, i, 1)[:, :, None] + np.take_along_axis(q, j, 1)[:, None, :] for p, q in ((x1, x2), (y1, y2)))
    return np.minimum(one, other).max((1, 2))


@lru_cache(maxsize=64)
def caps(dim: int, k: int, cosine: float) -> tuple[int, float]:
    """K, or as much of it as ``LIMIT`` allows, and the bound that ``RECALL`` of the pairs of that cosine both exceed for a filter."""
    rng = np.random.default_rng([SEED, dim])
    x, y = rng.standard_normal((2, PAIRS, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = cosine * x + sqrt(max(0.0, 1 - cosine**2)) * y / np.linalg.norm(y, axis=1, keepdims=True)
    k = min(k, WIDEST)
    while True:
        best = np.concatenate([np.max([_best(x[i : i + 50], y[i : i + 50], k, t) for t in range(TABLES)], 0) for i in range(0, PAIRS, 50)])
        least = float(np.quantile(best, 1 - RECALL, method="lower")) - 1e-9
        if k <= 8 or sum(len(_decode(x[:64], k, least, t)[0]) for t in range(TABLES)) <= 64 * LIMIT:
            return k, least
        k //= 2


def _decode(unit: np.ndarray, k: int, least: float, table: int) -> tuple[np.ndarray, np.ndarray]:
    """(vector, filter) for the filters of a code that unit vectors pass."""
    one, two = _scores(unit, k, table)
    row, second = np.nonzero(two >= least - one.max(1, keepdims=True))
    key = 8.0 * row - two[row, second]
    order = np.argsort(key)
    key, second = key[order], second[order]
    at, first = np.nonzero(one >= least - two.max(1, keepdims=True))
    begin = np.searchsorted(row, at)
    n = np.maximum(np.searchsorted(key, 8.0 * at - (least - one[at, first]), "right") - begin, 0)
    place = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(at, n), np.repeat(first, n) * k + second[place] + table * k * k


def decode(unit: np.ndarray, k: int, cosine: float) -> list[np.ndarray]:
    """For each unit vector the sorted numbers of its filters in all codes."""
    k, least = caps(unit.shape[1], k, cosine)
    parts = [_decode(unit, k, least, t) for t in range(TABLES)]
    row, f = (np.concatenate(c) for c in zip(*parts, strict=True))
    few = np.flatnonzero(np.bincount(row, minlength=len(unit)) < LEAST)
    if len(few):
        best = [np.stack([s.argmax(1) for s in _scores(unit[few], k, t)]) for t in range(TABLES)]
        row = np.concatenate([row, *[few] * TABLES])
        f = np.concatenate([f, *(i * k + j + t * k * k for t, (i, j) in enumerate(best))])
    order = np.lexsort((f, row))
    row, f = row[order], f[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (f[1:] != f[:-1])
    row, f = row[new], f[new]
    return np.split(f, np.searchsorted(row, np.arange(1, len(unit))))


def _unit(vectors: list | np.ndarray) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filtered(k: int, cosine: float, kind: str):
    """A row for each vector and filter: the vector as it came, and the list of all its filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin in range(0, b.num_rows, 512):
                part = b.slice(begin, 512)
                cid, m = part.column(0).to_numpy(), part.column(1).to_numpy()
                raw = part.column(2).to_pylist()
                sizes = np.array([len(v) for v in raw])
                for dim in np.unique(sizes):
                    at = np.flatnonzero(sizes == dim)
                    unit = _unit([raw[i] for i in at])
                    wide = unit if dim > 1 else np.pad(unit, ((0, 0), (0, 1)))
                    lists = decode(wide, k, cosine)
                    n = [len(x) for x in lists]
                    row = pa.array(np.repeat(np.arange(len(at)), n))
                    vec = pa.array([np.array(raw[i], kind).tobytes() for i in at], pa.binary())
                    every = pa.array([x.astype(np.int32).tobytes() for x in lists], pa.binary())
                    yield pa.record_batch([pa.array(np.full(sum(n), dim, np.int32)), pa.array(np.concatenate(lists).astype(np.int32)), pa.array(cid[at]).take(row), pa.array(m[at]).take(row), vec.take(row), every.take(row)], ["dim", "f", "cid", "m", "vec", "every"])

    return run


def _matched(cosine: float, kind: str):
    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        f, n = int(key[1]), len(rows)
        x = _unit(np.frombuffer(b"".join(rows["vec"]), kind).reshape(n, -1))
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        blk = rows["blk"].to_numpy()
        lo, hi = int(key[2]), int(key[3])
        if lo != hi:
            near &= blk[:, None] != blk[None, :]
        used = np.flatnonzero(near.any(1))
        if not len(used):
            return pd.DataFrame({"cid": np.zeros(0, np.int64), "c": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)})
        near = near[np.ix_(used, used)]
        cid, m = rows["cid"].to_numpy()[used], rows["m"].to_numpy()[used]
        lists = [np.frombuffer(v, np.int32) for v in rows["every"].iloc[used]]
        smaller = [v[v < f] for v in lists]
        names, col = np.unique(np.concatenate(smaller), return_inverse=True)
        if len(names):
            row, own = np.repeat(np.arange(len(used)), [len(v) for v in smaller]), near.copy()
            order = np.argsort(col, kind="stable")
            row, col = row[order], col[order]
            for begin in range(0, len(names), COLUMNS):
                a, b = np.searchsorted(col, (begin, begin + COLUMNS))
                has = np.zeros((len(used), min(COLUMNS, len(names) - begin)), np.float32)
                has[row[a:b], col[a:b] - begin] = 1
                own &= has @ has.T == 0
        else:
            own = near
        label = np.arange(len(used))
        while True:
            least = np.minimum(label, np.where(near, label[None, :], len(used)).min(1))
            least = least[least]
            if (least == label).all():
                break
            label = least
        return pd.DataFrame({"cid": cid, "c": own @ m.astype(np.int64), "other": cid[label]})

    return one


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id long, embedding array of numbers).

    Vectors that are null, empty, zero, or hold null, NaN or infinite components
    link with nothing, as do vectors of different lengths. Equal vectors are one
    class with a count, so copies cost nothing. Rows that share a vec_id are
    vectors each for itself.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    v = F.col("embedding").cast("array<double>")
    bad = F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0), F.lit(True))
    rows = vectors.select("vec_id", F.when(~bad, v).alias("v")).withColumn("cid", F.when(F.col("v").isNotNull(), F.xxhash64(F.transform("v", lambda x: x + 0.0))))
    rows = written(rows, "vectors")
    classes = rows.where("cid is not null").groupBy("cid").agg(F.count("*").alias("m"), F.min("vec_id").alias("rep"), F.first("v").alias("v"))
    classes = written(classes, "classes")
    k = 1 << max(3, ceil(log2(sqrt(max(1, classes.count() / LOAD)))))
    listed = classes.repartition(partitions(spark), "cid").select("cid", "m", "v").mapInArrow(_filtered(k, cosine, kind), "dim int, f int, cid long, m long, vec binary, every binary")
    listed = written(listed, "listed")
    long = listed.groupBy("dim", "f").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    listed = listed.join(written(long.drop("n"), "long"), ["dim", "f"]).withColumn("blk", F.pmod(F.hash("cid"), F.col("blocks")))
    listed = listed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other")).drop("other", "blocks")
    found = listed.groupBy("dim", "f", "lo", "hi").applyInPandas(_matched(cosine, kind), "cid long, c long, other long")
    found = written(found, "found")
    links = found.groupBy("cid").agg(F.sum("c").alias("c"))
    labels = components(found.select(F.col("cid").alias("x"), F.col("other").alias("y"))).withColumnRenamed("node", "cid")
    groups = classes.select("cid", "m", "rep").join(links, "cid", "left").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    groups = written(groups, "groups")
    least = groups.groupBy("label").agg(F.min("rep").alias("component_id"))
    of = written(groups.join(least, "label").select("cid", (F.coalesce("c", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id"), "of")
    out = rows.select("vec_id", "cid").join(of, "cid", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
