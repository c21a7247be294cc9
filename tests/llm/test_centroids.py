"""Clusters beside plain k-means in Python's integers, and trees beside all distances."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.llm import centroids


def plain(rows, clusters=8, rounds=10, dim=64):
    """rows: (vec_id, components or None)."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, z)), k) for k, z in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for z in set(own):
            vs = [v for (_, v), o in zip(kept, own) if o == z]
            c[z] = [sum(col) // len(vs) for col in zip(*vs)]
    got = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {z: sum(d for _, k, d in got if k == z) for z in range(len(c))}
    long = lambda v: v if v < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, z)).encode()).hexdigest() for z in c]
    beyond = {z: any(long(d) is None for _, k, d in got if k == z) for z in range(len(c))}
    total = None if any(beyond.values()) else long(sum(inertia.values()))
    return sorted(((i, k, long(d), None if beyond[k] else long(inertia[k]), total, digest[k]) for i, k, d in got), key=repr)


def held(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for c in ("cluster", "distance", "h", "ids", "x", "f", "inertia"):
        df = df.withColumn(c, F.lit("other"))
    return sorted(map(tuple, centroids.cluster(df, **how).collect()), key=repr)


def test_all_vectors(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = plain([(r.vec_id, r.embedding) for r in df.collect()])
    assert sorted(map(tuple, centroids.cluster(df).collect()), key=repr) == want and len(want) > 100


@pytest.mark.parametrize("wide", [False, True])
def test_odd_vectors(spark, monkeypatch, wide):
    """Nulls, other lengths, ties, copies, repeated and missing ids; with components that no double or no 64 bits hold exactly."""
    monkeypatch.setattr(centroids, "BLOCK", 50)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 4)]) for i in range(150)]
    rows += [(150 + i, [0.5, 0.25, -0.125, 0.0]) for i in range(120)]
    rows += [(7, [3.0, 3.0, 3.0, 3.0]), (7, [3.0, 3.0, 3.0, 3.0]), (None, [1.0, 1.0, 1.0, 1.0]), (400, None), (401, []), (402, [1.0, None, 1.0, 1.0]), (403, [1.0, math.nan, 0.0, 0.0]), (404, [math.inf, 0.0, 0.0, 0.0]), (405, [1.0] * 5), (406, [-0.0001, -0.0, 1e-300, 0.99999])]
    if wide:
        rows += [(500 + i, [1e6 * (i + 1), -1e6, 3e5, 1.0]) for i in range(4)] + [(510, [1e12, 1e12, 0.0, 0.0]), (511, [-1e12, 5.0, 0.0, 0.0]), (512, [2.0**33, 7.0, 0.0, 0.0])]
    assert held(spark, rows, dim=4) == plain(rows, dim=4)
    assert held(spark, rows, dim=4, clusters=3, rounds=2) == plain(rows, dim=4, clusters=3, rounds=2)


def test_few_and_no_vectors(spark):
    assert held(spark, [(1, [1.0] * 64), (2, [2.0] * 64), (3, None)]) == plain([(1, [1.0] * 64), (2, [2.0] * 64)])
    assert held(spark, [(1, None), (2, [1.0])]) == [] and held(spark, []) == []
    assert held(spark, [(None, [1.0] * 64)]) == []


@pytest.mark.parametrize("kind", [np.int64, object])
def test_trees(kind):
    """Every row gets its nearest centroid; clusters far apart are assigned by whole nodes."""
    rng = np.random.default_rng(1)
    for dim, spread, n in ((1, 5, 300), (2, 3, 500), (8, 100, 700), (64, 4, 400), (64, 4000, 400)):
        c = rng.integers(-9000, 9000, (6, dim))
        x = (c[rng.integers(0, 6, n)] + rng.integers(-spread, spread + 1, (n, dim))).astype(np.int32)
        x[: n // 3] = x[0]
        c[5] = c[0]
        t = centroids.Tree(x)
        want = (((t.x[:, None, :].astype(np.int64) - c) ** 2).sum(2)).argmin(1)
        label, single = np.full(n, -1), 0
        for nodes, rows, labels in centroids.visit(t, c.astype(kind)):
            label[rows] = labels if len(rows) else -1
            single += len(rows)
            for node, z in zip(nodes, labels):
                label[t.begin[node] : t.end[node]] = z
        assert (label == want).all() and sorted(t.order) == list(range(n))
        assert (t.sums[0] == x.sum(0)).all()
        if dim == 64 and spread == 4:
            assert single < n / 2
