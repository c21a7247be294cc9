"""Centroid clustering in exact integers, by kd-tree filtering.

Vectors are dealt into blocks of ``BLOCK`` rows of their partition. A block is
written once with its kd-tree, whose nodes hold their vectors' count, integer
sums and box. A round sends the centroids to the blocks and walks the trees
downwards, a level at a time: a centroid goes where another one, the nearest to
the box's middle, is strictly nearer at every point of the box; a node with one
centroid left is assigned as a whole; what is left at the leaves is resolved
vector by vector, ties to the smaller number. A task returns a count and sums a
cluster, so a round moves clusters x dimensions numbers a task and no vector.

Dot products of components below ``small(dim)`` are exact in doubles. A vector
with larger ones stays outside the trees, and everything it touches is computed
with Python's integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spill import bounded_batches, written

DIM, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Vectors of a block, and of a leaf.
BLOCK, LEAF = 2048, 32
#: Bytes of a row group of blocks: Parquet's reader holds one at a time.
GROUP_BYTES = 16 << 20
#: Components from which a squared distance is beyond 64 bits for most partners; such vectors aren't kept.
WIDEST = float(1 << 62)
_ARRAYS = {"x": np.int32, "lo": np.int32, "hi": np.int32, "sums": np.int64, "begin": np.int32, "end": np.int32, "left": np.int32, "loose": np.int64}


def small(dim: int) -> int:
    """Components below this have dot products, of differences too, that doubles hold exactly."""
    return isqrt((1 << 50) // dim)


class Tree:
    """A kd-tree over rows of x, which it puts in its own order: nodes level by level, children of node i at left[i] and left[i] + 1."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        begin, end, left, boxes = [0], [len(x)], [], []
        for i in range(2 * len(x)):
            if i == len(begin):
                break
            b, e = begin[i], end[i]
            own = x[self.order[b:e]]
            lo, hi = own.min(0), own.max(0)
            boxes.append((lo, hi, own.sum(0, dtype=np.int64)))
            d = int((hi - lo).argmax())
            if e - b <= leaf or lo[d] == hi[d]:
                left.append(-1)
                continue
            half = (e - b) // 2
            self.order[b:e] = self.order[b:e][np.argpartition(own[:, d], half)]
            left.append(len(begin))
            begin += [b, b + half]
            end += [b + half, e]
        self.x = x[self.order]
        self.begin, self.end, self.left = (np.array(a, np.int32) for a in (begin, end, left))
        self.lo, self.hi, self.sums = (np.array(a).reshape(-1, x.shape[1]) for a in zip(*boxes, strict=True))


def visit(t, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, rows, labels): nodes assigned as a whole, with no rows, or rows of x resolved one by one, with no nodes."""
    exact = np.float64 if c.dtype != object else object
    c = c.astype(exact)
    square = (c * c).sum(1)
    none = np.zeros(0, np.int64)
    nodes, live = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
    while len(nodes):
        lo, hi = t.lo[nodes].astype(exact), t.hi[nodes].astype(exact)
        middle = square - (lo + hi) @ c.T
        best = np.where(live, middle, middle.max() + 1).argmin(1)
        for b in np.unique(best):
            g = np.flatnonzero(best == b)
            u = c - c[b]
            most = hi[g] @ np.maximum(u, 0).T + lo[g] @ np.minimum(u, 0).T
            live[g] &= ~(square - square[b] - 2 * most > 0).astype(bool)
        whole = live.sum(1) == 1
        yield nodes[whole], none, live[whole].argmax(1)
        leaf = ~whole & (t.left[nodes] < 0)
        point = leaf & (t.lo[nodes] == t.hi[nodes]).all(1)
        yield nodes[point], none, (square - 2 * lo[point] @ c.T).argmin(1)
        if len(ends := nodes[leaf & ~point]):
            rows = np.concatenate([np.arange(t.begin[i], t.end[i]) for i in ends])
            yield none, rows, (square - 2 * t.x[rows].astype(exact) @ c.T).argmin(1)
        inner = ~whole & ~leaf
        nodes, live = np.concatenate([t.left[nodes[inner]], t.left[nodes[inner]] + 1]).astype(np.int64), np.concatenate([live[inner]] * 2)


class _Read:
    """A block as it was written."""

    def __init__(self, batch: pa.RecordBatch, i: int, dim: int):
        for name, kind in _ARRAYS.items():
            a = np.frombuffer(batch.column(name)[i].as_buffer(), kind)
            setattr(self, name, a.reshape(-1, dim) if name in ("x", "lo", "hi", "sums", "loose") else a)


def _whole_numbers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the kept vectors, and their components times ``SCALE``, rounded down."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.flatnonzero(pc.equal(pc.list_value_length(column), dim).fill_null(False).to_numpy(zero_copy_only=False))
    x = column.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(all="ignore"):
        x = np.floor(SCALE * x)
        ok = (np.abs(x) < WIDEST).all(1)
    return at[ok], x[ok].astype(np.int64)


def _blocks(dim: int, clusters: int, schema: pa.Schema):
    bound = small(dim)

    def block(ids: pa.Array, x: np.ndarray, hashes: list[str]) -> pa.RecordBatch:
        firsts = sorted((h, x[i].tolist()) for i, h in enumerate(hashes) if h is not None)[:clusters]
        loose = (np.abs(x) >= bound).any(1)
        inside, outside = np.flatnonzero(~loose), np.flatnonzero(loose)
        row = dict.fromkeys(_ARRAYS, b"")
        if len(inside):
            t = Tree(x[inside].astype(np.int32))
            inside = inside[t.order]
            row |= {name: getattr(t, name).astype(kind).tobytes() for name, kind in _ARRAYS.items() if name != "loose"}
        row["loose"] = x[outside].tobytes()
        ids = ids.take(pa.array(np.concatenate([inside, outside])))
        columns = {"ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "firsts": pa.array([[{"h": h, "x": v} for h, v in firsts]], schema.field("firsts").type)}
        return pa.record_batch([columns.get(f.name, pa.array([row.get(f.name)], f.type)) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs, hashes, n = [], [], [], 0
        for b in batches:
            at, x = _whole_numbers(b.column(1), dim)
            ids.append(b.column(0).take(pa.array(at)))
            hashes += b.column(2).take(pa.array(at)).to_pylist()
            xs.append(x)
            n += len(x)
            while n >= BLOCK:
                every, x = pa.concat_arrays(ids), np.concatenate(xs)
                yield block(every[:BLOCK], x[:BLOCK], hashes[:BLOCK])
                ids, xs, hashes, n = [every[BLOCK:]], [x[BLOCK:]], hashes[BLOCK:], n - BLOCK
        if n:
            yield block(pa.concat_arrays(ids), np.concatenate(xs), hashes)

    return run


def _kind(c: list[list[int]], dim: int) -> np.ndarray:
    return np.array(c, np.int64 if all(abs(v) < small(dim) for z in c for v in z) else object).reshape(-1, dim)


def _nearest(v: np.ndarray, c: np.ndarray) -> tuple[int, int]:
    """Number and squared distance, in Python's integers."""
    d = ((c.astype(object) - v.astype(object)) ** 2).sum(1)
    return int(d.argmin()), int(d.min())


def _sums(centroids: list[list[int]], dim: int):
    """For each cluster of a task: the number of its vectors (dim -1) and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, k = _kind(centroids, dim), len(centroids)
        count, total = np.zeros(k, object), np.zeros((k, dim), object)
        for b in batches:
            for i in range(b.num_rows):
                t = _Read(b, i, dim)
                n, s = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
                for nodes, rows, labels in visit(t, c) if len(t.x) else ():
                    np.add.at(n, labels, t.end[nodes] - t.begin[nodes] if len(nodes) else 1)
                    if len(nodes):
                        np.add.at(s, labels, t.sums[nodes])
                    elif len(rows):
                        s += ((labels == np.arange(k)[:, None]).astype(np.float64) @ t.x[rows].astype(np.float64)).astype(np.int64)
                count, total = count + n, total + s
                for v in t.loose:
                    z, _ = _nearest(v, c)
                    count[z] += 1
                    total[z] += v.astype(object)
        some = [z for z in range(k) if count[z]]
        rows = [(z, -1, count[z]) for z in some] + [(z, d, total[z, d]) for z in some for d in range(dim)]
        z, d, s = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.record_batch([pa.array(z, pa.int32()), pa.array(d, pa.int32()), pa.array(map(int, s), pa.decimal128(38, 0))], ["cluster", "dim", "total"])

    return run


def _assigned(centroids: list[list[int]], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _kind(centroids, dim)
        for b in batches:
            for i in range(b.num_rows):
                t = _Read(b, i, dim)
                label = np.zeros(len(t.x), np.int32)
                for nodes, rows, labels in visit(t, c) if len(t.x) else ():
                    label[rows] = labels if len(rows) else 0
                    for node, z in zip(nodes, labels, strict=False):
                        label[t.begin[node] : t.end[node]] = z
                d = ((t.x.astype(c.dtype) - c[label]) ** 2).sum(1).tolist()
                far = [_nearest(v, c) for v in t.loose]
                cluster = [*label.tolist(), *(z for z, _ in far)]
                d = [int(v) if v < 1 << 63 else None for v in (*d, *(v for _, v in far))]
                yield pa.record_batch([b.column("ids")[i].values, pa.array(cluster, pa.int32()), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def blocks(vectors: DataFrame, dim: int = DIM, clusters: int = CLUSTERS, seed: int = SEED) -> DataFrame:
    """The kept vectors as a written table of blocks with their trees: ids, the arrays of the tree, and the block's candidates for first centroids."""
    bounded_batches(vectors.sparkSession)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    source = vectors.select("vec_id", "embedding", hashed.alias("h"))
    types = f"ids array<{kind}>, {', '.join(f'{a} binary' for a in _ARRAYS)}, firsts array<struct<h: string, x: array<bigint>>>"
    shape = source.sparkSession.createDataFrame([], types).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    return written(source.mapInArrow(_blocks(dim, clusters, to_arrow_schema(shape)), shape), "kd-blocks", **{"parquet.block.size": GROUP_BYTES})


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each kept row of vectors (vec_id, embedding).

    Kept are vectors of ``dim`` components, none null or non-finite; components
    x count as floor(1024 * x). Rows are vectors of their own, repeated ones
    too. First centroids are the kept vectors of the smallest sha256 of
    ``<seed>:<vec_id>``, ties by their components; rows without vec_id are
    clustered, but are no first ones. Fewer such vectors than clusters make
    fewer clusters, none no rows. A centroid without vectors stays. Not kept
    are components of 2**52 and more (times 1024 they leave 64 bits); a
    distance or sum beyond 64 bits is null. Driven are ``rounds`` jobs, or
    fewer once no centroid moves; a round returns clusters x (dim + 1) numbers.
    """
    spark = vectors.sparkSession
    every = blocks(vectors, dim, clusters, seed)
    seeds = every.select(F.explode("firsts").alias("f")).select("f.h", "f.x").orderBy("h", "x").limit(clusters).collect()
    c = [list(r.x) for r in seeds]
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not c:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    trees = every.select(*_ARRAYS)
    for _ in range(rounds):
        got: dict[int, dict[int, int]] = {}
        for r in trees.mapInArrow(_sums(c, dim), "cluster int, dim int, total decimal(38,0)").groupBy("cluster", "dim").agg(F.sum("total").alias("total")).collect():
            got.setdefault(r["cluster"], {})[r["dim"]] = int(r["total"])
        moved = [[got[z][d] // got[z][-1] for d in range(dim)] if z in got else c[z] for z in range(len(c))]
        if moved == c:
            break
        c = moved
    out = written(every.select("ids", *_ARRAYS).mapInArrow(_assigned(c, dim), f"vec_id {kind}, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: None if r["beyond"] else int(r["total"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.sum(F.col("distance").isNull().cast("int")).alias("beyond")).collect()}
    fits = lambda v: v if v is not None and v < 1 << 63 else None
    total = None if None in sums.values() else sum(sums.values())
    at = lambda values, kind: F.get(F.array(*(F.lit(v).cast(kind) for v in values)), "cluster")
    digests = [hashlib.sha256(",".join(map(str, z)).encode()).hexdigest() for z in c]
    return out.select(
        "vec_id", "cluster", "distance", at([fits(sums.get(z)) for z in range(len(c))], "long").alias("cluster_inertia"), F.lit(fits(total)).cast("long").alias("inertia"), at(digests, "string").alias("centroid_sha256")
    )


def oracle_sql(rounds: int = ROUNDS) -> str:
    """DuckDB SQL for ``cluster`` with the other parameters' defaults; vec_id is a key."""
    distance = "list_sum([(v[i] - z[i]) * (v[i] - z[i]) FOR i IN range(1, 65)])"
    nearest = "a{0} AS MATERIALIZED (SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, v, c, {1} AS d FROM kept, z{0}) GROUP BY ALL)"
    moved = """z{1} AS MATERIALIZED (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS z FROM (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{0}, range(1, 65) t(i) GROUP BY ALL) GROUP BY c
UNION ALL SELECT c, z FROM z{0} WHERE c NOT IN (SELECT c FROM a{0}))"""
    steps = [s for r in range(rounds) for s in (nearest.format(r, distance), moved.format(r, r + 1))] + [nearest.format(rounds, distance)]
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
z0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v::HUGEINT[] AS z FROM kept ORDER BY sha256('3:' || vec_id) LIMIT 8),
{(", " + chr(10)).join(steps)}
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(z, ',')) AS centroid_sha256 FROM a{rounds} JOIN z{rounds} USING (c)
"""
