"""Bitmaps over 64-bit keys: which rows are worth sending on. Their size follows the number of keys up to a bound; a bit set by chance costs time, never a result, as what passes is joined with the keys themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernel import U, mix
from .spill import partitions

#: Bits for each key, and the most bits of a bitmap (64 MB).
BITS_PER_KEY, MOST_BITS = 16, 1 << 29


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys ^ U(0x5BD1E995)) & U(bits - 1)).astype(np.int64)


def bitmap(keys: DataFrame, bits: int | None = None) -> np.ndarray:
    """Packed bits of the slots of the only column (long, no null), as many as suit the number of keys. Each task fills slices, and only these, of bits / 8 bytes in all, are gathered."""
    if bits is None:
        bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_PER_KEY * keys.count()).bit_length()))
    slices = min(64, max(1, bits >> 12))
    size = bits // slices

    def packed(s: int, m: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([s], pa.int32()), pa.array([np.packbits(m, bitorder="little").tobytes()], pa.binary())], ["s", "bits"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for b in batches:
            at = _slot(b.column(0).to_numpy().view(U), bits)
            for s in np.unique(at // size):
                m = maps.setdefault(int(s), np.zeros(size, bool))
                m[at[at // size == s] - s * size] = True
        for s, m in maps.items():
            yield packed(s, m)

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for b in batches:
            for s, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                m = np.frombuffer(raw, np.uint8)
                maps[s] = maps[s] | m if s in maps else m
        for s, m in maps.items():
            yield pa.record_batch([pa.array([s], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["s", "bits"])

    kind = "s int, bits binary"
    n = min(slices, partitions(keys.sparkSession))
    out = np.zeros(bits // 8, np.uint8)
    for r in keys.mapInArrow(fill, kind).repartition(n, "s").mapInArrow(union, kind).collect():
        out[r.s * size // 8 : (r.s + 1) * size // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _slot(keys, len(bits) * 8)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
