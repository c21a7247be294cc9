"""Vectorised words and hashes over Arrow string columns.

Texts stay UTF-8 bytes: one byte table marks separators, and words are hashed
eight bytes at a time, all words of a slice at once, so no Python object is
made per word. The state is scrambled between steps, so texts built for
polynomial hashes (Thue-Morse words) don't meet; words of more than ``LONG``
bytes go by BLAKE2. Hashes of n-grams are polynomials of word hashes: sequences
that would meet there are longer than any n-gram here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 19
#: Bytes of a word up to which its hash is computed with those of other words.
LONG = 128

_Q = 0xC2B2AE3D27D4EB4F
#: The first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], U)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[65:91] += 32
#: ASCII letters and digits, and every byte of a non-ASCII character, make words.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = 1 << max(10, (n - 1).bit_length())
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(m, U(b))
                a[0] = U(1)
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_WORDS = _Powers(_Q)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and the n + 1 places where they begin and end; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of slices of about ``limit`` bytes; a longer text is a slice of its own."""
    data, at = buffers(texts)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans. Equal bytes have equal hashes, wherever they stand."""
    wide = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray((len(data) + 1,), "<u8", wide, strides=(1,))
    size = end - start
    h = mix(size.astype(U) + U(0x9E3779B97F4A7C15))
    rows, at, left = slice(None), start, size
    for _ in range(0, LONG, 8):
        h[rows] = mix(mix(h[rows] ^ U(0x2545F4914F6CDD1D)) + (eight[at] & _FIRST[np.minimum(left, 8)]))
        if not (more := left > 8).any():
            break
        rows = np.flatnonzero(more) if isinstance(rows, slice) else rows[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


class Words:
    """The words of a slice: byte spans, 64-bit hashes, and for each text the range of its words."""

    def __init__(self, data: np.ndarray, at: np.ndarray, separator: np.ndarray = SPACE, case: np.ndarray = IDENTITY, hashes: bool = True):
        n = len(data)
        word = ~separator[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = at[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.start, at)
        self.data = data if case is IDENTITY else case[data]
        if hashes:
            self.hash = word_hashes(self.data, self.start, self.end)

    def word(self, i: int) -> bytes:
        """The bytes of a word, in the case that was asked for."""
        return self.data[self.start[i] : self.end[i]].tobytes()

    def grams(self, k: int) -> np.ndarray:
        """Hash of each k consecutive words; those that begin at word j, for every j up to the slice's last k words. Text borders are not heeded."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, U)
        up, down = _WORDS.get(n + 1)
        sums = np.zeros(n + 1, U)
        np.cumsum(self.hash * up[:n], out=sums[1:])
        m = n - k + 1
        return mix((sums[k:] - sums[:m]) * down[:m] + U(k))

    def inside(self, k: int) -> np.ndarray:
        """Of the places of grams(k), True where all k words are of one text."""
        m = max(0, len(self.start) - k + 1)
        ok = np.zeros(m + 1, np.int32)
        a, b = self.of[:-1], self.of[1:] - k + 1
        full = b > a
        np.add.at(ok, a[full], 1)
        np.add.at(ok, b[full], -1)
        return np.cumsum(ok[:m]) > 0


def sliding_min(v: np.ndarray, s: int) -> np.ndarray:
    """The least of each s consecutive values."""
    m, w = v, 1
    while 2 * w <= s:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[: len(m) - (s - w)], m[s - w :]) if s > w else m


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)
