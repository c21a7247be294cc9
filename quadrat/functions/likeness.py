"""Ratcliff-Obershelp likeness of many pairs of texts at once."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Sequence

import numpy as np

#: Pairs compared at once; from ``LONG`` characters on, difflib leaves frequent ones out, and pairs go to it singly. Places of a text of at most ``SHORT`` are bits of one number, and ``PAIRS`` such pairs fit a core's cache.
BLOCK, LONG, SHORT, PAIRS = 1000, 200, 64, 8192


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a row a text, and lengths."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    out = np.zeros((len(texts), int(n.max(initial=0)) or 1), np.uint32)
    out[np.repeat(np.arange(len(texts)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out, n


def matched(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Characters in the common blocks of each pair: its longest one, of equal ones the first in a and then in b, and so on to the left and right of it."""
    total = np.zeros(len(a), np.int64)
    (ca, na), (cb, nb) = _codes(a), _codes(b)
    kind = np.uint8 if max(ca.max(initial=0), cb.max(initial=0)) < 254 else np.uint32
    ca, cb, top = ca.astype(kind), cb.astype(kind), np.iinfo(kind).max
    none = np.zeros(len(a), np.int64)
    parts = np.stack([np.arange(len(a)), none, na, none, nb])
    while True:
        parts = parts[:, (parts[1] < parts[2]) & (parts[3] < parts[4])]
        if not parts.shape[1]:
            return total
        row, a0, a1, b0, b1 = parts
        la, lb = int((a1 - a0).max()), int((b1 - b0).max())
        # a line a place, with pairs side by side; what lies beyond a part equals nothing
        x = ca[row, np.minimum(a0 + np.arange(la)[:, None], ca.shape[1] - 1)]
        y = cb[row, np.minimum(b0 + np.arange(lb)[:, None], cb.shape[1] - 1)]
        x[np.arange(la)[:, None] >= a1 - a0] = top
        y[np.arange(lb)[:, None] >= b1 - b0] = top - 1
        run = np.zeros((lb + 1, len(row)), np.uint8)
        best, i_end, j_end = np.zeros(len(row), np.uint8), np.zeros_like(row), np.zeros_like(row)
        for i in range(la):
            run[1:] = (run[:-1] + np.uint8(1)) * (y == x[i])
            longest = run.max(axis=0)
            new = np.flatnonzero(longest > best)
            best[new], i_end[new], j_end[new] = longest[new], i + 1, run[:, new].argmax(axis=0)
        np.add.at(total, row, best)
        size, i_end, j_end = best.astype(np.int64), a0 + i_end, b0 + j_end
        parts = np.concatenate([np.stack([row, a0, i_end - size, b0, j_end - size]), np.stack([row, i_end, a1, j_end, b1])], axis=1)[:, np.tile(size > 0, 2)]


def ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """``difflib.SequenceMatcher(None, x, y).ratio()`` of each pair."""
    n = np.fromiter((len(x) + len(y) for x, y in zip(a, b, strict=True)), np.int64, len(a))
    out = np.ones(len(a))
    order = np.argsort(n, kind="stable")
    long = np.fromiter((max(len(a[i]), len(b[i])) >= LONG for i in order), bool, len(a))
    for i in order[long]:
        out[i] = difflib.SequenceMatcher(None, a[i], b[i]).ratio()
    short = order[~long & (n[order] > 0)]
    for at in np.split(short, range(BLOCK, len(short), BLOCK)):
        out[at] = 2.0 * matched([a[i] for i in at], [b[i] for i in at]) / n[at]
    return out


class Lists:
    """Two lists of texts, those of the second at most ``SHORT`` long, for comparisons of many of their pairs."""

    def __init__(self, a: Sequence[str], b: Sequence[str]):
        (ca, self.na), (cb, self.nb) = _codes(a), _codes(b)
        self.kind = np.uint32 if cb.shape[1] <= 32 else np.uint64
        kinds, at = np.unique(cb, return_inverse=True)
        at = at.reshape(cb.shape)
        #: Where in each text of b a character is; the last row is of all others.
        self.places = np.zeros((len(kinds) + 1, len(b)), self.kind)
        for j in range(int(self.nb.max(initial=0))):
            has = np.flatnonzero(j < self.nb)
            self.places[at[has, j], has] |= self.kind(1 << j)
        near = np.minimum(np.searchsorted(kinds, ca), len(kinds) - 1)
        #: The row of each of a's characters, from the beginning of ``places`` on; a line a place.
        self.rows = np.ascontiguousarray(np.where(kinds[near] == ca, near, len(kinds)).T * len(b))
        self.every = np.bitwise_or.reduce(self.places, axis=0)

    def matched(self, ia: np.ndarray, ib: np.ndarray, settled: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """``matched`` of pairs by their places in a and b. A pair that is settled by its characters so far, and the most that can be added to them, goes no further."""
        total, one = np.zeros(len(ia), np.int64), self.kind(1)
        pair, a0, a1, mask = np.arange(len(ia)), np.zeros(len(ia), np.int64), self.na[ia], self.every[ib]
        while pair.size:
            n = a1 - a0
            most, x = int(n.max()), ia[pair]
            if a0.any():
                at = np.minimum(a0 + np.arange(most)[:, None], len(self.rows) - 1)
                at *= self.rows.shape[1]
                at += x
                at = self.rows.ravel().take(at)
            else:
                at = self.rows[:most].take(x, axis=1)
            at += ib[pair]
            has = self.places.ravel().take(at)
            has &= mask
            if n.min() < len(has):
                has[np.arange(len(has))[:, None] >= n] = 0
            size, i_end, last = _longest(has)
            total += np.bincount(pair, size, len(ia)).astype(np.int64)
            first = last >> np.maximum(size - 1, 0).astype(self.kind)
            left = (pair, a0, a0 + i_end + 1 - size, mask & (first - one))
            right = (pair, a0 + i_end + 1, a1, mask & ~((last << one) - one))
            on = np.tile(size > 0, 2)
            pair, a0, a1, mask = (np.concatenate(x) for x in zip(left, right, strict=True))
            on &= (a0 < a1) & (mask != 0)
            if settled is not None:
                rest = np.bincount(pair[on], np.minimum(a1 - a0, np.bitwise_count(mask))[on], len(ia)).astype(np.int64)
                on &= ~settled(total, rest)[pair]
            pair, a0, a1, mask = pair[on], a0[on], a1[on], mask[on]
        return total


def _longest(has: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each column: size of its longest run, the line where the first such run ends, and the bit where the first of these does. A run goes on from a line's bit to the next line's next bit."""
    bits = has.dtype.type

    def longer(by: np.ndarray, of: np.ndarray, s: int) -> np.ndarray:
        """Where runs end that are of a size and s more: of s in ``by``, after those in ``of``."""
        out = np.empty_like(by)
        out[:s] = 0
        np.left_shift(of[:-s], bits(s), out=out[s:])
        out[s:] &= by[s:]
        return out

    runs, s = [has], 1
    while s < len(has):  # runs[k]: where runs of 2^k end
        more = longer(runs[-1], runs[-1], s)
        if not more.any():
            break
        runs.append(more)
        s *= 2
    best = runs.pop()
    size = s * (np.bitwise_or.reduce(best, axis=0) != 0)
    while runs:
        by, s = runs.pop(), s // 2
        more, none = longer(by, best, s), size == 0
        if none.any():
            more = np.where(none, by, more)
        found = np.bitwise_or.reduce(more, axis=0) != 0
        best = more if found.all() else np.where(found, more, best)
        size += s * found
    i_end = (best != 0).argmax(axis=0)
    at = best[i_end, np.arange(has.shape[1])]
    return size, i_end, at & (~at + bits(1))
