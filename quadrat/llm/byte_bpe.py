"""Byte-level BPE encoding and decoding by two-tier lookup.

A text is split by the vocabulary's pattern. Tier one looks all pre-tokens of a
slice up at once in a minimal perfect hash of the vocabulary: a bucket of the
hash gives a displacement, the displaced hash the one slot a key can be in, and
the slot's bytes are compared. So a pre-token that is a token costs no Python
object. Tier two takes the misses: their bytes are a linked list, a heap holds
the pairs that may merge by rank and place, and the least is merged until none
is left. Encodings of short misses are kept by worker.

Decoding joins the ids' bytes. Both give what the library gives for ordinary
text: no special tokens, each match of the pattern by itself.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice
from struct import pack as _pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U, mix, word_hashes
from .spill import bounded_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Keys of a bucket of the perfect hash, on average.
BUCKET = 3
#: Pre-tokens that go through the tables at once, and characters of texts that are gathered for that.
SLICE, GATHERED = 1 << 16, 1 << 18
#: Misses whose encoding a worker keeps, in each of two generations, and the most bytes of one.
KEPT, SHORT = 250_000, 64


class PerfectHash:
    """A minimal perfect hash: n keys, n slots. Buckets are placed from the fullest on, each with the first displacement that leads its keys to free slots."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.n, self.buckets = n, max(1, n // BUCKET)
        if len(np.unique(hashes)) < n:
            raise ValueError("two keys have one hash")
        self.shift = np.zeros(self.buckets, U)
        self.key = np.zeros(n, np.int64)
        bucket = (hashes % U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        begin = np.cumsum(sizes) - sizes
        taken = np.zeros(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            if not sizes[b]:
                break
            keys = order[begin[b] : begin[b] + sizes[b]]
            h, first, width = hashes[keys], 0, 64
            while True:
                slots = (mix(h[None, :] + np.arange(first, first + width, dtype=U)[:, None] * U(0x9E3779B97F4A7C15)) % U(n)).astype(np.int64)
                free = ~taken[slots].any(1)
                if len(keys) > 1:
                    free &= (np.diff(np.sort(slots, 1), axis=1) > 0).all(1)
                if free.any():
                    break
                first, width = first + width, min(2 * width, 1 << 16)
            i = int(free.argmax())
            self.shift[b] = first + i
            taken[slots[i]] = True
            self.key[slots[i]] = keys

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The only key that each hash can be of."""
        shift = self.shift[(hashes % U(self.buckets)).astype(np.int64)]
        return self.key[(mix(hashes + shift * U(0x9E3779B97F4A7C15)) % U(self.n)).astype(np.int64)]


class Vocabulary:
    """Tokens and ranks of a file of base64 tokens, and both tiers over them."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        tokens = list(self.ranks)
        self.ids = np.array(list(self.ranks.values()), np.int64)
        self.bytes = dict(zip(self.ranks.values(), tokens, strict=True))
        self.size = np.array(list(map(len, tokens)), np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.slots = PerfectHash(word_hashes(self.data, self.at, self.at + self.size))
        self.longest = int(self.size.max())
        self.decimal = np.array([b""] * (max(self.bytes) + 1), object)
        self.raw = self.decimal.copy()
        for token, rank in self.ranks.items():
            self.decimal[rank], self.raw[rank] = str(rank).encode(), token
        self.pairs = [self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.new, self.old = {}, {}

    def whole(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tier one: ids of the spans that are tokens, -1 for others."""
        if not len(begin):
            return np.zeros(0, np.int64)
        key = self.slots.find(word_hashes(data, begin, end))
        hit = self.size[key] == end - begin
        rows = np.flatnonzero(hit)
        size = self.size[key[rows]]
        start = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(start, size)
        same = data[np.repeat(begin[rows], size) + step] == self.data[np.repeat(self.at[key[rows]], size) + step]
        hit[rows[np.repeat(np.arange(len(rows)), size)[~same]]] = False
        return np.where(hit, self.ids[key], -1)

    def merged(self, word: bytes) -> list[int]:
        """Tier two: a heap over linked bytes. An entry is a number: rank, place and length, so the least rank comes first, and of equal ones the leftmost."""
        ranks, longest, pairs, n = self.ranks, self.longest, self.pairs, len(word)
        wide = longest + 1
        heap = [(r * n + i) * wide + 2 for i, (a, b) in enumerate(zip(word, word[1:])) if (r := pairs[a << 8 | b]) >= 0]  # noqa: B905  the last byte has no pair
        heapify(heap)
        # where the part that begins here ends, 0 once it belongs to the part before it; and where the part before begins
        end, before = list(range(1, n + 1)), list(range(-1, n))
        while heap:
            i, m = divmod(heappop(heap), wide)
            i %= n
            j = end[i]
            if not 0 < j < n or end[j] - i != m:
                continue  # one of the two has merged with another since
            e = end[i] = end[j]
            end[j] = 0
            before[e] = i
            if e < n and (f := end[e]) - i <= longest and (r := ranks.get(word[i:f])) is not None:
                heappush(heap, (r * n + i) * wide + f - i)
            if (h := before[i]) >= 0 and e - h <= longest and (r := ranks.get(word[h:e])) is not None:
                heappush(heap, (r * n + h) * wide + e - h)
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def miss(self, word: bytes) -> bytes:
        """Ids of a pre-token, as bytes of 32-bit numbers."""
        if len(word) > SHORT:
            return np.array(self.merged(word), np.int32).tobytes()
        if len(self.new) >= KEPT:
            self.new, self.old = {}, self.new
        ids = self.old.get(word)
        if ids is None:
            own = self.merged(word)
            ids = _pack(f"{len(own)}i", *own)
        self.new[word] = ids
        return ids

    def spans(self, text: str) -> Iterator[list[int] | np.ndarray]:
        """Lengths in characters of slices of the text's pre-tokens; what the pattern passes over is an error."""
        if len(text) <= SLICE:
            yield np.fromiter(map(len, self.pattern.findall(text)), np.int64)
            return
        found = (m.end() - m.start() for m in self.pattern.finditer(text))
        while len(some := np.fromiter(islice(found, SLICE), np.int64)):
            yield some

    def encoded(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, some of its ids), in order; short texts go through the tables together."""
        held, chars = [], 0
        for i, text in enumerate(texts):
            if len(text) > SLICE:
                yield from self._slices(held)
                held, chars = [], 0
                at = 0
                for sizes in self.spans(text):
                    part = text[at : (at := at + int(sizes.sum()))]
                    yield from self._slices([(i, part, sizes)])
                if at != len(text):
                    raise ValueError("the pattern passes over characters")
                continue
            (sizes,) = self.spans(text)
            if sizes.sum() != len(text):
                raise ValueError("the pattern passes over characters")
            held.append((i, text, sizes))
            chars += len(text)
            if chars >= GATHERED:
                yield from self._slices(held)
                held, chars = [], 0
        yield from self._slices(held)

    def _slices(self, held: list[tuple[int, str, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
        if not held:
            return
        raw = "".join(t for _, t, _ in held).encode()
        data = np.frombuffer(raw, np.uint8)
        sizes = np.concatenate([s for _, _, s in held])
        ends = np.cumsum(sizes)
        if len(data) > ends[-1:].sum():  # characters of more than a byte
            ends = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[ends]
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        first = self.whole(data, begins, ends)
        counts = np.ones(len(first), np.int64)
        misses = np.flatnonzero(first < 0)
        found = []
        for b, e in zip(begins[misses].tolist(), ends[misses].tolist(), strict=True):
            ids = self.new.get(word := raw[b:e])
            found.append(self.miss(word) if ids is None else ids)
        counts[misses] = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), np.int64)
        ids[at[first >= 0]] = first[first >= 0]
        if found:
            own = np.frombuffer(b"".join(found), np.int32)
            n = counts[misses]
            ids[np.repeat(at[misses] - (np.cumsum(n) - n), n) + np.arange(len(own))] = own
        border = np.concatenate([at, [len(ids)]])
        k = 0
        for i, _, s in held:
            yield i, ids[border[k] : border[k + len(s)]]
            k += len(s)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(self.raw) and all(self.raw[i] for i in np.unique(ids))):
            raise ValueError("an id is not in the vocabulary")
        return b"".join(self.raw[ids].tolist())


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Vocabulary:
    """A worker's vocabulary; it outlives a task."""
    return Vocabulary(path, pattern)


def defaults(path: str | None = None, pattern: str | None = None) -> tuple[str, str]:
    import public_tokenizers

    return path or str(public_tokenizers.path(VOCABULARY)), pattern or public_tokenizers.PATTERN


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text"), docs.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids array<int> for each row of docs (doc_id, text); an empty array for a null or empty text. ``path``: the file of ranks, on every executor."""
    where = defaults(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(*where)
        for b in batches:
            own = [[] for _ in range(b.num_rows)]
            for i, ids in v.encoded([t or "" for t in b.column(1).to_pylist()]):
                own[i].append(ids)
            sizes = [sum(map(len, parts)) for parts in own]
            flat = np.concatenate([np.zeros(0, np.int64), *(p for parts in own for p in parts)]).astype(np.int32)
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))], ["doc_id", "ids"])

    rows, kind = _rows(docs)
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, decoded binary for each row of encoded (doc_id, ids array<int>); null for a null array. An id that the vocabulary lacks is an error; bytes of ids that were cut anywhere need not be UTF-8."""
    where = defaults(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(*where)
        for b in batches:
            some = [None if ids is None else v.decode(np.array(ids, np.int64)) for ids in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(some, pa.binary())], ["doc_id", "decoded"])

    bounded_batches(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, f"doc_id {kind}, decoded binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs (doc_id, text): texts are encoded and the ids decoded, slice by slice.

    ids_sha256 is over the decimal ids, joined by commas, decoded_sha256 over
    the bytes that the ids stand for. A null text is empty and has no ids. Rows
    are judged one by one, repeated ones too; a very long text goes in slices
    of pre-tokens, a very long pre-token through one heap, in time n log n.
    """
    where = defaults(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(*where)
        for b in batches:
            n, named, back = np.zeros(b.num_rows, np.int64), [hashlib.sha256() for _ in range(b.num_rows)], [hashlib.sha256() for _ in range(b.num_rows)]
            for i, ids in v.encoded([t or "" for t in b.column(1).to_pylist()]):
                if len(ids):
                    named[i].update((b"," if n[i] else b"") + b",".join(v.decimal[ids].tolist()))
                    back[i].update(v.decode(ids))
                    n[i] += len(ids)
            yield pa.record_batch([b.column(0), pa.array(n), pa.array([h.hexdigest() for h in named]), pa.array([h.hexdigest() for h in back])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows, kind = _rows(docs)
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
