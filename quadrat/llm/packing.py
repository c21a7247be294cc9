"""Packing documents into sequences: first-fit decreasing with a tournament tree of bin capacities.

Documents are tokenised and cut into full sequences and a rest where they
stand; only lengths and places travel. Pieces are dealt by a salted hash of
document, place and copy into groups of about ``GROUP_PIECES``, so that one task
packs a bounded number of pieces, though one document may have a billion tokens
or a billion copies. In a group, pieces are placed longest first, each
into the first sequence with room, which a tournament tree over the capacities
finds in log(sequences) steps.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spill import bounded_batches, written

TOKENIZER = "word_bpe_49k.json"
LENGTH = 2048
END_ID = 1
GROUP_PIECES = 4096
SEED = 11
#: Words whose ids a worker keeps, and characters of the longest of them.
KEPT_WORDS, SHORT = 200_000, 64
#: Separators for Python's split that the tokenizer doesn't take for white space.
_ODD = re.compile("[\x1c-\x1f]")
#: Texts whose pre-tokens are found here: white space, printable ASCII and the letters of the Latin-1 block, which normalisation leaves as they are.
_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]+").fullmatch
#: The tokenizer's own rule, for such texts in lower case.
_PRE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")


class _Kept(dict):
    """Ids by word, in two generations: what was not asked for since the last change goes."""

    def __init__(self, value):
        super().__init__()
        self.value, self.old = value, {}

    def __missing__(self, word: str) -> bytes:
        if len(word) > SHORT:
            return self.value(word)
        if len(self) > KEPT_WORDS:
            self.old = dict(self)
            self.clear()
        if (ids := self.old.get(word)) is None:
            ids = self.value(word)
        self[word] = ids
        return ids


class TextIds:
    """Little-endian 32-bit ids of texts. No token of the vocabulary reaches over a pre-token's border, so those of a text are those of its pre-tokens, which are kept."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        model = self.library.model
        # the characters that stand for the UTF-8 bytes of the letters in _PLAIN: themselves, or 256 and on for unprintable ones
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
        sign = {b: chr(256 + odd.index(b)) if b in odd else chr(b) for b in range(256)}
        of = {c: "".join(sign[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.tokens = _Kept(lambda token: array("I", [t.id for t in model.tokenize(token if token.isascii() else token.translate(of))]).tobytes())
        self.words = _Kept(self.whole)

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def of(self, text: str | None) -> bytes:
        """Ids of a text; a null is empty. One of other letters than _PLAIN goes by its blank-separated words."""
        if not text:
            return b""
        if _PLAIN(text) and "<|" not in text:
            return b"".join(map(self.tokens.__getitem__, _PRE.findall(text.lower())))
        if _ODD.search(text):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, text.split()))


@lru_cache(maxsize=1)
def text_ids(path: str) -> TextIds:
    """A worker's tokenizer; what it keeps outlives a task."""
    return TextIds(path)


class Tournament:
    """First bin of at least a given capacity. A complete binary tree holds in each node the largest capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.tree = [capacity] * (2 * self.leaves)

    def take(self, need: int) -> int:
        """Place ``need`` into the first bin with room for it; its number."""
        tree, i = self.tree, 1
        if tree[1] < need:
            raise ValueError("no bin has room")
        while i < self.leaves:
            i *= 2
            if tree[i] < need:
                i += 1
        at = i - self.leaves
        tree[i] -= need
        while i > 1:
            i //= 2
            tree[i] = max(tree[2 * i], tree[2 * i + 1])
        return at


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1 to capacity); ties keep their order."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = Tournament(max(1, len(lengths)), capacity), [0] * max(1, len(lengths))
    for i in order.tolist():
        need = int(lengths[i])
        b = tree.take(need)
        bins[i], offsets[i] = b, used[b]
        used[b] += need
    return bins, offsets


def _cut(path: str, length: int):
    """Pieces of (doc_id, text): where each begins, its length and the checksum of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = text_ids(path)
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            row, start, size, crc, total = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                raw = ids.of(text) + end
                n = len(raw) // 4
                for s in range(0, n, length):
                    e = min(n, s + length)
                    row.append(i)
                    start.append(s)
                    size.append(e - s)
                    crc.append(zlib.crc32(raw[4 * s : 4 * e]))
                    total.append(n)
            yield pa.record_batch([b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: every document (null text: empty) in pieces of at most ``length`` ids, its end id included, so that each has a piece."""
    import public_tokenizers

    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    path = path or str(public_tokenizers.path(TOKENIZER))
    return docs.select("doc_id", "text").mapInArrow(_cut(path, length), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces() with sequence_id and offset.

    Every id lies in exactly one piece and one place; a sequence has no gaps
    from 0. A null or empty text is its end id alone. Rows that share a doc_id,
    equal ones too, are packed each for itself. Of pieces of one length those of
    smaller doc_id and start are placed first. No documents give no rows. The
    same rows give the same packing.
    """
    cut = pieces(docs, path, length)
    own = cut.columns
    cut = written(cut.groupBy(*own).agg(F.count("*").alias("c")), "pieces")
    groups = max(1, round((cut.agg(F.sum("c")).first()[0] or 0) / group_pieces))
    kind = cut.schema["doc_id"].dataType.simpleString()

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32", "length", "doc_tokens", "copy"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), length)
        rows["sequence_id"] = (int(key[0]) << 32) + bins
        rows["offset"] = offsets
        return rows.drop(columns=["grp", "copy"])

    copies = cut.select(*own, F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))).alias("copy"))
    spread = copies.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "copy", F.lit(SEED)), F.lit(groups)))
    return spread.groupBy("grp").applyInPandas(one, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
