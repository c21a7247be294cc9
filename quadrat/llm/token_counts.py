"""Exact token counts of every prefix of a text, by dynamic programming.

A byte-pair encoding is the one segmentation in which no two neighbours would
have merged otherwise. So the encoding of a prefix is that of a shorter prefix
and one last token that is compatible with the token before it, and one pass
over the ends of prefixes gives last token and count of each (``prefixes``).
Truncation and budget questions are look-ups in that array.

No token of the vocabulary reaches over a word's border (checked on loading),
so the array of a text is that of its words, each added to the count so far;
arrays of words are kept while there is room.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernel import buffers
from .spill import bounded_batches

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: A word with the marks before it, or marks that end a text.
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")
LIMIT = 4096
#: Words, and prefixes, whose counts a worker keeps.
KEPT_WORDS = 250_000
#: Characters of a prefix, and of a word, that is kept.
SHORT = 64


class PieceModel:
    """Vocabulary of a sentence-piece BPE model: ranks of its pieces, and how each is merged from two."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = len(self.library)
        ids = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        order = sorted(ids, key=lambda i: -self.library.get_score(i))
        self.rank = {self.library.id_to_piece(i): r for r, i in enumerate(order)}
        self.chars = {p for p in self.rank if len(p) == 1}
        self.longest = max(map(len, self.rank))
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece reaches over a word's border")
        self.ends = {p[i:] for p in self.rank for i in range(len(p))}
        self.solo = not any("\n" in p for p in self.rank)
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.made = {p for p in self.rank if len(p) == 1 or self.split(p)}
        self.states: dict[str, tuple[int, str]] = {}

    def split(self, piece: str) -> tuple[str, str] | None:
        """The last merge that makes the piece; None if merging its characters ends elsewhere, or it has but one."""
        if piece not in self.halves:
            parts = list(piece)
            while len(parts) > 2:
                ranks = [self.rank.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
                best = min(ranks)
                if best == 1 << 60:
                    break
                i = ranks.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[piece] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[piece]

    def _compatible(self, left: str, right: str) -> bool:
        """Would the two stay apart? Undo merges on both sides of the border, latest first; apart if no pair that met there merged before them."""
        bound = 1 << 60
        while True:
            if self.rank.get(left + right, 1 << 60) < bound:
                return False
            a, b = (self.rank[left] if len(left) > 1 else -1), (self.rank[right] if len(right) > 1 else -1)
            if a < 0 and b < 0:
                return True
            # of equal ranks the left one is merged first, so the right one is undone first
            if a > b:
                left, bound = self.split(left)[1], a
            else:
                right, bound = self.split(right)[0], b + 1

    def compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        if (ok := self.fits.get(key)) is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            ok = self.fits[key] = self._compatible(left, right)
        return ok

    def prefixes(self, word: str) -> list[int]:
        """Token counts of the 0, 1, ... first characters of a word, which holds no mark but at its beginning.

        Counts and last tokens are held by position, so time and memory grow
        with the word's length. States of the first ``SHORT`` characters are
        kept for all words that begin alike.
        """
        if len(self.states) > KEPT_WORDS:
            self.states = {}
        states, chars, longest = self.states, self.chars, self.longest
        counts, last = [0], [""]
        for end in range(1, min(SHORT, len(word)) + 1):
            if (state := states.get(prefix := word[:end])) is None:
                state = states[prefix] = self._state(word, end, counts, last)
            counts.append(state[0])
            last.append(state[1])
        for end in range(SHORT + 1, len(word) + 1):
            if word[end - 1] in chars:
                n, t = self._state(word, end, counts, last)
            else:
                n, t = counts[-1] + len(word[end - 1].encode(errors="surrogatepass")), ""
            counts.append(n)
            last.append(t)
            if end > longest:
                last[end - longest] = None  # out of any token's reach
        return counts

    def _state(self, word: str, end: int, counts: list[int], last: list[str]) -> tuple[int, str]:
        """Count and last token of a prefix, from those of shorter ones."""
        made, ends, fits = self.made, self.ends, self.fits
        if word[end - 1] not in self.chars:
            return counts[-1] + len(word[end - 1].encode(errors="surrogatepass")), ""
        for begin in range(end - 1, -1, -1):
            t = word[begin:end]
            if t in made:
                p = last[begin]
                if not p or ((ok := fits.get((p, t))) is None and self.compatible(p, t)) or ok:
                    return counts[begin] + 1, t
            elif t not in ends:
                break
        raise ValueError(f"no last token at character {end} of a word")


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


class _Kept(dict):
    """Values by word, in two generations: what was not asked for since the last change goes."""

    def __init__(self, value):
        super().__init__()
        self.value, self.old = value, {}

    def __missing__(self, word: str) -> int:
        if len(word) > SHORT:
            return self.value(word)
        if len(self) > KEPT_WORDS:
            self.old = dict(self)
            self.clear()
        if (n := self.old.get(word)) is None:
            n = self.value(word)
        self[word] = n
        return n


class Counter:
    """Counts of whole texts and of their prefixes under one model."""

    def __init__(self, path: str):
        self.model = load(path)
        self.totals, self.words = _Kept(self._part), _Kept(lambda word: self.model.prefixes(word)[-1])

    def _part(self, part: str) -> int:
        """Of a blank-separated part; one that begins with a line break has no mark before it."""
        word = part[1:] if part[0] == "\n" else MARK + part
        return (part[0] == "\n") + (self.model.prefixes(word)[-1] if word else 0)

    def _parts(self, text: str) -> list[str] | None:
        """Blank-separated parts, line breaks at the beginning of a part of their own; None where blanks meet or marks are written out."""
        if not self.model.solo or MARK in text:
            return None
        parts = text.replace("\n", " \n").split(" ")
        return parts if "" not in parts else None

    def count(self, text: str) -> int:
        """Tokens of the text; none if it is empty."""
        if not text:
            return 0
        parts = self._parts(text)
        if parts is not None:
            return sum(map(self.totals.__getitem__, parts))
        return sum(map(self.words.__getitem__, WORD.findall(MARK + text.replace(" ", MARK))))

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token counts of the first 0, 1, ... code points of the text, each as if it were a text of its own."""
        marked = MARK + text.replace(" ", MARK)
        out = np.zeros(len(text) + 1, np.int64)
        done, at = 0, 0
        for m in WORD.finditer(marked):
            own = self.model.prefixes(m[0])
            out[max(0, at - 1) : at + len(own) - 1] = np.array(own[1 if at == 0 else 0 :]) + done
            at += len(m[0])
            done += own[-1]
        out[0] = 0
        return out

    @staticmethod
    def longest_within(counts: np.ndarray, budget: int) -> int:
        """Code points of the longest prefix up to which no prefix takes more tokens than the budget."""
        over = np.flatnonzero(counts > budget)
        return int(over[0]) - 1 if len(over) else len(counts) - 1


@lru_cache(maxsize=1)
def counter_of(path: str) -> Counter:
    """A worker's counter; it outlives a task."""
    return Counter(path)


def _counted(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for b in batches:
            _, at = buffers(b.column(1))
            n = np.array([counter.count(t) if t else 0 for t in b.column(1).to_pylist()], np.int64)
            yield pa.record_batch([b.column(0), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text). A null or empty text has no bytes and no tokens; rows are judged one by one, repeated ones too; a very long word takes time and memory in proportion. ``path``: the model's file, on every executor."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_counted(path or model_path(), limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def _prefix_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for b in batches:
            for i, t in enumerate(b.column(1)):
                counts = pa.array(counter.prefix_counts(t.as_py() or ""))
                yield pa.record_batch([b.column(0).slice(i, 1), pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), counts)], ["doc_id", "counts"])

    return run


def prefix_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, counts: the token counts of every prefix (by code points) of every text; [0] for a null or empty one."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_prefix_rows(path or model_path()), f"doc_id {kind}, counts array<long>")


__all__ = ["Counter", "load", "model_path", "prefix_table", "token_counts"]
