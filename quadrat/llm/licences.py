"""Licence scans as an exact set-similarity join of text blocks with templates.

A template is the set of its words; a block is any run of as many consecutive
words as the template has. A block meets the template when it holds at least
``THRESHOLD`` of the set. Words are ordered by the number of documents that
hold them, over the whole corpus: a block that meets a template of n words
must hold one of its n - ceil(t n) + 1 rarest (prefix filter), so only blocks
around those are looked at, only in texts long enough for the words needed
(length filter), and of those only blocks in which enough template words
are near (positional filter, from prefix sums). What is left is counted.

Every block that meets a template is reported (``block_labels``). Licences
differ in few words, fewer than the slack of the threshold. So labels are
chosen among the blocks: a template names the words that tell it from its kin,
which a block of its label holds, and a template whose kin says more (the GNU
GPL's notice within that of the LGPL) gives way where a block of the other
overlaps its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import LOWER, NOT_ALNUM, U, Words, chunks
from .spill import bounded_batches

THRESHOLD = 0.8
#: Blocks that are counted together.
PART = 8192
#: Fixed phrases whose every place is reported: label, words.
BASE = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
#: Public licence texts and notices. Label, the words that tell it from its kin, text.
TEMPLATES = (
    ("agpl", "affero", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl", "affero", "licensed under the gnu affero general public license"),
    ("apache-2.0", "apache", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache", "released under the apache license"),
    (
        "apache-2.0-notice",
        "compliance",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "bsd",
        "redistribution binary",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    ("bsd", "redistribution binary", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "bsd", "released under the bsd license"),
    ("cc-by-licence", "cc by", "licensed under cc by"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc"),
    ("cc-by-nd", "cc by nd", "licensed under cc by nd"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa"),
    ("cc-by-text", "commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "cc0", "released under cc0"),
    ("gpl-notice", "gnu general", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-notice", "gnu general", "this work is licensed under the gnu general public license version"),
    ("isc", "purpose fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "lesser", "it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "lesser", "licensed under the gnu lesser general public license"),
    ("mit", "mit", "licensed under the mit license"),
    ("mit", "mit", "released under the mit license"),
    (
        "mit-text",
        "sublicense",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied "
        "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
        "or the use or other dealings in the software",
    ),
    ("mit-grant", "permission charge", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl", "mozilla", "subject to the terms of the mozilla public license"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib", "altered", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely "
     "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
)
#: A label that gives way to others whose blocks overlap its own.
GIVES_WAY = {"gpl-notice": {"lgpl", "agpl"}, "cc-by-licence": {"cc-by-nc", "cc-by-nd", "cc-by-sa"}, "mit-grant": {"mit-text"}}


def word_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)]), NOT_ALNUM, LOWER).hash


@dataclass
class Template:
    """A template under one order of words: its text, its words' numbers in sequence, those that tell it apart, how many distinct ones it needs, and which of them every such block has one of."""

    label: str
    text: str
    sequence: np.ndarray
    must: np.ndarray
    distinct: int
    need: int
    prefix: np.ndarray


class Matcher:
    """Vocabulary of all templates, and the templates under the order by document frequency."""

    def __init__(self, base=BASE, templates=TEMPLATES, threshold: float = THRESHOLD, frequency: dict[int, int] | None = None):
        every = np.concatenate([word_hashes(t) for *_, t in (*base, *templates)])
        self.vocabulary = np.unique(every)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.vocabulary & U(0xFFFF)).astype(np.int64)] = True
        seen = frequency or {}
        rank = np.lexsort((self.vocabulary, [seen.get(i, 0) for i in range(len(self.vocabulary))]))
        self.order = np.empty(len(rank), np.int64)
        self.order[rank] = np.arange(len(rank))
        self.base = [self._template(k, "", t, 1.0) for k, t in base]
        self.templates = [self._template(k, must, t, threshold) for k, must, t in templates]

    def _template(self, label: str, must: str, text: str, threshold: float) -> Template:
        sequence = np.searchsorted(self.vocabulary, word_hashes(text))
        must = np.searchsorted(self.vocabulary, np.unique(word_hashes(must)))
        own = np.unique(sequence)
        need = ceil(threshold * len(own) - 1e-9)
        rare = own[np.argsort(self.order[own])]
        return Template(label, text, sequence, must, len(own), need, np.sort(rare[: len(own) - need + 1]))

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places of template words, and their numbers."""
        at = np.flatnonzero(self.maybe[(w.hash & U(0xFFFF)).astype(np.int64)])
        number = np.searchsorted(self.vocabulary, w.hash[at])
        ok = self.vocabulary[np.minimum(number, len(self.vocabulary) - 1)] == w.hash[at]
        return at[ok], number[ok]

    def blocks(self, t: Template, at: np.ndarray, number: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where blocks that meet the template begin, how many of its distinct words each holds, and whether all telling ones are among them. A text shorter than the template is one block."""
        own = np.isin(number, t.sequence)
        at, number = at[own], number[own]
        anchors = at[np.isin(number, t.prefix)]
        if not len(anchors):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        size = len(t.sequence)
        doc = np.searchsorted(w.of, anchors, "right") - 1
        long = w.of[doc + 1] - w.of[doc] >= t.need
        anchors, doc = anchors[long], doc[long]
        # the union of the runs of places from which a block reaches an anchor
        edge = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(edge, np.maximum(anchors - size + 1, w.of[doc]), 1)
        np.add.at(edge, anchors + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge) > 0)
        doc = np.searchsorted(w.of, starts, "right") - 1
        starts = np.unique(np.minimum(starts, np.maximum(w.of[doc], w.of[doc + 1] - size)))
        doc = np.searchsorted(w.of, starts, "right") - 1
        ends = np.minimum(starts + size, w.of[doc + 1])
        a, b = np.searchsorted(at, starts), np.searchsorted(at, ends)
        near = b - a >= t.need
        starts, a, b = starts[near], a[near], b[near]
        counts = [self._counted(t, number, a[i : i + PART], b[i : i + PART]) for i in range(0, len(starts), PART)]
        count, telling = map(np.concatenate, zip(*counts, strict=True)) if counts else (np.zeros(0, np.int64), np.zeros(0, bool))
        met = count >= t.need
        return starts[met], count[met], telling[met]

    @staticmethod
    def _counted(t: Template, number: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many distinct words of the template the blocks of hits a to b hold, and whether these include all telling ones."""
        cell = np.arange(len(t.sequence))[None, :] + a[:, None]
        words = np.where(cell < b[:, None], number[np.minimum(cell, len(number) - 1)], -1)
        words.sort(axis=1)
        count = (words[:, :1] >= 0).sum(1) + ((words[:, 1:] != words[:, :-1]) & (words[:, 1:] >= 0)).sum(1)
        telling = np.ones(len(words), bool)
        for m in t.must:
            telling &= (words == m).any(1)
        return count, telling

    def labelled(self, every: list[tuple[Template, np.ndarray, np.ndarray, np.ndarray]], w: Words) -> list[tuple[Template, np.ndarray, np.ndarray]]:
        """Of each template's blocks those that hold its telling words and don't give way to an overlapping one of other labels."""
        found = [(t, starts[telling], count[telling]) for t, starts, count, telling in every]
        out = []
        for t, starts, count in found:
            for other, begun, _ in found:
                if len(starts) and len(begun) and other.label in GIVES_WAY.get(t.label, ()):
                    # the last block of the other that begins before this one's end
                    last = np.searchsorted(begun, starts + len(t.sequence)) - 1
                    free = (last < 0) | (begun[np.maximum(last, 0)] + len(other.sequence) <= starts)
                    free |= np.searchsorted(w.of, begun[np.maximum(last, 0)], "right") != np.searchsorted(w.of, starts, "right")
                    starts, count = starts[free], count[free]
            out.append((t, starts, count))
        return out

    def places(self, t: Template, at: np.ndarray, number: np.ndarray, w: Words) -> np.ndarray:
        """Blocks of all of a phrase's words that have them in its order."""
        starts, *_ = self.blocks(t, at, number, w)
        size = len(t.sequence)
        starts = starts[starts + size <= len(w.hash)]
        doc = np.searchsorted(w.of, starts, "right") - 1
        ok = starts + size <= w.of[doc + 1]
        starts = starts[ok]
        if not len(starts):
            return starts
        # hashes first, then the bytes of what they leave
        starts = starts[(w.hash[starts[:, None] + np.arange(size)] == self.vocabulary[t.sequence]).all(1)]
        phrase = t.text.encode().split()
        return starts[[[w.word(i) for i in range(s, s + size)] == phrase for s in starts.tolist()]] if len(starts) else starts


def _frequencies(base, templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(base, templates)
        total = np.zeros(len(m.vocabulary), np.int64)
        for b in batches:
            for _, _, data, at in chunks(b.column(0)):
                w = Words(data, at, NOT_ALNUM, LOWER)
                where, number = m.hits(w)
                doc = np.searchsorted(w.of, where, "right") - 1
                total += np.bincount(np.unique(doc * len(total) + number) % len(total), minlength=len(total))
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], ["word", "df"])

    return run


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Matcher = shared.value
        for b in batches:
            for i, j, data, at in chunks(b.column(1)):
                w = Words(data, at, NOT_ALNUM, LOWER)
                n = j - i
                where, number = m.hits(w)
                base: list[set[str]] = [set() for _ in range(n)]
                every: list[set[str]] = [set() for _ in range(n)]
                held_by: list[set[str]] = [set() for _ in range(n)]
                count, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                score = np.zeros(n)
                for t in m.base:
                    starts = m.places(t, where, number, w)
                    doc = np.searchsorted(w.of, starts, "right") - 1
                    np.add.at(count, doc, 1)
                    np.minimum.at(first, doc, starts - w.of[doc])
                    np.maximum.at(last, doc, starts - w.of[doc])
                    for d in np.unique(doc):
                        base[d].add(t.label)
                        every[d].add(t.label)
                        score[d] = 1.0
                blocks = [(t, *m.blocks(t, where, number, w)) for t in m.templates]
                for t, starts, *_ in blocks:
                    for d in np.unique(np.searchsorted(w.of, starts, "right") - 1):
                        held_by[d].add(t.label)
                for t, starts, held in m.labelled(blocks, w):
                    doc = np.searchsorted(w.of, starts, "right") - 1
                    np.maximum.at(score, doc, held / t.distinct)
                    for d in np.unique(doc):
                        every[d].add(t.label)
                none = count == 0
                yield pa.record_batch(
                    [
                        b.column(0).slice(i, n),
                        pa.array(np.diff(w.of)),
                        pa.array(count),
                        pa.array(first, mask=none),
                        pa.array(last, mask=none),
                        pa.array([",".join(sorted(x)) for x in base]),
                        pa.array([",".join(sorted(x)) for x in every]),
                        pa.array(score),
                        pa.array([",".join(sorted(x)) for x in held_by]),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "block_labels"],
                )

    return run


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, block_labels for each row of docs (doc_id, text).

    A null text is empty: no words, places or labels, score 0. block_labels:
    those of all templates that a block of the text meets; labels: those of base
    phrases, and of templates that keep a block by its telling words; score: the
    highest containment among these, 1 where a base phrase stands. A text
    shorter than a template is one block: it gets the label if it alone holds
    enough of the template and its telling words. Rows are judged one by one,
    repeated ones too; the order of words comes from all rows. No rows give none.
    """
    bounded_batches(docs.sparkSession)
    counted = docs.select("text").mapInArrow(_frequencies(base, templates), "word long, df long").groupBy("word").agg(F.sum("df").alias("df"))
    frequency = {r.word: r.df for r in counted.collect()}  # a row for each word of the templates
    matcher = docs.sparkSession.sparkContext.broadcast(Matcher(base, templates, threshold, frequency))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan(matcher), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, block_labels string")


def plain_words(text: str | None) -> list[str]:
    """The words as the contract has them, for tests."""
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
