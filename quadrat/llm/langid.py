"""Language identification by language-bitmask n-gram filters.

Training picks, for each language, all byte n-grams that are about as frequent
in it as in any other, and sets the language's bit at the n-gram's places of a
Bloom filter, whose size follows their number. The filters of all languages are bit-sliced: one table of
integers, in which bit l belongs to language l. One look-up of an n-gram
(the AND of its places) thus returns all languages that have it. A text's
languages are decided by per-language popcounts over all its n-grams, from
which the hits expected by chance at each filter's fill are taken away.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import U, chunks, mix
from .spill import bounded_batches, partitions, written

UNKNOWN = "und"
SIZES = (3, 4)
#: About so many labelled texts a language are read for training, picked by hash of doc_id; a language with fewer gives all.
SAMPLE_PER_LANGUAGE = 1500
#: An n-gram seen less often than this in a language's sample isn't counted as one of it.
LEAST_SEEN = 2
#: An n-gram belongs to a language if its relative frequency there is at least this share of its highest.
RATIO = 0.5
#: Slots for an n-gram of the language with most of them, and the bounds of their number.
SLOTS_PER_GRAM, LEAST_SLOTS, MOST_SLOTS = 16, 1 << 14, 1 << 23
PROBES = 2
#: More values of lang than this are taken for an error of the data.
MOST_LANGUAGES = 1024
#: A text of so many n-grams is judged; it has a language if that has this share of them, beyond chance.
JUDGED, LEAST_SHARE = 30, 0.1

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Filters:
    """languages in code-point order, planes (one integer table for each 64 of them), the share of n-grams each has by chance, and the most frequent language."""

    languages: list[str]
    planes: list[np.ndarray]
    chance: np.ndarray
    usual: str | None


def _stream(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters with one space for anything else, a space before and after each text; where the spaces before each text stand, and the last one."""
    s = _LETTER[data]
    s[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] += 32  # capitals of the Latin-1 block
    s = np.insert(s, at, 32)
    begin = at + np.arange(len(at))
    keep = np.ones(len(s), bool)
    keep[:-1] = (s[:-1] != 32) | (s[1:] != 32)
    moved = np.append(0, np.cumsum(keep))
    return s[keep], moved[begin]


def _grams(s: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size the n-grams, and for each text the first of its own and the one after the last."""
    wide = s.astype(U)
    for k in SIZES:
        if len(s) >= k:
            key = wide[: len(s) - k + 1].copy()
            for i in range(1, k):
                key |= wide[i : len(s) - k + 1 + i] << U(8 * i)
            yield key | U(k << 56), begin[:-1], np.maximum(begin[:-1], begin[1:] + 2 - k)


def _slots(keys: np.ndarray, slots: int) -> list[np.ndarray]:
    h = mix(keys)
    return [((h >> U(32 * i)) & U(slots - 1)).astype(np.int64) for i in range(PROBES)]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, c) of (lang, text)."""
    for b in batches:
        lang = np.array(b.column(0).to_pylist(), object)
        for name in sorted(set(lang)):
            got = b.column(1).filter(pa.array(lang == name))
            for _, _, data, at in chunks(got):
                for keys, first, last in _grams(*_stream(data, at)):
                    own = np.zeros(len(keys) + 1, np.int32)
                    np.add.at(own, np.minimum(first, len(keys)), 1)
                    np.add.at(own, np.minimum(last, len(keys)), -1)
                    g, c = np.unique(keys[np.cumsum(own[:-1]) > 0], return_counts=True)
                    yield pa.record_batch([pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c)], ["lang", "gram", "c"])


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that training must not see: crc32 of the id's text, modulo 4, is 2. A null id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _filled(chosen: DataFrame, planes: int, slots: int) -> list[np.ndarray]:
    """The tables of (gram, plane, mask). Tasks fill slices; only these, of 8 bytes a slot and plane, are gathered."""
    size = min(slots, 1 << 14)

    def rows(maps: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        for (p, s), m in maps.items():
            yield pa.record_batch([pa.array([p], pa.int32()), pa.array([s], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["p", "s", "table"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            keys, plane, mask = (c.to_numpy() for c in b.columns)
            for at in _slots(keys.view(U), slots):
                part = plane.astype(np.int64) * (slots // size) + at // size
                order = np.argsort(part, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    if len(own):
                        m = maps.setdefault((int(plane[own[0]]), int(at[own[0]] // size)), np.zeros(size, U))
                        np.bitwise_or.at(m, at[own] % size, mask[own].view(U))
        yield from rows(maps)

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for p, s, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                m = np.frombuffer(raw, U)
                maps[p, s] = maps[p, s] | m if (p, s) in maps else m
        yield from rows(maps)

    kind = "p int, s int, table binary"
    n = min(planes * (slots // size), partitions(chosen.sparkSession))
    out = [np.zeros(slots, U) for _ in range(planes)]
    for r in chosen.mapInArrow(fill, kind).repartition(n, "p", "s").mapInArrow(union, kind).collect():
        out[r.p][r.s * size : (r.s + 1) * size] = np.frombuffer(r.table, U)
    return out


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Filters:
    """Fit filters on docs (doc_id, text, lang) outside the held-out fold; rows without text, language or doc_id are left out. No rows give filters of no language."""
    bounded_batches(docs.sparkSession)
    usable = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    per = written(usable.groupBy("lang").agg(F.count("*").alias("docs")), "languages")
    counts = {r.lang: r.docs for r in per.limit(MOST_LANGUAGES + 1).collect()}
    languages = sorted(counts)
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    if not languages:
        return Filters([], [], np.zeros(0), None)
    whole = 1 << 20
    part = F.least(F.lit(float(whole)), whole * per_language / F.col("docs") + 1)
    numbered = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(languages)), "l int, lang string").join(per, "lang").select("l", "lang", part.alias("part")))  # as many rows as languages
    sample = usable.join(numbered, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(whole)) < F.col("part"))
    grams = sample.select("lang", "text").mapInArrow(_gram_counts, "lang string, gram long, c long").groupBy("gram", "lang").agg(F.sum("c").alias("c"))
    grams = written(grams.join(numbered.select("lang", "l"), "lang").select("gram", "l", "c"), "grams")
    freq = grams.join(F.broadcast(grams.groupBy("l").agg(F.sum("c").alias("t"))), "l").withColumn("f", F.col("c") / F.col("t"))
    top = freq.groupBy("gram").agg(F.collect_list(F.struct("l", "c", "f")).alias("xs"), F.max("f").alias("top"))
    chosen = top.select("gram", F.explode("xs").alias("x"), "top").where((F.col("x.f") >= RATIO * F.col("top")) & (F.col("x.c") >= LEAST_SEEN))
    chosen = written(chosen.select("gram", "x.l"), "chosen")
    most = chosen.groupBy("l").count().agg(F.max("count")).first()[0] or 0
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (SLOTS_PER_GRAM * most - 1).bit_length()))
    masks = chosen.groupBy("gram", F.floor(F.col("l") / 64).cast("int").alias("plane")).agg(F.bit_or(F.expr("shiftleft(1L, l % 64)")).alias("mask"))
    planes = _filled(masks, (len(languages) + 63) // 64, slots)
    chance = np.array([(np.count_nonzero(planes[i // 64] >> U(i % 64) & U(1)) / slots) ** PROBES for i in range(len(languages))])
    if len(languages) <= 8:
        planes = [p.astype(np.uint8) for p in planes]
    return Filters(languages, planes, chance, max(languages, key=lambda x: (counts[x], x)))


def _no_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True for texts without any letter."""
    ascii_ = np.append(0, np.cumsum((_LETTER[data] != 32) & (data < 128)))
    wide = np.append(0, np.cumsum(data >= 128))
    none = ascii_[at[1:]] == ascii_[at[:-1]]
    for i in np.flatnonzero(none & (wide[at[1:]] > wide[at[:-1]])):
        none[i] = not any(c.isalpha() for c in data[at[i] : at[i + 1]].tobytes().decode(errors="ignore"))
    return none


def popcounts(filters: Filters, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text and language: n-grams that the language has, less those expected by chance, not below 0. And each text's n-grams."""
    n = len(at) - 1
    hits, tested = np.zeros((n, len(filters.languages))), np.zeros(n)
    for keys, first, last in _grams(*_stream(data, at)):
        first, last = np.minimum(first, len(keys)), np.minimum(last, len(keys))
        tested += last - first
        slots = _slots(keys, len(filters.planes[0]))
        for p, plane in enumerate(filters.planes):
            found = plane[slots[0]]
            for at_ in slots[1:]:
                found = found & plane[at_]
            for bit in range(min(64, len(filters.languages) - 64 * p)):
                one = np.append(0, np.cumsum((found >> found.dtype.type(bit)) & found.dtype.type(1), dtype=np.int32))
                hits[:, 64 * p + bit] += one[last] - one[first]
    return np.maximum(0, (hits - tested[:, None] * filters.chance) / (1 - filters.chance)), tested


def _judged(filters: Filters, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and whether it is known, of the texts of a slice."""
    n = len(at) - 1
    none = _no_letter(data, at)
    if not filters.languages:
        return np.full(n, UNKNOWN, object), np.zeros(n), ~none
    est, tested = popcounts(filters, data, at)
    best = est.argmax(1)
    total = est.sum(1)
    lang = np.array(filters.languages, object)[best]
    lang[total == 0] = filters.usual
    most = est[np.arange(n), best]
    score = np.divide(most, total, out=np.zeros(n), where=total > 0)
    lang[none], score[none] = UNKNOWN, 0.0
    return lang, score, ~none & ((tested < JUDGED) | (most >= LEAST_SHARE * tested))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, at in chunks(b.column(1)):
                lang, score, _ = _judged(shared.value, data, at)
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(lang, pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text).

    lang_pred is `und` and score 0 for a null text or one without a letter. A
    text with letters of which no filter knows an n-gram gets the most frequent
    training language and score 0; of languages with equal counts the first is
    taken. score: the language's part of the corrected popcounts of all. Rows
    are judged one by one; repeated rows repeat. No rows give none.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(filters)), f"row {kind}, lang_pred string, score double")
    return out.withColumnRenamed("row", "doc_id").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, filters: Filters) -> DataFrame:
    """docs without those of no known language: null, without a letter, or of at least ``JUDGED`` n-grams of which no language has ``LEAST_SHARE`` beyond chance.

    A shorter text with letters stays, as does every text with letters if the
    filters know no language. Rows are judged one by one. Columns stay as they
    are, whatever their names; only texts go to Python.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @F.arrow_udf("boolean")
    def known(text: pa.Array) -> pa.Array:
        parts = [_judged(shared.value, data, at)[2] for _, _, data, at in chunks(text)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, bool))

    return docs.where(known("text"))


__all__ = ["Filters", "held_out", "keep_known", "popcounts", "predict", "train"]
