"""Spelling variants: words one edit apart, by merging subtrees of their trie.

The trie's nodes are prefixes, by hash; a node's heavy child is the one with
the most words below it. A word leaves heavy paths at most log2(words) times,
and only there its subtree is merged into others, small into large:

* replaced: the light subtrees of a node meet with their first character left
  open, and each is looked up below the heavy child;
* skipped: each is looked up without its first character, and behind the heavy
  child's character, which is the case of a skipped heavy character.

What a light subtree is merged into are other subtrees' terminals, so every
altered word is a key of an equi-join, and coinciding terminals are pairs. A
character skipped in a run of equal ones counts as the run's last, so a pair
comes up once. Left-open keys hold at most one word a letter; they are reduced
to a count and the two most frequent words, and no pairs are made of them.

Which child counts as heavy decides on work only: two prefixes of one hash
share their choice.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import LOWER, U, Words, chunks, mix, signed, word_hashes
from .spill import bounded_batches, written

LEAST_CHARS, LEAST_COUNT, SPOILT, RATIO = 5, 3, 97, 2
#: Words, and bytes of them, that a task counts before it hands them on.
COUNTED, COUNTED_BYTES = 200_000, 16 << 20
#: Nodes of the trie that are sent to all tasks: the largest, of which no more can be so large.
TOP = 20_000
#: Bytes of a run up to which its checksum is computed with others'.
SHORT = 64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_OUTSIDE = np.array([True, False])
#: The reflected polynomial of CRC-32, and its remainders of all bytes.
POLYNOMIAL = 0xEDB88320
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(POLYNOMIAL), _CRC >> 1)


def _checksums(data: np.ndarray, begin: np.ndarray, end: np.ndarray, start: np.ndarray) -> np.ndarray:
    """CRC-32 of each span, carried on from ``start``."""
    out = start.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    size = end - begin
    rows = np.flatnonzero(size <= SHORT)
    for j in range(SHORT):
        if not len(rows := rows[size[rows] > j]):
            break
        out[rows] = _CRC[(out[rows] ^ data[begin[rows] + j]) & 255] ^ (out[rows] >> 8)
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > SHORT):
        out[i] = zlib.crc32(data[begin[i] : end[i]].tobytes(), int(start[i]))
    return out


class _Counts:
    """Counts of words, handed on when there are too many."""

    def __init__(self):
        self.n: dict[bytes, int] = {}
        self.bytes = 0

    def add(self, word: bytes, n: int) -> None:
        if word not in self.n:
            self.bytes += len(word)
            self.n[word] = n
        else:
            self.n[word] += n

    def full(self) -> bool:
        return len(self.n) > COUNTED or self.bytes > COUNTED_BYTES

    def batch(self) -> pa.RecordBatch:
        out = pa.record_batch([pa.array(self.n, pa.binary()).cast(pa.string()), pa.array(self.n.values(), pa.int64())], ["word", "n"])
        self.__init__()
        return out


def _slice(ids: list, data: np.ndarray, at: np.ndarray, spoilt: int, least: int, counts: _Counts) -> None:
    """Adds the words of a slice of texts; equal runs of one text are found by 64-bit hashes and length."""
    two = data == 0xC3
    inside = _LETTER[data] | two
    inside[1:] |= two[:-1]
    w = Words(inside.astype(np.uint8), at, _OUTSIDE, hashes=False)
    if not len(w.start):
        return
    data = LOWER[data]
    wide = np.concatenate([[0], np.cumsum(two)])
    chars = w.end - w.start - (wide[w.end] - wide[w.start])
    h = word_hashes(data, w.start, w.end)
    of = np.repeat(np.arange(len(at) - 1), np.diff(w.of))
    order = np.lexsort((chars, h, of))
    new = np.ones(len(order), bool)
    a, b = order[1:], order[:-1]
    new[1:] = (of[a] != of[b]) | (h[a] != h[b]) | (chars[a] != chars[b])
    one, n = order[new], np.diff(np.append(np.flatnonzero(new), len(order)))
    start = np.array([0 if i is None else zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    crc = _checksums(data, w.start[one], w.end[one], start[of[one]])
    hit = (crc % spoilt == 0) & np.array([i is not None for i in ids])[of[one]] if spoilt else np.zeros(len(one), bool)
    for i, k, c in zip(one[hit], n[hit], crc[hit], strict=True):
        run = data[w.start[i] : w.end[i]].tobytes().decode()
        gone = int(c) % len(run)
        if len(run) > least:
            counts.add((run[:gone] + run[gone + 1 :]).encode(), int(k))
    one, n = one[~hit & (chars[one] >= least)], n[~hit & (chars[one] >= least)]
    order = np.lexsort((chars[one], h[one]))
    one, n = one[order], n[order]
    first = np.flatnonzero(np.append(True, (h[one][1:] != h[one][:-1]) | (chars[one][1:] != chars[one][:-1]))) if len(one) else one
    for i, k in zip(one[first], np.add.reduceat(n, first) if len(first) else n, strict=True):
        counts.add(data[w.start[i] : w.end[i]].tobytes(), int(k))


def word_counts(docs: DataFrame, spoilt: int | None = SPOILT, least: int = LEAST_CHARS) -> DataFrame:
    """word, n over docs (doc_id, text): runs of Latin letters with A-Z in lower case, of at least ``least`` code points.

    ``spoilt``: from runs whose crc32 of ``<doc_id>:<run>`` it divides, the code
    point at that crc32 modulo their length is deleted (None: from no run; a
    null doc_id: from none of the row's). A null text has no words; repeated
    rows count again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for b in batches:
            ids = b.column(0).to_pylist()
            for i, j, data, at in chunks(b.column(1)):
                _slice(ids[i:j], data, at, spoilt or 0, least, counts)
                if counts.full():
                    yield counts.batch()
        yield counts.batch()

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w1, w2, i, node, c): the node before each character of each word, by the hash of its prefix. Time and rows grow with the words' length."""
    base = 0xC2B2AE3D27D4EB4F
    back = pow(base, -1, 1 << 64)
    for b in batches:
        words = b.column(2).to_pylist()
        for k in range(0, len(words), step := 256):
            some = [w.encode("latin-1") for w in words[k : k + step]]
            data = np.frombuffer(b"".join(some), np.uint8)
            size = np.array(list(map(len, some)))
            begin = np.cumsum(size) - size
            up, down = (np.multiply.accumulate(np.append(U(1), np.full(len(data), U(x), U))) for x in (base, back))
            sums = np.append(U(0), np.cumsum(mix(data.astype(U) + U(1)) * up[:-1]))
            of = np.repeat(np.arange(len(some)), size)
            i = np.arange(len(data)) - begin[of]
            node = mix((sums[:-1] - sums[begin[of]]) * down[begin[of]] + mix(i.astype(U)))
            rows = pa.array(k + of)
            yield pa.record_batch([b.column(0).take(rows), b.column(1).take(rows), pa.array(i.astype(np.int32)), pa.array(signed(node)), pa.array(data.astype(np.int16))], ["w1", "w2", "i", "node", "c"])


def _light(words: DataFrame) -> DataFrame:
    """(w1, w2, light): the places of each word where it leaves a heavy path, with the heavy child's character; words that never do are missing."""
    cells = written(words.select("w1", "w2", "word").mapInArrow(_prefixes, "w1 long, w2 long, i int, node long, c short"), "trie")
    sizes = cells.groupBy("node", "c").agg(F.count("*").alias("n"))
    nodes = sizes.groupBy("node").agg(F.sum("n").alias("n"), F.count("*").alias("children"), F.max_by("c", F.struct("n", "c")).alias("heavy"))
    nodes = written(nodes.where("children > 1").select("node", "n", "heavy"), "nodes")
    least = cells.count() // TOP + 1
    top = cells.join(F.broadcast(nodes.where(F.col("n") >= least).select("node", F.col("heavy").alias("top"))), "node", "left")
    # top nodes are those of at least 1 / TOP of all rows, so at most TOP; no key of the other join holds more
    met = top.where("top IS NOT NULL").select("w1", "w2", "i", "c", F.col("top").alias("heavy"))
    rest = top.where("top IS NULL").join(nodes.where(F.col("n") < least), "node").select("w1", "w2", "i", "c", "heavy")
    light = met.unionByName(rest).where("c <> heavy")
    return light.groupBy("w1", "w2").agg(F.collect_list(F.struct("i", F.chr(F.col("heavy").cast("int")).alias("h"))).alias("light"))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) for each word of vocabulary (word, n) that has near words: how many differ by one inserted, deleted or replaced character, and which of them has the largest n, ties by code points.

    Words are distinct, not null, not empty, of code points up to U+00FF; a
    written table, as it is read several times.
    """
    words = vocabulary.select("word", "n", F.xxhash64("word").alias("w1"), F.xxhash64(F.lit("second"), "word").alias("w2"))
    off = words.join(_light(words), ["w1", "w2"]).select("word", "n", F.explode("light").alias("l"))
    i, h = F.col("l.i"), F.col("l.h")
    before, own, rest = F.expr("left(word, l.i)"), F.expr("substring(word, l.i + 1, 1)"), F.expr("substring(word, l.i + 2)")
    off = off.select("word", "n", before.alias("v"), own.alias("c"), rest.alias("t"), h.alias("h"))
    skips = (F.col("t") != "") & (F.expr("left(t, 1)") != F.col("c"))
    keys = F.array(F.concat("v", "h", "t"), F.concat("v", "h", "c", "t"), F.when(skips, F.concat("v", "t")))
    asked = off.select("word", "n", F.explode(keys).alias("key")).where("key IS NOT NULL")
    asked = asked.unionByName(words.where("length(word) > 1").select("word", "n", F.expr("left(word, length(word) - 1)").alias("key")))
    found = vocabulary.select(F.col("word").alias("key"), F.col("n").alias("key_n"))
    pairs = asked.join(found, "key")
    ends = F.array(F.struct(F.col("word").alias("word"), F.lit(1).cast("long").alias("near"), F.struct((-F.col("key_n")).alias("m"), F.col("key").alias("w")).alias("best")), F.struct(F.col("key").alias("word"), F.lit(1).cast("long").alias("near"), F.struct((-F.col("n")).alias("m"), F.col("word").alias("w")).alias("best")))
    merged = pairs.select(F.explode(ends).alias("e")).select("e.*")
    # at most one word a letter of the alphabet has the same characters around an open one
    open_ = off.groupBy(F.concat("v", F.lit("*"), "t").alias("key")).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("word").alias("w")))).alias("all")).where(F.size("all") > 1)
    open_ = open_.select("all", F.explode("all").alias("own")).select(F.col("own.w").alias("word"), (F.size("all") - 1).cast("long").alias("near"), F.when(F.col("own.w") == F.col("all")[0]["w"], F.col("all")[1]).otherwise(F.col("all")[0]).alias("best"))
    near = merged.unionByName(open_).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return near.select("word", "n_near", (-F.col("best.m")).alias("best_n"), F.col("best.w").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each word of forms (word, form) that has a form: pointers are doubled until none of them leads to a word with a form."""
    moving = written(forms.where("form IS NOT NULL").select("word", F.col("form").alias("to")), "forms")
    while True:
        step = moving.select(F.col("word").alias("to"), F.col("to").alias("next"))
        after = written(moving.join(step, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "roots")
        if after.where("moved").isEmpty():
            return after.select("word", F.col("to").alias("root"))
        moving = after.select("word", "to")


def variants(docs: DataFrame, least_count: int = LEAST_COUNT, spoilt: int | None = SPOILT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of docs (doc_id, text) that occurs at least ``least_count`` times.

    A word's form is its near word of the largest n (ties: the smallest in code
    points) if that n is at least ``ratio`` times its own, else null; its root
    is the end of the chain of forms, the word itself without one. A chain's
    counts grow by the ratio, so it is short. Words are those of
    ``word_counts``. No rows, or texts without words, give no rows.
    """
    vocabulary = written(word_counts(docs, spoilt).where(F.col("n") >= least_count), "vocabulary")
    near = near_words(vocabulary)
    good = F.col("best_n") >= ratio * F.col("n")
    rows = vocabulary.join(near, "word", "left").select("word", F.when(good, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best_n")).alias("form_n"))
    rows = written(rows, "variants")
    return rows.join(_roots(rows), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = f"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END, b) ORDER BY b) AS tab FROM range(256) t(b)),
run AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, sum(n) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS r, 1 AS n FROM documents) GROUP BY ALL),
bytes AS (SELECT *, hex(encode(doc_id || ':' || r)) AS x FROM run),
crc AS (SELECT doc_id, r, n, xor(list_reduce([('0x' || x[2 * i + 1:2 * i + 2])::BIGINT FOR i IN range(len(x) // 2)], lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS h FROM bytes, tab),
word AS (SELECT CASE WHEN h % {SPOILT} = 0 THEN r[:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, n FROM crc),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM word WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
key AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || '*' || word[i + 1:] AS open, word[:i - 1] || word[i + 1:] AS gone FROM w, unnest(range(1, length(word) + 1)) t(i)),
edit AS (SELECT a.word AS a, b.word AS b FROM key a JOIN key b ON a.open = b.open AND a.word <> b.word UNION SELECT key.word, w.word FROM key JOIN w ON gone = w.word UNION SELECT w.word, key.word FROM key JOIN w ON gone = w.word),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-w.n, b)) AS best, max(w.n) AS best_n FROM edit JOIN w ON b = w.word GROUP BY a),
form AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {RATIO} * n THEN best END AS form, CASE WHEN best_n >= {RATIO} * n THEN best_n END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS next FROM form UNION ALL SELECT chain.word, form.word, form.form FROM chain JOIN form ON chain.next = form.word)
SELECT word, form, root, n, n_near, form_n FROM form JOIN (SELECT word, root FROM chain WHERE next IS NULL) USING (word)
"""
