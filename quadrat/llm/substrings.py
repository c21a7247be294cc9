"""Substring deduplication over a log-structured fingerprint index.

Every window of ``width`` consecutive words has one *anchor*: the leftmost of
its (width // 3)-word grams with the least hash. Equal windows have equal
anchors, so only anchors are indexed, about one for every dozen words. The
index is a list of immutable runs, each a table of (fp, n) sorted by fp: a new
batch becomes a run, is merge-joined with the earlier ones to find anchors
that occur more than once, and runs are compacted into one when there are many.
A table's anchors are written once and fed in ``BATCHES``, of which the last
finds ``FAN_IN`` runs and compacts; it is then verified as a whole. An index that
outlives a table also keeps its windows' hashes in the runs, so that a window
that stands once in a later batch and once in an earlier one is a repeat.
An anchor that repeats is only a hint; it is verified by the full hashes of the
windows behind it, compared among the rows of that anchor.

Anchors of many rows would make one task's work grow with the data. Their
stretches of windows go another way: equal stretches are counted map-side, then
the windows of the different ones, and what repeats is joined back, so that no
task needs the rows of a key together.

Both choices are read from bitmaps that tasks get by broadcast, of a size that
follows the number of repeated anchors up to a bound; a bit set by chance costs
time, never a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmaps import bitmap, has
from .kernel import U, Words, buffers, chunks, mix, signed, sliding_min
from .spill import bounded_batches, partitions, scratch, written

WIDTH = 35
#: An anchor of more rows than this goes by single windows.
HOT_ROWS = 1000
#: Runs of an index that are compacted into one when a further one comes.
FAN_IN = 2
#: Batches that a table without history is dealt in.
BATCHES = 3


class FingerprintIndex:
    """Immutable runs of (fp long, n long), sorted by fp within hash partitions, in the shared folder.

    ``append`` adds a batch as a run, ``add`` also merge-joins it with all
    history, ``compact`` merges the runs. Nulls are not fingerprints and are
    dropped. An empty index and an empty batch are allowed. With ``windows``
    each run has a table of (fp, windows) beside it, named after it.
    """

    def __init__(self, spark: SparkSession, runs: list[str] | None = None, fan_in: int = FAN_IN, windows: bool = True):
        self.spark, self.runs, self.fan_in, self.keeps = spark, list(runs or []), fan_in, windows

    def append(self, batch: DataFrame, windows: DataFrame | None = None) -> str:
        """Count the batch's fingerprints (column fp) and write them, and their windows, as a run."""
        run = scratch(self.spark, "run")
        self._sorted(batch.where("fp is not null").groupBy("fp").agg(F.count("*").alias("n")), run)
        if self.keeps:
            self._sorted(self.spark.createDataFrame([], "fp long, windows binary") if windows is None else windows.select("fp", "windows").distinct(), run + "-windows")
        self.runs.append(run)
        if len(self.runs) > self.fan_in:
            self.compact()
        return run

    def add(self, batch: DataFrame, windows: DataFrame | None = None) -> DataFrame:
        """Append the batch; (fp, n) of its fingerprints that occur more than once in it and the history together, by a merge join."""
        before = self.history().withColumnRenamed("n", "old") if self.runs else None
        rows = self.spark.read.schema("fp long, n long").parquet(self.append(batch, windows))
        if before is not None:
            rows = rows.join(before.hint("merge"), "fp", "left").select("fp", (F.col("n") + F.coalesce("old", F.lit(0))).alias("n"))
        return rows.where("n > 1")

    def _sorted(self, rows: DataFrame, at: str) -> None:
        rows.repartition(partitions(self.spark), "fp").sortWithinPartitions("fp").write.parquet(at)

    def windows(self) -> DataFrame:
        """(fp, windows): the stretches of windows behind the anchors of all runs."""
        return self.spark.read.schema("fp long, windows binary").parquet(*(r + "-windows" for r in self.runs))

    def history(self) -> DataFrame:
        """(fp, n): what all runs hold, merged."""
        rows = self.spark.read.schema("fp long, n long").parquet(*self.runs) if self.runs else self.spark.createDataFrame([], "fp long, n long")
        return rows if len(self.runs) == 1 else rows.groupBy("fp").agg(F.sum("n").alias("n"))

    def compact(self) -> None:
        """Merge all runs into one; the old ones stay on disk for readers that still use them."""
        if len(self.runs) > 1:
            run = scratch(self.spark, "run")
            self._sorted(self.history(), run)
            if self.keeps:
                self._sorted(self.windows().distinct(), run + "-windows")
            self.runs = [run]

    def repeated(self) -> DataFrame:
        """(fp, n) of the fingerprints that occur more than once in all runs together."""
        return self.history().where("n > 1")

    def seen(self, batch: DataFrame) -> DataFrame:
        """The batch's rows whose fp is in the history, by a merge join."""
        return batch.join(self.history().select("fp").hint("merge"), "fp", "left_semi")


def _anchors(w: Words, width: int):
    """Windows of a slice: their places, full hashes, the places of their anchors and the grams' hashes."""
    k = max(1, width // 3)
    ok = w.inside(width)
    if not ok.any():
        return None
    grams, full = w.grams(k), w.grams(width)
    bits = U(max(1, int(len(grams) - 1).bit_length()))
    low = (U(1) << bits) - U(1)
    rank = np.unique(grams, return_inverse=True)[1].astype(U)  # whole hashes are compared, so equal windows choose alike in any slice
    least = sliding_min((rank << bits) | np.arange(len(grams), dtype=U), width - k + 1) & low
    at = np.flatnonzero(ok)
    return at, full[at], least[at].astype(np.int64), grams


def _stretches(at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Where a new stretch begins of consecutive windows of one anchor."""
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    return np.flatnonzero(new)


def _anchor_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, at in chunks(b.column(0)):
                if found := _anchors(Words(data, at), width):
                    where, _, anchor, grams = found
                    yield pa.record_batch([pa.array(signed(grams[anchor[_stretches(where, anchor)]]))], ["fp"])

    return run


def _dealt_anchors(width: int):
    """``_anchor_rows`` of (text, batch), with the text's batch beside each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, data, at in chunks(b.column(0)):
                w = Words(data, at)
                if found := _anchors(w, width):
                    where, _, anchor, grams = found
                    new = _stretches(where, anchor)
                    doc = np.searchsorted(w.of, where[new], "right") - 1
                    yield pa.record_batch([pa.array(signed(grams[anchor[new]])), b.column(1).take(pa.array(i + doc))], ["fp", "batch"])

    return run


_STRETCH = pa.schema([("fp", pa.int64()), ("rid", pa.int64()), ("at", pa.int32()), ("windows", pa.binary()), ("hot", pa.bool_())])


def _stretch_rows(width: int, repeated, hot):
    """Stretches behind anchors that the bitmap takes for repeated, or all if there is none: the full hashes of their windows, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rids = b.column(1).to_numpy()
            for i, _, data, at in chunks(b.column(0)):
                w = Words(data, at)
                if not (found := _anchors(w, width)):
                    continue
                where, full, anchor, grams = found
                new = _stretches(where, anchor)
                key = grams[anchor[new]]
                keep = np.flatnonzero(has(repeated.value, key)) if repeated else np.arange(len(key))
                if not len(keep):
                    continue
                ends = np.append(new[1:], len(where))
                raw = full.tobytes()
                doc = np.searchsorted(w.of, where[new[keep]], "right") - 1
                key = key[keep]
                yield pa.record_batch(
                    [pa.array(signed(key)), pa.array(rids[i + doc]), pa.array((where[new[keep]] - w.of[doc]).astype(np.int32)), pa.array([raw[8 * s : 8 * e] for s, e in zip(new[keep], ends[keep], strict=True)], pa.binary()), pa.array(has(hot.value, key) if hot else np.zeros(len(key), bool))],
                    schema=_STRETCH,
                )

    return run


#: The place of windows of earlier batches, which no span of a text reaches.
_EARLIER = -(1 << 30)


def _earlier_rows(hot):
    """Stretches of earlier batches, from (fp, windows), as rows like those of ``_stretch_rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            key = b.column(0).to_numpy().view(U)
            yield pa.record_batch([b.column(0), pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, _EARLIER, np.int32)), b.column(1), pa.array(has(hot.value, key))], schema=_STRETCH)

    return run


def _spans(rid: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Repeated windows as (rid, first, how many in a row)."""
    order = np.lexsort((at, rid))
    rid, at = rid[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (rid[1:] != rid[:-1]) | (at[1:] > at[:-1] + 1)
    new = np.flatnonzero(new)
    last = np.append(new[1:], len(at)) - 1
    return pa.record_batch([pa.array(rid[new]), pa.array(at[new].astype(np.int32)), pa.array((at[last[: len(new)]] - at[new] + 1).astype(np.int32))], ["rid", "at", "n"])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by fp: the windows whose full hash occurs twice or more under their anchor. Holds one Arrow batch and the rows of one anchor, which are few."""

    def judge(rows: pa.RecordBatch | pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        data, ends = buffers_of(rows.column(3))
        full = data.view(U)
        size = np.diff(ends) // 8
        row = np.repeat(np.arange(rows.num_rows), size)
        at = rows.column(2).to_numpy()[row] + np.arange(len(full)) - (ends[:-1] // 8)[row]
        both = mix(full ^ mix(rows.column(0).to_numpy().view(U))[row])
        order = np.argsort(both)
        same = both[order][1:] == both[order][:-1]
        twice = np.zeros(len(full), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        if twice.any():
            yield _spans(rows.column(1).to_numpy()[row[twice]], at[twice])

    left = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if left is None else pa.concat_tables([left, t])
        fp = t.column(0).to_numpy()
        cut = int(np.searchsorted(fp, fp[-1], "left")) if len(fp) else 0
        yield from judge(t.slice(0, cut).combine_chunks())
        left = t.slice(cut)
    if left is not None:
        yield from judge(left.combine_chunks())


def buffers_of(column) -> tuple[np.ndarray, np.ndarray]:
    data, at = buffers(column)
    return (data if data.ctypes.data % 8 == 0 else data.copy()), at


def repeated_spans(docs: DataFrame, width: int = WIDTH, hot_rows: int = HOT_ROWS, bits: int | None = None, index: FingerprintIndex | None = None) -> DataFrame:
    """(rid, at, n) of the windows that occur more than once: n windows in a row of the row rid, from word ``at``.

    docs: text string, rid long. Null and short texts have no windows. A window
    repeated inside one text counts. ``index``: earlier runs, to which this
    batch is added with its windows; a window that an earlier batch has counts
    as repeated. Spans are of this batch only: what it repeats of earlier ones
    doesn't go there. By default the table is all there is, and every occurrence
    goes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("text", "rid")
    broadcast = spark.sparkContext.broadcast
    rows, every = "fp long, rid long, at int, windows binary, hot boolean", None
    if index is None:
        index = FingerprintIndex(spark, windows=False)
        anchors = written(docs.select("text", F.pmod(F.hash("rid"), F.lit(BATCHES)).alias("batch")).mapInArrow(_dealt_anchors(width), "fp long, batch int"), "anchors")
        dealt = [index.add(anchors.where(F.col("batch") == i).select("fp")) for i in range(BATCHES)]
        found = dealt[0]
        for other in dealt[1:]:
            found = found.unionByName(other)
        repeated = written(found.groupBy("fp").agg(F.max("n").alias("n")), "repeated")
    else:
        every = index.windows() if index.runs else None
        repeated = written(index.add(docs.select("text").mapInArrow(_anchor_rows(width), "fp long"), docs.mapInArrow(_stretch_rows(width, None, None), rows)), "repeated")
    hot = broadcast(bitmap(repeated.where(F.col("n") > hot_rows).select("fp"), bits))
    stretches = docs.mapInArrow(_stretch_rows(width, broadcast(bitmap(repeated.select("fp"), bits)), hot), rows)
    if every is not None:
        stretches = stretches.unionByName(every.join(repeated.select("fp").hint("merge"), "fp", "left_semi").select("fp", "windows").mapInArrow(_earlier_rows(hot), rows))
    stretches = written(stretches, "stretches")
    cold = stretches.where("not hot").repartition(partitions(spark), "fp").sortWithinPartitions("fp").mapInArrow(_repeats, "rid long, at int, n int").where("at >= 0")

    hot = stretches.where("hot")
    kinds = written(hot.groupBy("fp", "windows").agg(F.count("*").alias("c")), "kinds").select("fp", "windows", "c", F.xxhash64("windows").alias("kind"))
    windows = written(kinds.mapInArrow(_single, "fp long, w long, kind long, i int, c long"), "windows")
    twice = windows.groupBy("fp", "w").agg(F.sum("c").alias("c")).where("c > 1").select("fp", "w")
    marks = windows.join(twice, ["fp", "w"]).groupBy("fp", "kind").agg(F.collect_list("i").alias("marks"))
    marked = hot.where("at >= 0").select("fp", F.xxhash64("windows").alias("kind"), "rid", "at").join(written(marks, "marks"), ["fp", "kind"])
    return cold.unionByName(marked.select("kind", "rid", "at", "marks").mapInArrow(_marked, "rid long, at int, n int"))


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, w, kind, i, c): the windows of (fp, windows, c, kind)."""
    for b in batches:
        data, ends = buffers_of(b.column(1))
        row = np.repeat(np.arange(b.num_rows), np.diff(ends) // 8)
        i = np.arange(len(row)) - (ends[:-1] // 8)[row]
        row = pa.array(row)
        yield pa.record_batch([b.column(0).take(row), pa.array(signed(data.view(U))), b.column(3).take(row), pa.array(i.astype(np.int32)), b.column(2).take(row)], ["fp", "w", "kind", "i", "c"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of (kind, rid, at, marks)."""
    for b in batches:
        at = b.column(3)
        row = np.repeat(np.arange(b.num_rows), np.diff(at.offsets.to_numpy()))
        if len(row):
            yield _spans(b.column(1).to_numpy()[row], b.column(2).to_numpy()[row] + at.flatten().to_numpy())


def _kept_words(raw: bytes, spans: list | None, width: int) -> tuple[list[bytes], int]:
    """The words outside of spans, and the number of all."""
    w = raw.split()
    if not spans:
        return w, len(w)
    cover = np.zeros(len(w) + 1, np.int32)
    first = np.array([s["at"] for s in spans])
    np.add.at(cover, first, 1)
    np.add.at(cover, first + [s["n"] + width - 1 for s in spans], -1)
    return [x for x, c in zip(w, np.cumsum(cover[:-1]).tolist(), strict=True) if not c], len(w)


def _digested(width: int):
    """From (doc_id, text, spans): the word counts, and the digest of the words that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = buffers(b.column(1))
            data = data.tobytes()
            words, removed, kept = [], [], []
            for row, spans in enumerate(b.column(2).to_pylist()):
                stay, n = _kept_words(data[at[row] : at[row + 1]], spans, width)
                words.append(n)
                removed.append(n - len(stay))
                kept.append(hashlib.sha256(b" ".join(stay)).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["row", "n_words", "n_removed", "kept_sha256"])

    return run


def _spanned(docs: DataFrame, width: int, **how) -> DataFrame:
    """(_row, spans): each row of docs (doc_id, text, ...) and its spans or null. Rows equal in id and text have a common key, and so the same spans."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.xxhash64("doc_id", "text").alias("rid"))
    spans = repeated_spans(docs.select("text", F.xxhash64("doc_id", "text").alias("rid")), width, **how)
    return rows.join(spans.groupBy("rid").agg(F.collect_list(F.struct("at", "n")).alias("spans")), "rid", "left").select("_row", "spans")


def removals(docs: DataFrame, width: int = WIDTH, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs (doc_id, text; other columns are not read).

    Words are runs of bytes other than the six ASCII spaces. A null text has no
    words: 0, 0 and the digest of nothing. Rows with one doc_id stay apart, and
    a row equal in id and text is a second occurrence like any other. No rows
    give none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = _spanned(docs.select("doc_id", "text"), width, **how).select("_row.doc_id", "_row.text", "spans")
    return out.mapInArrow(_digested(width), f"row {kind}, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("row", "doc_id")


def dedup_text(docs: DataFrame, width: int = WIDTH, **how) -> DataFrame:
    """docs with repeated windows cut from text, and n_chars (if there) set anew where something was cut.

    Of a window that occurs several times every occurrence goes, as in
    ``removals``. A text from which nothing is cut stays byte for byte; one of
    which nothing is left becomes empty; a null stays. Columns and their order
    stay, whatever their names. Only texts that are cut go to Python.
    """

    @F.arrow_udf("string")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([None if t is None else b" ".join(_kept_words(t.encode(), s, width)[0]).decode() for t, s in zip(text.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    rows = _spanned(docs, width, **how)
    some = F.col("spans").isNotNull()
    rows = rows.withColumn("kept", cut(F.when(some, F.col("_row.text")), "spans"))

    def column(c: str):
        if c == "text":
            return F.when(some, F.col("kept")).otherwise(F.col("_row.text"))
        if c == "n_chars":
            return F.when(some, F.length("kept")).otherwise(F.col("_row.n_chars")).cast(docs.schema[c].dataType)
        return F.col(f"_row.`{c}`")

    return rows.select(*(column(c).alias(c) for c in docs.columns))
