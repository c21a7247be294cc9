"""The fingerprint index in many batches beside brute force."""

import random

import pytest

from quadrat.llm import substrings
from tests.llm.test_operators import brute_removals

WIDTH = 6


def texts(n, seed):
    rng = random.Random(seed)
    passages = [[f"p{i}w{j}" for j in range(rng.randint(6, 14))] for i in range(12)]
    return [" ".join(w for _ in range(rng.randint(1, 4)) for w in (rng.choice(passages) if rng.random() < 0.6 else [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 9))])) for _ in range(n)]


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_batches_of_a_table_equal_one(spark, monkeypatch, batches):
    monkeypatch.setattr(substrings, "BATCHES", batches)
    monkeypatch.setattr(substrings, "FAN_IN", 2)
    rows = list(enumerate(texts(120, 1)))
    got = substrings.removals(spark.createDataFrame(rows, "doc_id long, text string"), width=WIDTH).collect()
    assert sorted(map(tuple, got)) == brute_removals(rows, WIDTH)


def test_the_query_compacts(spark, monkeypatch):
    """With the production parameters the last batch's run is compacted with the earlier ones."""
    sizes, compact = [], substrings.FingerprintIndex.compact
    monkeypatch.setattr(substrings.FingerprintIndex, "compact", lambda self: (sizes.append(len(self.runs)), compact(self)))
    rows = list(enumerate(texts(60, 3)))
    got = substrings.removals(spark.createDataFrame(rows, "doc_id long, text string"), width=WIDTH).collect()
    assert sorted(map(tuple, got)) == brute_removals(rows, WIDTH) and sizes == [substrings.BATCHES]


@pytest.mark.parametrize("hot", [1000, 2])
def test_later_batches_need_no_earlier_texts(spark, hot):
    """A window of a batch is a repeat if it stands elsewhere in that batch or anywhere in an earlier one; the index, compacted on the way, is all that is kept of those."""
    index, seen = substrings.FingerprintIndex(spark, fan_in=2), set()
    for number in range(4):
        rows = list(enumerate(texts(25, number)))
        own = [(i, j, tuple(w[j : j + WIDTH])) for i, t in rows for w in [t.split()] for j in range(len(w) - WIDTH + 1)]
        times = {}
        for *_, w in own:
            times[w] = times.get(w, 0) + 1
        want = {(i, j) for i, j, w in own if times[w] > 1 or w in seen}
        spans = substrings.repeated_spans(spark.createDataFrame([(t, i) for i, t in rows], "text string, rid long"), WIDTH, hot_rows=hot, index=index).collect()
        assert {(r.rid, r.at + k) for r in spans for k in range(r.n)} == want
        seen |= set(times)
    assert len(index.runs) <= 2


def test_words_made_to_collide_stay_apart(spark):
    """Windows that differ in one Thue-Morse word and its complement are different windows."""
    morse = "a"
    while len(morse) < 2048:
        morse += morse.translate({97: 98, 98: 97})
    line = [f"w{i}" for i in range(34)]
    rows = [(1, " ".join([*line[:17], morse, *line[17:]])), (2, " ".join([*line[:17], morse.translate({97: 98, 98: 97}), *line[17:]])), (3, None), (4, "")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (35, 0), 2: (35, 0), 3: (0, 0), 4: (0, 0)}
