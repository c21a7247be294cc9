"""Words one edit apart beside all pairs, and counts beside plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def counted(rows, spoilt=97, least=5):
    n = Counter()
    for d, t in rows:
        for r in RUN.findall(t or ""):
            r = r.translate(LOWER)
            if spoilt and d is not None and (h := zlib.crc32(f"{d}:{r}".encode())) % spoilt == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            if len(r) >= least:
                n[r] += 1
    return n


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    s, l = sorted((a, b), key=len)
    return any(l[:i] + l[i + 1 :] == s for i in range(len(l)))


def judged(n):
    out = {}
    for w in n:
        own = [v for v in n if near(w, v)]
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = (form, n[w], len(own), n[form] if form else None)

    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return sorted(((w, f, root(w), k, m, fn) for w, (f, k, m, fn) in out.items()), key=repr)


@pytest.mark.parametrize(("signs", "longest", "top"), [("ab", 9, variants.TOP), ("ab", 9, 3), ("abcdef", 4, variants.TOP), ("aé\xff×", 6, 40)])
def test_pairs(spark, monkeypatch, signs, longest, top):
    """Dense sets of words: each has its near words counted once, in runs of equal characters and at both ends too."""
    monkeypatch.setattr(variants, "TOP", top)
    rng = random.Random(4)
    n = {"".join(rng.choice(signs) for _ in range(rng.randrange(1, longest + 1))): rng.randrange(1, 9) for _ in range(500)}
    got = variants.near_words(variants.written(spark.createDataFrame(list(n.items()), "word string, n long"), "words")).collect()
    assert len(got) == len({r.word for r in got})
    want = [(w, len(own), n[b := min(own, key=lambda v: (-n[v], v))], b) for w in n if (own := [v for v in n if near(w, v)])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_one_hash_for_all_nodes(spark, monkeypatch):
    """Nodes of one hash share a heavy child, which changes no result."""
    monkeypatch.setattr(variants, "mix", lambda h: h * np.uint64(0))
    n = {w: i for i, w in enumerate(["ab", "abc", "abd", "bb", "b", "a", "acc", "cab", "cabb", "aab", "aabb", "abab"])}
    got = variants.near_words(variants.written(spark.createDataFrame(list(n.items()), "word string, n long"), "words")).collect()
    assert {r.word: r.n_near for r in got} == {w: k for w in n if (k := sum(near(w, v) for v in n))}


def test_odd_rows(spark, monkeypatch):
    """Nulls, other letters, long words, repeated rows, many counts handed on; a chain of forms."""
    monkeypatch.setattr(variants, "COUNTED", 50)
    rng = random.Random(9)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(4, 8))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words).title() if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(400)))) for i in range(40)]
    rows += [(1, None), (None, "sechs sechs sechs sieben"), (2, ""), (3, "ÀÉÎÕÜ÷× ÀÉÎÕÜ÷× ÀÉÎÕÜ÷×x漢 ŁŁŁŁŁŁ naïve's"), (3, "ÀÉÎÕÜ÷× " * 3), (50, "x" * 200_000), (51, "x" * 200_000), (52, "x" * 200_001), (53, ("x" * 200_000 + " ") * 2)]
    rows += [(60 + i, " ".join(["chaina"] * 3 + ["chainab"] * 7 + ["chainabc"] * 15 + ["chainabcd"] * 31)) for i in range(4)] + [(70, rows[5][1])] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    df = df.withColumns({c: F.lit(1) for c in ("word", "n", "key", "w1", "light", "form", "root", "h")})
    got = sorted(map(tuple, variants.variants(df).collect()), key=repr)
    want = judged({w: k for w, k in counted(rows).items() if k >= 3 and len(w) < 1000})
    assert [r for r in got if len(r[0]) < 1000] == want
    assert any(r[1] and r[2] != r[1] for r in want)
    assert {len(r[0]): r[3:] for r in got if len(r[0]) > 1000} in ({200_000: (4, 0, None)}, {200_000: (3, 0, None)})
    assert sorted(map(tuple, variants.word_counts(df, spoilt=None).collect())) == sorted(counted(rows, None).items())


def test_long_near_words(spark):
    long = "ab" * 20_000
    rows = [(1, f"{long} {long}c {long}c {long[1:]} {long[1:]} {long[1:]}")] * 3
    got = {len(r.word): (r.n, r.n_near, r.root == long[1:]) for r in variants.variants(spark.createDataFrame(rows, "doc_id long, text string"), spoilt=None).collect()}
    assert got == {40_000: (3, 2, True), 40_001: (6, 1, False), 39_999: (9, 1, True)}


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert variants.variants(df).collect() == []
    assert variants.variants(spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")).collect() == []
    alone = variants.variants(spark.createDataFrame([(1, "alone alone alone")], "doc_id long, text string"), spoilt=None).collect()
    assert list(map(tuple, alone)) == [("alone", None, "alone", 3, 0, None)]
