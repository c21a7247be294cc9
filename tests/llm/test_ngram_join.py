"""The n-gram join on tables made for its weak places."""

import numpy as np
import pytest

from quadrat.llm import kernel, ngram_join
from tests.llm.test_operators import brute_components

TEMPLATE = [f"t{i}" for i in range(400)]


def family(n, own):
    """Pages of one template, each with so many words of its own at the end."""
    return [(i, " ".join(TEMPLATE + [f"p{i}x{j}" for j in range(own)])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("own", [20, 21, 22, 28])
def test_templates_at_the_threshold(spark, own):
    rows = family(40, own) + [(100, " ".join(TEMPLATE)), (101, " ".join(TEMPLATE[:-20]))]
    assert sorted(map(tuple, ngram_join.ngram_components(frame(spark, rows)).collect())) == brute_components(rows)


def test_pages_that_do_not_link_form_no_pairs(spark, monkeypatch):
    """2,000 pages with 6 % of their own: no pair of them reaches the product."""
    met, product = [], ngram_join._product
    monkeypatch.setattr(ngram_join, "_product", lambda pairs, *a: met.append(pairs.count()) or product(pairs, *a))
    tiles = ngram_join._tiles
    monkeypatch.setattr(ngram_join, "_tiles", lambda *a: (lambda out: met.append(out.count()) or out)(tiles(*a)))
    got = ngram_join.ngram_components(frame(spark, family(2000, 26)))
    assert got.where("doc_id <> component_id").count() == 0 and sum(met) == 0


def test_tiles_and_column_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 7)
    monkeypatch.setattr(ngram_join, "WIDE", 32)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(90):
        w = [f"c{j}" for j in range(int(rng.integers(60, 70)))] + [f"g{i % 3}x{j}" for j in range(int(rng.integers(0, 9)))]
        for at in rng.integers(0, 60, rng.integers(0, 3)):
            w[at] = f"z{rng.integers(0, 5)}"
        rows.append((i, " ".join(w)))
    for percent in (90, 80):
        assert sorted(map(tuple, ngram_join.ngram_components(frame(spark, rows), percent=percent).collect())) == brute_components(rows, percent)


def test_rows_follow_documents_not_partitions(spark):
    """The plans hold no exchange of buckets by buckets: the same rows pass whatever the number of partitions."""
    rows, old = family(30, 5), spark.conf.get("spark.sql.shuffle.partitions")
    want = None
    for n in ("2", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            cells = frame(spark, rows).select("text").mapInArrow(ngram_join._text_cells(3, 6), "cid long, h long").count()
            got = (cells, sorted(map(tuple, ngram_join.ngram_components(frame(spark, rows)).collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
        want = want or got
        assert got == want


def test_words_made_for_polynomial_hashes():
    """A Thue-Morse word and its complement have different hashes, as have words that differ in one byte anywhere."""
    morse = "a"
    while len(morse) < 4096:
        morse += morse.translate({97: 98, 98: 97})
    for n in (64, 128, 129, 1024, 2048, 4096):
        both = f"{morse[:n]} {morse[:n].translate({97: 98, 98: 97})}".encode()
        data = np.frombuffer(both, np.uint8)
        assert len(set(kernel.Words(data, np.array([0, len(data)])).hash.tolist())) == 2
    every = [b"x" * n for n in range(1, 300)] + [b"x" * i + b"y" + b"x" * (199 - i) for i in range(200)]
    data = np.frombuffer(b" ".join(every), np.uint8)
    assert len(set(kernel.Words(data, np.array([0, len(data)])).hash.tolist())) == len(every)


def test_one_long_word(spark):
    rows = [(1, "x" * 1_000_000), (2, "x" * 1_000_000), (3, "x" * 999_999 + "y")]
    assert sorted(map(tuple, ngram_join.ngram_components(frame(spark, rows)).collect())) == [(1, 1, 1), (2, 1, 1), (3, 1, 3)]
