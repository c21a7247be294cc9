"""Likeness of many pairs at once, beside difflib's of each."""

import difflib
import random
import time

import numpy as np

from quadrat.functions import likeness


def test_ratios_are_difflibs():
    rng = random.Random(1)
    words = ["CUSTOMER", "ACME", "TIMBER", "é漢", "ABAB", "A", "BA", "\U0001f332", "X" * 90, "ÿ"]
    text = lambda: " ".join(rng.choice(words) if rng.random() < 0.6 else str(rng.randrange(1000)) for _ in range(rng.randrange(6)))
    a, b = ([text() for _ in range(4000)] for _ in range(2))
    assert likeness.ratios(a, b).tolist() == [difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)]
    assert likeness.ratios([], []).tolist() == [] and likeness.ratios(["", ""], ["", "x"]).tolist() == [1.0, 0.0]


def test_many_pairs_cost_less_than_one_by_one():
    rng = random.Random(2)
    a, b = ([f"CUSTOMER {rng.randrange(90_000):09} AUTOMOBILE" for _ in range(10_000)] for _ in range(2))
    t0 = time.process_time()
    got = likeness.ratios(a, b).tolist()
    t1 = time.process_time()
    assert got == [difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)]
    assert t1 - t0 < (time.process_time() - t1) / 2


def test_lists_match_as_pairs_do():
    rng = random.Random(3)
    words = ["CUSTOMER", "ACME", "é漢", "ABAB", "AAAA", "BA", "\U0001f332", "X" * 30, "\0"]
    text = lambda n: " ".join(rng.choice(words) if rng.random() < 0.6 else str(rng.randrange(1000)) for _ in range(rng.randrange(6)))[:n]
    for n in (30, 64):  # places of b's texts as bits of 32 and of 64
        a, b = [text(90) for _ in range(80)], [text(n) for _ in range(60)]
        ia, ib = (x.ravel() for x in np.indices((80, 60)))
        want, lists = likeness.matched([a[i] for i in ia], [b[i] for i in ib]), likeness.Lists(a, b)
        assert lists.matched(ia, ib).tolist() == want.tolist()
        for least in (3, 9):
            got = lists.matched(ia, ib, lambda m, rest: (m >= least) == (m + rest >= least))  # noqa: B023
            assert ((got >= least) == (want >= least)).all() and got.sum() < want.sum()
