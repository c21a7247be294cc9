"""Token counts of very long words, beside the library."""

import random
import tracemalloc

import pytest

from quadrat.llm import token_counts


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts.model_path())


def long_words():
    rng = random.Random(5)
    return {
        "one letter": "a" * 1_000_000,
        "letters": "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)),
        "base64": "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(100_000)),
        "no spaces": "".join(rng.choice("天地玄黃宇宙洪荒日月盈昃辰宿列張") for _ in range(100_000)),
        "mixed": "".join(rng.choice("aé漢b\n\t▁x") for _ in range(100_000)),
    }


@pytest.mark.parametrize("kind", list(long_words()))
def test_long_words(counter, kind):
    text = long_words()[kind]
    want = len(counter.model.library.encode(text))
    tracemalloc.start()
    try:
        assert counter.count(text) == want
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
    finally:
        tracemalloc.stop()
    assert all(len(k) <= token_counts.SHORT for k in counter.model.states)


def test_prefixes_of_a_long_word(counter):
    text = "begin " + long_words()["letters"][:600] + " end"
    counts = counter.prefix_counts(text)
    assert [int(c) for c in counts] == [len(counter.model.library.encode(text[:i])) for i in range(len(text) + 1)]
    assert counter.longest_within(counts, 10) == max(i for i in range(len(text) + 1) if max(counts[: i + 1]) <= 10)
