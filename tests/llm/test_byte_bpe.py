"""Byte-level encodings beside the library, and back."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quadrat.llm import byte_bpe, queries
from quadrat.llm.kernel import U

ODD = [None, "", " ", "  \n\n\t x", "<|endoftext|> don't we'll I'VE 'S", "ábc ünïcödé 漢字かな 한국어 العربية हिन्दी", "🙂👩‍👩‍👧‍👦 é ​﻿", "\x00\x01\x1c\x1d\x1e\x1f\x85\xa0 　x", "0123456789 ½ Ⅷ ४५", "a" * 3000, "ab" * 20_000, " " * 5000 + "x", "漢" * 3000, "!?" * 900 + "\r\n"]


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.load(*byte_bpe.defaults())


def ids_of(vocabulary, texts):
    out = [[] for _ in texts]
    for i, ids in vocabulary.encoded(texts):
        out[i] += ids.tolist()
    return out


def test_perfect_hash(vocabulary):
    """Every token has a slot of its own; other strings, also those of a token's hash slot, are misses."""
    v = vocabulary
    assert sorted(v.slots.key) == list(range(len(v.ranks)))
    assert (v.whole(v.data, v.at, v.at + v.size) == v.ids).all()
    others = np.frombuffer(b"".join(t + b"\xff\x00" for t in v.ranks), np.uint8)
    assert (v.whole(others, v.at + 2 * np.arange(len(v.at)), v.at + v.size + 2 * np.arange(len(v.at)) + 2) == -1).all()
    for n in (1, 2, 7, 1000):
        h = byte_bpe.mix(np.arange(1, n + 1, dtype=U))
        assert (byte_bpe.PerfectHash(h).find(h) == np.arange(n)).all()
    with pytest.raises(ValueError):
        byte_bpe.PerfectHash(np.array([5, 5], U))


def test_merges(vocabulary, library):
    """The heap alone gives the library's merges, for words that are tokens too."""
    rng = random.Random(2)
    for _ in range(3000):
        w = "".join(rng.choice("aeinrst lhé漢") for _ in range(rng.randrange(1, 30))).encode()
        assert vocabulary.merged(w) == library._encode_single_piece(w) or w in vocabulary.ranks


def test_odd_and_random_texts(vocabulary, library, monkeypatch):
    rng = random.Random(7)
    signs = [chr(c) for c in range(0x250)] + list("漢字かな한국어العربيةहिन्दी🙂‍️́½Ⅷ٣ ᠎­") + [" ", " ", "'", "s", "\n"] * 20
    texts = [t or "" for t in ODD] + ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(4000)]
    want = [library.encode_ordinary(t) for t in texts]
    assert ids_of(vocabulary, texts) == want
    monkeypatch.setattr(byte_bpe, "SLICE", 100)
    monkeypatch.setattr(byte_bpe, "GATHERED", 500)
    assert ids_of(vocabulary, texts) == want


def test_generations(vocabulary, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT", 3)
    texts = [f"qzx{i % 11} vwq{i % 5}" for i in range(100)]
    assert ids_of(vocabulary, texts) == [library.encode_ordinary(t) for t in texts]


def test_whole_table(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op12_byte_bpe(spark, sf).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        ids = library.encode_ordinary(t or "")
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_rows_and_round_trip(spark, library):
    rows = [(i % 12, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ids", "n_tokens", "decoded")})
    want = sorted(((d, library.encode_ordinary(t or "")) for d, t in rows), key=repr)
    encoded = byte_bpe.encode(df)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=repr) == want
    assert sorted(((r.doc_id, bytes(r.decoded).decode()) for r in byte_bpe.decode(encoded).collect()), key=repr) == sorted(((d, t or "") for d, t in rows), key=repr)
    assert sorted((r.n_tokens for r in byte_bpe.digests(df).collect())) == sorted(len(ids) for _, ids in want)
    none = df.where("false")
    assert byte_bpe.digests(none).collect() == byte_bpe.encode(none).collect() == byte_bpe.decode(byte_bpe.encode(none)).collect() == []
    cut = spark.createDataFrame([(1, None), (2, []), (3, library.encode_ordinary("漢字")[:1])], "doc_id long, ids array<int>")
    assert [r.decoded is None for r in byte_bpe.decode(cut).orderBy("doc_id").collect()] == [True, False, False]
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([(1, [10**9])], "doc_id long, ids array<int>")).collect()
