"""Language filters beside a version in plain Python, and what the pipeline's first stage keeps."""

import re
import unicodedata
import zlib
from collections import Counter

import pytest

from quadrat.llm import langid

MASK = (1 << 64) - 1


def mixed(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & MASK
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & MASK
    return h ^ (h >> 31)


def stream(text):
    """Letters in lower case (ASCII and Latin-1 ones), one space for anything else of ASCII, one before and after."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or "\xc0" <= c <= "\xde" else c for c in text)
    return b" " + re.sub(rb"[^a-z\x80-\xff]+", b" ", low.encode()).strip(b" ") + (b" " if re.search(rb"[a-z\x80-\xff]", low.encode()) else b"")


def grams(text):
    s = stream(text)
    return [s[i : i + k] for k in langid.SIZES for i in range(len(s)) if i + k <= len(s)]


def key(g):
    return int.from_bytes(g, "little") | len(g) << 56


def test_against_plain_python(spark, sf):
    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 3 = 0").select("doc_id", "text", "lang").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.train(docs, per_language=1 << 40)
    seen = {}
    for r in rows:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            seen.setdefault(r.lang, Counter()).update(g for g in grams(r.text))
    total = {k: sum(c.values()) for k, c in seen.items()}
    slots = len(filters.planes[0])
    table = {k: set() for k in seen}
    for g in set().union(*seen.values()):
        top = max(c[g] / total[k] for k, c in seen.items())
        for k, c in seen.items():
            if c[g] >= langid.LEAST_SEEN and c[g] / total[k] >= langid.RATIO * top:
                table[k] |= {(mixed(key(g)) >> 32 * i) & (slots - 1) for i in range(langid.PROBES)}
    names = sorted(table)
    assert filters.languages == names
    for i, k in enumerate(names):
        assert {int(x) for x in ((filters.planes[0] >> i) & 1).nonzero()[0]} == table[k]
    chance = {k: (len(t) / slots) ** langid.PROBES for k, t in table.items()}
    got = {r.doc_id: r for r in langid.predict(docs, filters).collect()}
    for r in rows:
        if r.text is None or not any(unicodedata.category(c)[0] == "L" for c in r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        keys = [mixed(key(g)) for g in grams(r.text)]
        est = {}
        for k in names:
            hits = sum(all((h >> 32 * i) & (slots - 1) in table[k] for i in range(langid.PROBES)) for h in keys)
            est[k] = max(0.0, (hits - len(keys) * chance[k]) / (1 - chance[k]))
        best = max(names, key=lambda k: est[k])
        assert got[r.doc_id].lang_pred == best and got[r.doc_id].score == pytest.approx(est[best] / sum(est.values()))


def test_kept_texts(spark, sf):
    filters = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    odd = " ".join(chr(0x10A0 + i % 37) + chr(0x10A0 + i * 7 % 37) + chr(0x10A0 + i * 11 % 37) for i in range(400))
    rows = [(1, odd, 1), (2, "ok", 2), (3, None, 3), (4, "1 2 3", 4), (5, "the house and the garden of the people are in the city that we know " * 4, 5), (5, "ok", 6), (6, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long").withColumnsRenamed({"row": "known"})
    kept = langid.keep_known(df, filters)
    assert kept.columns == df.columns and sorted(r.known for r in kept.collect()) == [2, 5, 6]


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    df = spark.createDataFrame([(i, "some words", f"l{i}") for i in range(20)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 3"):
        langid.train(df)


def test_more_languages_than_a_plane_has(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} word{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5, f"l{i:03}") for i in range(100)]
    df = spark.createDataFrame([(1000 * k + i, t, x) for i, t, x in rows for k in range(4)], "doc_id long, text string, lang string")
    filters = langid.train(df)
    assert len(filters.planes) == 2
    got = langid.predict(df, filters).join(df.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() > 0.95 * got.count()
