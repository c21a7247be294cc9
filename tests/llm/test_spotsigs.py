"""Signatures and likeness beside chains that plain Python makes."""

import re

import pytest

from quadrat.llm import spotsigs


def chains(text):
    w = [x for x in re.split("[" + re.escape(spotsigs._SIGNS + " ") + "]", text.lower()) if x]
    anchors, out = set(spotsigs.ANCHORS), set()
    for i in range(1, len(w)):
        if w[i - 1] in anchors and w[i] not in anchors:
            after = next((x for x in w[i + 1 : i + 1 + spotsigs.REACH] if x not in anchors), "")
            out.add((w[i - 1], w[i], after))
    return out or ({tuple(w)} if w else set())


def jaccard(a, b):
    if not a and not b:
        return 1.0
    return len(a & b) / len(a | b)


def test_against_chains(spark, sf):
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in spotsigs.edited_fingerprints(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        own, edited = chains(t), chains(t[: len(t) - half] + after[:half])
        assert len(got[d].fingerprint.split()) == len(own) and len(got[d].edited_fingerprint.split()) == len(edited)
        assert got[d].near_edited == pytest.approx(jaccard(own, edited)) and got[d].near_next == pytest.approx(jaccard(own, chains(after)))


def test_length_partitions(spark):
    """Sizes whose ratio reaches the least are in the same or neighbouring partitions."""
    for least in (0.1, 0.8):
        df = spark.range(1, 400).withColumn("p", spotsigs.partition(spotsigs.F.col("id"), least))
        p = {r.id: r.p for r in df.collect()}
        assert all(abs(p[a] - p[b]) <= 1 for a in p for b in p if min(a, b) >= least * max(a, b))
