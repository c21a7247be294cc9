"""The pipeline's stages against brute force on a small table with planted copies."""

from collections import Counter

import pytest

import corpus_pipeline
from quadrat.llm import mixing
from tests.llm.test_operators import ROWS, shingles, words


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    texts = {d: t for d, t, *_ in ROWS if d != 8}
    base = " ".join(f"the{i} of and" for i in range(80))
    planted = [(100 + i, " ".join(w if j != 7 * i else "other" for j, w in enumerate(base.split())), "en", "p") for i in range(4)]
    passage = " ".join(f"passage word{i}" for i in range(30))
    planted += [(200 + i, f"{' '.join(f'unique{i}x{j} text' for j in range(40))} {passage} end{i}", "en", "q") for i in range(3)]
    rows = [(d, t, "en", "s", len(t) if t is not None else None) for d, t in texts.items()] + [(d, t, x, s, len(t)) for d, t, x, s in planted]
    at = str(tmp_path_factory.mktemp("pipe"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return at


def near(a, b):
    a, b = shingles(a, 5), shingles(b, 5)
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def test_stages(spark, docs):
    table = spark.read.parquet(f"{docs}/documents.parquet")
    names = table.columns
    before = {r.doc_id: r for r in table.collect()}
    kept = corpus_pipeline.language_id(spark, table, docs).cache()
    assert kept.columns == names
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {d for d, r in before.items() if r.text and any(c.isalpha() for c in r.text)}

    one = corpus_pipeline.ngram_jaccard(spark, kept, docs).cache()
    want, left = set(), sorted(ids)
    group = {d: d for d in left}
    changed = True
    while changed:
        changed = False
        for a in left:
            for b in left:
                if group[a] > group[b] and near(before[a].text, before[b].text):
                    group[a], changed = group[b], True
    want = {d for d in left if group[d] == d}
    assert one.columns == names and Counter(r.doc_id for r in one.collect()) == Counter(want) and 100 in want and 101 not in want

    cut = corpus_pipeline.substring_dedup(spark, one, docs).cache()
    rows = one.collect()
    seen = Counter(tuple(w[i : i + 35]) for r in rows for w in [words(r.text)] for i in range(len(w) - 34))
    for r in cut.collect():
        old = before[r.doc_id].text
        w = words(old)
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        assert r.text == (" ".join(x for x, g in zip(w, gone) if not g) if any(gone) else old) and r.n_chars == len(r.text)
    assert cut.columns == names and all("passage" not in r.text for r in cut.where("doc_id >= 200").collect())

    mixed = corpus_pipeline.source_mixing(spark, cut, docs).cache()
    plan = {r.doc_id: r for r in mixing.mix_plan(cut).collect()}
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == names and all(times[d] * r["size"] == r.taken for d, r in plan.items())

    packed = corpus_pipeline.sequence_packing(spark, mixed, docs).toPandas()
    assert (packed[packed.start == 0].groupby("doc_id").size().to_dict()) == dict(times)
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


def test_run(spark, docs):
    assert corpus_pipeline.run(spark, docs).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "substring_dedup", "source_mixing", "sequence_packing"]


def test_run_on_nothing(spark, docs, tmp_path):
    spark.read.parquet(f"{docs}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
