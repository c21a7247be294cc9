"""Very long words, repeated rows and clashing columns through the operators."""

import pytest
from pyspark.sql import functions as F

from quadrat.llm import embeddings, langid, licences, mixing, ngram_join, packing, spotsigs, substrings

LONG = "ab" * 300_000
ROWS = [(1, LONG, "en", "s"), (2, LONG, "en", "s"), (2, LONG, "en", "s"), (3, "the " * 40 + LONG, "en", None), (4, None, None, None), (5, "漢" * 100_000, "zh", "t"), (6, "", "en", "t")]
NAMES = ("fp", "h", "cid", "u", "copy", "grp", "_row", "_u", "_of", "rate", "suspect", "spans", "f", "lo", "hi", "every", "known", "rep")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(NAMES))).cache()


OPERATORS = {
    "op1": lambda df: langid.predict(df, langid.train(df)), "op2": substrings.removals, "op3": ngram_join.ngram_components, "op5": mixing.mix_plan, "op6": spotsigs.edited_fingerprints, "op7": licences.scan,
    "one_of_each": ngram_join.one_of_each, "dedup_text": substrings.dedup_text, "mix": mixing.mix, "keep_known": lambda df: langid.keep_known(df, langid.train(df)),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows(odd, name):
    got = OPERATORS[name](odd)
    n = got.count()
    if name.startswith("op") or name == "dedup_text":
        assert n == len(ROWS)
    else:
        assert got.columns == odd.columns
    if name == "op3":
        assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    if name == "one_of_each":
        assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 5, 6]


def test_packing_many_copies(spark, monkeypatch):
    """Copies of one row and the pieces of one long text are dealt to many groups."""
    rows = [(1, "same words here")] * 300 + [(2, "word " * 120_000), (None, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").withColumn("copy", F.lit(1)), group_pieces=50).toPandas()
    assert (got[got.start == 0].groupby("doc_id", dropna=False).size().to_dict())[1] == 300
    assert (got.sequence_id // 2**32).value_counts().max() < 150 and got.groupby("sequence_id").length.sum().max() <= 2048
    two = got[got.doc_id == 2]
    assert two.length.sum() == two.doc_tokens.iloc[0] and got.doc_id.isna().sum() == 1


def test_clashing_columns_of_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [0.0, 1.0]), (3, None)], "vec_id long, embedding array<double>")
    got = embeddings.near_duplicates(v.select("*", *(F.lit(i).alias(n) for i, n in enumerate((*NAMES, "v", "m", "dim", "label", "n_links")))))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
