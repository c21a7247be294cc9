"""The trigram index beside the scan, for patterns of every kind."""

import random

from pyspark.sql import functions as F

from quadrat.operators import search


def test_same_rows_as_the_scan(spark, tmp_path):
    rng = random.Random(5)
    words = ["Red", "redwood", "PREDATOR", "Ünï", "a%b", "x_y", "12-34", "", "re", "ed r", "İstanbul", "漢字かな", "back\\slash"]
    rows = [(i, rng.choice([None, " ".join(rng.choice(words) for _ in range(rng.randrange(4)))]), rng.choice(words), str(rng.randrange(50))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, operator string, product string, permit string")
    index = search.TrigramIndex(spark, f"file://{tmp_path}/index")
    index.add(search.long_form(df.where("id < 250"), "id", "operator", "product", "permit"))
    index.add(search.long_form(df.where("id >= 200"), "id", "operator", "product", "permit"))
    for text in ["red", "RED", "redw", "ed r", "re", "", "ünï", "a%b", "x_y", "r_dwood", "red%od", "12-34", "漢字か", "nothing here", "4", "ed redwood", "predator red", "____", "istan"]:
        for fields in [(), ("operator",), ("product", "permit")]:
            like = [F.col(c).ilike(f"%{text}%") & (F.col(c) != "") for c in fields or ("operator", "product", "permit")]
            some = F.lit(False)
            for c in like:
                some = some | F.coalesce(c, F.lit(False))
            want = sorted(r.id for r in df.where(some).collect())
            assert sorted(r.id for r in index.search(text, *fields).collect()) == want, (text, fields)


def test_reads_only_its_trigrams(spark, tmp_path):
    """The search's filters reach the scan of postings."""
    df = spark.range(2000).select("id", F.lit("name").alias("field"), F.concat(F.lit("owner "), F.hex(F.xxhash64("id"))).alias("value"))
    index = search.TrigramIndex(spark, f"file://{tmp_path}/index")
    index.add(df)
    value = df.where("id = 77").first().value
    found = index.search(value[6:])
    assert [r.id for r in found.collect()] == [77]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [IsNotNull(vid), In(gram" in plan or "In(gram" in plan


def test_rows_are_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    """What is sorted and kept beside the rows grows with the different values, not with the rows."""
    sent, keep, sort = {}, search.kept, type(spark.range(0)).repartitionByRange
    monkeypatch.setattr(search, "kept", lambda df, name: (lambda out: sent.update({name: (out.count(), out.columns)}) or out)(keep(df, name)))
    monkeypatch.setattr(type(spark.range(0)), "repartitionByRange", lambda df, *a: sent.update({a: (df.count(), df.columns)}) or sort(df, *a))
    df = spark.range(3000).select("id", F.lit("name").alias("field"), F.concat(F.lit("owner "), F.col("id") % 3).alias("value"))
    index = search.TrigramIndex(spark, f"file://{tmp_path}/index")
    index.add(df.unionByName(df.limit(100)))
    assert sent and all(n <= 3 * len("owner 1") and "id" not in columns for n, columns in sent.values())
    assert sorted(r.id for r in index.search("OWNER 2").collect()) == list(range(2, 3000, 3))


def test_literals():
    assert search.literals("Red%wood_x") == ["ood", "red", "woo"] and search.literals("ab") == [] and search.literals("%%a_b%") == []
