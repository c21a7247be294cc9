"""Entries by compare-and-set, rebuilds that are all or nothing, and pulls whose mark waits for a clean run."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quadrat.operators import overlay, versions


def test_ledger(spark, tmp_path):
    a, b = (versions.Ledger(spark, f"file://{tmp_path}/l") for _ in range(2))
    assert a.last() == (0, None)
    assert a.put(0, {"x": 1}) == 1 and b.last() == (1, {"x": 1})
    with pytest.raises(versions.Conflict):
        b.put(0, {"x": 2})
    assert b.put(1, {"x": 3}) == 2
    with pytest.raises(versions.Conflict):
        a.put(1, {"x": 4})
    assert a.last() == (2, {"x": 3}) and a.get(1) == {"x": 1}


def steps(spark):
    labels = lambda records: records.groupBy("owner").agg(F.min("id").alias("component")).join(records, "owner").select("id", "component")
    clusters = lambda labels, decisions: overlay.assigned(labels, decisions)
    return {
        "applications": (("clusters", "records"), lambda c, r: c.join(r, "id").groupBy("component").agg(F.count("*").alias("n"), F.sum("acres").alias("acres"))),
        "clusters": (("labels", "decisions"), clusters), "labels": (("records",), labels), "records": (("files",), lambda f: f.dropDuplicates(["id"])),
    }


def test_rebuild(spark, tmp_path):
    files = spark.createDataFrame([(1, "a", 2.0), (2, "a", 3.0), (3, "b", 5.0), (3, "b", 5.0)], "id long, owner string, acres double")
    decisions = spark.createDataFrame([(2, 3, 1)], "id long, cluster long, decided int")
    v = versions.Versions(spark, f"file://{tmp_path}/v")
    with pytest.raises(KeyError):
        v.read("applications")
    v.rebuild({"files": files, "decisions": decisions}, steps(spark))
    first = sorted(map(tuple, v.read("applications").collect()))
    assert first == [(1, 1, 2.0), (3, 2, 8.0)]
    reader = v.read("applications")
    v.rebuild({"files": files, "decisions": decisions}, steps(spark))
    assert sorted(map(tuple, v.read("applications").collect())) == first == sorted(map(tuple, reader.collect()))
    # what fails changes nothing and leaves nothing
    broken = steps(spark) | {"applications": (("clusters",), lambda c: c.select(F.raise_error("broken").alias("x"), "id"))}
    folders = set((tmp_path / "v/versions").iterdir())
    for bad, of in ((broken, None), (steps(spark) | {"labels": (("nowhere",), None)}, None), (steps(spark), lambda t: 1 / 0)):
        with pytest.raises(Exception):  # noqa: B017
            v.rebuild({"files": files.where("id > 1"), "decisions": decisions}, bad, of)
        assert sorted(map(tuple, v.read("applications").collect())) == first and set((tmp_path / "v/versions").iterdir()) == folders
    with pytest.raises(ValueError):
        v.rebuild({"files": files, "records": files}, steps(spark))
    # two rebuilds at once: the one that ends first wins
    other = versions.Versions(spark, f"file://{tmp_path}/v")
    with pytest.raises(versions.Conflict):
        v.rebuild({"files": files, "decisions": decisions}, steps(spark), lambda t: other.rebuild({"files": files.where("id = 1"), "decisions": decisions}, steps(spark)))
    assert sorted(map(tuple, v.read("applications").collect())) == [(1, 1, 2.0)]
    assert len(v.prune(keep=1)) == 2 and v.prune(keep=1) == []
    assert v.read("applications").count() == 1


def listing(spark, *rows):
    """(name, hash, day)."""
    return spark.createDataFrame([(n, None, h, d) for n, h, d in rows], "name string, file_type string, sha256 string, received date")


def test_pulls(spark, tmp_path):
    day = lambda m, d: dt.date(2026, m, d)
    bad = set()
    load = lambda new: new.withColumn("problem", F.when(F.col("name").isin(*bad, ""), "can't be downloaded"))
    sinks = {"records": lambda good: good.select("name", F.length("name").alias("n")), "names": lambda good: good.select("name")}
    pull = versions.Pull(spark, f"file://{tmp_path}/p")
    assert pull.mark() is None and pull.window_start() == dt.date(2020, 1, 1) and pull.read("records") is None
    first = listing(spark, ("a.csv", "a", day(8, 1)), ("again.csv", "a", day(8, 2)), ("photo.jpg", "j", day(8, 1)), ("old.csv", "o", dt.date(2019, 1, 1)), ("b.csv", "b", day(8, 3)), ("none.csv", None, None))
    bad.add("b.csv")
    got = pull.run(first, day(9, 1), load, sinks)
    assert (got["seen"], got["not_importable"], got["ingested"], got["problems"], got["duplicate"]) == (5, 1, 2, 1, 1)
    assert got["mark"] is None and pull.mark() is None, "a problem keeps the mark"
    assert sorted(r.name.rstrip() for r in pull.read("records").collect()) in (["a.csv", "none.csv"], ["again.csv", "none.csv"])
    # a sink that raises makes nothing visible, and the next try writes over what it left
    with pytest.raises(ZeroDivisionError):
        pull.run(first, day(9, 2), load, sinks | {"names": lambda good: 1 / 0})
    assert pull.read("records").where("pull > 1").count() == 0
    bad.clear()
    got = pull.run(first, day(9, 2), load, sinks)
    assert got["ingested"] == 2 and got["mark"] == day(9, 2) == pull.mark(), "the bad file came through, and that without a hash is never known"
    assert pull.window_start() == day(8, 19)
    late = listing(spark, ("late.csv", "l", day(8, 20)), ("early.csv", "e", day(8, 1)), ("a2.csv", "a", day(9, 3)))
    got = pull.run(late, day(10, 1), load, sinks)
    assert (got["seen"], got["ingested"], got["duplicate"], got["pull"]) == (2, 1, 1, 3)
    assert versions.Pull(spark, f"file://{tmp_path}/q", overlap_days=14, coverage_start=day(1, 1)).window_start() == day(1, 1)
    near = versions.Pull(spark, f"file://{tmp_path}/r")
    near.ledger.put(0, {"mark": "2020-01-05"})
    assert near.window_start() == dt.date(2020, 1, 1), "never before coverage begins"
    other = versions.Pull(spark, f"file://{tmp_path}/p")
    with pytest.raises(versions.Conflict):
        pull.run(late, day(10, 2), lambda new: (other.run(late, day(10, 2), load, sinks), load(new))[1], sinks)


def test_release(spark, tmp_path, monkeypatch):
    """Only tables of runs go, and only old ones."""
    from quadrat.operators import storage

    monkeypatch.setattr(storage, "shared_folder", lambda _: f"file://{tmp_path}")
    one = storage.kept(spark.range(3), "one")
    (tmp_path / "people").mkdir()
    assert storage.release(spark) == [] and one.count() == 3
    (gone,) = storage.release(spark, hours=0)
    assert gone.startswith("one-") and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["people"]


def test_medians(spark):
    """One hot key over many tasks, nulls as a key and as values, even and odd counts."""
    import random
    import statistics

    from quadrat.operators import tallies

    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.choice(["u", None]), rng.choice([None, 1.5, float(rng.randrange(40))])) for _ in range(900)] + [("empty", "u", None), ("one", "u", 2.0)]
    want = {}
    for k, u, v in rows:
        if v is not None:
            want.setdefault((k, u), []).append(v)
    got = tallies.medians(spark.createDataFrame(rows, "p string, u string, rate double").repartition(6), "rate", "p", "u").collect()
    assert {(r.p, r.u): (r.n, r["median"]) for r in got} == {k: (len(v), statistics.median(v)) for k, v in want.items()}
