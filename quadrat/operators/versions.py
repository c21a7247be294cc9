"""Numbered entries with compare-and-set, versions of derived tables that are swapped in one step, and pulls that move a mark.

All of it is files in a shared store, through Spark's own file systems. An
entry is a file that is created only if no other has its number, so of two
writers one wins and the other learns of it. A version is a folder of tables;
readers follow the last entry, so they see the old version until the new one is
whole, and a rebuild that fails changes nothing.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.operators.ingest import importable
from quadrat.operators.storage import kept

#: Days that a pull looks back over, and where coverage begins.
OVERLAP_DAYS, COVERAGE_START = 14, dt.date(2020, 1, 1)

#: A claim on a number that has no entry by then is a dead writer's.
STALE_SECONDS = 600


class Conflict(RuntimeError):
    """Another writer was first."""


class Ledger:
    """Entries 1, 2, ... of small JSON values below a folder."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs

    def path(self, name: str = ""):
        return self._jvm.Path(f"{self.at}/{name}" if name else self.at)

    @property
    def files(self):
        return self.path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        fs, entries = self.files, self.path("entries")
        if not fs.exists(entries):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(entries) if s.getLen() > 0]
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n))

    def last(self) -> tuple[int, dict | None]:
        """Number and value of the last entry; 0 and None before the first."""
        numbers = self._numbers()
        return (numbers[-1], self.get(numbers[-1])) if numbers else (0, None)

    def get(self, number: int) -> dict:
        stream = self.files.open(self.path(f"entries/{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put(self, expected: int, value: dict) -> int:
        """Add the entry after ``expected``; a Conflict if that isn't the last one any more. The value is written aside and takes its number by a rename, which fails if the number is taken."""
        fs, to = self.files, self.path(f"entries/{expected + 1:012d}.json")
        if self.last()[0] != expected:
            raise Conflict(f"entry {expected} isn't the last one")
        aside = self.path(f"aside/{uuid.uuid4().hex}")
        fs.mkdirs(self.path("entries"))
        out = fs.create(aside, False)
        out.write(json.dumps(value, default=str).encode())
        out.close()
        claim = self.path(f"aside/claim-{expected + 1:012d}")
        if fs.exists(claim) and time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 > STALE_SECONDS:
            fs.delete(claim, False)  # of a writer that died; the entry isn't there, as the check above has it
        try:
            fs.create(claim, False).close()  # one writer only
        except Exception as e:
            fs.delete(aside, False)
            raise Conflict(f"entry {expected + 1} is taken") from e
        if not fs.rename(aside, to):
            fs.delete(claim, False)
            raise Conflict(f"entry {expected + 1} is taken")
        return expected + 1


#: A table's needs, and how it is made of them.
Step = tuple[tuple[str, ...], Callable[..., DataFrame]]


class Versions:
    """Versions of derived tables below a folder."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.ledger = spark, Ledger(spark, at)

    def _folder(self, version: str) -> str:
        return f"{self.ledger.at}/versions/{version}"

    def read(self, table: str) -> DataFrame:
        """The table in the current version."""
        _, entry = self.ledger.last()
        if entry is None or table not in entry["tables"]:
            raise KeyError(table)
        return self.spark.read.parquet(f"{self._folder(entry['version'])}/{table}")

    def rebuild(self, sources: dict[str, DataFrame], steps: dict[str, Step], check: Callable[[dict[str, DataFrame]], None] | None = None) -> str:
        """Make every table anew and let readers see them at once; the new version's name.

        ``steps`` names tables, each with the sources and tables that it needs,
        in any order; people's decisions are sources, which no version holds, so
        they outlive all. ``check`` may raise on the new tables. If anything
        raises, or another rebuild was first, the old version stays and the new
        folder goes.
        """
        number, _ = self.ledger.last()
        version = f"{number + 1:06d}-{uuid.uuid4().hex[:8]}"
        made, left = dict(sources), dict(steps)
        if clash := sources.keys() & steps.keys():
            raise ValueError(f"both a source and a table: {sorted(clash)}")
        try:
            while left:
                ready = [n for n, (needs, _) in left.items() if all(m in made for m in needs)]
                if not ready:
                    raise ValueError(f"needs that nothing makes, or that go in a circle: {sorted(left)}")
                for name in ready:
                    needs, make = left.pop(name)
                    at = f"{self._folder(version)}/{name}"
                    make(*(made[m] for m in needs)).write.parquet(at)
                    made[name] = self.spark.read.parquet(at)
            if check:
                check({n: made[n] for n in steps})
            self.ledger.put(number, {"version": version, "tables": sorted(steps)})
        except BaseException:
            self.ledger.files.delete(self.ledger.path(f"versions/{version}"), True)
            raise
        return version

    def prune(self, keep: int = 2) -> list[str]:
        """Delete all but the last ``keep`` versions, which readers that began on them may still use; folders that no entry names, of rebuilds that died, go too if they are older than the last entry. The names of what went."""
        numbers = self.ledger._numbers()
        named = {self.ledger.get(n)["version"] for n in numbers[-max(1, keep) :]}
        fs, folder, gone = self.ledger.files, self.ledger.path("versions"), []
        if not numbers or not fs.exists(folder):
            return gone
        for s in fs.listStatus(folder):
            name = s.getPath().getName()
            if name not in named and int(name[:6]) <= numbers[-1]:
                fs.delete(s.getPath(), True)
                gone.append(name)
        return sorted(gone)


class Pull:
    """Pulls of files by a high-water mark into several sinks.

    A pull looks at files received since the mark less an overlap, or since
    coverage begins, and takes those of a type that can be imported and of a
    hash that no earlier pull holds. Each sink is written under the pull's
    number, over what a try that died left there; then one entry makes all of
    them visible, and moves the mark only if no file had a problem. So files
    that came through stay, and the window with the bad one is looked at again.
    """

    def __init__(self, spark: SparkSession, at: str, coverage_start: dt.date = COVERAGE_START, overlap_days: int = OVERLAP_DAYS):
        self.spark, self.ledger, self.start, self.overlap = spark, Ledger(spark, at), coverage_start, dt.timedelta(days=overlap_days)

    def mark(self) -> dt.date | None:
        _, entry = self.ledger.last()
        return dt.date.fromisoformat(entry["mark"]) if entry and entry["mark"] else None

    def window_start(self) -> dt.date:
        mark = self.mark()
        return self.start if mark is None else max(mark - self.overlap, self.start)

    def read(self, sink: str) -> DataFrame | None:
        """What all pulls that ended have written to a sink, with the column ``pull``; None before the first."""
        numbers = self.ledger._numbers()
        parts = [self.spark.read.parquet(f"{self.ledger.at}/sinks/{sink}/pull-{n}").withColumn("pull", F.lit(n)) for n in numbers]
        for other in parts[1:]:
            parts[0] = parts[0].unionByName(other)
        return parts[0] if parts else None

    def run(self, files: DataFrame, today: dt.date, load: Callable[[DataFrame], DataFrame], sinks: dict[str, Callable[[DataFrame], DataFrame]]) -> dict:
        """Pull files (name, file_type, sha256, received, ...) and return the pull's figures.

        ``load`` gives each new file a ``problem``, or null, and whatever sinks
        need; a sink is a function of the loaded files without a problem. A file
        without a hash is never known; one without a date is always in the
        window. If ``load`` or a sink raises, no entry is made and nothing is
        visible. The sink ``files`` holds hashes and problems.
        """
        number, _ = self.ledger.last()
        start = self.window_start()
        seen = files.where(F.col("received").isNull() | (F.to_date("received") >= F.lit(start)))
        right = seen.where(importable(F.col("file_type"), F.col("name")))
        held = self.read("files")
        new = right.where("sha256 is not null").dropDuplicates(["sha256"])
        if held is not None:
            new = new.join(held.where("problem is null and sha256 is not null").select("sha256").distinct(), "sha256", "left_anti")
        loaded = kept(load(new.unionByName(right.where("sha256 is null").select(*new.columns))), "loaded")
        good = loaded.where("problem is null")
        for name, of in ({"files": lambda _: loaded.select("name", "sha256", "received", "problem")} | sinks).items():
            of(good).write.mode("overwrite").parquet(f"{self.ledger.at}/sinks/{name}/pull-{number + 1}")
        told = loaded.agg(F.count_if(F.col("problem").isNull()).alias("ingested"), F.count_if(F.col("problem").isNotNull()).alias("problems")).first()
        counts = seen.agg(F.count("*").alias("seen"), F.count_if(~importable(F.col("file_type"), F.col("name"))).alias("not_importable")).first()
        figures = {"window_start": start.isoformat(), "seen": counts.seen, "not_importable": counts.not_importable, "ingested": told.ingested, "problems": told.problems}
        figures["duplicate"] = counts.seen - counts.not_importable - told.ingested - told.problems
        mark = self.mark() if told.problems else today
        self.ledger.put(number, figures | {"mark": mark.isoformat() if mark else None})
        return figures | {"pull": number + 1, "mark": mark}
