"""Delimited files read by many splits, beside the library's reader over the whole file."""

import csv
import io
import random

import pytest

from quadrat.sources import delimited, tabular

CELLS = ["plain", "", 'say ""so""', "two\nlines", "a,b;c", "x" * 80, 'five 5" pipe', "é漢", "\n\n", '""']


def written(rng, rows, delimiter):
    out = []
    for _ in range(rows):
        cells = []
        for _ in range(rng.randrange(1, 6)):
            c = rng.choice(CELLS)
            cells.append(f'"{c}"' if (set(c) & set('\n,;"') and not c.startswith("five")) or rng.random() < 0.2 and '"' not in c else c)
        out.append(delimiter.join(cells) + rng.choice(["", "", "tail"] if cells[-1].endswith('"') else [""]))
    return "\n".join(out) + rng.choice(["", "\n"])


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "311")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def plain(text, delimiter):
    return [(i, [c.strip() for c in row]) for i, row in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter), 1)]


def test_splits(spark, tmp_path, small_splits):
    """Quotes, doubled quotes, line breaks and delimiters in cells, over dozens of splits and several files at once."""
    rng = random.Random(11)
    want = {}
    for k, delimiter in enumerate(",;\t|,"):
        text = delimiter.join(["h1", "h2", "h3"] * 3) + "\n" + written(rng, 60, delimiter)
        (tmp_path / f"f{k}.csv").write_text(text, newline="")
        want[f"f{k}.csv"] = plain(text, delimiter)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "mark.csv").write_bytes("﻿a,b\r\n\r\n1,2\r\n".encode())
    want["mark.csv"] = [(1, ["a", "b"]), (2, []), (3, ["1", "2"])]
    df = delimited.split_rows(spark, str(tmp_path), tabular.DELIMITERS, tabular.SNIFFED_LINES)
    got = {}
    for r in df.collect():
        got.setdefault(r.file.rpartition("/")[2], []).append((r.line, r.cells))
    assert {f: sorted(v) for f, v in got.items()} == want


def test_states():
    """The state after a line is that of the library's reader, from both states and for each delimiter."""
    rng = random.Random(4)
    for _ in range(4000):
        line = "".join(rng.choice('",;a ') for _ in range(rng.randrange(12)))
        for d in ",;":
            for quoted in (False, True):
                head = '"\n' if quoted else ""
                # a second line with a mark that begins a record of its own unless a quote is open
                rows = list(csv.reader(io.StringIO(head + line + "\nMARK", newline=""), delimiter=d))
                assert delimited.ends_quoted(line, d, quoted) == (rows[-1] != ["MARK"]), (line, d, quoted)


def test_a_quote_never_closed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delimited, "MOST_LINES", 5)
    (tmp_path / "a.csv").write_text('a,b\n1,2\n3,"4\n' + "".join(f"{i},x\n" for i in range(20)))
    got = sorted((r.line, r.cells) for r in delimited.split_rows(spark, str(tmp_path), tabular.DELIMITERS, 40).collect())
    assert got[:2] == [(1, ["a", "b"]), (2, ["1", "2"])] and len(got) == 23 and [3, ["3", "4"]] in [list(g) for g in got]


def test_header_read_once_and_problems(spark, tmp_path, small_splits):
    """Ten splits give the rows of one; a file without a header is a problem, not silence."""
    head = "Permit #,Operator Name,Site ID,Appl Date,Product,Quantity,Units\n"
    body = "".join(f'{i},"Ranch\n{i}",30{i:04d},7/{i % 28 + 1}/2021,"X ""{i}""",{i},Gal\n' for i in range(60))
    (tmp_path / "use.csv").write_text("County export\n\n" + head + body)
    (tmp_path / "other.csv").write_text("one,two\n1,2\n")
    got = sorted((r.permit_number, r.operator_name, r.product_name, r.quantity) for r in tabular.use_records(spark, str(tmp_path)).collect())
    assert got == sorted((str(i), f"Ranch\n{i}", f'X "{i}"', float(i)) for i in range(60))
    (bad,) = tabular.problems(spark, str(tmp_path)).collect()
    assert bad.file.endswith("other.csv") and "known labels" in bad.problem
