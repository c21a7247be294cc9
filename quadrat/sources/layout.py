"""Tables of texts without separators, by where their cells stand.

A cell is a run of words one blank apart; two blanks or more part cells. Columns are clusters of beginnings over the
table's lines: a title's beginning is one, and so is any other at which enough
lines have a cell. A line that fills the key column with what a key looks like
begins a row; other lines go on with the row above, column by column, over page
breaks too.
"""

from __future__ import annotations

import re

#: Places by which beginnings of one column may differ, and the part of lines that makes a column without a title.
SLACK, SHARE = 2, 0.4
_CELL = re.compile(r"\S+(?: \S+)*")
_PAGE = re.compile(r"(?i)^\s*(?:page\s+\d+(?:\s+of\s+\d+)?|-\s*\d+\s*-)\s*$")


def cells(line: str) -> list[tuple[int, str]]:
    """(place, text) of a line's cells; a tab parts them, too, and goes to the next eighth place."""
    out, at = [], 0
    for part in line.split("\t"):
        out += [(at + m.start(), m[0]) for m in _CELL.finditer(part)]
        at = (at + len(part)) // 8 * 8 + 8
    return out


def columns(lines: list[str], titles: list[int]) -> list[int]:
    """Beginnings of the columns: those of titles, and of clusters that enough lines share and no title is near."""
    starts = sorted(at for line in lines for at, _ in cells(line))
    clusters: list[list[int]] = []
    for at in starts:
        if clusters and at - clusters[-1][-1] <= SLACK:
            clusters[-1].append(at)
        else:
            clusters.append([at])
    often = [c[len(c) // 2] for c in clusters if len(c) >= max(2, SHARE * len(lines))]
    return sorted({*titles, *(c for c in often if all(abs(c - t) > SLACK for t in titles))})


def table(text: str, names: tuple[str, ...], titles: tuple[str, ...], key: str, alone: bool = True) -> list[dict[str, str]]:
    """Rows of a table with a line of titles, by the names of its columns in order.

    ``titles``: the titles as they stand; the line that holds all but one of
    them at least is theirs, and its repetitions on later pages are skipped.
    ``key``: what the first column holds where a row begins; ``alone``: also if
    the line has no other cell. A cell belongs to
    the last column that begins at or before its end, and nearest to its
    beginning. Without a line of titles there are no rows.
    """
    lines = [line for line in text.splitlines() if line.strip() and not _PAGE.match(line)]
    low = [t.lower() for t in titles]
    is_head = lambda line: sum(t in line.lower() for t in low) >= max(1, len(low) - 1)
    head = next((i for i, line in enumerate(lines) if is_head(line)), None)
    if head is None:
        return []
    places, at, title = [], 0, lines[head].expandtabs(8).lower()
    for t in low:
        found = title.find(t, at)
        if found >= 0:
            places.append(found)
            at = found + len(t)
    body = [line for line in lines[head + 1 :] if not is_head(line)]
    begins = columns(body, places)
    if len(begins) != len(names):
        begins = places if len(places) == len(names) else begins[: len(names)]
    rows: list[dict[str, str]] = []
    for line in body:
        got: dict[str, str] = {}
        for place, cell in cells(line):
            k = min(range(len(begins)), key=lambda k: (abs(begins[k] - place) if begins[k] <= place + SLACK else 1 << 20, k))
            got[names[k]] = f"{got[names[k]]} {cell}" if names[k] in got else cell
        first = got.get(names[0], "")
        if re.fullmatch(key, first) and (alone or len(got) > 1 or not rows):
            rows.append(dict.fromkeys(names, "") | got)
        elif rows:
            for name, cell in got.items():
                rows[-1][name] = f"{rows[-1][name]} {cell}".strip()
    return rows
