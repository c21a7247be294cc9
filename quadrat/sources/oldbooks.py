"""Rows of .xls workbooks: sector chains of a compound file, and the cell records of its workbook stream."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_END = 0xFFFFFFFA
#: Days between the two date systems.
SHIFT_1904 = 1462
#: Numbers of records.
BOUNDSHEET, SST, CONTINUE, FORMAT, XF, DATEMODE, EOF, BOF = 0x85, 0xFC, 0x3C, 0x41E, 0xE0, 0x22, 0x0A, 0x809
NUMBER, RK, MULRK, LABELSST, LABEL, FORMULA, STRING, BOOLERR = 0x203, 0x27E, 0xBD, 0xFD, 0x204, 0x06, 0x207, 0x205


def _chain(start: int, table: tuple[int, ...], sector: Callable[[int], bytes]) -> bytes:
    out, n = [], 0
    while start < _END:
        if n > len(table) or start >= len(table):
            raise ValueError("a chain of sectors is broken")
        out.append(sector(start))
        start, n = table[start], n + 1
    return b"".join(out)


def workbook_stream(raw: bytes) -> bytes:
    """The workbook's stream of a compound file."""
    if raw[:8] != MAGIC or len(raw) < 512:
        raise ValueError("not a compound file")
    shift, small = struct.unpack("<HH", raw[30:34])
    first, _, cutoff, mini, _, more, _ = struct.unpack("<7I", raw[48:76])
    size = 1 << shift
    sector = lambda i: raw[(i + 1) * size : (i + 2) * size]
    numbers = lambda b: struct.unpack(f"<{len(b) // 4}I", b[: len(b) // 4 * 4])
    fat_sectors, seen = list(struct.unpack("<109I", raw[76:512])), 0
    while more < _END:
        part = numbers(sector(more))
        fat_sectors += part[:-1]
        more, seen = part[-1] if part else _END, seen + 1
        if seen > len(raw) // size:
            raise ValueError("a chain of sectors is broken")
    fat = numbers(b"".join(sector(i) for i in fat_sectors if i < _END))
    folder = _chain(first, fat, sector)
    entries = {}
    for at in range(0, len(folder) - 127, 128):
        e = folder[at : at + 128]
        n = struct.unpack("<H", e[64:66])[0]
        name = "" if n < 2 else e[: n - 2].decode("utf-16-le", "replace")
        entries[name.lower() if e[66] == 2 else f"/{e[66]}"] = struct.unpack("<II", e[116:124])
    start, length = next((entries[n] for n in ("workbook", "book") if n in entries), (None, 0))
    if start is None:
        raise ValueError("no workbook in the compound file")
    if length >= cutoff:
        return _chain(start, fat, sector)[:length]
    whole = _chain(entries["/5"][0], fat, sector)
    tiny = 1 << small
    return _chain(start, numbers(_chain(mini, fat, sector)), lambda i: whole[i * tiny : (i + 1) * tiny])[:length]


def _records(stream: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(stream):
        kind, n = struct.unpack("<HH", stream[at : at + 4])
        yield kind, stream[at + 4 : at + 4 + n]
        at += 4 + n


class _Strings:
    """Strings over a record and those that continue it; characters that go on in the next one begin with a byte of their own width."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.i, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.i >= len(self.parts):
                raise ValueError("a string is cut off")
            got = self.parts[self.i][self.at : self.at + n - len(out)]
            out, self.at = out + got, self.at + len(got)
            if self.at >= len(self.parts[self.i]):
                self.i, self.at = self.i + 1, 0
        return out

    def text(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = "", flags & 1
        while n:
            room = min(n, (len(self.parts[self.i]) - self.at) // (2 if wide else 1)) if self.i < len(self.parts) else 0
            if not room:
                raise ValueError("a string is cut off")
            out += self.take(room * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1", "replace")
            n -= room
            if n:
                wide = self.take(1)[0] & 1
        self.take(4 * runs + extra)
        return out


def _short(b: bytes) -> str:
    """A text after its length and its width."""
    n, wide = struct.unpack("<HB", b[:3])
    return b[3 : 3 + n * (2 if wide & 1 else 1)].decode("utf-16-le" if wide & 1 else "latin-1", "replace")


def _rk(v: int) -> float:
    x = float(v >> 2 if v < 1 << 31 else (v >> 2) - (1 << 30)) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & ~3) << 32))[0]
    return x / 100 if v & 1 else x


def sheets(raw: bytes, built_in: set[int], shown: Callable[[str, bool], str]) -> Iterator[tuple[str, Iterator[list[str]]]]:
    """(name, rows) of each sheet. ``built_in``: numbers of date formats; ``shown``: a number's text, as a date or not."""
    stream = workbook_stream(raw)
    found, strings, own, formats, shift, pending = [], [], set(), [], 0, None
    for kind, b in _records(stream):
        if pending is not None and kind != CONTINUE:
            source = _Strings([p for p in (pending[0][8:], *pending[1:]) if p])
            strings, pending = [source.text() for _ in range(struct.unpack("<I", pending[0][4:8])[0])], None
        if kind == BOUNDSHEET and b[5] == 0:
            n, wide = b[6], b[7] & 1
            found.append((struct.unpack("<I", b[:4])[0], b[8 : 8 + n * (1 + wide)].decode("utf-16-le" if wide else "latin-1", "replace")))
        elif kind == SST:
            pending = [b]
        elif kind == CONTINUE and pending is not None:
            pending.append(b)
        elif kind == FORMAT:
            if re.search("[ydh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", _short(b[2:]).lower())):
                own.add(struct.unpack("<H", b[:2])[0])
        elif kind == XF:
            formats.append(struct.unpack("<H", b[2:4])[0])
        elif kind == DATEMODE:
            shift = SHIFT_1904 * struct.unpack("<H", b[:2])[0]
        elif kind == EOF:
            break
    dates = {i for i, f in enumerate(formats) if f in own | built_in}
    for offset, name in found:
        yield name, iter(_cells(stream, offset, strings, dates, shift, shown))


def _cells(stream: bytes, at: int, strings: list[str], dates: set[int], shift: int, shown: Callable[[str, bool], str]) -> list[list[str]]:
    cells: dict[tuple[int, int], str] = {}
    depth, last = 0, None

    def number(row: int, col: int, xf: int, v: float) -> None:
        cells[row, col] = shown(repr(v + shift if xf in dates else v), xf in dates)

    for kind, b in _records(stream, at):
        if kind == BOF:
            depth += 1
        elif kind == EOF:
            depth -= 1
            if not depth:
                break
        elif depth > 1:
            continue
        elif kind == NUMBER:
            number(*struct.unpack("<HHHd", b[:14]))
        elif kind == RK:
            row, col, xf, v = struct.unpack("<HHHI", b[:10])
            number(row, col, xf, _rk(v))
        elif kind == MULRK:
            row, col = struct.unpack("<HH", b[:4])
            for k in range((len(b) - 6) // 6):
                xf, v = struct.unpack("<HI", b[4 + 6 * k : 10 + 6 * k])
                number(row, col + k, xf, _rk(v))
        elif kind == LABELSST:
            row, col, _, i = struct.unpack("<HHHI", b[:10])
            cells[row, col] = strings[i]
        elif kind == LABEL:
            cells[struct.unpack("<HH", b[:4])] = _short(b[6:])
        elif kind == BOOLERR and not b[7]:
            cells[struct.unpack("<HH", b[:4])] = str(b[6])
        elif kind == FORMULA:
            row, col, xf = struct.unpack("<HHH", b[:6])
            if b[12:14] != b"\xff\xff":
                number(row, col, xf, struct.unpack("<d", b[6:14])[0])
            elif b[6] == 0:
                last = (row, col)
            elif b[6] == 1:
                cells[row, col] = str(b[8])
        elif kind == STRING and last:
            cells[last], last = _short(b), None
    rows: list[list[str]] = []
    for (row, col), text in sorted(cells.items()):
        rows += [[] for _ in range(row + 1 - len(rows))]
        rows[row] += [""] * (col + 1 - len(rows[row]))
        rows[row][col] = text
    return rows
