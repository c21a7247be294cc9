"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

An archive is a row of gzip members, one a record. The reader deals byte
ranges to tasks. A task looks for gzip's magic bytes from the beginning of its
range, takes a place for a member only if it decodes to a record's header, and
from there reads member after member; it owns those that begin inside its range
and reads on past the end to finish the last. Between members nothing may stand,
so a place where the next one should begin but no whole one does is damage and
an error, as is a number of records that isn't the one written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spill import partitions, scratch, written

MAGIC = b"\x1f\x8b\x08"
#: What a record begins with.
VERSION = b"WARC/1."
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads shorter than this are never stored as revisits.
LEAST_BYTES = 0


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One gzip member: the response, or a revisit that holds the HTTP header only."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _open(folder)
        system.create_dir(at, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        size = n = 0
        with system.open_output_stream(f"{at}/{name}", compression=None) as out:
            for b in batches:
                for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    raw = record(page_id, url, (html or "").encode(), refers_to, revisit)
                    out.write(raw)
                    size, n = size + len(raw), n + 1
        if n:
            yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([size]), pa.array([n])], ["path", "size", "records"])
        else:
            system.delete_file(f"{at}/{name}")

    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write a record for each row of pages (page_id long, url, html; a null html is empty); (path, size, records) of the files.

    Of rows with equal payloads the one of the largest page_id is a response and
    the others revisit it; rows that share that page_id are all responses, as
    are payloads shorter than ``least_bytes``. A task writes a file of a name of
    its own and only files of tasks that ended well are listed, so lost or
    repeated tasks leave nothing that is read.
    """
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    small = pages.select("page_id", digest.alias("d")).where(size >= least_bytes)
    equal = small.groupBy("d").agg(F.max("page_id").alias("largest"), F.count("*").alias("c")).where("c > 1")
    # numbers and digests meet; a page gets its answer by its number, so copies of one page are no hot key where html travels
    known = small.join(equal, "d").where("largest is not null and not page_id <=> largest").select(F.col("page_id").alias("_id"), F.col("d").alias("_d"), F.col("largest").alias("refers_to")).distinct()
    known = written(known, "revisits")
    rows = pages.select("page_id", "url", "html", digest.alias("d")).join(known, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("d") == F.col("_d")), "left")
    rows = rows.select("page_id", "url", "html", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))
    return written(rows.mapInArrow(_writer(folder), "path string, size long, records long"), "files")


class RecordReader:
    """Records of an archive that begin in a byte range. Damage is an error: a member that is cut short or whose stream or checksum is wrong, and anything else between members."""

    def __init__(self, source, start: int, end: int, size: int):
        self.source, self.end, self.size = source, end, size
        self.base, self.data = start, bytearray()

    def _more(self) -> bool:
        at = self.base + len(self.data)
        if at >= self.size:
            return False
        self.source.seek(at)
        got = self.source.read(min(READ_BYTES, self.size - at))
        self.data += got
        return bool(got)

    def _drop(self, n: int) -> None:
        self.base += n
        del self.data[:n]

    def _member(self) -> tuple[bytes, int] | None:
        """The record at the beginning of the data and its length there; None if what begins here isn't a record. Raises if one begins and doesn't end."""
        squeezed = zlib.decompressobj(31)
        try:
            head = squeezed.decompress(self.data, len(VERSION))
            while len(head) < len(VERSION) and not squeezed.eof:
                n = len(self.data)
                if not self._more():
                    return None
                head += squeezed.decompress(squeezed.unconsumed_tail + self.data[n:], len(VERSION) - len(head))
        except zlib.error:
            return None
        if head != VERSION:
            return None
        parts, rest = [head], squeezed.unconsumed_tail
        try:
            while True:
                parts.append(squeezed.decompress(rest))
                if squeezed.eof:
                    return b"".join(parts), len(self.data) - len(squeezed.unused_data)
                n = len(self.data)
                if not self._more():
                    raise ValueError(f"a record at byte {self.base} is cut short")
                rest = self.data[n:]
        except zlib.error as e:
            raise ValueError(f"a damaged record at byte {self.base}: {e}") from None

    def __iter__(self) -> Iterator[bytes]:
        inside = self.base == 0  # at the border of a member, not somewhere within one
        while self.base < self.end:
            if len(self.data) < len(MAGIC) and self._more():
                continue
            at = self.data.find(MAGIC)
            if inside and self.data and at != 0:
                raise ValueError(f"no record begins at byte {self.base}, where the last one ends")
            if at < 0:
                keep = min(len(self.data), len(MAGIC) - 1)
                self._drop(len(self.data) - keep)
                if self.base >= self.end or not self._more():
                    return
                continue
            self._drop(at)
            if self.base >= self.end:
                return
            if found := self._member():
                yield found[0]
                self._drop(found[1])
                inside = True
            elif inside:
                raise ValueError(f"no record begins at byte {self.base}, where the last one ends")
            else:
                self._drop(1)


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's header, HTTP header and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def _number(urn: str | None) -> int | None:
    text = (urn or "")[len("<urn:page:") : -1]
    return int(text) if text else None


def _reader(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, end, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                system, at = _open(path)
                rows = []
                with system.open_input_file(at) as source:
                    for raw in RecordReader(source, start, end, size):
                        fields, http, payload = parse(raw)
                        kind = fields["WARC-Type"]
                        said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        n = int(http.rpartition(b"Content-Length: ")[2])
                        if kind == "response" and (payload_digest(payload) != said or len(payload) != n):
                            raise ValueError(f"{path}: a record's payload isn't what its header says")
                        rows.append((_number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), n, said, kind, _number(fields.get("WARC-Refers-To")), payload.decode() if payloads and kind == "response" else None))
                        if len(rows) >= 500:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return run


_ROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload of responses) of the records of files (path, size). A file is dealt out in ranges of ``split_bytes``, in shuffled order so that tasks get like shares."""
    ranges = files.select("path", "size", F.explode(F.expr(f"sequence(0L, greatest(size - 1, 0L), {split_bytes}L)")).alias("start"))
    ranges = ranges.select("path", "start", F.least("size", F.col("start") + split_bytes).alias("end"), "size").where("size > 0")
    ranges = ranges.repartition(partitions(files.sparkSession), "path", "start")
    out = ranges.mapInArrow(_reader(payloads), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")
    return out if payloads else out.drop("payload")


def checked(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows as a table in the shared folder; an error if they aren't as many as the records of files."""
    rows = written(rows, "records")
    got, want = rows.count(), files.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    if got != want:
        raise ValueError(f"{got} records were read and {want} written")
    return rows


def round_trip(pages: DataFrame, folder: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row of pages, as read back from the archives. A null html is an empty payload; rows that share page_id and html have one answer; no rows give none."""
    files = write_archives(pages, folder or scratch(pages.sparkSession, "warc"))
    return checked(read_archives(files, split_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), files)
