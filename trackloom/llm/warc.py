"""WARC archives: gzip members written through Spark's own writer, read again by byte ranges.

Writing.  Every page becomes one record in a gzip member of its own.  Of pages with
equal payloads (at least LEAST_PAYLOAD bytes) those with the smallest id are
`response` records; the others are `revisit` records that refer to it and hold the
HTTP header only, whose Content-Length and WARC-Payload-Digest describe the full
payload.  Files go out through Spark's text writer and its commit protocol, so any
store that Spark writes to will do, and a retried task leaves no half file: a member
ends with the length of its content as four little-endian bytes, the last of which
is zero below 16 MiB, so that zero is the writer's line separator.  A longer record
is followed by an empty member, which ends with a zero as well.

Reading.  Spark lists the files (names and lengths only) and deals out byte ranges.
A task scans its range for the magic number of gzip; a place where it stands is a
candidate, and a record begins there if the bytes decode to a WARC header.  From then
on members follow each other.  A task owns the records that begin inside its range
and reads the last one on beyond the end.  Names need no suffix; `.warc.gz` files of
other tools are read alike.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, bounded

LEAST_PAYLOAD = 100
#: Bytes of an archive a task owns, read at once, and of payload handed on at once.
RANGE, READ, HANDED = 64 << 20, 1 << 20, 8 << 20
ROWS = 512
MAGIC = b"\x1f\x8b\x08"
#: A WARC header longer than this is none.
LONGEST_HEADER = 1 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:page:"
_EMPTY = zlib.compressobj(6, zlib.DEFLATED, 31).flush()


def _member(head: list[str], block: bytes, level: int) -> bytes:
    """One record as a gzip member, without its last byte, which is zero."""
    text = "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}", "", ""])
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    raw = b"".join([packer.compress(text.encode() + block + b"\r\n\r\n"), packer.flush()])
    return (raw if raw[-1] == 0 else raw + _EMPTY)[:-1]


def _address(url: str) -> str:
    """A URL on one line: control characters and spaces percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, html: str | None, digest: str, refers_to: int | None = None, revisit: bool = False, date: str = DATE, level: int = 6) -> bytes:
    """The member of one page."""
    payload = (html or "").encode()
    named = "" if page_id is None else page_id
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_PAGE}{named}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_address(url)}")
    if revisit:
        head += [f"WARC-Refers-To: <{_PAGE}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _member(head, http if revisit else http + payload, level)


def _records(level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, held = [], 0
            for row in zip(*(batch.column(k) for k in range(batch.num_columns))):
                page_id, url, html, digest, first, revisit = (x.as_py() for x in row)
                own.append(record(page_id, url, html, digest, first, revisit, date, level))
                held += len(own[-1])
                if held > HANDED:
                    yield pa.RecordBatch.from_pydict({"value": pa.array(own, pa.binary())})
                    own, held = [], 0
            if own:
                yield pa.RecordBatch.from_pydict({"value": pa.array(own, pa.binary())})

    return run


def write(pages: DataFrame, path: str, work: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_PAYLOAD, date: str = DATE, level: int = 6) -> None:
    """Writes the pages as archives to the folder `path`; `work` holds the payloads that come again.

    A payload is the html in UTF-8, a null one empty.  Rows that repeat the
    smallest id of their payload are responses as well.  A page without an id is
    a revisit if its payload has a smallest id, else a response.  A null url
    leaves the record without a target.  Other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    payload = F.coalesce("html", F.lit(""))
    rows = rows.withColumn("digest", F.sha2(payload, 256)).withColumn("n", F.octet_length(payload))
    again = rows.where(F.col("n") >= least).groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where((F.col("copies") > 1) & F.col("first").isNotNull()).select("digest", "n", "first")
    again, small = bounded(again, work, "repeated-payloads")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    out = rows.join(small(again), ["digest", "n"], "left").select("page_id", "url", "html", "digest", "first", revisit.alias("revisit"))
    out.mapInArrow(_records(level, date), "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)
    work.drop("repeated-payloads")


class Damaged(ValueError):
    """An archive that does not go on with a record where one must begin, or whose record breaks off."""


class _Source:
    """A file of which the part last read is kept."""

    def __init__(self, file, length: int):
        self.file, self.length, self.at, self.data = file, length, 0, b""

    def read(self, place: int, n: int = READ) -> bytes:
        """Bytes from `place` on, at most about `n` of them; none at the end."""
        if not self.at <= place < self.at + len(self.data):
            self.file.seek(place)
            self.at, self.data = place, self.file.read(min(n, self.length - place)) if place < self.length else b""
        return self.data[place - self.at : place - self.at + n]

    def find(self, place: int, end: int) -> int:
        """First place of the magic number in [place, end), or -1; the number itself may reach beyond."""
        while place < end:
            part = self.read(place)
            if len(part) < len(MAGIC):
                part += self.read(place + len(part), len(MAGIC)) if part else b""
                if len(part) < len(MAGIC):
                    return -1
            k = part.find(MAGIC)
            if k >= 0:
                return place + k if place + k < end else -1
            place += len(part) - len(MAGIC) + 1
        return -1


class _Inflated:
    """What the member at `place` decodes to, a part at a time."""

    def __init__(self, source: _Source, place: int):
        self.source, self.place, self.inner, self.data = source, place, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Decodes on; False at the member's end."""
        if self.inner.eof:
            return False
        raw = self.inner.unconsumed_tail or self.source.read(self.place)
        if not raw:
            raise Damaged("a gzip member breaks off")
        try:
            self.data += self.inner.decompress(raw, READ)
        except zlib.error as e:
            raise Damaged(f"not a gzip member: {e}") from e
        self.place += len(raw) - len(self.inner.unconsumed_tail) - len(self.inner.unused_data)
        return True

    def upto(self, mark: bytes) -> bytes:
        """Takes everything up to and with `mark`."""
        looked = 0
        while (k := self.data.find(mark, looked)) < 0:
            looked = max(0, len(self.data) - len(mark) + 1)
            if len(self.data) > LONGEST_HEADER or not self.data.startswith(b"WARC/"[: len(self.data)]) or not self.more():
                raise Damaged("no WARC header")
        out, self.data = self.data[: k + len(mark)], self.data[k + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, held = [self.data], len(self.data)
        while held < n:
            self.data = b""
            if not self.more():
                raise Damaged("a WARC record breaks off")
            parts.append(self.data)
            held += len(self.data)
        whole = b"".join(parts)
        self.data = whole[n:]
        return whole[:n]


def _fields(head: bytes) -> dict[str, str]:
    """Named fields of a header, names in lower case; lines that begin with a blank go on with the field before."""
    out, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def _member_records(source: _Source, place: int) -> Iterator[tuple[dict[str, str], bytes] | int]:
    """Header fields and block of each record of the member at `place`; last, the place after the member."""
    inner = _Inflated(source, place)
    while True:
        while not inner.data and inner.more():
            pass
        if not inner.data:
            break
        head = inner.upto(b"\r\n\r\n")
        if not head.startswith(b"WARC/"):
            raise Damaged("no WARC header")
        fields = _fields(head)
        try:
            n = int(fields["content-length"])
        except (KeyError, ValueError) as e:
            raise Damaged("a WARC header without a length") from e
        block = inner.take(n)
        if inner.take(4) != b"\r\n\r\n":
            raise Damaged("a WARC record that does not end with two line ends")
        yield fields, block
    yield inner.place


def scan(file, length: int, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of the members that begin in [start, end)."""
    source, place, known = _Source(file, length), start, False
    while (found := source.find(place, end)) >= 0:
        # Between members there may be padding; a range that begins inside a member finds its first record by trying.
        if known and source.read(place, found - place).strip(b"\0"):
            raise Damaged(f"no gzip member at byte {place}")
        try:
            for item in _member_records(source, found):
                if isinstance(item, int):
                    place, known = item, True
                else:
                    known = True
                    yield item
        except Damaged:
            if known:
                raise
            place = found + 1


def _http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, mark, payload = block.partition(b"\r\n\r\n")
    return _fields(head), payload if mark else b""


def _row(fields: dict[str, str], block: bytes, with_payload: bool) -> dict:
    kind, payload, digest, size = fields.get("warc-type", ""), block, None, None
    if fields.get("content-type", "").startswith("application/http"):
        http, payload = _http(block)
        size = http.get("content-length")
    said = fields.get("warc-payload-digest", "")
    said = said.removeprefix("sha256:") if said.startswith("sha256:") else None
    if kind == "revisit":
        digest, size = said, int(size) if size and size.isdigit() else None
    else:
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
        if said is not None and said != digest:
            raise Damaged(f"the payload of {fields.get('warc-record-id')} is not what its digest says")
    ids = [fields.get(k, "").strip("<>") or None for k in ("warc-record-id", "warc-refers-to")]
    out = {"record_id": ids[0], "record_type": kind, "refers_to": ids[1], "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "payload_bytes": size, "payload_digest": digest}
    return out | ({"payload": payload} if with_payload else {})


_SCHEMA = [("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
_NAMES = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}


def _opened(path: str):
    from pyarrow import fs

    scheme, mark, rest = path.partition(":")
    if not mark:
        return fs.LocalFileSystem().open_input_file(path)
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    store, place = fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)
    return store.open_input_file(place)


def _ranges(with_payload: bool):
    schema = pa.schema(_SCHEMA if with_payload else _SCHEMA[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                own, held = [], 0
                with _opened(part["path"]) as file:
                    for fields, block in scan(file, part["length"], part["start"], part["stop"]):
                        own.append(_row(fields, block, with_payload))
                        held += len(block) if with_payload else 0
                        if len(own) >= ROWS or held > HANDED:
                            yield pa.RecordBatch.from_pylist(own, schema)
                            own, held = [], 0
                if own:
                    yield pa.RecordBatch.from_pylist(own, schema)

    return run


def read(spark: SparkSession, path: str, with_payload: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """Records of all archives in `path`: record_id, record_type, refers_to (a record id), target_uri, date, payload_bytes, payload_digest, payload.

    Of a revisit, bytes and digest are those of the full payload as its headers
    state them (null where they don't) and `payload` is empty; of other records
    they are computed, and a record whose own digest differs stops the job, as
    does an archive that breaks off.  Other kinds of records (`warcinfo`,
    `request`) come as they are, their block as payload.  Files are opened by the
    tasks, from folders that all machines share or from stores that pyarrow opens
    (s3, gs, hdfs, abfs).  A folder without files gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    step = F.lit(int(range_bytes)).cast("long")
    parts = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step))).withColumn("stop", F.least(F.col("start") + step, "length"))
    n = parts.count()
    schema = ", ".join(f"{name} {_NAMES[kind]}" for name, kind in (_SCHEMA if with_payload else _SCHEMA[:-1]))
    return parts.repartitionByRange(max(1, n), "path", "start").mapInArrow(_ranges(with_payload), schema)


def page_number(column: str):
    """The page id in a record id that `write` made."""
    return F.expr(f"try_cast(substring({column}, {len(_PAGE) + 1}) as long)")
