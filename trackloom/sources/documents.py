"""Large JSON documents, split at the members of their top level and parsed in parallel.

A byte range of a document says little by itself: it may begin inside a string or
at any depth.  But unescaped quotes can be told from what stands before them, so a
range can say how many it has, and how far brackets outside of strings rise or fall
if it begins outside a string, and if inside.  Running sums over the ranges then
give the state in which each begins.  With that, a task finds the members that
begin in its range and reads the last one on beyond the end.  No task holds a document.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Bytes of a document that a task owns, and bytes looked at together.
RANGE, WINDOW = 32 << 20, 1 << 20
ROWS, TEXT = 4096, 4 << 20
_OPEN, _CLOSE = (ord("{"), ord("[")), (ord("}"), ord("]"))
_STEP = np.zeros(256, np.int8)
_STEP[list(_OPEN)], _STEP[list(_CLOSE)] = 1, -1
_MARK = _STEP != 0
_MARK[ord(",")] = True


def opened(path: str):
    """A file that can be read from any place, in a folder that all machines share or a store that pyarrow opens."""
    from pyarrow import fs

    scheme, mark, rest = path.partition(":")
    if not mark or scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + (rest if mark else path).lstrip("/"))
    store, place = fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)
    return store.open_input_file(place)


class _Window:
    """Bytes of a document with its brackets and commas; `slashes` is how many backslashes stand right before it."""

    def __init__(self, raw: bytes, slashes: int):
        data = np.frombuffer(raw, np.uint8)
        quotes = np.flatnonzero(data == ord('"'))
        slash = data == ord("\\")
        self.slashes = slashes
        if slash.any() or slashes:
            place = np.arange(len(data))
            last = np.maximum.accumulate(np.where(slash, -1 - slashes, place))
            last = np.concatenate([[-1 - slashes], last])  # the last other byte before each place
            quotes = quotes[(quotes - 1 - last[quotes]) % 2 == 0]
            self.slashes = int(len(data) - 1 - last[-1])
        self.quotes = len(quotes)
        self.places = np.flatnonzero(_MARK[data])
        self.bytes = data[self.places]
        #: Whether each bracket or comma is outside of strings, if the first byte is.
        self.outside = np.searchsorted(quotes, self.places) % 2 == 0

    def marks(self, inside: bool) -> tuple[np.ndarray, np.ndarray]:
        own = ~self.outside if inside else self.outside
        return self.places[own], self.bytes[own]


def _slashes(read: Callable[[int, int], bytes], place: int) -> int:
    n = 0
    while place > n and read(place - n - 1, 1) == b"\\":
        n += 1
    return n


def summary(read: Callable[[int, int], bytes], start: int, stop: int) -> tuple[int, int, int]:
    """Unescaped quotes of a range, and how far brackets rise if it begins outside a string, and if inside."""
    quotes, rises, slashes = 0, [0, 0], _slashes(read, start)
    for at in range(start, stop, WINDOW):
        w = _Window(read(at, min(WINDOW, stop - at)), slashes)
        for k in (0, 1):
            rises[k] += int(_STEP[w.marks((quotes + k) % 2 == 1)[1]].sum())
        quotes, slashes = quotes + w.quotes, w.slashes
    return quotes, *rises


def _separators(read: Callable[[int, int], bytes], start: int, length: int, inside: bool, depth: int, level: int) -> Iterator[tuple[int, bytes, list[tuple[int, int]]]]:
    """Window by window: place, bytes, and (place, byte) of what opens, parts and closes members at `level`."""
    slashes = _slashes(read, start)
    for at in range(start, length, WINDOW):
        raw = read(at, min(WINDOW, length - at))
        w = _Window(raw, slashes)
        places, marks = w.marks(inside)
        steps = _STEP[marks].astype(np.int64)
        after = depth + np.cumsum(steps)
        own = np.where(steps < 0, after - steps, after) == level
        yield at, raw, list(zip((at + places[own]).tolist(), marks[own].tolist()))
        inside, slashes = inside ^ (w.quotes % 2 == 1), w.slashes
        depth = int(after[-1]) if len(after) else depth


def members(read: Callable[[int, int], bytes], length: int, start: int, stop: int, inside: bool, depth: int, level: int, first: int = 0, last: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the members at `level` whose beginning is in [start, stop) and in [first, last)."""
    pending, parts = -1, []
    for at, raw, found in _separators(read, start, length, inside, depth, level):
        done = 0
        for place, mark in found:
            if pending >= 0:
                parts.append(raw[done : place - at])
                text = b"".join(parts)
                if text.strip():
                    yield pending, text
                pending, parts = -1, []
            if mark not in _CLOSE and start <= place < stop and first <= place and (last is None or place < last):
                pending, done = place, place + 1 - at
        if pending >= 0:
            parts.append(raw[done:])
        elif at + len(raw) >= stop:
            return


def keyed(text: str) -> tuple[str | None, str]:
    """Key and value of a member of an object; an item of a list has no key."""
    text = text.strip()
    if text[:1] == '"':
        key, end = json.decoder.scanstring(text, 1)
        rest = text[end:].lstrip()
        if rest[:1] == ":":
            return key, rest[1:].strip()
    return None, text


def _reader(file) -> Callable[[int, int], bytes]:
    def read(place: int, n: int) -> bytes:
        file.seek(place)
        return file.read(n)

    return read


def _each(function: Callable, schema: pa.Schema):
    """Rows that `function` makes of each row (a range) and a reader of its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["path"]) as file:
                    held, size = [], 0
                    for out in function(row, _reader(file)):
                        held.append(out)
                        size += len(out.get("value") or "")
                        if len(held) >= ROWS or size > TEXT:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    return run


def _summarised(row: dict, read) -> Iterator[dict]:
    quotes, out, in_ = summary(read, row["start"], row["stop"])
    yield row | {"quotes": quotes, "rise_outside": out, "rise_inside": in_}


def _top_level(row: dict, read) -> Iterator[dict]:
    """Places of separators at the top level, and the keys that follow them."""
    for at, raw, found in _separators(read, row["start"], row["stop"], row["inside"], row["depth"], 1):
        for place, mark in found:
            key = None
            if mark not in _CLOSE:
                head = read(place + 1, 1 << 12).decode("utf-8", "replace").lstrip()
                try:
                    key = json.decoder.scanstring(head, 1)[0] if head[:1] == '"' else None
                except ValueError:
                    key = None
            yield {"path": row["path"], "first": place, "key": key}


def _parsed(row: dict, read) -> Iterator[dict]:
    level = 1 if row["member"] is None else 2
    for place, text in members(read, row["length"], row["start"], row["stop"], row["inside"], row["depth"], level, row["first"] or 0, row["last"]):
        key, value = keyed(text.decode())
        yield {"path": row["path"], "member": row["member"], "place": place, "key": key, "value": value}


class Documents:
    """JSON documents in `path`, cut into ranges whose beginnings are known; ranges are the only thing that is kept."""

    def __init__(self, spark: SparkSession, path: str, range_bytes: int = RANGE):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
        step = F.lit(int(range_bytes)).cast("long")
        parts = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step))).withColumn("stop", F.least(F.col("start") + step, "length"))
        # Ranges of many small files share a task, one for each range's worth of bytes or two a core.
        n, size = parts.agg(F.count("*"), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()
        self.count = max(1, min(n, max(-(-size // int(range_bytes)), 2 * spark.sparkContext.defaultParallelism)))
        kinds = pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("length", "start", "stop", "quotes", "rise_outside", "rise_inside"))])
        told = parts.repartitionByRange(self.count, "path", "start").mapInArrow(_each(_summarised, kinds), "path string, length long, start long, stop long, quotes long, rise_outside long, rise_inside long")
        before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        told = told.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
        told = told.withColumn("rise", F.when(F.col("inside"), F.col("rise_inside")).otherwise(F.col("rise_outside")))
        told = told.withColumn("depth", F.coalesce(F.sum("rise").over(before), F.lit(0)))
        self.ranges = checkpointed(told.select("path", "length", "start", "stop", "inside", "depth"))
        self._spans: DataFrame | None = None

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartitionByRange(self.count, "path", "start")

    def _top(self) -> DataFrame:
        """Where each member of the top level begins and ends: path, key, first, last."""
        if self._spans is None:
            kinds = pa.schema([("path", pa.string()), ("first", pa.int64()), ("key", pa.string())])
            found = self._dealt(self.ranges).mapInArrow(_each(_top_level, kinds), "path string, first long, key string")
            self._spans = checkpointed(found.withColumn("last", F.lead("first").over(Window.partitionBy("path").orderBy("first"))))
        return self._spans

    def items(self, member: str | None = None) -> DataFrame:
        """(path, member, place, key, value): what the documents hold at the top, or in the list or object that `member` of the top level is.

        Members of an object have a key, items of a list none; `value` is JSON text.
        """
        if member is None:
            rows = self.ranges.select("*", F.lit(None).cast("string").alias("member"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
        else:
            spans = self._top().where(F.col("key") == member).select("path", F.col("key").alias("member"), "first", "last")
            rows = self.ranges.join(spans, "path").where((F.col("start") < F.coalesce("last", "length")) & (F.col("stop") > F.col("first")))
        kinds = pa.schema([("path", pa.string()), ("member", pa.string()), ("place", pa.int64()), ("key", pa.string()), ("value", pa.string())])
        return self._dealt(rows).mapInArrow(_each(_parsed, kinds), "path string, member string, place long, key string, value string")


def items(spark: SparkSession, path: str, member: str | None = None, range_bytes: int = RANGE) -> DataFrame:
    """`Documents.items` of the documents in `path`."""
    return Documents(spark, path, range_bytes).items(member)


def fields(df: DataFrame, schema: str, keep: Sequence[str] = ("path", "place", "key")) -> DataFrame:
    """Items with `v`: their value parsed by `schema`."""
    return df.select(*keep, F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("v"))
