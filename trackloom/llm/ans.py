"""Token-id files: interleaved range asymmetric numeral system blocks with shared tables.

A dataset of token ids is a folder with two Parquet tables:

* `table`: one row, the frequency table shared by all blocks: `precision`,
  `symbols` and `frequencies` (they add up to 2**precision).  Counts are taken
  over all documents before anything is encoded.
* `blocks`: one row a block, in ascending order of documents: `first_id`,
  `last_id`, `n_tokens`, `doc_ids` and `lengths` (ids per document, the end id
  included), and `frame`, the coded ids.

A frame stands alone.  Its ids are dealt round robin to LANES coders that share one
stream of 32-bit words; all lanes take a step together in numpy.  States are 64
bits wide and renormalise at most once a step.  Every CHECKPOINT_STEPS steps the
frame holds the lanes' states and the place in the stream, so decoding can begin
at any checkpoint: a frame's stretches between checkpoints are decoded side by side,
as rows of one matrix of states.  A crc32 over the frame guards it.

Layout (little-endian): magic 4s, version u16, precision u16, lanes u32, steps per
checkpoint u32, ids u64, checkpoints u32, words u64; places u64[checkpoints];
states u64[checkpoints][lanes]; stream u32[words]; crc32 u32.
"""

from __future__ import annotations

import gc
import json
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .prefix_counts import byte_symbols, require_byte_level
from .pretokens import Pieces, Stretches
from .scratch import BROADCAST_ROWS, Scratch

MAGIC, VERSION = b"TLRA", 1
LANES, CHECKPOINT_STEPS, BLOCK_TOKENS = 1024, 128, 1 << 20
#: Ids after which a chunk may end where document ids descend.
LEAST_TOKENS = BLOCK_TOKENS // 16
_HEAD = struct.Struct("<4sHHIIQIQ")
_LOW = np.uint64(1 << 31)


class FrequencyTable:
    """Static frequencies, scaled so that they add up to a power of two."""

    def __init__(self, symbols: np.ndarray, frequencies: np.ndarray, precision: int):
        self.precision, self.symbols, self.frequencies = precision, symbols.astype(np.int64), frequencies.astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.frequencies)[:-1]]).astype(np.uint64) if len(symbols) else self.frequencies
        self.place = np.full(int(self.symbols.max(initial=0)) + 1, -1, np.int64)
        self.place[self.symbols] = np.arange(len(self.symbols))
        self._slots = None

    @classmethod
    def scaled(cls, symbols: np.ndarray, counts: np.ndarray) -> FrequencyTable:
        """From counts: every symbol keeps at least one slot; rounding is settled on the most frequent ones."""
        if not len(symbols):
            return cls(np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
        order = np.argsort(symbols)
        symbols, counts = np.asarray(symbols)[order], np.asarray(counts, np.float64)[order]
        precision = min(30, max(12, int(len(symbols) - 1).bit_length() + 2))
        frequencies = np.maximum(1, np.floor(counts / counts.sum() * (1 << precision))).astype(np.int64)
        left = (1 << precision) - int(frequencies.sum())
        top = np.argsort(-frequencies, kind="stable")
        while left:
            step = max(left, 1 - int(frequencies[top[0]])) if left < 0 else left
            frequencies[top[0]] += step
            left -= step
            top = top[1:] if left else top
        return cls(symbols, frequencies, precision)

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.symbols), dtype=np.int32), self.frequencies.astype(np.int64))
        return self._slots


def encode_frame(ids: np.ndarray, table: FrequencyTable) -> bytes:
    """A frame that holds `ids`, all of which the table must have."""
    n = len(ids)
    lanes = int(min(LANES, 1 << max(0, (n // 64).bit_length() - 1))) if n else 1
    steps = -(-n // lanes)
    known = len(table.place) > ids.max(initial=0) and ids.min(initial=0) >= 0
    place = table.place[ids] if known else np.full(n, -1)
    if n and place.min() < 0:
        raise ValueError("an id is not in the frequency table")
    freq, start = table.frequencies[place], table.starts[place]
    bits = np.uint64(table.precision)
    limit = freq << np.uint64(63 - table.precision)
    state = np.full(lanes, _LOW, np.uint64)
    marks, chunks, sizes = [], [], np.zeros(steps + 1, np.int64)
    for t in range(steps - 1, -1, -1):
        own = slice(t * lanes, min(n, (t + 1) * lanes))
        x = state[: own.stop - own.start]
        full = np.flatnonzero(x >= limit[own])
        if len(full):
            chunks.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            sizes[t] = len(full)
            x[full] >>= np.uint64(32)
        f = freq[own]
        q = x // f
        x[:] = (q << bits) + (x - q * f) + start[own]
        if t % CHECKPOINT_STEPS == 0:
            marks.append((t, state.copy()))
    before = np.concatenate([[0], np.cumsum(sizes[:steps])])
    marks.reverse()
    stream = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, "<u4")
    head = _HEAD.pack(MAGIC, VERSION, table.precision, lanes, CHECKPOINT_STEPS, n, len(marks), len(stream))
    body = b"".join([head, np.array([before[t] for t, _ in marks], "<u8").tobytes(), *(x.astype("<u8").tobytes() for _, x in marks), stream.tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


def decode_frame(frame: bytes | pa.Buffer, table: FrequencyTable, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a frame, or those from checkpoint `first` up to checkpoint `last`."""
    frame = memoryview(frame)
    if len(frame) < _HEAD.size + 4 or frame[:4] != MAGIC:
        raise ValueError("not a token frame")
    if zlib.crc32(frame[:-4]) != struct.unpack("<I", frame[-4:])[0]:
        raise ValueError("a token frame is damaged")
    _, version, precision, lanes, every, n, marks, words = _HEAD.unpack_from(frame)
    if version != VERSION or precision != table.precision:
        raise ValueError("a token frame does not fit the table")
    at = _HEAD.size
    places = np.frombuffer(frame, "<u8", marks, at)
    at += 8 * marks
    last = marks if last is None else min(last, marks)
    if first >= last:
        return np.zeros(0, np.int64)
    states = np.frombuffer(frame, "<u8", lanes * marks, at).astype(np.uint64).reshape(marks, lanes)
    # One word more, as lanes that need none still look at a place.
    stream = np.concatenate([np.frombuffer(frame, "<u4", words, at + 8 * lanes * marks), np.zeros(1, "<u4")])
    each = every * lanes
    begin, end = first * each, min(n, last * each)
    whole = (end - begin) // each
    out = np.empty(end - begin, np.int32)
    _decode_rows(states[first : first + whole], places[first : first + whole].astype(np.int64), stream, table, out[: whole * each].reshape(whole, each))
    if whole < last - first:
        _decode_rows(states[first + whole : last], places[first + whole : last].astype(np.int64), stream, table, out[whole * each :].reshape(1, -1))
    return table.symbols[out]


def _decode_rows(state: np.ndarray, place: np.ndarray, stream: np.ndarray, table: FrequencyTable, out: np.ndarray) -> None:
    """Fills each row of `out` with the symbols that follow a checkpoint; all rows take a step together."""
    mask, bits = np.uint64((1 << table.precision) - 1), np.uint64(table.precision)
    slots, freq, start = table.slots, table.frequencies, table.starts
    lanes, width = state.shape[1], out.shape[1]
    for k in range(0, width, lanes):
        own = min(lanes, width - k)
        x = state[:, :own]
        slot = x & mask
        symbol = slots[slot.astype(np.int64)]
        out[:, k : k + own] = symbol
        x = freq[symbol] * (x >> bits) + slot - start[symbol]
        row, lane = np.nonzero(x < _LOW)
        if len(row):
            # Lanes of a row take its words in their order.
            taken = np.bincount(row, minlength=len(place))
            before = np.cumsum(taken) - taken
            word = stream[(place - before)[row] + np.arange(len(row))]
            x[row, lane] = (x[row, lane] << np.uint64(32)) | word
            place += taken
        state[:, :own] = x


# Texts to ids with the tokenizers library.

_SYMBOLS = dict(enumerate(byte_symbols()))


class LibraryEncoder:
    """Ids as the tokenizers library gives them for a file with a byte-level BPE model.

    The library's model encodes each distinct piece; texts with special strings
    go through the whole library.
    """

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        require_byte_level(json.loads(raw))
        self.tokenizer = Tokenizer.from_buffer(raw)
        self.model = self.tokenizer.model
        self.specials = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.stretches = Stretches(Pieces(self._pieces))

    def _pieces(self, own: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # 0xFF is in no UTF-8 text, so its symbol can stand between pieces.
        shown = b"\xff".join([x.encode() for x in own]).decode("latin-1").translate(_SYMBOLS).split(_SYMBOLS[0xFF])
        tokenise, flat, counts = self.model.tokenize, array("i"), array("q")
        for x in shown:
            tokens = tokenise(x)
            counts.append(len(tokens))
            flat.extend([t.id for t in tokens])
        return np.frombuffer(flat, np.int32), np.frombuffer(counts, np.int64)

    def block(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a block."""
        ids, bounds = self.stretches.block(data, offsets)
        out = [ids[i:j] for i, j in zip(bounds.tolist(), bounds[1:].tolist())]
        raw = data.tobytes()
        if any(s in raw for s in self.specials):
            for k, (i, j) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                if any(s in raw[i:j] for s in self.specials):
                    out[k] = np.array(self.tokenizer.encode(raw[i:j].decode(), add_special_tokens=False).ids, np.int32)
        return out


_CHUNK = "first_id long, last_id long, ordered boolean, n_tokens long, doc_ids array<long>, lengths array<long>, ids binary, symbols array<int>, counts array<long>"
_encoders: dict[int, LibraryEncoder] = {}


def _planes(ids: np.ndarray) -> bytes:
    """Ids with their high and low bytes apart, which compresses better."""
    wide = 2 if ids.max(initial=0) < 1 << 16 else 4
    return bytes([wide]) + ids.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T.tobytes()


def _unplanes(raw) -> np.ndarray:
    wide = memoryview(raw)[0]
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=1).reshape(wide, -1).T).view(f"<u{wide}").ravel()


class _Chunks:
    """Gathers documents into chunks of about BLOCK_TOKENS ids, in order of document ids.

    Where the ids of documents descend, a chunk that is large enough ends, so
    that sorted files one after the other give chunks apart from each other;
    in a smaller one the documents are sorted.  The last chunk has the counts
    of all token ids.
    """

    def __init__(self) -> None:
        self.ids, self.parts, self.n, self.ascends, self.counts = [], [], 0, True, np.zeros(0, np.int64)

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        up = not self.ids or doc_id is not None and self.ids[-1] is not None and doc_id > self.ids[-1]
        if self.n >= (BLOCK_TOKENS if up else LEAST_TOKENS):
            yield self.flush()
        elif not up:
            self.ascends = False
        self.ids.append(doc_id)
        self.parts.append(ids)
        self.n += len(ids)

    def flush(self, last: bool = False) -> pa.RecordBatch:
        if not self.ascends:
            keys = [(i is not None, i or 0, _planes(x)) for i, x in zip(self.ids, self.parts)]
            order = sorted(range(len(keys)), key=keys.__getitem__)
            self.ids, self.parts = [self.ids[k] for k in order], [self.parts[k] for k in order]
        own = [x for x in self.ids if x is not None]
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        counts = np.bincount(ids, minlength=len(self.counts))
        counts[: len(self.counts)] += self.counts
        self.counts = counts
        symbols = np.flatnonzero(counts) if last else []
        row = {
            "first_id": pa.array([own[0] if own else None], pa.int64()),
            "last_id": pa.array([own[-1] if own else None], pa.int64()),
            "ordered": pa.array([len(own) == len(self.ids)]),
            "n_tokens": pa.array([len(ids)], pa.int64()),
            "doc_ids": pa.array([self.ids], pa.list_(pa.int64())),
            "lengths": pa.array([[len(x) for x in self.parts]], pa.list_(pa.int64())),
            "ids": pa.array([_planes(ids)], pa.binary()),
            "symbols": pa.array([symbols], pa.list_(pa.int32())),
            "counts": pa.array([counts[symbols] if last else []], pa.list_(pa.int64())),
        }
        self.ids, self.parts, self.n, self.ascends = [], [], 0, True
        return pa.RecordBatch.from_pydict(row)


def _tokenise(shared, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) else zlib.crc32(shared.value)
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = LibraryEncoder(shared.value)
        end = np.array([end_id], np.int32)
        chunks = _Chunks()
        # Millions of short-lived tokens and no cycles among them: the cycle collector would only look.
        collects = gc.isenabled()
        gc.disable()
        try:
            for batch in batches:
                data, offsets = tc.buffers(batch.column("text"))
                doc_ids = batch.column("doc_id").to_pylist()
                for i, j in tc.blocks(offsets):
                    own = _encoders[key].block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    for k, ids in enumerate(own, i):
                        yield from chunks.add(doc_ids[k], np.concatenate([ids, end]))
            if chunks.ids:
                yield chunks.flush(last=True)
        finally:
            if collects:
                gc.enable()

    return run


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[pa.Scalar]]:
    """The rows of all batches, one at a time: a row may hold megabytes."""
    for batch in batches:
        columns = [batch.column(c) for c in names]
        for i in range(len(batch)):
            yield [c[i] for c in columns]


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for doc_ids, lengths, raw in _rows(batches, "doc_ids", "lengths", "ids"):
        at = np.concatenate([[0], np.cumsum(lengths.values.to_numpy())])
        ids = _unplanes(raw.as_buffer())
        yield pa.RecordBatch.from_pydict({"doc_id": doc_ids.values, "ids": pa.array([_planes(ids[i:j]) for i, j in zip(at.tolist(), at[1:].tolist())], pa.binary())})


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunks = _Chunks()
    for doc_id, raw in _rows(batches, "doc_id", "ids"):
        yield from chunks.add(doc_id.as_py(), _unplanes(raw.as_buffer()).astype(np.int32))
    if chunks.ids:
        yield chunks.flush(last=True)


def _encode_blocks(shared):
    names = ["first_id", "last_id", "n_tokens", "doc_ids", "lengths"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = FrequencyTable(*shared.value)
        for batch in batches:
            for i in range(len(batch)):
                frame = encode_frame(_unplanes(batch.column("ids")[i].as_buffer()), table)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i : i + 1] for c in names), pa.array([frame], pa.binary())], names=[*names, "frame"])

    return run


_BLOCK = "first_id long, last_id long, n_tokens long, doc_ids array<long>, lengths array<long>, frame binary"


def _apart(chunks: DataFrame) -> bool:
    """Whether chunks hold ascending, disjoint ranges of ids, so that their order is the documents' order."""
    own = chunks.select("first_id", "last_id", "ordered").repartitionByRange("first_id").withColumn("part", F.spark_partition_id())
    own = own.withColumn("before", F.lag("last_id").over(Window.partitionBy("part").orderBy("first_id")))
    ends = own.groupBy("part").agg(F.min("first_id"), F.max("last_id"), F.bool_or((~F.col("ordered")) | F.coalesce(F.col("before") >= F.col("first_id"), F.lit(False))).alias("bad")).collect()
    if any(x["bad"] for x in ends):
        return False
    ends.sort(key=lambda x: (x[1] is not None, x[1]))
    return all(a[2] < b[1] for a, b in zip(ends, ends[1:]))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, appends `end_id` to each, and writes a dataset in ascending order of ids.

    Null counts as an empty text, which leaves the end id alone.  Rows without an
    id come first; rows with equal ids are ordered by their token ids.  Extra
    columns are not read.  Texts are tokenised once.  Where the input already
    comes in ascending, disjoint ranges (which is checked), nothing is shuffled;
    otherwise token ids are ordered by range.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "tokens")
    with open(tokenizer_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chunks = work.save(docs.mapInArrow(_tokenise(shared, end_id), _CHUNK), "chunks", "snappy")
    if not _apart(chunks):
        rows = chunks.select("doc_ids", "lengths", "ids").mapInArrow(_documents, "doc_id long, ids binary").repartitionByRange("doc_id", "ids").sortWithinPartitions("doc_id", "ids")
        chunks = work.save(rows.mapInArrow(_gather, _CHUNK), "ordered", "snappy")
        work.drop("chunks")
    pairs = chunks.select(F.explode(F.arrays_zip("symbols", "counts")).alias("x"))
    counts = pairs.groupBy(F.col("x.symbols").cast("long").alias("symbol")).agg(F.sum("x.counts").alias("n"))
    # One row a symbol of the vocabulary: bounded by its size.
    found = counts.toPandas()
    table = FrequencyTable.scaled(found["symbol"].to_numpy(np.int64), found["n"].to_numpy(np.int64))
    spark.createDataFrame([(table.precision, table.symbols.tolist(), table.frequencies.astype(np.int64).tolist())], "precision int, symbols array<long>, frequencies array<long>").coalesce(1).write.parquet(f"{path}/table")
    coded = spark.sparkContext.broadcast((table.symbols, table.frequencies, table.precision))
    chunks.drop("symbols", "counts").mapInArrow(_encode_blocks(coded), _BLOCK).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    work.drop("chunks", "ordered")


def _read(shared, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = FrequencyTable(*shared.value)
        for begin, doc_ids, lengths, frame in _rows(batches, "begin", "doc_ids", "lengths", "frame"):
            raw = memoryview(decode_frame(frame.as_buffer(), table).astype("<u4").tobytes())
            at = np.concatenate([[0], np.cumsum(lengths.values.to_numpy())])
            parts = [raw[4 * i : 4 * j] for i, j in zip(at.tolist(), at[1:].tolist())]
            out = {"doc_id": doc_ids.values, "start": pa.array(begin.as_py() + at[:-1], pa.int64()), "n_tokens": lengths.values, "ids_crc32": pa.array(map(zlib.crc32, parts), pa.int64())}
            if with_ids:
                out["ids"] = pa.array(map(bytes, parts), pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    return run


def _begins(blocks: DataFrame) -> DataFrame:
    """(place, begin) of each block, `begin` being the ids of all blocks before it; to be broadcast where blocks are few."""
    spark = blocks.sparkSession
    key = ["first_id", "last_id", "n_tokens", "tie"]
    facts = blocks.select("first_id", "last_id", "n_tokens", F.xxhash64("doc_ids", "lengths", "frame").alias("tie"), "place")
    # Written, because the ranges of a second run may differ.
    facts = Scratch(spark, "token-starts").save(facts.repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "facts")
    sums = facts.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("blocks"), F.min(F.struct(*key)).alias("first")).collect()
    sums.sort(key=lambda x: tuple((v is not None, v) for v in x["first"]))
    total, before = 0, []
    for x in sums:
        before.append((x["part"], total))
        total += x["n"]
    offsets = F.create_map(*[F.lit(v) for pair in before for v in pair]) if before else F.create_map(F.lit(0), F.lit(0))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1))
    begins = facts.select("place", (F.coalesce(inside, F.lit(0)) + offsets[F.col("part")]).alias("begin"))
    return F.broadcast(begins) if sum(x["blocks"] for x in sums) <= BROADCAST_ROWS else begins


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): where each document's ids begin in the whole sequence, how many they are, their crc32 and themselves.

    Ids are little-endian unsigned 32-bit integers, for the checksum too.  Without
    `with_ids` they are decoded and checked, but not sent out.
    """
    table = spark.read.parquet(f"{path}/table").first()
    if table is None:
        raise ValueError("a token dataset without a table")
    coded = spark.sparkContext.broadcast((np.array(table["symbols"], np.int64), np.array(table["frequencies"], np.int64), table["precision"]))
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    # A block's place is its file and its row in it; both stay the same at every reading.
    blocks = blocks.withColumn("place", F.concat_ws(":", F.col("_metadata.file_name"), F.col("_metadata.row_index")))
    rows = blocks.join(_begins(blocks), "place").select("begin", "doc_ids", "lengths", "frame")
    return rows.mapInArrow(_read(coded, with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
