"""Byte-level BPE encoding and decoding with padded numpy matrices.

Distinct pieces of text are put into buckets by length.  A bucket is a padded
matrix of token ids, one row a piece; every round, each row merges its leftmost
pair of least rank, found among ranks looked up in a hash table of id pairs; only
the two ranks beside the merge are looked up anew.  Rows without a pair leave the
matrix, and columns that no row needs are cut off.  Pieces longer than the widest
bucket take a heap over their pairs, with the same order of merges.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textcore as tc
from .pretokens import Pieces, Stretches

WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128)
NO_PAIR = np.int32(2**31 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of the merged token."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        n = 1 << self.bits
        self.keys = np.full(n, np.uint64(2**64 - 1))
        self.values = np.full(n, NO_PAIR, np.int32)
        for (a, b), c in pairs.items():
            key = a << 32 | b
            at = (key * int(_SPREAD) & (2**64 - 1)) >> (64 - self.bits)
            while self.values[at] != NO_PAIR:
                at = (at + 1) & (n - 1)
            self.keys[at], self.values[at] = key, c

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged ids, NO_PAIR where there is none; an id of -1 stands for nothing."""
        out = np.full(len(a), NO_PAIR, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[todo].astype(np.uint64) << np.uint64(32) | b[todo].astype(np.uint64)
        at = ((key * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            there = self.keys[at]
            hit = there == key
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (self.values[at] != NO_PAIR)
            todo, key, at = todo[on], key[on], (at[on] + 1) & (len(self.keys) - 1)
        return out


class Vocabulary:
    """Ranks of byte strings (a token's id is its rank), as in a tiktoken file."""

    def __init__(self, raw: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    self.pairs[left, right] = rank
        self.table = PairTable(self.pairs)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read())

    def _matrix(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids of words of 2 to `width` bytes."""
        n = len(words)
        flat = np.frombuffer(b"".join(words), np.uint8)
        length = np.fromiter(map(len, words), np.int64, n)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < length[:, None]] = self.bytes[flat]
        ranks = np.full((n, width), NO_PAIR, np.int32)
        ranks[:, :-1] = self.table.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        out: list[bytes] = [b""] * n
        rows = np.arange(n)
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            done = best == NO_PAIR
            if done.any():
                for row, end, own in zip(rows[done].tolist(), length[done].tolist(), ids[done]):
                    out[row] = own[:end].tobytes()
                on = ~done
                rows, length, ids, ranks, at, best = rows[on], length[on], ids[on], ranks[on], at[on], best[on]
                if not len(rows):
                    break
            own = np.arange(len(rows))
            ids[own, at] = best
            columns = np.arange(ids.shape[1] - 1)
            later = columns > at[:, None]
            ids[:, :-1] = np.where(later, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            later = columns >= at[:, None]
            ranks[:, :-1] = np.where(later, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NO_PAIR
            length -= 1
            widest = int(length.max())
            if widest < ids.shape[1]:
                ids, ranks = np.ascontiguousarray(ids[:, :widest]), np.ascontiguousarray(ranks[:, :widest])
            right = np.where(at + 1 < widest, ids[own, np.minimum(at + 1, widest - 1)], -1)
            left = np.where(at > 0, ids[own, np.maximum(at - 1, 0)], -1)
            found = self.table.find(np.concatenate([best, left]), np.concatenate([right, best]))
            ranks[own, at] = found[: len(rows)]
            some = at > 0
            ranks[own[some], at[some] - 1] = found[len(rows) :][some]
        return out

    def _long(self, word: bytes) -> bytes:
        """Ids of one word, by a heap of (rank, place)."""
        ids = self.bytes[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        find = self.pairs.get
        heap = [(r, i) for i in range(n - 1) if (r := find((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or find((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := find((rank, ids[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := find((ids[h], rank))) is not None:
                heapq.heappush(heap, (r, h))
        return np.array([x for x in ids if x >= 0], "<i4").tobytes()

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        out: list[bytes] = [b""] * len(words)
        buckets: dict[int, list[int]] = {w: [] for w in WIDTHS}
        by_length = [next((w for w in WIDTHS if n <= w), 0) for n in range(WIDTHS[-1] + 1)]
        single = self.bytes.astype("<i4")
        for k, word in enumerate(words):
            n = len(word)
            if n == 1:
                out[k] = single[word[0]].tobytes()
            elif n > WIDTHS[-1]:
                out[k] = self._long(word)
            elif n:
                buckets[by_length[n]].append(k)
        for width, own in buckets.items():
            for i in range(0, len(own), 1 << 15):
                part = own[i : i + (1 << 15)]
                for k, ids in zip(part, self._matrix([words[k] for k in part], width)):
                    out[k] = ids
        return out

    def decode(self, ids: bytes) -> bytes:
        """Bytes of little-endian 32-bit ids."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Encoder:
    """Encodes texts, keeping what it has learnt of distinct stretches."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.stretches = Stretches(Pieces(self._pieces))

    def _pieces(self, own: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.vocabulary.encode_words([x.encode() for x in own])
        return np.frombuffer(b"".join(ids), "<i4"), np.fromiter(map(len, ids), np.int64, len(ids)) >> 2

    def block(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Little-endian 32-bit ids of each text of a block."""
        ids, bounds = self.stretches.block(data, offsets)
        raw, at = ids.astype("<i4").tobytes(), (4 * bounds).tolist()
        return [raw[i:j] for i, j in zip(at, at[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        data, offsets = tc.buffers(pa.array(texts, pa.string()))
        return [ids for i, j in tc.blocks(offsets) for ids in self.block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]


_encoders: dict[int, Encoder] = {}


def _schema(df: DataFrame, keep: list[str], added: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([df.schema[c] for c in keep] + [T.StructField(c, kind) for c, kind in added])


def _id_column(ids: list[bytes], arrays: bool) -> pa.Array:
    if not arrays:
        return pa.array(ids, pa.binary())
    at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def _encode(shared, keep: list[str], text: str, names: list[str], arrays: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker keeps one encoder, of the vocabulary it used last, from task to task.
        vocabulary = shared.value
        encoder = _encoders.get(id(vocabulary))
        if encoder is None:
            _encoders.clear()
            encoder = _encoders[id(vocabulary)] = Encoder(vocabulary)
        for batch in batches:
            data, offsets = tc.buffers(batch.column(text))
            for i, j in tc.blocks(offsets):
                ids = encoder.block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                added = [_id_column(ids, arrays)]
                if len(names) > 1:
                    added.append(pa.array(map(vocabulary.decode, ids), pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column(c)[i:j] for c in keep] + added, names=[*keep, *names])

    return run


def encode(df: DataFrame, ranks_path: str, text_col: str = "text", out_col: str = "ids", as_bytes: bool = False, keep: list[str] | None = None, decoded_col: str | None = None) -> DataFrame:
    """`df` with the token ids of each text, as an array of int or (as_bytes) as little-endian unsigned 32-bit integers.

    Null counts as an empty text and gives no ids.  Special strings are ordinary
    text.  With `decoded_col` the ids are decoded again in the same task, which
    spares sending them out and back.  `keep` names the columns to carry (default:
    all); one named like a result is replaced.  Rows are neither merged nor
    reordered.
    """
    names = [out_col, *[decoded_col] * bool(decoded_col)]
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(ranks_path))
    kinds = [T.BinaryType() if as_bytes else T.ArrayType(T.IntegerType()), T.BinaryType()]
    need = df.select(*dict.fromkeys([*keep, text_col]))
    return need.mapInArrow(_encode(shared, keep, text_col, names, not as_bytes), _schema(df, keep, list(zip(names, kinds))))


def _decode(shared, keep: list[str], source: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                ids = part.column(source).to_pylist()
                if pa.types.is_list(part.column(source).type):
                    ids = [None if x is None else np.array(x, "<u4").tobytes() for x in ids]
                out = pa.array([None if x is None else shared.value.decode(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [out], names=[*keep, name])

    return run


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """`df` with the bytes of each row's ids (either form that `encode` gives); null ids give null."""
    keep = [c for c in (df.columns if keep is None else keep) if c != out_col]
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(ranks_path))
    need = df.select(*dict.fromkeys([*keep, ids_col]))
    return need.mapInArrow(_decode(shared, keep, ids_col, out_col), _schema(df, keep, [(out_col, T.BinaryType())]))
