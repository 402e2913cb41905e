"""Vectorised text primitives shared by the corpus operators.

Every function works on a flat UTF-8 byte buffer with document offsets, which
is how Arrow hands over a string column, so whole texts are processed without
creating one Python object per word.  Words are maximal runs of bytes other
than U+0020 and U+0009..U+000D; those separators are single bytes in UTF-8, so
splitting bytes equals splitting code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes handled at once; one longer document makes a larger block of its own.
BLOCK_BYTES = 2 << 20


def _random_words(name: str, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit integers, the same on every machine."""
    raw = b"".join(hashlib.blake2b(f"{name}:{i}".encode(), digest_size=64).digest() for i in range((n + 7) // 8))
    return np.frombuffer(raw, dtype="<u8")[:n].copy()


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads every input bit over all output bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
IS_WORD = ~_SPACE
#: Letters for word features: ASCII letters and every byte of a non-ASCII character.
IS_LETTER = np.zeros(256, bool)
IS_LETTER[ord("A") : ord("Z") + 1] = IS_LETTER[ord("a") : ord("z") + 1] = IS_LETTER[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_SHINGLE_CODE = _random_words("shingle", 64) | U64(1)
_LENGTH_CODE = _random_words("length", 1)[0] | U64(1)
#: Longest span whose bytes enter its hash as numbers.
_DIRECT = 16
_FIRST = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(_DIRECT + 1)], U64)
_SECOND = np.array([(1 << 8 * max(0, n - 8)) - 1 for n in range(_DIRECT + 1)], U64)


def eights(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one little-endian number; `padded` goes on for as many beyond the last place."""
    return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))[at]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and each document's bounds in that list."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    here = inside[data]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.empty_like(here)
    before[0], before[1:] = False, here[:-1]
    before[edge] = False
    starts = np.flatnonzero(here & ~before)
    after = np.empty_like(here)
    after[-1], after[:-1] = False, here[1:]
    after[edge - 1] = False
    ends = np.flatnonzero(here & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, A-Z counted as a-z: mixed from the bytes themselves, of spans over 16 bytes by BLAKE2."""
    padded = np.zeros(len(data) + _DIRECT, np.uint8)
    np.take(LOWER, data, out=padded[: len(data)])
    length = ends - starts
    cut = np.minimum(length, _DIRECT)
    out = eights(padded, starts) & _FIRST[cut]
    out += length.astype(U64) * _LENGTH_CODE
    out = mix(out)
    longer = np.flatnonzero(length > 8)
    out[longer] = mix(out[longer] + (eights(padded, starts[longer] + 8) & _SECOND[cut[longer]]))
    for k in longer[length[longer] > _DIRECT].tolist():
        out[k] = int.from_bytes(hashlib.blake2b(padded[starts[k] : ends[k]].data, digest_size=8).digest(), "little")
    return out


def word_hash(word: str) -> int:
    """The hash of one word by itself."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def shingles(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `size` words of each document, and their bounds.

    A document with fewer words, but at least one, has one shingle: all of them.
    """
    count = np.diff(bounds)
    kept = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    out_bounds = np.concatenate([[0], np.cumsum(kept)])
    out = np.empty(out_bounds[-1], U64)
    short = np.flatnonzero((count > 0) & (count < size))
    is_short = np.zeros(len(out), bool)
    is_short[out_bounds[short]] = True
    n = len(words) - size + 1
    if n > 0:
        total = words[:n] * _SHINGLE_CODE[0]
        for j in range(1, size):
            total += words[j : j + n] * _SHINGLE_CODE[j]
        valid = np.ones(n, bool)
        inner = bounds[(bounds > 0) & (bounds < len(words))]
        for j in range(1, size):
            at = inner - j
            at = at[(at >= 0) & (at < n)]
            valid[at] = False
        out[~is_short] = mix(total[valid])
    for d in short:
        w = words[bounds[d] : bounds[d + 1]]
        out[out_bounds[d]] = mix((w * _SHINGLE_CODE[: len(w)]).sum(dtype=U64, keepdims=True) + U64(len(w)))[0]
    return out, out_bounds


def document_shingles(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, shingle hashes, bounds by row) block by block."""
    data, offsets = buffers(column)
    for i, j in blocks(offsets):
        at = offsets[i : j + 1] - offsets[i]
        part = data[offsets[i] : offsets[j]]
        starts, ends, bounds = word_spans(part, at)
        yield i, j, *shingles(span_hashes(part, starts, ends), bounds, size)


def minima(values: np.ndarray, bounds: np.ndarray, multipliers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash signatures: for each group of values, the least of (a*x+b) for each (a, b).

    Empty groups get the largest value of the type.
    """
    kind = multipliers.dtype
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.full((len(bounds) - 1, len(multipliers)), np.iinfo(kind).max, kind)
    if len(full):
        at = bounds[full]
        x = values if kind == U64 else (values >> U64(32)).astype(kind)
        held = np.empty_like(x)
        for k in range(len(multipliers)):
            np.multiply(x, multipliers[k], out=held)
            held += offsets[k]
            out[full, k] = np.minimum.reduceat(held, at)
    return out
