"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is contained in a document if the document holds at least THRESHOLD
of the item's distinct runs of five words.  Items are short and documents long,
so a Jaccard index on whole documents would see almost nothing.  Following the
ensemble idea, containment is turned into a Jaccard bound per size partition:

* Items fall into classes by set size: up to `u` and over `u/2` runs, u = 16, 32,
  64, ...  Items of up to 8 runs form a class of their own.
* For a class, a document is cut into blocks of `u` consecutive runs, and two
  neighbouring blocks make one domain set, so that an occurrence of an item lies
  inside one set.  Domain sets are partitioned by their own size (up to u/2, u
  and 2u).  The containment threshold gives a least similarity for each
  partition, and bands of minhashes (as many rows as possible) are chosen so that
  a match is missed with probability below MISS.
* For the smallest class the domain sets are single runs.

Candidates are verified on full sets by exact containment of the whole document.

Block minima of wider classes are minima of finer ones, so each document run is
hashed once per function.  Items are shipped to executors in slices whose size is
checked (SLICE_CHARS characters, or one longer item).  More items mean more passes
over the documents, one after the other: the driver holds one slice at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .scratch import Scratch

THRESHOLD, MISS, HASHES, TINY, FINEST = 0.8, 1e-6, 96, 8, 16
SLICE_CHARS = 16_000_000
_MUL = (tc._random_words("contain-a", HASHES) >> tc.U64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (tc._random_words("contain-b", HASHES) >> tc.U64(32)).astype(np.uint32)


def bands(similarity: float) -> tuple[int, int]:
    """(bands, rows) for a least similarity: most rows whose bands miss with probability under MISS."""
    for rows in (4, 3, 2, 1):
        n = math.ceil(math.log(MISS) / math.log1p(-(min(similarity, 0.999999) ** rows)))
        if n * rows <= HASHES:
            return n, rows
    raise ValueError(f"{HASHES} minhashes are too few for a similarity of {similarity:.3f}: use a higher threshold")


def _band_key(signature: np.ndarray, band: int, rows: int) -> np.ndarray:
    key = signature[:, band * rows].astype(tc.U64)
    for r in range(1, rows):
        key = tc.mix(key) + signature[:, band * rows + r]
    return key


class _Lookup:
    """Which rows have a key: a bitmap that rules most keys out, then a sorted list."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[order], rows[order]
        self.mask = tc.U64((1 << max(12, int(len(keys) * 64 - 1).bit_length())) - 1)
        self.bitmap = np.zeros(int(self.mask) + 1, bool)
        self.bitmap[(keys & self.mask).astype(np.int64)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `keys`, row) of every match."""
        maybe = np.flatnonzero(self.bitmap[(keys & self.mask).astype(np.int64)])
        left = np.searchsorted(self.keys, keys[maybe], "left")
        n = np.searchsorted(self.keys, keys[maybe], "right") - left
        place = np.repeat(maybe, n)
        at = np.repeat(left, n) + (np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n))
        return place, self.rows[at]


class Index:
    """Banded signatures of a slice of test items."""

    def __init__(self, ids: list[int], texts: list[str], size: int, threshold: float):
        self.ids, self.size, self.threshold = ids, size, threshold
        self.sets: list[np.ndarray] = [np.zeros(0, tc.U64)] * len(ids)
        self.width = np.full(len(ids), size)
        column = pa.array(texts, pa.string())
        data, offsets = tc.buffers(column)
        _, _, word_bounds = tc.word_spans(data, offsets)
        n_words = np.diff(word_bounds)
        for i, j, values, bounds in tc.document_shingles(column, size):
            for k in range(i, j):
                self.sets[k] = np.unique(values[bounds[k - i] : bounds[k - i + 1]])
        for k in np.flatnonzero((n_words > 0) & (n_words < size)):
            self.width[k] = n_words[k]
            self.sets[k] = next(tc.document_shingles(pa.array([texts[k]]), int(n_words[k])))[2]
        sizes = np.array([len(x) for x in self.sets])
        #: By width in words: a lookup of single runs of tiny items.
        self.tiny: dict[int, _Lookup] = {}
        for width in sorted(set(self.width[(sizes > 0) & (sizes <= TINY)])):
            rows = np.flatnonzero((sizes > 0) & (sizes <= TINY) & (self.width == width))
            self.tiny[int(width)] = _Lookup(np.concatenate([self.sets[k] for k in rows]), np.repeat(rows, sizes[rows]))
        #: By class: [(least and most runs of a domain set, band count, rows, lookups)].
        self.classes: dict[int, list] = {}
        upper = FINEST
        while (sizes > TINY).any() and upper // 2 < sizes.max():
            rows = np.flatnonzero((sizes > max(TINY, upper // 2)) & (sizes <= upper))
            if len(rows):
                values = np.concatenate([self.sets[k] for k in rows])
                signature = tc.minima(values, np.concatenate([[0], np.cumsum(sizes[rows])]), _MUL, _ADD)
                least = max(TINY, upper // 2) + 1
                parts = []
                for low, high in ((0, upper // 2), (upper // 2, upper), (upper, 2 * upper)):
                    both = threshold * least
                    n, r = bands(both / max(high + least - both, least))
                    parts.append((low, high, n, r, [_Lookup(_band_key(signature, t, r), rows) for t in range(n)]))
                self.classes[upper] = parts
            upper *= 2

    def candidates(self, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(document, item) pairs that share a band key in some partition; documents by place in `bounds`."""
        found = []
        if self.size in self.tiny:
            place, item = self.tiny[self.size].find(values)
            found.append(np.stack([np.searchsorted(bounds, place, "right") - 1, item], 1))
        count = np.diff(bounds)
        width, doc = FINEST, np.arange(len(count))
        n_blocks = -(-count // width)
        first = np.concatenate([[0], np.cumsum(n_blocks)])
        owner = np.repeat(doc, n_blocks)
        starts = bounds[owner] + width * (np.arange(first[-1]) - first[owner])
        edges = np.concatenate([starts, bounds[-1:]])
        signature = tc.minima(values, edges, _MUL, _ADD) if self.classes and len(starts) else None
        length = np.diff(edges)
        top = max(self.classes, default=0)
        while signature is not None and width <= top:
            last = np.ones(len(owner), bool)
            last[:-1] = owner[1:] != owner[:-1]
            if width in self.classes:
                pair = np.flatnonzero(~last)
                alone = np.flatnonzero(last & (np.arange(len(owner)) == first[owner]))
                domain = np.concatenate([np.minimum(signature[pair], signature[pair + 1]), signature[alone]])
                of = np.concatenate([owner[pair], owner[alone]])
                size = np.concatenate([length[pair] + length[pair + 1], length[alone]])
                for low, high, n, r, lookups in self.classes[width]:
                    here = np.flatnonzero((size > low) & (size <= high))
                    if len(here):
                        part = domain[here]
                        for t in range(n):
                            place, item = lookups[t].find(_band_key(part, t, r))
                            if len(place):
                                found.append(np.stack([of[here[place]], item], 1))
            # Two neighbouring blocks become one of twice the width.
            even = np.flatnonzero((np.arange(len(owner)) - first[owner]) % 2 == 0)
            merged = signature[even].copy()
            joined = ~last[even]
            merged[joined] = np.minimum(merged[joined], signature[even[joined] + 1])
            longer = length[even].copy()
            longer[joined] += length[even[joined] + 1]
            signature, length, owner, width = merged, longer, owner[even], 2 * width
            n_blocks = -(-n_blocks // 2)
            first = np.concatenate([[0], np.cumsum(n_blocks)])
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def contained(self, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item id, runs of the item, shared runs) at or over the threshold."""
        for i, j, values, bounds in tc.document_shingles(column, self.size):
            yield from self._verified(i, values, bounds, self.candidates(values, bounds), self.size)
        for width in self.tiny:
            if width != self.size:
                for i, j, values, bounds in tc.document_shingles(column, width):
                    place, item = self.tiny[width].find(values)
                    pairs = np.unique(np.stack([np.searchsorted(bounds, place, "right") - 1, item], 1), axis=0)
                    yield from self._verified(i, values, bounds, pairs, width)

    def _verified(self, row: int, values: np.ndarray, bounds: np.ndarray, pairs: np.ndarray, width: int) -> Iterator[tuple[int, int, int, int]]:
        held, runs = -1, None
        for doc, item in pairs.tolist():
            if self.width[item] != width:
                continue
            if doc != held:
                held, runs = doc, np.unique(values[bounds[doc] : bounds[doc + 1]])
            own = self.sets[item]
            at = np.minimum(np.searchsorted(runs, own), len(runs) - 1)
            shared = int((runs[at] == own).sum())
            if shared >= self.threshold * len(own) - 1e-9:
                yield row + doc, self.ids[item], len(own), shared


def _search(index, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(index.value.contained(batch.column("text")))
            at = pa.array([x[0] for x in rows], pa.int64())
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c).take(at) for c in carried},
                "item_id": pa.array([x[1] for x in rows], pa.int64()),
                "n_item": pa.array([x[2] for x in rows], pa.int64()),
                "n_shared": pa.array([x[3] for x in rows], pa.int64()),
            })

    return run


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", place: Column | None = None) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): every pair at or over the threshold.

    Null or empty texts and items without words match nothing.  An item of fewer
    than `size` words is one run of its own length, looked for among runs of that
    length.  Repeated rows give repeated results; rows of `items` without an id
    are left out.  Extra columns are not read.  A threshold that the minhashes
    cannot serve at MISS is refused.  With `place`, a string that tells rows of
    `docs` apart, it is returned as a further column.
    """
    spark = docs.sparkSession
    carried = ["doc_id", *["place"] * (place is not None)]
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([] if place is None else [place.cast("string").alias("place")]))
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, math.ceil(chars / SLICE_CHARS))
    work = Scratch(spark, "decontam")
    found = []
    for s in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == s).collect()
        index = spark.sparkContext.broadcast(Index([x[0] for x in part], [x[1] for x in part], size, threshold))
        hits = docs.mapInArrow(_search(index, carried), "doc_id long, " + "place string, " * (place is not None) + "item_id long, n_item long, n_shared long")
        if slices > 1:
            hits = work.save(hits, f"slice-{s}")
            index.destroy()
        found.append(hits)
    out = reduce(DataFrame.unionByName, found)
    return out.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"), *carried[1:])
