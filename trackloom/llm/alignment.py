"""Alignment of two tokenizers' tokens over the same bytes, with packed bitsets.

Both tokenizers see space + text.  Over the bytes of many texts one after the other,
a packed bitset marks where tokens of A end and another where tokens of B end.
Their AND has the cuts that both share; the rank of a cut (population counts of
whole words, and of the part of a word before it) is the number of tokens up to
it, so two cuts next to each other give the token ranges of a group.  Their OR has
all ends: between two neighbours lies exactly one pair of tokens that overlap, and
each such pair lies between two neighbours once, so ranks at the OR's bits list the
links.

Links are counted corpus-wide without a link leaving its task: a task gives each
block of texts a table of its distinct pairs, and each text the numbers and counts of its own
in that table.  Pair tables are summed by pair, and sums go back to the blocks.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .ans import LibraryEncoder
from .prefix_counts import byte_symbols
from .pretokens import Pieces, Stretches
from .scratch import BROADCAST_ROWS, Scratch

#: Bytes of text whose pairs share a table.
BLOCK_BYTES = 4 << 20
_SPACE = 0x20
_MARK = "▁"


class PieceEncoder:
    """Ids as sentencepiece gives them, a stretch at a time.

    No piece has a word mark after another character, so no merge passes the place
    between a visible character and a space: what stands between two such places is
    encoded once and known again by its bytes.  Models for which that is not so, or
    that change the text or add no space before it, are refused.
    """

    def __init__(self, raw: bytes):
        import sentencepiece

        self.inner = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.names = [self.inner.id_to_piece(k) for k in range(self.inner.vocab_size())]
        self.tokens = [bytes([int(x[3:5], 16)]) if self.inner.is_byte(k) else x.replace(_MARK, " ").encode() for k, x in enumerate(self.names)]
        probe = " a  b\tc   ﬁ "
        if any(_MARK in x.lstrip(_MARK) for x in self.names) or b"".join(self.tokens[k] for k in self.inner.encode(probe)) != f" {probe}".encode():
            raise ValueError("only models that keep the text, add a space before it and merge nothing across words are supported")
        self.lone = self.inner.piece_to_id(_MARK)
        self.stretches = Stretches(Pieces(self._stretches))

    def _stretches(self, own: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # A stretch begins with a space, which sentencepiece adds by itself where something follows.
        ids = [x or [self.lone] for x in self.inner.encode([x[1:] for x in own], num_threads=1)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((k for x in ids for k in x), np.int32, int(lengths.sum())), lengths

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts that each begin with a space, and each text's bounds among them."""
        here = data == _SPACE
        here[1:] &= data[:-1] != _SPACE
        here[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(here)
        numbers, ends = self.stretches.numbers(self.stretches.places(data, starts, np.zeros(0, np.int64)))
        return numbers, ends[np.searchsorted(starts, offsets)]


class ByteEncoder:
    """Ids as a byte-level file of the tokenizers library gives them, special strings taken as text."""

    def __init__(self, raw: bytes):
        self.inner = LibraryEncoder(raw)
        back = {c: b for b, c in enumerate(byte_symbols())}
        names = {k: x for x, k in json.loads(raw)["model"]["vocab"].items()}
        self.tokens = [bytes(back[c] for c in names.get(k, "")) for k in range(max(names, default=-1) + 1)]

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.inner.stretches.block(data, offsets)


class Table:
    """Strings of bytes by number, as one array."""

    def __init__(self, values: list[bytes]):
        self.sizes = np.fromiter(map(len, values), np.int64, len(values))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(values), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The strings of `ids`, one after the other."""
        n = self.sizes[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return self.flat[at]


class Ends:
    """A packed bitset of the places where tokens end."""

    def __init__(self, places: np.ndarray, n: int):
        marks = np.zeros((n // 64 + 1) * 64, np.bool_)
        marks[places] = True
        self.words = np.packbits(marks, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many tokens end at or before each place."""
        word = places >> 6
        part = self.words[word] & (np.uint64(2**64 - 1) >> (63 - (places & 63)).astype(np.uint64))
        return self.before[word] + np.bitwise_count(part)

    def has(self, places: np.ndarray) -> np.ndarray:
        return (self.words[places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)


def selected(words: np.ndarray) -> np.ndarray:
    """Places of the bits that are set."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def aligned(a_ends: np.ndarray, b_ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For tokens that end at these places of n bytes: shared cuts, tokens of A and of B up to each cut, and the links as places in A and in B."""
    a, b = Ends(a_ends, n), Ends(b_ends, n)
    cuts, ends = selected(a.words & b.words), selected(a.words | b.words)
    return cuts, a.rank(cuts), b.rank(cuts), a.rank(ends) - a.has(ends), b.rank(ends) - b.has(ends)


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text that is not empty with a space before it."""
    full = np.diff(offsets) > 0
    added = np.concatenate([[0], np.cumsum(full)])
    out = np.full(len(data) + added[-1], _SPACE, np.uint8)
    out[np.arange(len(data)) + np.repeat(added[1:], np.diff(offsets))] = data
    return out, offsets + added


def _only(ids: np.ndarray, bounds: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items of the texts that are good; the others keep none."""
    n = np.where(good, np.diff(bounds), 0)
    return ids[np.repeat(good, np.diff(bounds))], np.concatenate([[0], np.cumsum(n)])


class Aligner:
    """Aligns blocks of texts."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteEncoder(a), PieceEncoder(b)
        self.a_bytes, self.b_bytes = Table(self.a.tokens), Table(self.b.tokens)
        self.digits = Table([b"%d" % k for k in range(max(len(self.a.tokens), len(self.b.tokens)))])

    def _good(self, data: np.ndarray, offsets: np.ndarray, sides: list[tuple[Table, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Texts whose tokens' bytes are the text's, on both sides."""
        length = np.diff(offsets)
        good = length > 0
        for table, ids, bounds in sides:
            at = np.concatenate([[0], np.cumsum(table.sizes[ids])])[bounds]
            good = good & (np.diff(at) == length)
        for table, ids, bounds in sides:
            own, _ = _only(ids, bounds, good)
            said, _ = _only(data, offsets, good)
            other = np.flatnonzero(table.joined(own) != said)
            if len(other):
                ends = np.cumsum(np.where(good, length, 0))
                good[np.searchsorted(ends, other, "right")] = False
        return good

    def _groups(self, a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of `a1,a2|b1;...` over all groups (`last` says which end a text), and where each group's begin (and the end)."""
        na, nb = np.diff(ra, prepend=0), np.diff(rb, prepend=0)
        # A token of A stands after those of B in the groups before, one of B after those of A in its group too.
        pa_, pb = np.arange(len(a)) + np.repeat(rb - nb, na), np.arange(len(b)) + np.repeat(ra, nb)
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[pa_], ids[pb] = a, b
        ends = ra + rb - 1
        mark[ra + (rb - nb) - 1], mark[ends] = ord("|"), np.where(last, 0, ord(";"))
        size = self.digits.sizes[ids]
        at = np.cumsum(size + 1) - 1
        flat = np.empty(at[-1] + 1 if len(at) else 0, np.uint8)
        room = np.ones(len(flat), np.bool_)
        room[at] = False
        flat[room] = self.digits.joined(ids)
        flat[at] = mark
        return flat, np.concatenate([[0], at[ends] + 1])

    def block(self, column: pa.Array) -> tuple[dict[str, np.ndarray | list], np.ndarray, np.ndarray]:
        """Counts and digest of each text, its links as pairs (A id * 2**32 + B id) and their bounds by text."""
        data, offsets = _spaced(*tc.buffers(column))
        a, a_bounds = self.a.block(data, offsets)
        b, b_bounds = self.b.block(data, offsets)
        good = self._good(data, offsets, [(self.a_bytes, a, a_bounds), (self.b_bytes, b, b_bounds)])
        a, a_bounds = _only(a, a_bounds, good)
        b, b_bounds = _only(b, b_bounds, good)
        length = np.where(good, np.diff(offsets), 0)
        ends = np.cumsum(length)
        n = int(length.sum())
        # A bit stands for the last byte of a token.
        cuts, ra, rb, la, lb = aligned(np.cumsum(self.a_bytes.sizes[a]) - 1, np.cumsum(self.b_bytes.sizes[b]) - 1, n)
        by_text = np.concatenate([[0], np.searchsorted(cuts, ends - 1, "right")])
        last = np.zeros(len(cuts), np.bool_)
        last[by_text[1:][good] - 1] = True
        flat, at = self._groups(a, b, ra, rb, last)
        at = at[by_text].tolist()
        shown = flat.data
        digest = [hashlib.sha256(shown[i : j - 1]).hexdigest() if ok else "" for i, j, ok in zip(at, at[1:], good.tolist())]
        counts = {"n_a": np.diff(a_bounds), "n_b": np.diff(b_bounds), "n_groups": np.diff(by_text), "groups_sha256": digest}
        # Links of a text: one more than the tokens, less one a group.
        bounds = np.concatenate([[0], np.cumsum(counts["n_a"] + counts["n_b"] - counts["n_groups"])])
        return counts, a[la].astype(np.int64) << 32 | b[lb].astype(np.int64), bounds


_BLOCKS = "block long, {key}n_a long, n_b long, n_groups long, groups_sha256 string, links binary, pairs array<long>, counts array<long>"
_aligners: dict[int, Aligner] = {}


def _align(shared, key: str, kind: pa.DataType, text: str):
    """A row a text (its links as numbers and counts of pairs of its block), and after the texts of a block one with the block's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        aligner = _aligners.get(id(known))
        if aligner is None:
            _aligners.clear()
            aligner = _aligners[id(known)] = Aligner(*known)
        schema = pa.schema([("block", pa.int64()), (key, kind), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
        block, held, parts = TaskContext.get().partitionId() << 32, 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            pairs, place = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
            counts = np.bincount(place, minlength=len(pairs))
            begin = 0
            for ids, own, links, bounds in parts:
                n = len(ids)
                mine = np.repeat(np.arange(n) << 32, np.diff(bounds)) | place[begin : begin + len(links)]
                begin += len(links)
                mine.sort()
                first = np.flatnonzero(np.diff(mine, prepend=-1))
                times = np.diff(first, append=len(mine))
                both = np.stack([(mine[first] & 0xFFFFFFFF).astype("<u4"), times.astype("<u4")], 1)
                at = np.searchsorted(mine[first], np.arange(n + 1) << 32).tolist()
                raw = [both[i:j].T.tobytes() for i, j in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), ids, *(pa.array(own[x]) for x in ("n_a", "n_b", "n_groups")), pa.array(own["groups_sha256"], pa.string()), pa.array(raw, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], schema=schema)
            last = {"block": block, "pairs": pairs, "counts": counts}
            yield pa.RecordBatch.from_pylist([last], schema)

        for batch in batches:
            column = batch.column(text)
            _, offsets = tc.buffers(column)
            for i, j in tc.blocks(offsets):
                own, links, bounds = aligner.block(column[i:j])
                parts.append((batch.column(key)[i:j], own, links, bounds))
                held += int(offsets[j] - offsets[i])
                if held >= BLOCK_BYTES:
                    yield from flush()
                    block, held, parts = block + 1, 0, []
        if parts:
            yield from flush()

    return run


def align(docs: DataFrame, a_path: str, b_path: str, work: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each text: tokens of both sides, groups between shared cuts, and how its links stand corpus-wide.

    `a_path` is a byte-level file of the tokenizers library, which sees space +
    text; `b_path` a sentencepiece model that adds the space itself.  Columns:
    `id_col`, n_a, n_b, n_groups, n_links, n_best (links whose pair of ids is
    linked corpus-wide as often as any pair with its B id, ties included),
    count_sum (that count, over the links) and groups_sha256 (of `a1,a2|b1;a3|b2`).
    Texts that are null or empty, or that either side does not give back byte for
    byte, have zeros and ''.  Repeated rows and ids count each by itself; other
    columns are not read.
    """
    spark = docs.sparkSession
    raw = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            raw.append(f.read())
    shared = spark.sparkContext.broadcast(tuple(raw))
    field = docs.schema[id_col]
    kind = pa.int64() if field.dataType.simpleString() in ("bigint", "int") else pa.string()
    name = "bigint" if kind == pa.int64() else "string"
    rows = docs.select(F.col(id_col).cast(name).alias("id"), F.col(text_col).alias("text"))
    blocks = work.save(rows.mapInArrow(_align(shared, "id", kind, "text"), _BLOCKS.format(key=f"id {name}, ")), "blocks")
    pairs = blocks.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x")).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    totals = work.save(pairs.groupBy("pair").agg(F.sum("n").alias("total")), "totals")
    right = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    best = totals.groupBy(right.alias("b")).agg(F.max("total").alias("most"))
    best = F.broadcast(best) if pieces_of(raw[1]) <= BROADCAST_ROWS else best  # at most a row a piece
    sums = totals.withColumn("b", right).join(best, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    back = pairs.select(F.col("block").alias("of"), "place", "pair").join(sums, "pair").select("of", "place", "total", "best")
    texts = blocks.where("pairs is null").select("block", "id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    out = f"id {name}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    done = texts.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_summed, out)
    return done.withColumnRenamed("id", id_col)


def pieces_of(model: bytes) -> int:
    """Pieces of a sentencepiece model."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model).vocab_size()


def _summed(texts: pa.Table, back: pa.Table) -> pa.Table:
    """Texts of one block, with the corpus-wide counts of its pairs."""
    total, best = np.zeros(len(back), np.int64), np.zeros(len(back), np.int64)
    if len(back):  # an empty side has no columns but its key
        place = back["place"].to_numpy()
        total[place], best[place] = back["total"].to_numpy(), back["best"].to_numpy(zero_copy_only=False)
    sums, hits = [], []
    for raw in texts["links"].to_pylist():
        own, times = np.frombuffer(raw, "<u4").reshape(2, -1).astype(np.int64)
        sums.append(int((total[own] * times).sum()))
        hits.append(int((best[own] * times).sum()))
    columns = {x: texts[x] for x in ("id", "n_a", "n_b", "n_groups")}
    links = np.add(texts["n_a"].to_numpy(), texts["n_b"].to_numpy()) - texts["n_groups"].to_numpy()
    return pa.table(columns | {"n_links": pa.array(links, pa.int64()), "n_best": pa.array(hits, pa.int64()), "count_sum": pa.array(sums, pa.int64()), "groups_sha256": texts["groups_sha256"]})
