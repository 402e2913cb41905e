"""Exact token counts at every prefix, by dynamic programming.

A byte-level BPE encoding is the one sequence of tokens in which each two
neighbours, taken alone, would encode to themselves.  So the last token of the
encoding of a prefix ending at byte j is the one token t that ends there and
whose left neighbour, the last token of the prefix before t, is compatible with
it; the count at j is the count before t plus one.  Going once through a piece
gives the last token and the count at each of its prefixes.

Counts over pieces add up, so the count at every prefix of a text is known
without encoding any prefix again, which answers how many tokens a cut text has
and which is the longest prefix within a budget.  Three things at a cut are
minded: white space at the end of a prefix is one piece, a contraction cut short
is an apostrophe and a letter, and a special string cut short is ordinary text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as tc
from .pretokens import CONTRACTIONS, Pieces, Stretches, cuts, pieces


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Grammar:
    """Which tokens may stand side by side.  Tokens are numbered by bytes first, then in the order of merges."""

    def __init__(self, merges: list[tuple[bytes, bytes]], limit: int = 400_000):
        self.tokens = [bytes([b]) for b in range(256)]
        self.number = {t: k for k, t in enumerate(self.tokens)}
        self.left, self.right, self.merged = list(range(256)), list(range(256)), {}
        for a, b in merges:
            x, y = self.number[a], self.number[b]
            k = self.number.setdefault(a + b, len(self.tokens))
            if k == len(self.tokens):
                self.tokens.append(a + b)
                self.left.append(x)
                self.right.append(y)
            self.merged.setdefault((x, y), k)
        self.longest = max(map(len, self.tokens))
        #: Tokens that begin no longer token can end the search for longer ones early.
        self.limit, self._side, self._own = limit, {}, {}

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether the bytes of a then b encode to just these two tokens."""
        key = a << 32 | b
        known = self._side.get(key)
        if known is None:
            if len(self._side) > self.limit:
                self._side.clear()
            known = self._side[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the later of the two tokens' last merges again and again: the pair at
        # the seam must never merge before the merges that built a and b were done.
        bound = 1 << 60
        while True:
            seam = self.merged.get((a, b))
            if seam is not None and seam < bound:
                return False
            if a > b:
                bound = a
                a, whole = self.right[a], a
                if a == whole:
                    a, bound = whole, b + 1
                    b, whole = self.left[b], b
                    if b == whole:
                        return True
            else:
                bound = b + 1
                b, whole = self.left[b], b
                if b == whole:
                    bound = a
                    a, whole = self.right[a], a
                    if a == whole:
                        return True

    def reached(self, token: int) -> bool:
        """Whether a token's own bytes encode to it."""
        known = self._own.get(token)
        if known is None:
            if token < 256:
                known = True
            else:
                a, b = self.left[token], self.right[token]
                known = self.reached(a) and self.reached(b) and self._seam_first(a, b, token)
            self._own[token] = known
        return known

    def _seam_first(self, a: int, b: int, token: int) -> bool:
        # Nothing across the seam of a and b merges before `token` does.
        bound = token
        while True:
            seam = self.merged.get((a, b))
            if seam is not None and seam < bound:
                return False
            if a > b:
                bound = min(bound, a)
                if self.right[a] == a:
                    return True
                a = self.right[a]
            else:
                bound = min(bound, b + 1)
                if self.left[b] == b:
                    if self.right[a] == a:
                        return True
                    bound = min(bound, a)
                    a = self.right[a]
                else:
                    b = self.left[b]

    def _extend(self, piece: bytes, last: list[int], count: list[int]) -> None:
        """Goes on from the prefixes that `last` and `count` hold to the whole piece."""
        number, longest, memo, side = self.number.get, self.longest, self._side.get, self.side_by_side
        for j in range(len(last), len(piece) + 1):
            for i in range(j - longest if j > longest else 0, j):
                t = number(piece[i:j])
                if t is not None:
                    if i:
                        fits = memo(last[i] << 32 | t)
                        if fits is None:
                            fits = side(last[i], t)
                    else:
                        fits = self.reached(t)
                    if fits:
                        last.append(t)
                        count.append(count[i] + 1)
                        break
            else:
                raise ValueError(f"no encoding ends at byte {j} of a piece")

    def counts(self, piece: bytes) -> list[int]:
        """Tokens of each prefix of a piece, the empty one first."""
        last, count = [-1], [0]
        self._extend(piece, last, count)
        return count

    def totals(self, sorted_pieces: list[bytes]) -> list[int]:
        """Tokens of each piece; neighbours share the work on the prefix they have in common."""
        last, count, before, out = [-1], [0], b"", []
        for piece in sorted_pieces:
            k, n = 0, min(len(before), len(piece))
            while k < n and before[k] == piece[k]:
                k += 1
            del last[k + 1 :], count[k + 1 :]
            self._extend(piece, last, count)
            before = piece
            out.append(count[-1])
        return out


def require_byte_level(file: dict) -> None:
    """Refuses a tokenizers file that does more or else than split by the byte-level pattern and merge by rank."""
    split, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    merges = model.get("type") in (None, "BPE") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    words = all(not any(x.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for x in file.get("added_tokens", []))
    if not (plain and merges and words and not file.get("normalizer") and not file.get("truncation") and not file.get("padding")):
        raise ValueError("only tokenizers files with a byte-level pattern, plain merges and plain added tokens are supported")


def load(path: str) -> tuple[list[tuple[bytes, bytes]], list[str]]:
    """Merges in order, as bytes, and the special strings of a tokenizers file with a byte-level BPE model."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    require_byte_level(file)
    back = {c: b for b, c in enumerate(byte_symbols())}
    merges = []
    for m in file["model"]["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        merges.append((bytes(back[c] for c in a), bytes(back[c] for c in b)))
    return merges, [x["content"] for x in file.get("added_tokens", [])]


class Counter:
    """Counts tokens of texts and of all their prefixes."""

    def __init__(self, merges: list[tuple[bytes, bytes]], specials: list[str]):
        self.grammar, self.specials = Grammar(merges), specials
        self.stretches = Stretches(Pieces(self._pieces))
        self._totals: dict[str, int] = {}

    def _piece_total(self, piece: str) -> int:
        known = self._totals.get(piece)
        if known is None:
            if len(self._totals) > 200_000:
                self._totals.clear()
            known = self._totals[piece] = self.grammar.counts(piece.encode())[-1]
        return known

    def _pieces(self, own: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each piece; pieces are gone through in order, so that those with a common prefix share its work."""
        raw = [p.encode() for p in own]
        order = sorted(range(len(raw)), key=raw.__getitem__)
        out = np.empty(len(raw), np.int64)
        out[order] = self.grammar.totals([raw[k] for k in order])
        return out, np.ones(len(raw), np.int64)

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of text[:p] for p from 0 to len(text)."""
        if any(s in text for s in self.specials):
            return self._around_specials(text)
        out = np.zeros(len(text) + 1, np.int64)
        at = 0
        for piece in pieces(text):
            raw = self.grammar.counts(piece.encode())
            ends = accumulate(len(c.encode()) for c in piece)
            out[at + 1 : at + 1 + len(piece)] = [out[at] + raw[e] for e in ends]
            if piece in CONTRACTIONS and len(piece) == 3:
                out[at + 2] = out[at] + self._piece_total(piece[0]) + self._piece_total(piece[1])
            at += len(piece)
        # A prefix that ends in white space: the run is one piece, whatever follows the cut.
        fixed = []
        p = 0
        while p < len(text):
            if text[p].isspace():
                q = p
                while q < len(text) and text[q].isspace():
                    q += 1
                split = pieces(text[p:q] + "x")[:-1]
                if q - p > 1 or not split:
                    raw = self.grammar.counts(text[p:q].encode())
                    ends = list(accumulate(len(c.encode()) for c in text[p:q]))
                    # Characters that isspace() has and White_Space lacks make other pieces: count those anew.
                    odd = any(c in "\x1c\x1d\x1e\x1f" for c in text[p:q])
                    for k, e in enumerate(ends):
                        fixed.append((p + k + 1, out[p] + (sum(self._piece_total(x) for x in pieces(text[p : p + k + 1])) if odd else raw[e])))
                p = q
            else:
                p += 1
        for place, value in fixed:
            out[place] = value
        return out

    def _around_specials(self, text: str) -> np.ndarray:
        out, at, base = [np.zeros(1, np.int64)], 0, 0
        while at < len(text):
            found = [(k, -len(s), s) for s in self.specials if (k := text.find(s, at)) >= 0]
            if not found:
                out.append(base + self.prefixes(text[at:])[1:])
                break
            k, _, special = min(found)
            end = k + len(special)
            # A special string cut short is text that goes on with what stands before it.
            own = self.prefixes(text[at : end - 1])
            base_here = base + own[1:]
            total = base + own[k - at] + 1
            out += [base_here, np.array([total])]
            at, base = end, total
        return np.concatenate(out)

    def total(self, text: str) -> int:
        for s in self.specials:
            if s in text:
                return int(self.prefixes(text)[-1])
        return sum(map(self._piece_total, pieces(text)))

    def block(self, data: np.ndarray, offsets: np.ndarray, limits: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Totals of the texts of a block, and for each limit the longest prefixes within it, in code points."""
        starts, bounds, mixed = cuts(data, offsets)
        numbers, ends = self.stretches.numbers(self.stretches.places(data, starts, mixed))
        sums = np.concatenate([[0], np.cumsum(numbers)])[ends]
        totals = sums[bounds[1:]] - sums[bounds[:-1]]
        # Code points: bytes that do not go on with a character.
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        lengths = points[offsets[1:]] - points[offsets[:-1]]
        raw = data.tobytes()
        special = set()
        if any(s.encode() in raw for s in self.specials):
            special = {k for k in range(len(totals)) if any(s.encode() in raw[offsets[k] : offsets[k + 1]] for s in self.specials)}
            for k in special:
                totals[k] = self.prefixes(raw[offsets[k] : offsets[k + 1]].decode())[-1]
        ends = []
        for limit in limits:
            end = lengths.copy()
            for k in np.flatnonzero(totals > limit):
                if k in special:
                    end[k] = np.flatnonzero(self.prefixes(raw[offsets[k] : offsets[k + 1]].decode()) <= limit)[-1]
                    continue
                # The stretch that goes over the limit; those before it end in visible characters.
                base = sums[bounds[k]]
                at = int(np.searchsorted(sums, base + limit, "right")) - 1
                stop = starts[at + 1] if at + 1 < bounds[k + 1] else offsets[k + 1]
                inside = self.prefixes(raw[starts[at] : stop].decode()) + (sums[at] - base)
                end[k] = points[starts[at]] - points[offsets[k]] + np.flatnonzero(inside <= limit)[-1]
            ends.append(end)
        return totals, ends

    def count(self, texts: list[str], limits: list[int]) -> tuple[list[int], list[list[int]]]:
        """Totals, and for each limit the longest prefixes within it."""
        data, offsets = tc.buffers(pa.array(texts, pa.string()))
        totals: list[int] = []
        ends: list[list[int]] = [[] for _ in limits]
        for i, j in tc.blocks(offsets):
            own, within = self.block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], limits)
            totals += own.tolist()
            for kept, fresh in zip(ends, within):
                kept += fresh.tolist()
        return totals, ends


_counters: dict[int, Counter] = {}


def _count(shared, keep: list[str], text: str, limits: list[int], table: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) else id(shared.value)
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(*shared.value)
        counter = _counters[key]
        for batch in batches:
            data, offsets = tc.buffers(batch.column(text))
            for i, j in tc.blocks(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                totals, ends = counter.block(part, at, limits)
                columns = [pa.array(totals, pa.int64()), *(pa.array(x, pa.int64()) for x in ends)]
                names = ["n_tokens", *(f"chars_within_{x}" for x in limits)]
                if table:
                    raw = part.tobytes()
                    columns.append(pa.array([counter.prefixes(raw[a:b].decode()) for a, b in zip(at.tolist(), at[1:].tolist())], pa.list_(pa.int64())))
                    names.append("prefix_tokens")
                yield pa.RecordBatch.from_arrays([batch.column(c)[i:j] for c in keep] + columns, names=[*keep, *names])

    return run


def token_counts(df: DataFrame, tokenizer_path: str, text_col: str = "text", limits: tuple[int, ...] = (), prefix_table: bool = False, keep: list[str] | None = None) -> DataFrame:
    """`df` with n_tokens, chars_within_<limit> for each limit, and (prefix_table) prefix_tokens.

    chars_within_<limit> is the length in code points of the longest prefix that
    has at most that many tokens; prefix_tokens holds the count at every prefix
    from the empty one to the whole text.  Counts are those of the tokenizers
    library without begin, end or added special tokens; special strings inside a
    text count one each.  Null counts as an empty text.  Columns of `df` named
    like a result are replaced.
    """
    results = ["n_tokens", *(f"chars_within_{x}" for x in limits), *["prefix_tokens"] * prefix_table]
    keep = [c for c in (df.columns if keep is None else keep) if c not in results]
    shared = df.sparkSession.sparkContext.broadcast(load(tokenizer_path))
    kinds = [T.StructField(c, T.ArrayType(T.LongType()) if c == "prefix_tokens" else T.LongType()) for c in results]
    need = df.select(*dict.fromkeys([*keep, text_col]))
    return need.mapInArrow(_count(shared, keep, text_col, list(limits), prefix_table), T.StructType([df.schema[c] for c in keep] + kinds))


def over_budget(df: DataFrame, tokenizer_path: str, limit: int, **options) -> DataFrame:
    """`token_counts` with over_limit: whether the whole text has more than `limit` tokens."""
    return token_counts(df, tokenizer_path, limits=(limit,), **options).withColumn("over_limit", F.col("n_tokens") > limit)
