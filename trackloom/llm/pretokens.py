"""Splitting texts the way byte-level BPE does, with a table of distinct stretches.

A text is cut where its bytes alone show that the splitting pattern begins a new
match there and that what stands before is split the same with or without what
follows (`cuts`).  So a stretch between two cuts needs to be tokenised once; where it
occurs again, it is found by its bytes: a short one in a numpy table whose keys are
its bytes and its length, block by block, without a Python object per word; a longer
one in a dict.  Most stretches are single matches (a word and the space before it);
only the others go through the pattern.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import regex

from .textcore import U64, eights, mix

#: The pattern of the vocabularies, with White_Space spelled out.
GENERAL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: The same for characters for which both engines agree on letters, digits and white space.
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\x7eÀ-ɏ]")
CONTRACTIONS = frozenset(["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"])
#: Kinds of characters that bytes show: UNKNOWN are control characters that engines take for white space, and all but some of those beyond ASCII.
UNKNOWN, LETTER, NUMBER, BLANK, OTHER, _LEAD = range(6)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[[*range(0x09, 0x0E), 0x20]] = BLANK
_KIND[0x30:0x3A] = NUMBER
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = LETTER
_KIND[0x1C:0x20] = _KIND[0x80:] = UNKNOWN
#: First bytes of letters of two bytes: U+00C0 to U+023F (two signs apart) and U+0400 to U+047F.
_KIND[[*range(0xC3, 0xC9), 0xD0, 0xD1]] = _LEAD
#: Last bytes of white space of three bytes, by its first two.
_WIDE_BLANKS = ((0xE1, 0x9A, [0x80]), (0xE2, 0x80, [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]), (0xE2, 0x81, [0x9F]), (0xE3, 0x80, [0x80]))
#: Longest stretch that is a key of the numpy table: with its length it fills two 64-bit numbers.
SHORT = 15
_FIRST = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(SHORT + 1)], U64)
_SECOND = np.array([(1 << 8 * max(0, n - 8)) - 1 for n in range(SHORT + 1)], U64)
#: Stretches and their numbers that a table holds before it is emptied, and the longest stretch that is kept (in bytes).
MOST, MOST_NUMBERS, LONGEST = 500_000, 4_000_000, 256
_NONE = U64(2**64 - 1)


def pieces(text: str) -> list[str]:
    """Matches of the pattern, in order; they cover the text."""
    return (GENERAL if _NOT_PLAIN.search(text) else _PLAIN).findall(text)


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the stretches of a block of texts, each text's bounds among them (an empty text has none), and places of which a stretch that is a single match has none.

    Two neighbours of different known kinds are cut, but for a space and what
    follows it, an apostrophe and a letter (a contraction), and white space of
    two or more characters (or after an unknown one) and what follows.  A space
    is cut from any visible character before it.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, np.zeros(len(offsets), np.int64), none
    kind = _KIND[data]
    two = np.flatnonzero(kind == _LEAD)
    kind[two] = kind[two + 1] = LETTER
    signs = two[(data[two] == 0xC3) & ((data[two + 1] == 0x97) | (data[two + 1] == 0xB7))]
    kind[signs] = kind[signs + 1] = UNKNOWN
    change = np.zeros(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    known = kind != UNKNOWN
    space = data == 0x20
    here = change & known
    here[1:] &= known[:-1]
    here[1:] &= ~space[:-1]
    marks = np.flatnonzero(data[:-1] == 0x27) + 1
    here[marks[kind[marks] == LETTER]] = False
    # A space after a visible character of more than one byte.
    at = np.flatnonzero(space[1:] & ~known[:-1]) + 1
    if len(at):
        one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        blank = (one < 0x80) | (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
        for a, b, last in _WIDE_BLANKS:
            blank |= (three == a) & (two == b) & np.isin(one, last)
        here[at[~blank]] = True
    begins = offsets[:-1][np.diff(offsets) > 0]
    here[begins] = True
    # White space before a visible character: one alone is the match it is without it.
    after = np.flatnonzero(here[1:] & (kind[:-1] == BLANK)) + 1
    here[after[~here[after - 1]]] = False
    here[begins] = True
    starts = np.flatnonzero(here)
    # Unknown characters, and changes inside a stretch but that after the space it begins with.
    change &= ~here
    change[1:] &= ~(space[:-1] & here[:-1])
    return starts, np.searchsorted(starts, offsets), np.flatnonzero(change | ~known)


def keys(data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each span of at most SHORT bytes: its bytes, and its length in the topmost byte."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    return eights(padded, starts) & _FIRST[length], eights(padded, starts + 8) & _SECOND[length] | length.astype(U64) << U64(56)


class Stretches:
    """What `encode` makes of each distinct stretch: whole numbers.

    `encode` puts the numbers of a stretch together from those of its pieces; for a
    stretch that is one piece, they are those of the piece.  The table grows to MOST stretches or MOST_NUMBERS numbers
    and is then emptied; stretches over LONGEST bytes are encoded wherever they stand.
    Results do not depend on that.
    """

    def __init__(self, encode: Pieces):
        self.encode = encode
        self._empty()

    def _empty(self) -> None:
        self.n, self.used, self.flat, self.long = 0, 0, np.zeros(1 << 16, np.int32), {}
        self._slots(16)

    def _slots(self, bits: int) -> None:
        # Two keys, and where the numbers begin (upper half) and how many there are; all ones where empty.
        self.bits, self.slots = bits, np.full((1 << bits, 3), U64(2**64 - 1))

    def _at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (mix(mix(a) + b) >> U64(64 - self.bits)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place and count of each entry, all ones where it is not there."""
        rows = self.slots[self._at(a, b)]
        out = rows[:, 2].copy()
        todo = np.flatnonzero(((rows[:, 0] != a) | (rows[:, 1] != b)) & (out != _NONE))
        out[todo] = _NONE
        at = self._at(a[todo], b[todo])
        while len(todo):
            at = (at + 1) & ((1 << self.bits) - 1)
            rows = self.slots[at]
            there = rows[:, 2] != _NONE
            hit = (rows[:, 0] == a[todo]) & (rows[:, 1] == b[todo]) & there
            out[todo[hit]] = rows[hit, 2]
            on = there & ~hit
            todo, at = todo[on], at[on]
        return out

    def _put(self, rows: np.ndarray) -> None:
        at = self._at(rows[:, 0], rows[:, 1])
        while len(rows):
            free = np.flatnonzero(self.slots[at, 2] == _NONE)
            own = free[np.unique(at[free], return_index=True)[1]]
            self.slots[at[own]] = rows[own]
            left = np.ones(len(rows), bool)
            left[own] = False
            rows, at = rows[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _places(self, stretches: list[bytes], single: np.ndarray) -> np.ndarray:
        """Entries of stretches that are encoded now; `single` says which are one piece for certain."""
        texts = b"\xff".join(stretches).decode("utf-8", "surrogateescape").split("\udcff")
        if single.all():
            return self._stored(*self.encode.encode(texts))
        out = np.empty(len(texts), U64)
        for which, encode in ((single, self.encode.encode), (~single, self.encode)):
            at = np.flatnonzero(which)
            if len(at):
                out[at] = self._stored(*encode([texts[k] for k in at.tolist()]))
        return out

    def _stored(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if self.used + len(flat) > len(self.flat):
            grown = np.zeros(max(2 * len(self.flat), self.used + len(flat)), np.int32)
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used : self.used + len(flat)] = flat
        starts = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)
        self.n += len(lengths)
        return starts.astype(U64) << U64(32) | lengths.astype(U64)

    def _add(self, a: np.ndarray, b: np.ndarray, places: np.ndarray) -> None:
        if 2 * self.n > 1 << self.bits:
            old = self.slots[self.slots[:, 2] != _NONE]
            self._slots((2 * self.n - 1).bit_length())
            self._put(old)
        self._put(np.stack([a, b, places], 1))

    def _short(self, data: np.ndarray, starts: np.ndarray, length: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        a, b = keys(data, starts, length)
        out = self._find(a, b)
        missing = np.flatnonzero(out == _NONE)
        raw = data.tobytes() if len(missing) else b""
        while len(missing):
            # One of each; two stretches that are mixed to one number take a round each.
            own = missing[np.unique(mix(mix(a[missing]) + b[missing]), return_index=True)[1]]
            at, ends = starts[own], starts[own] + length[own]
            places = self._places([raw[s:e] for s, e in zip(at.tolist(), ends.tolist())], _single(at, ends, mixed))
            self._add(a[own], b[own], places)
            out[missing] = self._find(a[missing], b[missing])
            missing = missing[out[missing] == _NONE]
        return out

    def _long(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        own = [data[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist())]
        fresh = {x: one for x, one in zip(own, _single(starts, ends, mixed)) if x not in self.long}
        known = dict(zip(fresh, self._places(list(fresh), np.array(list(fresh.values()))).tolist())) if fresh else {}
        self.long.update((x, place) for x, place in known.items() if len(x) <= LONGEST)
        return np.array([known[x] if x in known else self.long[x] for x in own], U64)

    def places(self, data: np.ndarray, starts: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """Entries of the stretches of a block that begin at `starts` (each ends where the next begins, the last with the block); `mixed` as `cuts` gives it."""
        if not len(starts):
            return np.zeros(0, U64)
        if self.n > MOST or self.used > MOST_NUMBERS:
            self._empty()
        ends = np.append(starts[1:], len(data))
        length = ends - starts
        long = np.flatnonzero(length > SHORT)
        if not len(long):
            return self._short(data, starts, length, mixed)
        short = np.flatnonzero(length <= SHORT)
        out = np.empty(len(starts), U64)
        out[short] = self._short(data, starts[short], length[short], mixed)
        out[long] = self._long(data, starts[long], ends[long], mixed)
        return out

    def numbers(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the entries one after the other, and where each entry's begin (and the end)."""
        lengths = (places & U64(0xFFFFFFFF)).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat((places >> U64(32)).astype(np.int64) - bounds[:-1], lengths)
        at += np.arange(bounds[-1])
        return self.flat[at], bounds

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts of a block, and each text's bounds among them."""
        starts, bounds, mixed = cuts(data, offsets)
        numbers, ends = self.numbers(self.places(data, starts, mixed))
        return numbers, ends[bounds]


def _single(starts: np.ndarray, ends: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """Which stretches hold none of the places `mixed`."""
    return np.searchsorted(mixed, starts) == np.searchsorted(mixed, ends)


class Pieces:
    """Numbers of stretches, put together from those of their pieces.

    `encode` gets distinct pieces, and returns their numbers one after the other and
    how many each has.  Two generations of `limit` / 2 pieces are kept: when the
    young one is full it becomes the old one.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 100_000):
        self.encode, self.limit, self.young, self.old = encode, limit, {}, {}

    def __call__(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [pieces(x) for x in stretches]
        own = [p for x in split for p in x]
        distinct = dict.fromkeys(own)
        if len(self.young) + len(distinct) > self.limit // 2:
            self.old, self.young = self.young, {}
        known = {p: x for p in distinct if (x := self.young.get(p) or self.old.get(p)) is not None}
        fresh = [p for p in distinct if p not in known]
        if fresh:
            flat, lengths = self.encode(fresh)
            raw, ends = flat.astype("<i4").tobytes(), (4 * np.cumsum(lengths)).tolist()
            known.update((p, raw[i:j]) for p, i, j in zip(fresh, [0, *ends], ends))
        self.young.update(known)
        values = [known[p] for p in own]
        sizes = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        counts = np.fromiter(map(len, split), np.int64, len(split))
        return np.frombuffer(b"".join(values), "<i4"), np.add.reduceat(sizes, np.cumsum(counts) - counts)
