"""Cuts of texts into stretches, and stretches and words told apart by their bytes."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from trackloom.llm import ans, bpe, neardup, prefix_counts, pretokens
from trackloom.llm import textcore as tc
from trackloom.llm.queries import RANKS, TOKENIZER

MARKS = ["a", "Z", "é", "ß", "×", "÷", "ɏ", "ж", "҂", "λ", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "　", " ", "'", "'s", "'ll", "'re", "1", "²", "_", "!", "...", "中", "́", "😀", " the", "ing", "\x00", "\x7f"]


def thue_morse(n):
    """A string of `n` letters a and b, and the one with both swapped: sums of powers of an odd base cannot tell long ones apart."""
    first = ["ab"[bin(k).count("1") % 2] for k in range(n)]
    return "".join(first), "".join("b" if c == "a" else "a" for c in first)


def texts(n, seed, most=25):
    r = random.Random(seed)
    return ["".join(r.choice(MARKS) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_kinds_are_those_of_the_pattern():
    for c in map(chr, [*range(0x80), *range(0xC0, 0x240), *range(0x400, 0x480)]):
        raw = np.frombuffer(("x" + c + "y").encode(), np.uint8)
        kind = "letter" if regex.fullmatch(r"\p{L}", c) else "number" if regex.fullmatch(r"\p{N}", c) else "blank" if regex.fullmatch(r"\p{White_Space}", c) else "other"
        _, _, mixed = pretokens.cuts(raw, np.array([0, len(raw)]))
        if 1 in mixed and kind != "blank":
            assert 0x1C <= ord(c) < 0x20 or c in "×÷'"
        starts = set(pretokens.cuts(raw, np.array([0, len(raw)]))[0].tolist())
        if 1 not in mixed:
            assert (1 in starts) == (kind != "letter")


def test_cuts_change_no_piece():
    own = texts(6000, 1)
    data, offsets = tc.buffers(pa.array(own))
    starts, bounds, mixed = pretokens.cuts(data, offsets)
    ends, raw = np.append(starts[1:], len(data)), data.tobytes()
    single = pretokens._single(starts, ends, mixed)
    for k, text in enumerate(own):
        parts = [raw[starts[i] : ends[i]].decode() for i in range(bounds[k], bounds[k + 1])]
        assert "".join(parts) == text
        assert [p for x in parts for p in pretokens.pieces(x)] == pretokens.pieces(text)
        for i, x in enumerate(parts, bounds[k]):
            assert not single[i] or pretokens.pieces(x) == [x]


def test_keys_hold_short_spans():
    spans = [b"", b"\0", b"\0\0", b"a", b"a\0", b"12345678", b"12345678\0", b"123456789012345", b"12345678901234\0"]
    data = np.frombuffer(b"".join(spans), np.uint8)
    length = np.array([len(x) for x in spans])
    keys = set(zip(*(x.tolist() for x in pretokens.keys(data, np.cumsum(length) - length, length))))
    assert len(keys) == len(spans)


@pytest.mark.parametrize("n", [16, 64, 1024, 2048, 4096])
def test_swapped_letters_are_told_apart(n):
    a, b = thue_morse(n)
    assert tc.word_hash(a) != tc.word_hash(b)
    pair = [a, b, f"x {a} {b}.", f"{b}\n{a}"]
    library = Tokenizer.from_file(TOKENIZER)
    with open(TOKENIZER, "rb") as f:
        encoder = ans.LibraryEncoder(f.read())
    data, offsets = tc.buffers(pa.array(pair))
    want = [library.encode(t, add_special_tokens=False).ids for t in pair]
    assert [x.tolist() for x in encoder.block(data, offsets)] == want
    assert prefix_counts.Counter(*prefix_counts.load(TOKENIZER)).count(pair, [])[0] == [len(x) for x in want]
    vocabulary = bpe.Vocabulary.load(RANKS)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    for text, ids in zip(pair, bpe.Encoder(vocabulary).encode(pair)):
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(text) and vocabulary.decode(ids).decode() == text


def test_swapped_letters_do_not_link(spark):
    a, b = thue_morse(2048)
    rows = [(1, f"{a} one two three four"), (2, f"{b} one two three four"), (3, f"{a.upper()} one two three four")]
    got = sorted(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [(r["component_id"], r["kept"]) for r in got] == [(1, True), (2, True), (1, False)]


def test_word_hashes_follow_words():
    r = random.Random(5)
    own = {"".join(r.choice("abé\0") for _ in range(r.randint(1, 24))) for _ in range(5000)}
    assert len({tc.word_hash(w) for w in own}) == len(own)
    assert all(tc.word_hash(w) == tc.word_hash(w.upper().replace("É", "é")) for w in list(own)[:200])


def test_long_and_many_stretches_leave_the_tables(monkeypatch):
    monkeypatch.setattr(pretokens, "MOST_NUMBERS", 300)
    monkeypatch.setattr(pretokens, "LONGEST", 20)
    monkeypatch.setattr(tc.blocks, "__defaults__", (400,))
    vocabulary = bpe.Vocabulary.load(RANKS)
    own = [*texts(200, 3), "q" * 300, "q" * 300, " word" * 40]
    encoder = bpe.Encoder(vocabulary)
    got = encoder.encode(own)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [known.encode_ordinary(t) for t in own]
    assert encoder.stretches.used < 2000 and all(len(x) <= 20 for x in encoder.stretches.long)
