"""Token alignment against a plain walk over both sides' tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from trackloom.llm import alignment
from trackloom.llm.queries import PIECES, TOKENIZER
from trackloom.llm.scratch import Scratch


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(open(TOKENIZER, "rb").read(), open(PIECES, "rb").read())


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(TOKENIZER)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def texts():
    r = random.Random(1)
    parts = ["a", "b", " ", "  ", "é", "▁", "<0x41>", "日本", "\n", "\t", "\x00", "😀", "<|endoftext|>", "hello", " the", "123", "_", "'s", " ", "<unk>", "<s>"]
    plain = [x for x in parts if x != "▁"]
    return [None, "", " ", "  ", "a ", " a", "x   ", "   x", "▁", "word " * 4000] + ["".join(r.choice(p) for _ in range(r.randint(1, 30))) for p in (parts, plain) for _ in range(300)]


def plain(text, both, aligner):
    """Counts, digest and links of one text."""
    if not text:
        return (0, 0, 0, 0, ""), []
    a, b = both[0].encode(" " + text, add_special_tokens=False).ids, both[1].encode(text)
    raw = [[aligner.a.tokens[k] for k in a], [aligner.b.tokens[k] for k in b]]
    if any(b"".join(x) != f" {text}".encode() for x in raw):
        return (0, 0, 0, 0, ""), []
    spans = []
    for ids, own in zip((a, b), raw):
        at = np.concatenate([[0], np.cumsum([len(x) for x in own])]).tolist()
        spans.append(list(zip(ids, at, at[1:])))
    cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
    shown = ";".join("|".join(",".join(str(k) for k, s, e in own if low <= s and e <= high) for own in spans) for low, high in zip([0, *cuts], cuts))
    links, j = [], 0
    for x, s, e in spans[0]:
        while spans[1][j][2] <= s:
            j += 1
        links += [(x, y) for y, t, _ in spans[1][j : j + e - s] if t < e]
    return (len(a), len(b), len(cuts), len(links), hashlib.sha256(shown.encode()).hexdigest()), links


def test_blocks_against_a_plain_walk(aligner, both):
    own = texts()
    counts, links, bounds = aligner.block(pa.array(own))
    for k, text in enumerate(own):
        if text and len(text) > 1000:
            continue
        want, pairs = plain(text, both, aligner)
        assert (counts["n_a"][k], counts["n_b"][k], counts["n_groups"][k], bounds[k + 1] - bounds[k], counts["groups_sha256"][k]) == want
        assert sorted(links[bounds[k] : bounds[k + 1]].tolist()) == sorted(x << 32 | y for x, y in pairs)


def test_whole_table_against_a_plain_count(spark, aligner, both, monkeypatch):
    own = [x for x in texts() if not x or len(x) < 1000]
    own += own[20:40]
    rows = [(k % 500 if k % 17 else None, x, "clash", 1) for k, x in enumerate(own)]
    found = [plain(x, both, aligner) for x in own]
    count = Counter(pair for _, links in found for pair in links)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    want = sorted(((i, *head[:4], sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), head[4]) for (i, *_), (head, links) in zip(rows, found)), key=repr)
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, total int").repartition(3)
    for size in (alignment.BLOCK_BYTES, 500):
        monkeypatch.setattr(alignment, "BLOCK_BYTES", size)
        out = alignment.align(df, TOKENIZER, PIECES, Scratch(spark, "test-alignment"))
        assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(map(tuple, out.collect()), key=repr) == want


def test_no_texts(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(df, TOKENIZER, PIECES, Scratch(spark, "test-alignment")).collect() == []
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.align(df, TOKENIZER, PIECES, Scratch(spark, "test-alignment")).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_packed_bitsets():
    rng = np.random.default_rng(4)
    places = np.flatnonzero(rng.random(1000) < 0.3)
    ends = alignment.Ends(places, 1000)
    every = np.arange(1000)
    assert (ends.rank(every) == np.searchsorted(places, every, "right")).all()
    assert (np.flatnonzero(ends.has(every)) == places).all() and (alignment.selected(ends.words) == places).all()
