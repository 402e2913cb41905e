"""Text primitives, byte-level BPE, token files and prefix counts, against libraries and plain loops."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from trackloom.llm import ans, bpe, prefix_counts, pretokens
from trackloom.llm import textcore as tc
from trackloom.llm.queries import RANKS, TOKENIZER

PARTS = ["a", "b", "é", "ß", " ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", "1", "²", "½", "_", "!", "中", "文", " ", "　", "\x85", "\x1c", " ", "the", " the", "Ⅷ", "́", "😀", "\r\n", "<|endoftext|>", "٣", "x" * 40, "ab" * 100, "." * 50, "ing", " International"]


def random_texts(n, seed=1, most=30):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(RANKS)


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for sep in "\t\n\v\f\r":
        low = low.replace(sep, " ")
    return [w for w in low.split(" ") if w]


@pytest.mark.parametrize("size", [1, 3, 5])
def test_shingles_follow_words(size):
    texts = [*random_texts(300, 2), "", "one", "One TWO three four five six", None]
    seen = {}
    for i, j, values, bounds in tc.document_shingles(pa.array(texts), size):
        for k in range(i, j):
            own = values[bounds[k - i] : bounds[k - i + 1]].tolist()
            words = plain_words(texts[k] or "")
            runs = [tuple(words[p : p + size]) for p in range(len(words) - size + 1)] if len(words) >= size else [tuple(words)] * bool(words)
            assert len(own) == len(runs)
            for value, run in zip(own, runs):
                assert seen.setdefault(run, value) == value
    assert len(set(seen.values())) == len(seen)


def test_blocks_do_not_change_shingles(monkeypatch):
    texts = pa.array(random_texts(200, 3))
    whole = np.concatenate([v for *_, v, _ in tc.document_shingles(texts, 5)])
    monkeypatch.setattr(tc, "BLOCK_BYTES", 64)
    monkeypatch.setattr(tc.blocks, "__defaults__", (64,))
    assert (np.concatenate([v for *_, v, _ in tc.document_shingles(texts, 5)]) == whole).all()


def test_encoder_equals_tiktoken(vocabulary):
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    texts = [*random_texts(1500), "z" * 3000, "abcdefgh" * 200, ""]
    for text, ids in zip(texts, bpe.Encoder(vocabulary).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(text)
        assert vocabulary.decode(ids) == text.encode()


def test_full_tables_start_anew(vocabulary, monkeypatch):
    monkeypatch.setattr(pretokens, "MOST", 50)
    monkeypatch.setattr(tc.blocks, "__defaults__", (500,))
    texts = random_texts(400, 8)
    small, large = bpe.Encoder(vocabulary), bpe.Encoder(vocabulary)
    small.stretches.encode.limit = 40
    assert large.stretches.encode.limit > 40
    got = small.encode(texts)
    monkeypatch.setattr(pretokens, "MOST", 10**9)
    assert got == large.encode(texts)


def test_bpe_frames(spark, vocabulary):
    rows = [(1, "the end", "x"), (2, None, "y"), (3, "", "z"), (None, "the end", "x"), (1, "the end", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(df, RANKS)
    assert out.columns == ["doc_id", "text", "ids"]
    got = out.collect()
    assert got[0]["ids"] == got[3]["ids"] == got[4]["ids"] and len(got[0]["ids"]) == 2 and got[1]["ids"] == got[2]["ids"] == []
    back = bpe.decode(out, RANKS).collect()
    assert [bytes(r["decoded"]).decode() for r in back] == [r[1] or "" for r in rows]
    both = bpe.encode(df, RANKS, as_bytes=True, decoded_col="text2", keep=["doc_id"]).collect()
    assert [bytes(r["text2"]).decode() for r in both] == [r[1] or "" for r in rows]
    assert bpe.decode(bpe.encode(df.limit(0), RANKS), RANKS).collect() == []


def test_frame_round_trip_and_checkpoints():
    r = np.random.default_rng(0)
    for n in (0, 1, 7, 100, 5000, 1_200_000):
        ids = r.zipf(1.3, n) % 50257
        table = ans.FrequencyTable.scaled(*np.unique(ids, return_counts=True))
        frame = ans.encode_frame(ids, table)
        assert (ans.decode_frame(frame, table) == ids).all()
    step = ans.LANES * ans.CHECKPOINT_STEPS
    assert (ans.decode_frame(frame, table, 1, 2) == ids[step : 2 * step]).all()
    entropy = -sum(c * np.log2(c / n) for c in np.unique(ids, return_counts=True)[1]) / 8
    assert len(frame) < 1.15 * entropy
    hurt = bytearray(frame)
    hurt[len(hurt) // 2] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        ans.decode_frame(bytes(hurt), table)
    with pytest.raises(ValueError, match="not in"):
        ans.encode_frame(np.array([60_000]), table)


def test_frequencies_add_up():
    for counts in ([1], [1] * 300, [10**12, 1, 1], [5, 3, 10**6] + [1] * 5000):
        table = ans.FrequencyTable.scaled(np.arange(len(counts)), np.array(counts))
        assert table.frequencies.sum() == 1 << table.precision and table.frequencies.min() >= 1


@pytest.mark.parametrize("ordered", [True, False])
def test_token_files(spark, library, tmp_path, ordered):
    texts = random_texts(120, 5)
    rows = [(k * 3, t) for k, t in enumerate(texts)]
    if not ordered:
        rows += [(None, "no id"), (6, "again"), (6, texts[2]), (7, None)]
        random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3) if not ordered else spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    ans.write_tokens(df, f"file://{tmp_path}/t", TOKENIZER)
    got = ans.read_tokens(spark, f"file://{tmp_path}/t").collect()
    got.sort(key=lambda r: r["start"])
    ids = [library.encode(t or "", add_special_tokens=False).ids + [0] for _, t in rows]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, zlib.crc32(r["ids"])) for r in got) == sorted((d is not None, d or 0, zlib.crc32(np.array(x, "<u4").tobytes())) for (d, _), x in zip(rows, ids))
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert order == sorted(order)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]


def test_token_files_of_nothing(spark, tmp_path):
    ans.write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/t", TOKENIZER)
    assert ans.read_tokens(spark, f"file://{tmp_path}/t").count() == 0


def test_prefix_counts_equal_library(library):
    counter = prefix_counts.Counter(*prefix_counts.load(TOKENIZER))
    texts = random_texts(400, 4, 25)
    totals, ends = counter.count(texts, [5, 20])
    for k, text in enumerate(texts):
        want = [len(library.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
        assert counter.prefixes(text).tolist() == want
        assert totals[k] == want[-1]
        for limit, end in zip((5, 20), ends):
            assert end[k] == max(p for p in range(len(want)) if want[p] <= limit)


def test_token_counts_frame(spark, library):
    df = spark.createDataFrame([(1, "some text here " * 40, 9), (2, None, 9), (3, "<|endoftext|>", 9), (3, "<|endoftext|>", 9)], "doc_id long, text string, n_tokens int")
    got = prefix_counts.over_budget(df, TOKENIZER, 50, prefix_table=True).collect()
    assert [r["n_tokens"] for r in got] == [len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in got]
    assert [r["over_limit"] for r in got] == [True, False, False, False]
    assert len(got[0]["prefix_tokens"]) == 601 and got[1]["prefix_tokens"] == [0]
    assert prefix_counts.token_counts(df.limit(0), TOKENIZER).collect() == []


def test_query_digests(spark, tmp_path, library):
    from trackloom.llm import queries

    texts = [*random_texts(30, 6), None]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    ids = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4") for t in texts]
    ordinary = [np.array(tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Vocabulary.load(RANKS).ranks, special_tokens={}).encode_ordinary(t or ""), "<u4") for t in texts]
    two = sorted(queries.op2_byte_bpe(spark, f"file://{tmp_path}").collect())
    assert [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in two] == [(len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for x, t in zip(ordinary, texts)]
    three = sorted(queries.op3_token_files(spark, f"file://{tmp_path}").collect())
    assert [r["ids_crc32"] for r in three] == [zlib.crc32(np.append(x, np.uint32(0)).astype("<u4").tobytes()) for x in ids]
    seven = sorted(queries.op7_prefix_counts(spark, f"file://{tmp_path}").collect())
    assert [(r["n_tokens"], r["n_bytes"]) for r in seven] == [(len(x), len((t or "").encode())) for x, t in zip(ids, texts)]
