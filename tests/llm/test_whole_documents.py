"""Token ids, counts and near copies of whole documents of the driver's tables, against the libraries and brute force."""

import os
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

from trackloom.llm import ans, bpe, neardup, prefix_counts
from trackloom.llm import textcore as tc
from trackloom.llm.queries import RANKS, TOKENIZER

DATA = "/root/testdata/sf0.001/documents.parquet"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def texts():
    return [t or "" for t in pq.read_table(DATA, columns=["text"])["text"].to_pylist()]


def blocks(texts):
    data, offsets = tc.buffers(pa.array(texts, pa.string()))
    return [(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in tc.blocks(offsets, 100_000)]


def test_ids_of_whole_documents(texts):
    library = Tokenizer.from_file(TOKENIZER)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    with open(TOKENIZER, "rb") as f:
        encoder = ans.LibraryEncoder(f.read())
    assert [x.tolist() for b in blocks(texts) for x in encoder.block(*b)] == want
    assert prefix_counts.Counter(*prefix_counts.load(TOKENIZER)).count(texts, [])[0] == [len(x) for x in want]


def test_ranks_of_whole_documents(texts):
    vocabulary = bpe.Vocabulary.load(RANKS)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    for text, ids in zip(texts, bpe.Encoder(vocabulary).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(text) and vocabulary.decode(ids) == text.encode()


def plain_sets(texts):
    out = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in low).split(" ") if w]
        out.append({tuple(words[p : p + 5]) for p in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    return out


@pytest.mark.parametrize("share", [80, 85])
def test_components_of_whole_documents(spark, texts, share):
    sets, label = plain_sets(texts), list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        small, large = sorted((len(sets[a]), len(sets[b])))
        if small and 100 * small >= share * large:
            both = len(sets[a] & sets[b])
            if 100 * both >= share * (small + large - both) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(neardup.near_duplicates(docs, share=share).collect())
    assert [(r["n_shingles"], r["component_id"]) for r in got] == [(len(s), x) for s, x in zip(sets, label)]
