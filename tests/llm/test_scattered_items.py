"""Items in pieces all over a document are found, and scores beyond 64 bits do not stop a search."""

import random

import numpy as np
import pyarrow as pa

from trackloom.llm import decontam, topk


def test_items_in_scattered_pieces_are_found():
    r = random.Random(6)
    items = [" ".join(f"i{k}w{r.randint(0, 10**9)}" for _ in range(r.randint(60, 900))) for k in range(60)]
    texts, want = [], set()
    for k, item in enumerate(items):
        words = item.split()
        cuts = sorted(r.sample(range(1, len(words)), max(1, len(words) // 40)))
        parts = [words[i:j] for i, j in zip([0, *cuts], [*cuts, len(words)])]
        r.shuffle(parts)
        text = [w for p in parts for w in (*p, *(f"noise{r.randint(0, 10**9)}" for _ in range(r.randint(20, 200))))]
        runs = {tuple(text[i : i + 5]) for i in range(len(text) - 4)}
        own = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        if sum(x in runs for x in own) >= 0.8 * len(set(own)):
            want.add((k, k))
        texts.append(" ".join(text))
    found = {(row, item) for row, item, *_ in decontam.Index(list(range(60)), items, 5, 0.8).contained(pa.array(texts))}
    assert len(want) > 40 and found == want


def test_scores_beyond_64_bits():
    v = np.array([[3e38, 1.0], [-3e38, 2.0], [3e38, 5.0]]).round()
    query, ids, score = topk.search(np.array([7]), v[:1], np.array([1, 2, 3]), v, 3)
    assert query.tolist() == [7] * 3 and ids.tolist() == [1, 3, 2]
    assert score.tolist() == [2**63 - 1, 2**63 - 1, 1 - 2**63]
