"""Top-k search, near duplicates, decontamination and the pipeline, against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import components, decontam, neardup, topk
from trackloom.llm.scratch import Scratch

VOCABULARY = ["".join(chr(97 + k // 26**i % 26) for i in range(3)) + "o" for k in range(4000)]


def runs_of(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[p : p + size]) for p in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def words(r, n):
    return [r.choice(VOCABULARY) for _ in range(n)]


def planted(seed):
    """Documents with chains and bundles of near copies around the threshold."""
    r = random.Random(seed)
    out = []
    for _ in range(25):
        base = words(r, r.randint(3, 150))
        out.append(" ".join(base))
        for _ in range(r.randint(0, 12)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(copy) // 40))):
                copy[r.randrange(len(copy))] = r.choice(VOCABULARY)
            out.append(" ".join(copy).upper() if r.random() < 0.2 else " ".join(copy))
            if r.random() < 0.3:
                base = copy
    return [*out, "", None, "one two", "One  TWO", " \n "]


def brute_components(texts, share=85):
    sets, label = [runs_of(t) for t in texts], list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= share * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
            old, new = sorted((label[a], label[b]), reverse=True)
            label = [new if x == old else x for x in label]
    return [(len(s), x) for s, x in zip(sets, label)]


@pytest.mark.parametrize("block", [512, 6])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_SETS", block)
    texts = planted(block)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as vid", "2 as digest").repartition(5)
    got = sorted(neardup.near_duplicates(docs).collect())
    assert [(r["n_shingles"], r["component_id"]) for r in got] == brute_components(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicate_edge_cases(spark):
    text = " ".join(VOCABULARY[:60])
    long_text = " ".join(words(random.Random(1), 30_000))
    rows = [(5, text), (5, text), (3, text), (None, text), (5, "other words are here now"), (9, None), (8, long_text), (7, long_text + " end")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == sorted([(5, 3, False), (5, 3, False), (3, 3, True), (-1, -1, True), (5, 5, True), (9, 9, True), (8, 7, False), (7, 7, True)])
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_table_keys_are_pairs_of_half_keys():
    miss = 1 - (1 - (1 - 0.85**neardup.ROWS) ** neardup.HALVES) ** 2
    assert miss < 5e-5


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(7, 7)]
    label = {}
    for a, b in edges:
        for x in (a, b):
            label.setdefault(x, x)
        p, q = label[a], label[b]
        if p != q:
            label = {k: min(p, q) if v in (p, q) else v for k, v in label.items()}
    want = {k: v for k, v in label.items() if any(a != b and k in (a, b) for a, b in edges)}
    got = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    assert {x["node"]: x["root"] for x in got.collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).collect() == []


def brute_contained(texts, items, threshold=0.8):
    out = []
    for d, text in texts:
        for i, item in items:
            own = (item or "").split()
            size = min(5, len(own))
            need = runs_of(item, size) if own else set()
            shared = len(need & runs_of(text, size)) if own and len((text or "").split()) >= size else 0
            if need and shared >= threshold * len(need) - 1e-9:
                out.append((d, i, len(need), shared))
    return sorted(out, key=str)


def test_contamination_equals_brute_force(spark):
    r = random.Random(6)
    items = [(k, " ".join(words(r, n))) for k, n in enumerate([2, 4, 5, 6, 9, 12, 13, 16, 20, 21, 30, 40, 60, 90, 140, 300])]
    items += [(90, items[10][1]), (91, None), (92, ""), (None, "x y z")]
    texts = []
    for d in range(120):
        text = words(r, r.choice([0, 3, 30, 400, 5000]))
        for _ in range(r.randint(0, 2)):
            passage = r.choice(items[:16])[1].split()
            cut = r.randint(0, max(0, len(passage) // 5))
            at = r.randint(0, len(text))
            text[at:at] = passage[cut:]
        texts.append((d, " ".join(text)))
    texts += [(500, None), (501, ""), (None, items[9][1]), (502, items[12][1].upper()), (502, items[12][1].upper())]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as n_item")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(docs, tests).collect()
    want = brute_contained(texts, [x for x in items if x[0] is not None])
    assert sorted(((g["doc_id"], g["item_id"], g["n_item"], g["n_shared"]) for g in got), key=str) == want
    assert all(g["containment"] == g["n_shared"] / g["n_item"] for g in got)
    assert decontam.contaminated(docs.limit(0), tests).collect() == [] == decontam.contaminated(docs, tests.limit(0)).collect()


def test_contamination_in_slices(spark, monkeypatch):
    r = random.Random(7)
    items = [(k, " ".join(words(r, 30))) for k in range(20)]
    docs = spark.createDataFrame([(k, " ".join(words(r, 200)) + " " + t) for k, t in items], "doc_id long, text string")
    monkeypatch.setattr(decontam, "SLICE_CHARS", 1000)
    got = decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((g["doc_id"], g["item_id"]) for g in got) == [(k, k) for k in range(20)]


def test_bands_reach_their_bound():
    for s in (0.15, 0.2, 0.4, 0.7, 0.9):
        n, rows = decontam.bands(s)
        assert n * rows <= decontam.HASHES and (1 - s**rows) ** n <= decontam.MISS * 1.01


def brute_top(rows, k):
    usable = [(i, [np.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in {i: min(w for j, w in usable if j == i) for i, _ in usable if i % 5 == 0}.items():
        found = sorted((-int(np.dot(v, w)), j) for j, w in usable if j != i and len(w) == len(v))[:k]
        out += [(i, n, j, -s) for n, (s, j) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("width", [1, 4, 33])
def test_top_k_equals_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(topk, "SLICE", 60)
    monkeypatch.setattr(topk, "GROUP", 20)
    monkeypatch.setattr(topk, "STEP", 16)
    r = np.random.default_rng(width)
    rows = [(k, [float(x) for x in r.normal(0, 0.3, width)]) for k in range(200)]
    rows += [(300 + k, rows[3][1]) for k in range(30)] + [(400, None), (405, [None] * width), (410, [float("nan")] * width), (415, [float("inf")] * width), (None, rows[0][1]), (420, [0.5] * (width + 1)), (425, [0.25] * (width + 1)), (5, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as width", "2 as rank").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 5 == 0, 7)
    stored = [(x["vec_id"], x["embedding"]) for x in df.collect()]
    assert sorted(tuple(x) for x in got.collect()) == brute_top(stored, 7)


def test_top_k_of_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(x) for x in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_bounds_hold():
    r = np.random.default_rng(0)
    a, b = np.floor(64 * r.normal(0, 0.3, (50, 30))), np.floor(64 * r.normal(0.1, 0.3, (60, 30)))
    exact = a @ b.T
    for n in (1, 2, 8, 15):
        assert (topk.descriptions(a, n) @ topk.descriptions(b, n).T >= exact - 1e-6).all()


def test_pipeline_on_planted_documents(spark, tmp_path):
    import corpus_pipeline
    from trackloom.llm import bpe
    from trackloom.llm.queries import RANKS

    r = random.Random(9)
    item = " ".join(words(r, 40))
    rows, labels = [], []
    for k in range(800):
        text = words(r, r.randint(30, 80))
        if k % 2:
            text.insert(r.randint(0, len(text)), r.choice(["grobble", "snurk", "wazzle"]))
        rows.append((k, " ".join(text), "en", "s", 0))
        labels.append((k, k % 2))
    clean = [k for k in range(0, 800, 2)]
    base = " ".join(words(r, 120))
    rows += [(1000, base, "en", "s", 0), (1001, base, "en", "s", 0), (1002, base + " more", "en", "s", 0), (1003, " ".join(words(r, 50)) + " " + item + " " + " ".join(words(r, 50)), "en", "s", 0), (1004, "write to me at some.one@mail.example.org now please", "en", "s", 0), (1005, None, "en", "s", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = {x["doc_id"]: x for x in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    assert 1000 in got and 1001 not in got and 1002 not in got and 1003 not in got and 1004 in got and 1005 in got
    assert len([k for k in clean if k in got]) >= 0.97 * len(clean)
    assert len([k for k in range(1, 800, 2) if k in got]) <= 12
    vocabulary = bpe.Vocabulary.load(RANKS)
    assert vocabulary.decode(bytes(got[1004]["token_ids"])).decode() == "write to me at [EMAIL] now please"
    assert got[1005]["n_tokens"] == 0 and got[1004]["n_chars"] == len("write to me at [EMAIL] now please")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), f"file://{tmp_path}").columns == docs.columns


def test_stages():
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "decontamination", "personal-data", "byte-bpe"]
