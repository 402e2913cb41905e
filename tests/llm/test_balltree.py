"""Clusters against a plain loop over whole numbers, and trees against all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from trackloom.llm import balltree
from trackloom.llm.scratch import Scratch

SCHEMA = "vec_id long, embedding array<float>, cluster string, id int"


def plain(rows, k, rounds, width):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:k]]

    def gap(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))

    def nearest(v):
        return min(range(len(centroids)), key=lambda c: (gap(v, centroids[c]), c))

    for _ in range(rounds):
        by = {}
        for _, v in kept:
            by.setdefault(nearest(v), []).append(v)
        for c, own in by.items():
            centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, nearest(v), gap(v, centroids[nearest(v)])) for i, v in kept]
    shown = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, c, d, sum(y for _, x, y in out if x == c), sum(y for _, _, y in out), shown[c]) for i, c, d in out)


def vectors(width, n, seed):
    r = random.Random(seed)
    middles = [[r.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    rows = [(k, [x + r.gauss(0, 0.2) for x in r.choice(middles)], "clash", k) for k in range(n)]
    rows += [(n + k, [0.25] * width, None, None) for k in range(n // 3)]
    rows += [(7, rows[7][1], "", 0), (7, [1.0] * width, "", 0)]
    bad = [(9001, None, "", 0), (9002, [], "", 0), (9003, [0.5] * (width - 1), "", 0), (9004, [None] + [0.5] * (width - 1), "", 0), (9005, [float("nan")] * width, "", 0), (9006, [float("inf")] * width, "", 0)]
    return rows + bad


def result(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, balltree.cluster(df, Scratch(spark, "test-clusters"), **options).collect()))


def test_against_a_plain_loop(spark, monkeypatch):
    rows = vectors(8, 300, 1)
    want = plain(rows, 16, 3, 8)
    assert result(spark, rows, width=8) == want
    monkeypatch.setattr(balltree, "BLOCK", 50)
    assert result(spark, rows, width=8) == want


def test_few_vectors_and_none(spark):
    rows = vectors(8, 6, 2)[:6]
    assert result(spark, rows, width=8) == plain(rows, 16, 3, 8)
    assert result(spark, rows, width=5) == []
    assert result(spark, [], width=8) == []


def test_rows_without_an_id_are_clustered_but_begin_no_cluster(spark):
    rows = vectors(4, 40, 3)
    df = spark.createDataFrame([*rows, (None, [9.0] * 4, "", 0)], SCHEMA)
    out = balltree.cluster(df, Scratch(spark, "test-clusters"), width=4).collect()
    assert len(out) == len(plain(rows, 16, 3, 4)) + 1 and sum(r["vec_id"] is None for r in out) == 1


def test_components_beyond_64_bits_count_as_the_largest(spark):
    rows = [(k, [float(k), 3e38 if k == 3 else 1.0], "", 0) for k in range(5)]
    out = {r["vec_id"]: r for r in balltree.cluster(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "test-clusters"), k=2, width=2).collect()}
    assert len(out) == 5 and len({out[k]["cluster"] for k in (0, 1, 2, 4)} | {out[3]["cluster"]}) == 2


@pytest.mark.parametrize("top", [3, 1000, 1 << 26])
def test_trees_give_what_all_distances_give(top):
    rng = np.random.default_rng(top)
    points = rng.integers(-top, top + 1, (700, 6))
    points[::3] = points[0]
    centroids = np.concatenate([points[rng.integers(0, 700, 9)], rng.integers(-top, top + 1, (4, 6))])
    gap = np.array([[int(sum((int(x) - int(y)) ** 2 for x, y in zip(p, c))) for c in centroids] for p in points], object)
    own = np.array([min(range(13), key=lambda c: (row[c], c)) for row in gap])
    tree = balltree.Tree.build(points, leaf=8)
    tree = balltree.Tree.unpacked(700, *(tree.packed()[x] for x in ("points", "nodes", "balls", "totals")))
    order = balltree.Tree.build(points, leaf=8).order
    label, distance = tree.assigned(centroids)
    assert (label == own[order]).all() and distance.tolist() == [gap[k][own[k]] for k in order]
    count, total = tree.sums(centroids)
    assert count.tolist() == np.bincount(own, minlength=13).tolist()
    assert all((total[c] == points[own == c].sum(0)).all() for c in range(13))


def test_far_balls_go_whole():
    rng = np.random.default_rng(1)
    middles = rng.integers(-5000, 5000, (16, 64))
    points = middles[rng.integers(0, 16, 4000)] + rng.integers(-3, 4, (4000, 64))
    node, _, leaves, _ = balltree.Tree.build(points).filtered(middles)
    tree = balltree.Tree.build(points)
    assert (tree.hi[node] - tree.lo[node]).sum() > 0.8 * len(points) and len(leaves) < len(tree.lo) // 4
