"""Matching over sparse pairs against dense kernels and plain loops, in one task a part and in rounds over the table."""

import random

import numpy as np
import pytest

from trackloom.operators import assignment as K
from trackloom.operators import identities, matching, tracklets


def sparse(seed, n=14, m=12, share=0.3, whole=None):
    r = random.Random(seed)
    return [(s, i, j, float(r.randint(0, whole)) if whole else r.random()) for s in range(3) for i in range(n) for j in range(m) if r.random() < share]


def dense(rows, scene, n=14, m=12, empty=np.inf):
    out = np.full((n, m), empty)
    for s, i, j, c in rows:
        if s == scene:
            out[i, j] = c
    return out


@pytest.mark.parametrize("seed", range(30))
def test_heaviest_equals_the_dense_assignment(seed):
    rows = [x for x in sparse(seed, whole=9 if seed % 2 else None) if x[0] == 0]
    limit = 7.0 if seed % 2 else 0.8
    cost = dense(rows, 0)
    i, j = K.assign_pairs(cost, limit)
    left, right, worth = (np.array(x) for x in zip(*[(i, j, limit - c) for _, i, j, c in rows if c <= limit]))
    kept = matching.heaviest(left, right, worth)
    assert len(set(left[kept])) == len(set(right[kept])) == len(kept)
    assert worth[kept].sum() == pytest.approx((limit - cost[i, j]).sum())


@pytest.mark.parametrize("most", [0, 200_000])
def test_assignment_of_scenes(spark, most):
    rows = sparse(5, share=0.15, whole=20)
    df = spark.createDataFrame([*rows, (0, 0, None, 1.0), (1, None, 2, 1.0), (2, 3, 3, None), *rows[:5]], "scene int, l int, r int, c double")
    out = matching.assignment(df, ["scene"], "l", "r", "c", 15.0, most_pairs=most, resolution=1.0).collect()
    assert {tuple(x) for x in out} <= set(rows)
    for scene in range(3):
        own = [x for x in out if x["scene"] == scene]
        assert len({x["l"] for x in own}) == len({x["r"] for x in own}) == len(own)
        cost = dense(rows, scene)
        i, j = K.assign_pairs(cost, 15.0)
        assert sum(15.0 - x["c"] for x in own) == pytest.approx((15.0 - cost[i, j]).sum())
    assert matching.assignment(df.where("false"), ["scene"], "l", "r", "c", 15.0).collect() == []


@pytest.mark.parametrize("most", [0, 200_000])
def test_greedy_pairs_of_scenes(spark, most):
    rows = sparse(6, whole=6)
    want = set()
    for scene in range(3):
        score = dense(rows, scene, empty=-1.0)
        want |= {(scene, i, j, score[i, j]) for i, j in K.greedy_pairs(score, 0.0)}
    df = spark.createDataFrame([*rows, *rows[:7], (0, None, 1, 9.0)], "scene int, l int, r int, s double")
    assert {tuple(x) for x in matching.greedy(df, ["scene"], "l", "r", "s", most_pairs=most).collect()} == want
    assert matching.greedy(df.where("false"), ["scene"], "l", "r", "s").collect() == []


def plain_association(n, pairs, frames, least=0.0):
    """One merge at a time: the most similar first, equal ones by the lesser names."""
    own = {i: [i] for i in range(n)}
    sim = {}
    for a, b, s in pairs:
        sim[min(a, b), max(a, b)] = s
    while True:
        best = None
        for a in own:
            for b in own:
                if a < b:
                    cells = [sim.get((min(x, y), max(x, y)), 0.0) for x in own[a] for y in own[b]]
                    if min(cells) < 0 or any(frames.get(x, set()) & frames.get(y, set()) for x in own[a] for y in own[b]):
                        continue
                    key = (-round(sum(cells) / len(cells), 9), a, b)
                    if -key[0] > least and (best is None or key < best):
                        best = key
        if best is None:
            return {i: a for a, members in own.items() for i in members}
        own[best[1]] += own.pop(best[2])


@pytest.mark.parametrize("seed", range(3))
def test_association_equals_one_merge_at_a_time(spark, seed):
    r = random.Random(seed)
    pairs = [(a, b, r.choice([0.9, 0.5, r.random(), -1.0 if r.random() < 0.2 else 0.7])) for a in range(24) for b in range(a) if r.random() < 0.2]
    frames = {i: {r.randint(0, 30) for _ in range(3)} for i in range(20)}
    nodes = spark.createDataFrame([(i,) for i in range(24)], "id long")
    seen = spark.createDataFrame([(i, f) for i, own in frames.items() for f in own], "id long, frame long")
    out = matching.associate(nodes, spark.createDataFrame(pairs, "a long, b long, similarity double"), seen)
    assert {x["id"]: x["cluster"] for x in out.collect()} == plain_association(24, pairs, frames)


def test_places_overrule_similarities(spark):
    pairs = spark.createDataFrame([(1, 2, 0.4), (1, 3, 0.4), (2, 3, 0.4)], "a long, b long, similarity double")
    places = spark.createDataFrame([(1, 2, 0.1, 0.0), (1, 3, 50.0, 20.0), (4, 5, 0.2, 0.1), (4, 6, 3.0, 1.0)], "a long, b long, mean_distance double, least_distance double")
    assert sorted(map(tuple, matching.overruled(pairs, places, ["a", "b"]).collect())) == [(1, 2, 1.0), (1, 3, -10.0), (2, 3, 0.4), (4, 5, 1.0)]
    s = np.full((2, 2), 0.4)
    assert identities.link_override(s, np.full((2, 2), 0.1), np.full((2, 2), 20.0)).tolist() == [[-10.0] * 2] * 2


def scenes(seed):
    r = random.Random(seed)
    tracks = [(s, c, i) for s in range(2) for c in range(4) for i in range(6)]
    pairs = [(s, (c, i), (d, j), r.choice([0.5, 1.0, 2.0]), r.choice([0.2, 0.9])) for s, c, i in tracks for t, d, j in tracks if s == t and c < d and r.random() < 0.2]
    return tracks, pairs


PAIRS = "scene long, a struct<camera: long, local_id: long>, b struct<camera: long, local_id: long>, distance double, similarity double"


def plain_first(tracks, pairs):
    out = {}
    for scene in {s for s, *_ in tracks}:
        groups = []
        for node in sorted((c, i) for s, c, i in tracks if s == scene):
            near = {}
            for s, a, b, d, x in pairs:
                if s == scene and d <= 1.5 and node in (a, b):
                    other = b if node == a else a
                    near[other] = near.get(other, False) or x >= 0.7
            def free(g, node=node):
                return all(m[0] != node[0] for m in g)
            alike = [k for k, g in enumerate(groups) if free(g) and any(near.get(m) for m in g)]
            close = [k for k, g in enumerate(groups) if free(g) and any(m in near for m in g)]
            k = min(alike or close or [len(groups)])
            if k == len(groups):
                groups.append([])
            groups[k].append(node)
            out[scene, *node] = k + 1
    return out


def plain_merge(ids, pairs):
    out = dict(ids)
    for scene in {s for s, *_ in ids}:
        links = sorted({tuple(sorted((ids[scene, *a], ids[scene, *b]))) for s, a, b, d, x in pairs if s == scene and d <= 1.5 and x >= 0.7})
        name = {g: g for (s, *_), g in ids.items() if s == scene}
        cameras = {g: {c for (s, c, _), h in ids.items() if s == scene and h == g} for g in name}
        for g, h in links:
            g, h = sorted((name[g], name[h]))
            if g != h and not cameras[g] & cameras[h]:
                cameras[g] |= cameras[h]
                name = {k: g if v == h else v for k, v in name.items()}
        out |= {k: name[v] for k, v in ids.items() if k[0] == scene}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_identities_equal_one_track_at_a_time(spark, seed):
    tracks, pairs = scenes(seed)
    df = spark.createDataFrame(tracks, "scene long, camera long, local_id long")
    found = spark.createDataFrame([*pairs, (0, (0, 0), (1, 1), 1.0, None)], PAIRS)
    pairs = [*pairs, (0, (0, 0), (1, 1), 1.0, -1.0)]
    first = identities.first_identities(df, found, ["scene"])
    assert {tuple(x)[:3]: x["global_id"] for x in first.select("scene", "camera", "local_id", "global_id").collect()} == plain_first(tracks, pairs)


@pytest.mark.parametrize("most", [0, 200_000])
@pytest.mark.parametrize("seed", range(2))
def test_merging_equals_one_link_at_a_time(spark, seed, most):
    tracks, pairs = scenes(seed)
    ids = {(s, c, i): 10 * c + i for s, c, i in tracks}
    df = spark.createDataFrame([(*k, v) for k, v in ids.items()], "scene long, camera long, local_id long, global_id long")
    out = identities.merge_identities(df, spark.createDataFrame(pairs, PAIRS), ["scene"], most_links=most).select("scene", "camera", "local_id", "global_id").collect()
    assert {tuple(x)[:3]: x["global_id"] for x in out} == plain_merge(ids, pairs)


def test_sections_link_as_one_fold_would(spark):
    r = np.random.default_rng(2)
    rows = [(cam, sec, 10 * sec, i, (r.normal(size=5) * 0.3 + np.eye(5)[i % 5]).tolist()) for cam in ("a", "b") for sec in (0, 1, 2, 4, 5, 6, 7, 8) for i in range(int(r.integers(1, 5)))]
    df = spark.createDataFrame(rows, "camera string, section long, frame long, local_id long, vector array<double>")
    got = {(x["camera"], x["section"], x["local_id"]): x["track_id"] for x in tracklets.link_sections(df, ["camera"], "frame", "vector", 0.6).collect()}
    want = {}
    for cam in ("a", "b"):
        fresh, before, last = 0, [], None
        for sec in sorted({x[1] for x in rows}):
            own = [x for x in rows if x[:2] == (cam, sec)]
            if before and last == sec - 1:
                s = K.cosine_matrix(np.array([x[4] for x in own]), np.array([x[4] for x in before]))
                for i, j in zip(*K.assign(-s)):
                    if s[i, j] >= 0.6:
                        want[cam, sec, own[i][3]] = want[cam, last, before[j][3]]
            for x in own:
                if (cam, sec, x[3]) not in want:
                    want[cam, sec, x[3]], fresh = fresh, fresh + 1
            before, last = own, sec
    assert got == want
