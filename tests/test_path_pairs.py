"""Pairs of tracks in blocks: against plain loops, and finished where they are found, without a shuffle of pairs."""

import math
import os
import random
from collections import defaultdict

import pytest

import __spark_entry__
from trackloom.operators import identities, pairs

DATA = "/root/testdata/sf0.001"


def random_points(seed, n=400):
    """(scene, camera, local_id, frame, x, y), with nulls and with rows of a track that repeat a frame."""
    r = random.Random(seed)
    return [(r.choice("ab"), r.choice([0, 1, 2, 2, None]) if r.random() < 0.2 else r.randrange(3), f"t{r.randrange(9)}", r.choice([None, *range(6)]), r.choice([None, *map(float, range(9))]), float(r.randrange(9))) for _ in range(n)]


def plain(points, most=None):
    found = defaultdict(list)
    for s, c, i, t, x, y in points:
        for s2, c2, j, t2, x2, y2 in points:
            if s == s2 and t is not None and t == t2 and c is not None and c2 is not None and c < c2:
                found[s, (c, i), (c2, j)].append(None if x is None or x2 is None else math.hypot(x - x2, y - y2))
    out = {}
    for pair, all_ in found.items():
        d = [v for v in all_ if v is not None]
        out[pair] = (len(all_), sum(d) / len(d) if d else None, min(d) if d else None)
    return {k: v for k, v in out.items() if most is None or v[1] is not None and v[1] <= most}


@pytest.mark.parametrize("most", [None, 3.0])
@pytest.mark.parametrize("seed", range(2))
def test_distances_of_tracks_of_different_cameras(spark, seed, most):
    points = random_points(seed)
    df = spark.createDataFrame(points, "scene string, camera int, local_id string, frame int, x double, y double")
    got = {(r["scene"], tuple(r["a"]), tuple(r["b"])): (r["n_shared"], r["distance"], r["least"]) for r in identities.trajectory_pairs(df, ["scene"], "frame", ["x", "y"], most).collect()}
    want = plain(points, most)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("every", [False, True])
@pytest.mark.parametrize("block", [2, 5, 100])
def test_tracks_of_one_camera_in_blocks_of_any_size(spark, block, every):
    rows = {(c, i, t) for _, c, i, t, _, _ in random_points(7) if c is not None and t is not None}
    df = spark.createDataFrame(sorted(rows), "camera int, id string, frame int")
    paths = pairs.gathered_paths(df, ["camera", "id"], "frame").selectExpr("*", "array_min(t) as first")
    got = {(r["camera"], r["id_1"], r["id_2"]): (r["n_shared"], r["a"]["first"], r["b"]["first"]) for r in pairs.path_pairs(paths, ["camera"], "id", carry=["first"], every=every, block=block, steps=(2, 3)).collect()}
    frames = defaultdict(set)
    for c, i, t in rows:
        frames[c, i].add(t)
    want = {(c, i, j): (len(frames[c, i] & frames[d, j]), min(frames[c, i]), min(frames[d, j])) for c, i in frames for d, j in frames if c == d and i < j}
    assert got == {k: v for k, v in want.items() if every or v[0]}
    assert pairs.path_pairs(paths.limit(0), ["camera"], "id", carry=["first"], every=every).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["j8_track_distances", "a8_distance_stats", "j9_same_camera_overlap", "j9_incompatible_pairs"])
def test_pairs_are_not_shuffled(spark, name):
    plan = __spark_entry__.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    after, kernel, _ = plan.partition("FlatMapGroupsInArrow")
    assert kernel and "Exchange" not in after and "Join" not in after


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_far_pairs_are_not_kept_for_identities(spark, monkeypatch):
    seen = []
    whole = identities.match_all
    monkeypatch.setattr(identities, "match_all", lambda nodes, ids, found, *a, **k: seen.append(found) or whole(nodes, ids, found, *a, **k))
    __spark_entry__.queries()["c16_global_identities"](spark, DATA)
    assert 0 < seen[0].count() == seen[0].where("distance <= 3").count()
