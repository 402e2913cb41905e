"""Metrics on frames with an empty side, sequence lengths, and optimal parts against all permutations."""

from itertools import permutations

import numpy as np
import pytest

from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.operators import assignment
from trackloom.operators import detection as D
from trackloom.operators import metrics as M
from trackloom.operators import pairs


def frames(spark, gt, tracker, near):
    return M.timeline(spark.createDataFrame(gt, "seq string, t int, gt_id int"), spark.createDataFrame(tracker, "seq string, t int, tracker_id int"), spark.createDataFrame(near, "seq string, t int, gt_id int, tracker_id int, similarity double"))


def test_a_frame_with_one_side_empty_breaks_nothing(spark):
    # Matched, then no tracker row, then matched again: one stretch. Then no ground truth, then matched by another id.
    gt = [("a", t, 1) for t in (0, 1, 2, 4)]
    tracker = [("a", t, 7) for t in (0, 2, 3)] + [("a", 4, 8)]
    times = frames(spark, gt, tracker, [("a", t, 1, 7, 0.9) for t in (0, 2)] + [("a", 4, 1, 8, 0.9)])
    r = M.finals(M.evaluate(times, ["CLEAR"]), "CLEAR").first()
    assert (r["CLR_TP"], r["CLR_FN"], r["CLR_FP"], r["IDSW"], r["Frag"], r["MT"], r["PT"]) == (3, 1, 1, 1, 0, 0, 1)


def test_continuation_counts_over_an_empty_frame(spark):
    # At the last frame the ids go on as before though others are nearer.
    gt = [("a", t, g) for t in (0, 1, 2) for g in (1, 2)]
    tracker = [("a", t, k) for t in (0, 2) for k in (5, 6)]
    near = [("a", 0, 1, 5, 0.9), ("a", 0, 2, 6, 0.9), ("a", 2, 1, 5, 0.6), ("a", 2, 2, 6, 0.6), ("a", 2, 1, 6, 0.95), ("a", 2, 2, 5, 0.95)]
    r = M.finals(M.evaluate(frames(spark, gt, tracker, near), ["CLEAR"]), "CLEAR").first()
    assert (r["CLR_TP"], r["IDSW"], r["CLR_FN"]) == (4, 0, 2)


def test_lengths_count_times_without_rows(spark):
    times = frames(spark, [("a", 0, 1), ("b", 0, 1)], [("a", 0, 2), ("a", 0, 3), ("b", 0, 2)], [("a", 0, 1, 2, 0.8)])
    lengths = spark.createDataFrame([("a", 10)], "seq string, n_times int")
    parts = M.evaluate(times, ["CLEAR", "Count"], lengths)
    clear = {r["seq"]: r for r in M.finals(parts, "CLEAR").collect()}
    assert clear["a"]["CLR_Frames"] == 10 and clear["a"]["FP_per_frame"] == pytest.approx(0.1) and clear["b"]["CLR_Frames"] == 1
    assert {r["seq"]: r["Frames"] for r in M.finals(parts, "Count").collect()} == {"a": 10, "b": 1}


def test_one_side_of_a_sequence_missing(spark):
    times = frames(spark, [("a", 0, 1), ("a", 1, 2)], [], [])
    clear = M.finals(M.evaluate(times, ["CLEAR"]), "CLEAR").first()
    assert (clear["CLR_FN"], clear["ML"], clear["CLR_Frames"]) == (2, 2, 0)
    count = M.finals(M.evaluate(times, ["Count"]), "Count").first()
    assert (count["Dets"], count["GT_Dets"], count["IDs"], count["GT_IDs"], count["Frames"]) == (0, 2, 0, 2, 2)


def best_total(score):
    n, m = score.shape
    if n > m:
        return best_total(score.T)
    return max((sum(score[i, j] for i, j in enumerate(p)) for p in permutations(range(m), n)), default=0.0)


def cases(seed, n):
    r = np.random.default_rng(seed)
    for _ in range(n):
        shape = r.integers(0, 6, 2)
        kind = r.integers(0, 3)
        yield r.random(shape) if kind == 0 else r.integers(0, 3, shape).astype(float) if kind == 1 else np.where(r.random(shape) < 0.3, r.random(shape), np.inf)


def test_assignment_with_a_limit_is_optimal():
    for cost in cases(1, 400):
        limit = 0.7
        rows, columns = assignment.assign_pairs(cost, limit)
        assert len(set(rows.tolist())) == len(rows) == len(set(columns.tolist())) and list(rows) == sorted(rows)
        assert all(cost[i, j] <= limit for i, j in zip(rows, columns))
        gain = np.where(cost <= limit, limit - np.where(np.isfinite(cost), cost, 0), 0.0)
        assert sum(gain[i, j] for i, j in zip(rows, columns)) == pytest.approx(best_total(gain))
        pairs, left, rest = assignment.assign_within(cost, limit)
        assert pairs == list(zip(rows, columns)) and sorted([i for i, _ in pairs] + left) == list(range(cost.shape[0])) and sorted([j for _, j in pairs] + rest) == list(range(cost.shape[1]))


def random_rows(seed, n_times=6):
    r = np.random.default_rng(seed)
    gt = [("a", t, g) for t in range(n_times) for g in range(4) if r.random() < 0.7]
    tracker = [("a", t, k) for t in range(n_times) for k in range(10, 14) if r.random() < 0.7]
    pairs = [("a", t, g, k, float(r.random())) for _, t, g in gt for _, u, k in tracker if t == u and r.random() < 0.8]
    return gt, tracker, pairs


@pytest.mark.parametrize("seed", range(3))
def test_identity_and_vace_against_all_permutations(spark, seed):
    gt, tracker, near = random_rows(seed)
    parts = M.evaluate(frames(spark, gt, tracker, near), ["Identity", "VACE"])
    overlap, share = np.zeros((4, 4)), np.zeros((4, 4))
    for g in range(4):
        for k in range(4):
            overlap[g, k] = sum(s >= 0.5 for _, _, a, b, s in near if (a, b) == (g, 10 + k))
            either = {t for _, t, a in gt if a == g} | {t for _, t, b in tracker if b == 10 + k}
            share[g, k] = overlap[g, k] / max(1, len(either))
    one = M.finals(parts, "Identity").first()
    assert one["IDTP"] == best_total(overlap) and one["IDFN"] == len(gt) - one["IDTP"] and one["IDFP"] == len(tracker) - one["IDTP"]
    two = M.finals(parts, "VACE").first()
    fda = 0.0
    for t in range(6):
        own, other = [g for _, u, g in gt if u == t], [k for _, u, k in tracker if u == t]
        if own and other:
            s = np.array([[next((x for _, u, a, b, x in near if (u, a, b) == (t, g, k)), 0.0) for k in other] for g in own])
            fda += best_total(s) / (0.5 * (len(own) + len(other)))
    assert two["STDA"] == pytest.approx(best_total(share)) and two["FDA"] == pytest.approx(fda)


@pytest.mark.parametrize("seed", range(3))
def test_frame_matches_against_all_permutations(spark, seed):
    gt, tracker, near = random_rows(seed + 10)
    got = D.frame_matches(frames(spark, gt, tracker, near), 0.4).collect()
    for t in range(6):
        own, other = [g for _, u, g in gt if u == t], [k for _, u, k in tracker if u == t]
        s = np.array([[next((x for _, u, a, b, x in near if (u, a, b) == (t, g, k)), 0.0) for k in other] for g in own]).reshape(len(own), len(other))
        assert sum(r["similarity"] for r in got if r["t"] == t) == pytest.approx(best_total(np.where(s >= 0.4, s, 0)) if s.size else 0)


def test_travelled_share_counts_all_pairs_over_the_limit(spark):
    # Two tracker ids lie on the track all along; each covers its own part of the way.
    gt = spark.createDataFrame([("a", t, 1, float(t), 0.0) for t in range(5)], "seq string, t int, gt_id int, x double, y double")
    matches = spark.createDataFrame([("a", t, 1, 7) for t in range(5)] + [("a", t, 1, 8) for t in (0, 4)] + [("a", 2, 1, 9)], "seq string, t int, gt_id int, tracker_id int")
    assert M.travelled(gt, matches).first()["IDEucl"] == pytest.approx(1.0)
    assert M.travelled(gt, matches.where("tracker_id <> 7 and t < 4")).first()["IDEucl"] == 0.0


def test_boxes_meet_as_pairs_do(spark):
    r = np.random.default_rng(3)
    corners = np.sort(r.random((120, 2, 2)) * 60, axis=1).reshape(120, 4)
    rows = [("a" if k % 3 else "b", k % 7, k, corners[k].tolist()) for k in range(120)]
    df = spark.createDataFrame(rows, "seq string, t int, id int, b array<double>").selectExpr("seq", "t", "id", "struct(b[0] as x1, b[1] as y1, b[2] as x2, b[3] as y2) as box")
    gt = df.where("id % 2 = 0 and t <> 5").selectExpr("seq", "t", "id as gt_id", "box as gt_box")
    tracker = df.where("id % 2 = 1 and t <> 3").selectExpr("seq", "t", "id as tracker_id", "box as tracker_box")
    near = pairs.similarities(gt, tracker, ["seq", "t"], "gt_id", "tracker_id", G.iou(F.col("gt_box"), F.col("tracker_box")))

    def plain(times):
        return sorted((x["seq"], x["t"], sorted(x["gt_ids"]), sorted(x["tracker_ids"]), sorted((p["gt_id"], p["tracker_id"], round(p["similarity"], 9)) for p in x["pairs"])) for x in times.collect())

    assert plain(M.box_timeline(gt, tracker)) == plain(M.timeline(gt, tracker, near))
    assert plain(M.box_timeline(gt.limit(0), tracker.limit(0))) == []
