"""Tracking metrics on the three hand-made sequences, and properties that must always hold."""

import numpy as np
import pytest

from trackloom.operators import detection as D
from trackloom.operators import metrics as M

# Ground truth and tracker presence by time, and pairs of similarity 1.
BASE = ({0: "11111", 1: "11100"}, {0: "11110", 1: "11111"})
NO_CONFUSION = [(3, 0, 1), (4, 0, 1), (0, 1, 0), (1, 1, 0)]
SEQUENCES = {
    "no_confusion": (*BASE, NO_CONFUSION),
    "with_confusion": (*BASE, NO_CONFUSION + [(2, 0, 0), (1, 1, 1)]),
    "split_tracks": ({0: "11011", 1: "11111"}, {0: "11000", 1: "00111", 2: "00001", 3: "00111", 4: "11000"}, [(0, 0, 0), (1, 0, 0), (3, 0, 3), (4, 0, 3), (2, 1, 1), (3, 1, 1), (4, 1, 2), (0, 1, 4), (1, 1, 4)]),
}


@pytest.fixture(scope="module")
def times(spark):
    gt, tracker, pairs = [], [], []
    for seq, (a, b, s) in SEQUENCES.items():
        gt += [(seq, t, g) for g, on in a.items() for t, x in enumerate(on) if x == "1"]
        tracker += [(seq, t, k) for k, on in b.items() for t, x in enumerate(on) if x == "1"]
        pairs += [(seq, t, g, k, 1.0) for t, g, k in s]
    return M.timeline(spark.createDataFrame(gt, "seq string, t int, gt_id int"), spark.createDataFrame(tracker, "seq string, t int, tracker_id int"), spark.createDataFrame(pairs, "seq string, t int, gt_id int, tracker_id int, similarity double")).cache()


def by_seq(df):
    return {r["seq"]: r.asDict() for r in df.collect()}


def test_clear(times):
    got = by_seq(M.finals(M.evaluate(times, ["CLEAR"]), "CLEAR"))
    want = {"no_confusion": (4, 4, 5, 0, -1 / 8), "with_confusion": (5, 3, 4, 1, 0), "split_tracks": (9, 0, 2, 3, 4 / 9)}
    for seq, (tp, fn, fp, switches, mota) in want.items():
        r = got[seq]
        assert (r["CLR_TP"], r["CLR_FN"], r["CLR_FP"], r["IDSW"]) == (tp, fn, fp, switches)
        assert r["MOTA"] == pytest.approx(mota)


def test_identity(times):
    got = by_seq(M.finals(M.evaluate(times, ["Identity"]), "Identity"))
    want = {"no_confusion": (4, 4, 5), "with_confusion": (4, 4, 5), "split_tracks": (4, 5, 7)}
    assert {k: (r["IDTP"], r["IDFN"], r["IDFP"]) for k, r in got.items()} == want


def test_vace(times):
    got = by_seq(M.finals(M.evaluate(times, ["VACE"]), "VACE"))
    want = {"no_confusion": (0.9, 0.45), "with_confusion": (0.9, 0.45), "split_tracks": (0.9, 0.9 / 3.5)}
    for seq, (stda, ata) in want.items():
        assert (got[seq]["STDA"], got[seq]["ATA"]) == (pytest.approx(stda), pytest.approx(ata))


def test_combination_adds_parts(times):
    parts = M.evaluate(times)
    whole = M.finals(M.combine(parts), "CLEAR", []).first()
    assert whole["CLR_TP"] == 18 and whole["MOTA"] == pytest.approx((18 - 11 - 4) / 25)


def _random(spark, seed, same):
    r = np.random.default_rng(seed)
    gt = [("s", t, g) for t in range(12) for g in range(5) if r.random() < 0.8]
    tracker = [(s, t, g + 10) for s, t, g in gt] if same else [("s", t, k + 10) for t in range(12) for k in range(6) if r.random() < 0.7]
    pairs = [("s", t, g, g + 10, 1.0) for _, t, g in gt] if same else [("s", t, g, k, float(r.random())) for _, t, g in gt for _, u, k in tracker if t == u and r.random() < 0.6]
    return gt, tracker, pairs


def _frames(spark, gt, tracker, pairs):
    return M.timeline(spark.createDataFrame(gt, "seq string, t int, gt_id int"), spark.createDataFrame(tracker, "seq string, t int, tracker_id int"), spark.createDataFrame(pairs, "seq string, t int, gt_id int, tracker_id int, similarity double"))


def test_perfect_tracker(spark):
    parts = M.evaluate(_frames(spark, *_random(spark, 1, True))).cache()
    s = M.summary(M.finals(parts, "HOTA")).first()
    assert s["HOTA"] == s["DetA"] == s["AssA"] == s["LocA"] == pytest.approx(1)
    assert M.finals(parts, "CLEAR").first()["MOTA"] == M.finals(parts, "Identity").first()["IDF1"] == 1


def test_renaming_ids_changes_nothing(spark):
    gt, tracker, pairs = _random(spark, 2, False)
    name = {k: 100 - k for k in range(40)}
    other = _frames(spark, gt, [(s, t, name[k]) for s, t, k in tracker], [(s, t, g, name[k], v) for s, t, g, k, v in pairs])
    a = {(r["metric"], r["field"], r["alpha"]): r["value"] for r in M.evaluate(_frames(spark, gt, tracker, pairs)).collect()}
    b = {(r["metric"], r["field"], r["alpha"]): r["value"] for r in M.evaluate(other).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_one_side_only(spark):
    frames = _frames(spark, [("s", 0, 1), ("s", 1, 1)], [], [])
    r = M.finals(M.evaluate(frames, ["CLEAR"]), "CLEAR").first()
    assert (r["CLR_TP"], r["CLR_FN"], r["CLR_FP"], r["MOTA"]) == (0, 2, 0, 0)
    s = M.summary(M.finals(M.evaluate(frames, ["HOTA"]), "HOTA")).first()
    assert s["HOTA"] == 0 and s["LocA"] == 1


def test_frame_matches_and_distractors(spark, times):
    found = D.frame_matches(times).where("seq = 'with_confusion'").collect()
    assert sorted((r["t"], r["gt_id"], r["tracker_id"]) for r in found)[:2] == [(0, 1, 0), (1, 1, 0)] or len(found) == 5
    tracker = spark.createDataFrame([("s", 0, 1), ("s", 0, 2)], "seq string, t int, tracker_id int")
    gt = spark.createDataFrame([("s", 0, 7, 12)], "seq string, t int, gt_id int, class int")
    matches = spark.createDataFrame([("s", 0, 7, 2)], "seq string, t int, gt_id int, tracker_id int")
    assert [r["tracker_id"] for r in D.without_distractors(tracker, matches, gt, gt["class"] == 12).collect()] == [1]
    covered = spark.createDataFrame([("s", 0, 1, 0.9), ("s", 0, 2, 0.9)], "seq string, t int, tracker_id int, ioa double")
    assert [r["tracker_id"] for r in D.without_ignored(tracker, covered, matches).collect()] == [2]


def test_track_average_precision(spark):
    ious = spark.createDataFrame([("v", 1, 10, 0.9), ("v", 2, 11, 0.6)], "video string, gt_track int, track int, iou double")
    tracks = spark.createDataFrame([("v", "a", 10, 0.9, False), ("v", "a", 11, 0.8, False), ("v", "a", 12, 0.1, False)], "video string, class string, track int, score double, ignored boolean")
    gts = spark.createDataFrame([("v", "a", 1, False), ("v", "a", 2, False)], "video string, class string, gt_track int, ignored boolean")
    got = {round(r["level"], 2): r["ap"] for r in D.track_ap(D.track_matches(ious, tracks, gts), gts).collect()}
    assert got[0.5] == pytest.approx(1) and got[0.75] == pytest.approx(51 / 101) and got[0.95] == 0


def test_travelled_distance(spark):
    gt = spark.createDataFrame([("s", t, 1, float(t), 0.0) for t in range(5)], "seq string, t int, gt_id int, x double, y double")
    matches = spark.createDataFrame([("s", t, 1, 5 if t < 3 else 6) for t in range(5)], "seq string, t int, gt_id int, tracker_id int")
    assert M.travelled(gt, matches).first()["IDEucl"] == pytest.approx(0.5)
