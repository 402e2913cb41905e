"""Ids with equal boxes: matched as kinds, with the totals that ids one by one have, and without their pairs."""

import numpy as np
import pytest

from trackloom.operators import assignment as K
from trackloom.operators import detection as D
from trackloom.operators import metrics as M


@pytest.mark.parametrize("seed", range(30))
def test_transport_has_the_total_of_the_assignment_of_all(seed):
    r = np.random.default_rng(seed)
    n, m = r.integers(1, 6, 2)
    rows, columns = r.integers(0, 4, n), r.integers(0, 4, m)
    cost = r.integers(-4, 1, (n, m)).astype(float) if seed % 2 else -r.random((n, m))
    flow = K.transport(cost, rows, columns)
    whole = np.repeat(np.repeat(cost, rows, 0), columns, 1)
    assert (flow >= 0).all() and (flow.sum(1) <= rows).all() and (flow.sum(0) <= columns).all()
    assert (flow * cost).sum() == pytest.approx(whole[K.assign(whole)].sum())
    i, j = np.nonzero(cost)
    taken = K.assign_kinds(i, j, -cost[i, j], rows, columns)
    assert (taken * cost[i, j]).sum() == pytest.approx((flow * cost).sum())


def random_frames(seed, times=5, ids=14, kinds=5):
    """Frames with kinds, each kind with a similarity to some others."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(times):
        gt, tracker = (np.flatnonzero(r.random(ids) < 0.8) for _ in range(2))
        kind = tuple(np.unique(r.integers(0, kinds, len(x)), return_inverse=True)[1] for x in (gt, tracker))
        s = np.where(r.random((kind[0].max() + 1, kind[1].max() + 1)) < 0.7, r.random((kind[0].max() + 1, kind[1].max() + 1)), 0)
        i, j = np.nonzero(s)
        out.append(M.Frame(gt, tracker, i, j, s[i, j], kind))
    return out, ids, ids


@pytest.mark.parametrize("seed", range(10))
def test_metrics_of_kinds_are_those_of_ids(seed):
    frames, n, m = random_frames(seed)
    each = [f.spread() for f in frames]
    for metric in ("HOTA", "Identity", "VACE"):
        got, want = ({(p.field, p.alpha): p.value for p in M.KERNELS[metric](x, n, m)} for x in (frames, each))
        assert got == pytest.approx(want)


@pytest.mark.parametrize("seed", range(10))
def test_clear_matches_of_kinds_are_as_good_as_those_of_ids(seed):
    # From one state, a frame's matches have the same total and the same pairs that go on, whoever of equal ones is taken.
    frames, *_ = random_frames(seed)
    one, two = M.Clear(0.3), M.Clear(0.3)
    for f in frames:
        two.before = dict(one.before)
        overlap = one.overlap, two.overlap
        before, each = dict(one.before), f.spread()
        a = one.update_pairs(f.gt.tolist(), f.tracker.tolist(), f.rows, f.columns, f.similarity, f.kinds)
        b = two.update_pairs(f.gt.tolist(), f.tracker.tolist(), each.rows, each.columns, each.similarity)
        assert len({g for g, _ in a}) == len({k for _, k in a}) == len(a)
        assert {p for p in a if before.get(p[0]) == p[1]} == {p for p in b if before.get(p[0]) == p[1]}
        assert one.overlap - overlap[0] == pytest.approx(two.overlap - overlap[1])


def test_equal_boxes_meet_once(spark):
    # 6,000 by 6,000 boxes at three places: nine pairs a time, not 36 million.
    rows = spark.range(6000).selectExpr("'a' as seq", "explode(sequence(0, 1)) as t", "id", "struct((id % 3) * 100.0D as x1, 0.0D as y1, (id % 3) * 100.0D + 120 as x2, 50.0D as y2) as box")
    gt, tracker = rows.selectExpr("seq", "t", "id as gt_id", "box as gt_box"), rows.selectExpr("seq", "t", "id + 9000 as tracker_id", "box as tracker_box")
    times = M.box_timeline(gt, tracker, alike=True)
    assert {len(r["pairs"]) for r in times.collect()} == {7}
    clear = M.finals(M.evaluate(times, ["CLEAR"]), "CLEAR").first()
    assert (clear["CLR_TP"], clear["CLR_FP"], clear["IDSW"], clear["MOTP"]) == (12000, 0, 0, 1)
    found = D.frame_matches(times, 0.5)
    assert found.where("similarity = 1 and gt_id % 3 = tracker_id % 3").count() == found.count() == 12000
    assert found.select("t", "gt_id").distinct().count() == found.select("t", "tracker_id").distinct().count() == 12000
