"""Assignment, suppression, clustering and masks, against brute force on small cases."""

from itertools import permutations

import numpy as np
import pytest

from trackloom.operators import assignment as K
from trackloom.operators import masks


@pytest.mark.parametrize("shape", [(1, 1), (3, 3), (2, 5), (5, 2), (6, 6), (7, 4), (0, 3), (3, 0)])
def test_assignment_is_optimal(shape):
    r = np.random.default_rng(sum(shape))
    for trial in range(40):
        cost = r.integers(0, 6, shape).astype(float) if trial % 2 else r.normal(size=shape)
        rows, columns = K.assign(cost)
        n, m = shape
        assert len(rows) == min(n, m) and len(set(rows)) == len(rows) and len(set(columns)) == len(columns)
        wide = cost if n <= m else cost.T
        best = min((sum(wide[i, p[i]] for i in range(wide.shape[0])) for p in permutations(range(wide.shape[1]), wide.shape[0])), default=0)
        assert np.isclose(cost[rows, columns].sum(), best)


def test_assignment_within_a_limit():
    cost = np.array([[0.1, 0.8], [0.2, np.inf]])
    assert K.assign_within(cost, 0.5) == ([(0, 0)], [1], [1])
    assert K.assign_within(cost, 1.0) == ([(0, 1), (1, 0)], [], [])
    assert K.assign_within(np.full((2, 2), np.inf), 1.0) == ([], [0, 1], [0, 1])
    assert K.assign_within(np.zeros((0, 2)), 1.0) == ([], [], [0, 1])


def test_greedy_pairs():
    assert K.greedy_pairs(np.array([[0.9, 0.8], [0.85, 0.1]])) == [(0, 0), (1, 1)]
    assert K.greedy_pairs(np.array([[-1.0]])) == []


def test_iou_matrix():
    a = [[0, 0, 2, 2]]
    b = [[0, 0, 2, 2], [1, 1, 3, 3], [2, 2, 4, 4], [5, 5, 6, 6], [0, 0, 1, 1], [3, 3, 3, 3]]
    assert np.allclose(K.iou_matrix(a, b)[0], [1, 1 / 7, 0, 0, 0.25, 0])


def test_suppression():
    boxes = [[0, 0, 10, 10], [1, 0, 11, 10], [2, 0, 12, 10], [50, 0, 60, 10]]
    scores = [0.9, 0.8, 0.7, 0.6]
    assert K.suppress(boxes, scores, 0.75).tolist() == [0, 2, 3]
    assert K.suppress(boxes, scores, 0.5).tolist() == [0, 3]
    assert K.suppress(boxes, scores, 0.5, classes=[0, 1, 0, 0]).tolist() == [0, 1, 3]
    assert K.suppress(boxes, scores, 0.5, most=1).tolist() == [0]
    assert K.suppress(np.zeros((0, 4)), [], 0.5).tolist() == []


def test_linkage_and_density():
    x = np.array([0.0, 0.2, 0.4, 2.0, 2.1, 9.0])
    d = np.abs(x[:, None] - x[None])
    assert K.single_linkage(d, 0.25).tolist() == [0, 0, 0, 1, 1, 2]
    assert K.dbscan(d, 0.25, 2).tolist() == [0, 0, 0, 1, 1, -1]
    assert K.noise_as_singletons(K.dbscan(d, 0.25, 2)).tolist() == [0, 0, 0, 1, 1, 2]


def test_association_respects_frames():
    s = np.array([[1, 0.9, 0.8], [0.9, 1, 0.7], [0.8, 0.7, 1]])
    assert K.associate(s, [{1}, {2}, {3}]).tolist() == [0, 0, 0]
    assert K.associate(s, [{1}, {1}, {3}]).tolist() == [0, 1, 0]
    assert K.associate(s, [{1}, {1}, {3}], guard=False).tolist() == [0, 0, 0]
    s[0, 2] = s[2, 0] = -10
    assert K.associate(s, [{1}, {2}, {3}]).tolist() == [0, 0, 1]


def test_masks_round_trip():
    r = np.random.default_rng(1)
    for shape in ((1, 1), (5, 9), (40, 30)):
        for share in (0.0, 0.2, 0.9, 1.0):
            mask = r.random(shape) < share
            h, w, counts = masks.from_mask(mask)
            assert (masks.to_mask(h, w, counts) == mask).all()


def test_mask_scores():
    a = np.zeros((40, 40), bool)
    a[5:15, 5:15] = True
    b = np.roll(a, 5, 1)
    assert masks.region(a, b) == pytest.approx(1 / 3) and masks.region(a & ~a, b & ~b) == 1
    assert masks.iou([a], [a, b], [False, True])[0].tolist() == [1.0, 0.5]
    assert masks.boundary(a, a) == 1 and masks.boundary(a, b) < 1 and masks.boundary(a & ~a, b) == 0
    assert masks.bounding_box(a) == (5, 5, 10, 10) and masks.bounding_box(a & ~a) == (0, 0, 0, 0)
    assert [m.sum() for m in masks.painted([a, b], [0.1, 0.9])] == [50, 100]
    assert masks.suppressed([a, b, a], [0.5, 0.9, 0.4], 0.3) == [1] and masks.suppressed([a, b, a], [0.5, 0.9, 0.4], 0.5) == [1, 0]
    assert masks.decay(np.array([1.0, 1, 1, 1, 0, 0, 0, 0])) == 1
