"""Metrics of sequences with many ids: memory goes with what is there, never with ids by ids."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from trackloom.operators import assignment as K
from trackloom.operators import metrics as M

MANY = 20_000


@pytest.fixture(scope="module")
def rows():
    """Two frames in which every ground-truth id has a tracker id of its own beside it, of similarity 0.8."""
    ids = np.arange(MANY)
    pairs = pa.StructArray.from_arrays([pa.array(np.tile(ids, 2)), pa.array(np.tile(ids + MANY, 2)), pa.array(np.full(2 * MANY, 0.8))], names=["gt_id", "tracker_id", "similarity"])
    return pa.table({"t": [0, 1], "gt_ids": [ids.tolist()] * 2, "tracker_ids": [(ids + MANY).tolist()] * 2, "pairs": pa.ListArray.from_arrays([0, MANY, 2 * MANY], pairs)})


def parts(rows, metric):
    """The parts of a metric, made with at most 200 MB."""
    tracemalloc.start()
    try:
        got = {(p.field, p.alpha): p.value for p in M.KERNELS[metric](*M.frames_of(rows))}
        assert tracemalloc.get_traced_memory()[1] < 200e6
    finally:
        tracemalloc.stop()
    return got


def test_hota(rows):
    got = parts(rows, "HOTA")
    assert got["TP", 0.5] == 2 * MANY and got["Ass_sum", 0.5] == pytest.approx(2 * MANY) and got["TP", 0.85] == 0


def random_sides(seed, n, m, spread, d):
    r = np.random.default_rng(seed)
    for k in (n, m):
        low = r.integers(0, spread, (k, d)).astype(float)
        yield low, low + r.integers(0, 12, (k, d))


@pytest.mark.parametrize("seed", range(6))
def test_pairs_of_boxes_against_the_whole_matrix(seed):
    one, two = random_sides(seed, 40, 60, (20, 200)[seed % 2], 2)
    two[0][7] = np.nan
    want = K.iou_matrix(np.hstack(one), np.nan_to_num(np.hstack(two)) * ~np.isnan(np.hstack(two)).any(1)[:, None])
    i, j, value = K.box_pairs(one, two, cells=50)
    assert list(zip(i, j)) == list(zip(*np.nonzero(want))) and value.tolist() == want[i, j].tolist()


@pytest.mark.parametrize("seed", range(20))
def test_sparse_assignment_has_the_total_of_the_dense_one(seed):
    r = np.random.default_rng(seed)
    score = np.where(r.random((9, 12)) < 0.2, r.integers(1, 6, (9, 12)), 0).astype(float)
    i, j = np.nonzero(score)
    at = K.assign_sparse(i, j, score[i, j])
    assert len(set(i[at])) == len(set(j[at])) == len(at)
    assert score[i[at], j[at]].sum() == score[K.assign(-score)].sum()


def test_clear(rows):
    got = parts(rows, "CLEAR")
    assert (got["CLR_TP", None], got["IDSW", None], got["MT", None]) == (2 * MANY, 0, MANY)


def test_vace(rows):
    got = parts(rows, "VACE")
    assert got["STDA", None] == pytest.approx(MANY) and got["FDA", None] == pytest.approx(2 * 0.8)


def test_identity(rows):
    assert parts(rows, "Identity")["IDTP", None] == 2 * MANY


def test_world_boxes_meet_without_a_join_of_their_pairs(spark, monkeypatch):
    monkeypatch.setattr("trackloom.functions.geometry.iou_3d", None)
    rows = spark.range(6000).selectExpr("'a' as seq", "1 as frame", "id", "struct(id * 10.0D as x, 0.0D as y, 0.0D as z, 4.0D as l, 4.0D as w, 2.0D as h) as box")
    moved = rows.selectExpr("seq", "frame", "id", "struct(box.x + 1 as x, box.y, box.z, box.l, box.w, box.h) as box")
    got = {r["field"]: r["value"] for r in M.world_evaluate(rows, moved, ["CLEAR"]).collect()}
    assert (got["CLR_TP"], got["CLR_FP"], got["MOTP_sum"]) == (6000, 0, pytest.approx(6000 * 0.6))
