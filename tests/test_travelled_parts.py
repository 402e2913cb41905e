"""Travelled distance of many tracks, each met by one tracker's: no table of all of them by all."""

import numpy as np
import pytest

from trackloom.operators import metrics as M


def test_many_tracks_are_assigned_by_parts(spark, monkeypatch):
    n = 300
    gt = spark.createDataFrame([(1, t, k, float(t * (k + 1)), 0.0) for k in range(n) for t in range(3)], "seq int, t int, gt_id int, x double, y double")
    near = gt.where("gt_id % 2 = 0 and t < 2 or gt_id = 7").selectExpr("seq", "t", "gt_id", "gt_id + 1000 as tracker_id")
    own, steps = np.arange(1, n + 1), np.where(np.arange(n) == 7, 2, np.where(np.arange(n) % 2 == 0, 1, 0))
    assert M.travelled(gt, near).first()["IDEucl"] == pytest.approx((own * steps).sum() / (2 * own).sum())


def test_near_pairs_are_those_of_a_timeline(spark):
    boxes = [(k, 10.0 * k, 0.0, 10.0 * k + 9, 9.0) for k in range(50)]
    schema = "id int, x1 double, y1 double, x2 double, y2 double"
    rows = spark.createDataFrame(boxes, schema)
    gt = rows.selectExpr("1 as seq", "1 as t", "id as gt_id", "struct(x1, y1, x2, y2) as gt_box")
    own = rows.selectExpr("1 as seq", "1 as t", "id + 100 as tracker_id", "struct(x1 + id % 9 as x1, y1, x2 + id % 9 as x2, y2) as tracker_box")
    got = {(r["gt_id"], r["tracker_id"]) for r in M.near_pairs(M.box_timeline(gt, own), 0.4).collect()}
    assert got == {(k, k + 100) for k in range(50) if (9 - k % 9) / (9 + k % 9) >= 0.4} | {(k + 1, k + 100) for k in range(49) if (k % 9 - 1) / (19 - k % 9) >= 0.4}


def test_boxes_travel_as_their_near_pairs_do(spark):
    r = np.random.default_rng(4)
    rows = [(k % 2, t, k, *(float(v) for v in r.integers(0, 20, 2))) for k in range(40) for t in range(8) if r.random() < 0.7]
    df = spark.createDataFrame(rows, "seq int, t int, id int, x double, y double").selectExpr("*", "struct(x as x1, y as y1, x + 20 as x2, y + 15 as y2) as box")
    gt, own = df.where("id % 4 < 2").withColumnRenamed("id", "gt_id"), df.where("id % 4 > 1").selectExpr("seq", "t", "id as tracker_id", "box")
    near = M.near_pairs(M.box_timeline(gt.withColumnRenamed("box", "gt_box"), own.withColumnRenamed("box", "tracker_box")), 0.4)
    want = {x["seq"]: x["IDEucl"] for x in M.travelled(gt.drop("box"), near).collect()}
    got = {x["seq"]: x["IDEucl"] for x in M.travelled_boxes(gt, own, 0.4, 3, 4).collect()}
    assert got == pytest.approx(want) and 0 < min(want.values()) and len(want) == 2
