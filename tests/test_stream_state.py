"""Tracking as stream state: batch equals stream over restarts, late rows are counted, idle sensors end."""

from datetime import datetime, timedelta

import numpy as np

from trackloom.operators import online
from trackloom.streaming import state

SCHEMA = "camera string, frame long, x1 double, y1 double, x2 double, y2 double, score double, class_id int, feature array<double>, ts timestamp"


def detections(cameras=("a", "b"), frames=30):
    r = np.random.default_rng(4)
    rows = []
    for cam in cameras:
        for f in range(1, frames + 1):
            for o in range(4):
                if r.random() < 0.9:
                    x, y = (100.0 * o + 3 * f + r.normal(), 50.0 * o + r.normal())
                    rows.append((cam, f, float(x), float(y), float(x + 60), float(y + 80), float(r.uniform(0.3, 1)), 0, (np.eye(4)[o] + r.normal(0, 0.05, 4)).tolist(), datetime(2024, 1, 1) + timedelta(seconds=f)))
    return rows


def run(spark, tmp_path, batches, **options):
    """Each batch is a run of its own, which goes on from the checkpoint."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        source = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")
        query = state.tracked_stream(source, "ts", **options).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"file://{tmp_path}/out").toPandas()


def test_stream_equals_batch_over_restarts_and_counts_late_rows(spark, tmp_path):
    rows = detections()
    late = [x for x in rows if x[1] == 19 and x[0] == "a"]
    parts = [[x for x in rows if a < x[1] <= b] for a, b in ((0, 11), (11, 20), (20, 30))]
    out = run(spark, tmp_path, [parts[0], parts[1], parts[2] + late], late="1 hour", idle_ms=10**9)
    batch = online.track(spark.createDataFrame(rows, SCHEMA).drop("ts")).toPandas()
    boxes = out[out["kind"] == "box"]
    key = ["camera", "frame", "track_id"]
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (batch, boxes))
    assert len(a) == len(b) and (a[key].astype(str) == b[key].astype({"frame": int, "track_id": int}).astype(str)).all().all()
    assert np.allclose(a[["x1", "y1", "x2", "y2"]], b[["x1", "y1", "x2", "y2"]].astype(float))
    last = out[out["kind"] == "counts"].sort_values("n_rows").groupby("camera").last()
    assert last.loc["a", "n_late"] == len(late) and last.loc["b", "n_late"] == 0
    assert last["n_frames"].tolist() == [30, 30] and last["n_boxes"].sum() == len(boxes)
    assert last.loc["b", "n_rows"] == sum(x[0] == "b" for x in rows)


def test_idle_sensors_end_by_event_time(spark, tmp_path):
    rows = detections(frames=6)
    later = [(*x[:1], x[1] + 1000, *x[2:9], x[9] + timedelta(hours=1)) for x in rows if x[0] == "b"]
    again = [(*x[:1], 2000 + x[1], *x[2:9], x[9] + timedelta(hours=2)) for x in rows if x[0] == "a"]
    out = run(spark, tmp_path, [rows, later, again], late="1 second", idle_ms=60_000)
    closed = out[out["kind"] == "closed"]
    assert "a" in set(closed["camera"]) and closed[closed["camera"] == "a"]["n_rows"].iloc[0] == sum(x[0] == "a" for x in rows)
    # After its end a sensor's ids begin anew.
    assert out[(out["kind"] == "box") & (out["camera"] == "a") & (out["frame"] > 2000)]["track_id"].min() == 1


def test_tracks_keep_their_values_as_rows():
    tracker = online.Tracker(online.PRESETS["cascade"])
    for f in range(1, 4):
        tracker.update(f, online.Detections(np.array([[0.0, 0, 10, 20], [100, 0, 130, 50]]), np.array([0.9, 0.8]), np.array([0, 1]), np.eye(2)))
    for t in tracker.tracks:
        again = state.unpacked(t.id, state.packed(t))
        assert (again.mean == t.mean).all() and (again.cov == t.cov).all() and (again.feature == t.feature).all() and again.classes == t.classes
        assert len(again.looks) == len(t.looks) and (again.id, again.score, again.first, again.last, again.state, again.hits) == (t.id, t.score, t.first, t.last, t.state, t.hits)
