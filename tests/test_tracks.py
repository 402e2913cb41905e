"""Ordered tracks, online tracking in batch and stream, tracklet repair and global identities."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.functions.geometry import box
from trackloom.operators import identities, online, pairs, tracklets, windows
from trackloom.streaming import tracks as streams


def test_gaps_of_several_lengths(spark):
    df = spark.createDataFrame([(1, f, float(f), "a") for f in (3, 5, 8, 30)] + [(2, 4, 1.0, "b")], "id int, frame int, x double, kind string")
    got = sorted((r["id"], r["frame"], r["x"], r["filled"]) for r in windows.fill_gaps(df, ["id"], "frame", ["x"], ["kind"], max_gap=5).collect())
    assert [g[1] for g in got] == [3, 4, 5, 6, 7, 8, 30, 4] and all(g[2] == g[1] for g in got if g[0] == 1)
    assert len(windows.fill_gaps(df, ["id"], "frame", ["x"], max_gap=5, min_length=4).collect()) == 5


def test_nearest_nonzero(spark):
    for values, want in (([0, 0, 5, 0, 7, 0, 0], [5, 5, 5, 5, 7, 7, 7]), ([0, 0, 0], [0, 0, 0])):
        df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(values)], "id int, k int, yaw double")
        assert [r["yaw"] for r in windows.nearest_nonzero(df, ["id"], "k", "yaw").orderBy("k").collect()] == want


def moving(seed=0, cameras=2, objects=4, frames=40):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(cameras):
        start, speed = r.uniform(0, 800, (objects, 2)), r.uniform(-4, 4, (objects, 2))
        for f in range(1, frames + 1):
            for o in range(objects):
                if (f + o) % 11 == 0:
                    continue
                x, y = start[o] + speed[o] * f
                feature = np.eye(objects)[o] + r.normal(0, 0.02, objects)
                rows.append((f"c{c}", f, x, y, x + 40, y + 90, 0.9 if (f + o) % 7 else 0.3, 0, feature.tolist(), o))
    return pd.DataFrame(rows, columns=["camera", "frame", "x1", "y1", "x2", "y2", "score", "class_id", "feature", "truth"])


@pytest.mark.parametrize("config", sorted(online.PRESETS))
def test_online_tracks_keep_their_ids(spark, config):
    rows = moving()
    out = online.track(spark.createDataFrame(rows.drop(columns="truth")), config=config).toPandas()
    assert not out.duplicated(["camera", "frame", "track_id"]).any() and len(out) > 200
    joined = out.merge(rows, on=["camera", "frame"], suffixes=("", "_d"))
    joined = joined[np.hypot(joined.x1 - joined.x1_d, joined.y1 - joined.y1_d) < 10]
    share = joined.groupby(["camera", "track_id"])["truth"].agg(lambda s: s.value_counts().iloc[0] / len(s))
    assert share.mean() > 0.95


def test_best_overlap_tracker():
    rows = moving(cameras=1)
    tracker, seen = online.BestOverlap(), {}
    for frame, found in online.frames_in_order(rows.drop(columns="feature")):
        for track_id, j in tracker.update(frame, found):
            seen.setdefault(track_id, []).append(j)
    assert 4 <= len(seen) <= 8


def test_kalman_follows_constant_velocity():
    mean, cov = online.Kalman.begin(np.array([[10.0, 20.0, 30.0, 60.0]]))
    for t in range(1, 30):
        mean, cov = online.Kalman.predict(mean, cov)
        mean, cov = online.Kalman.update(mean, cov, np.array([[10 + 2.0 * t, 20 - 1.0 * t, 30, 60]]))
    assert np.allclose(mean[0, 4:6], [2, -1], atol=0.1)
    assert online.Kalman.gate(mean, cov, mean[:, :4])[0, 0] == pytest.approx(0)


def test_stream_equals_batch(spark, tmp_path):
    rows = moving().drop(columns=["truth", "feature"])
    schema = "camera string, frame long, x1 double, y1 double, x2 double, y2 double, score double, class_id long"
    batch = online.track(spark.createDataFrame(rows), config="two-band").toPandas()
    for k, (a, b) in enumerate(((0, 15), (15, 28), (28, 41))):
        part = rows[(rows.frame > a) & (rows.frame <= b)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
        query = streams.online_tracks(source, config="two-band").writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    stream = spark.read.parquet(f"file://{tmp_path}/out").toPandas()
    key = ["camera", "frame", "track_id"]
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (batch, stream))
    assert len(a) == len(b) and (a[key] == b[key]).all().all() and np.allclose(a.x1, b.x1)


def test_windows_and_sessions_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "a"), ("2024-01-01 00:00:05", "a"), ("2024-01-01 00:01:10", "b"), ("2024-01-01 01:00:00", "z")]
    spark.createDataFrame(rows, "ts string, kind string").selectExpr("cast(ts as timestamp) as ts", "kind").coalesce(1).write.parquet(f"file://{tmp_path}/in")

    def run(make, name):
        source = spark.readStream.schema("ts timestamp, kind string").parquet(f"file://{tmp_path}/in")
        q = make(source).writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        return sorted((str(r["start"]), r["kind"], r["n_rows"]) for r in spark.table(name).collect())

    assert run(lambda s: streams.section_counts(s, "ts", ["kind"], "1 minute"), "sections") == [("2024-01-01 00:00:00", "a", 2), ("2024-01-01 00:01:00", "b", 1)]
    assert run(lambda s: streams.track_sessions(s, "ts", ["kind"], "30 seconds"), "gaps") == [("2024-01-01 00:00:01", "a", 2), ("2024-01-01 00:01:10", "b", 1)]


def test_detections_cluster_into_tracks(spark):
    rows = moving(cameras=1)
    rows["serial"] = [f"{k:05d}" for k in range(len(rows))]
    df = spark.createDataFrame(rows[["camera", "frame", "serial", "feature", "truth"]])
    out = tracklets.cluster_detections(df, ["camera"], "frame", "serial", "feature", cut=0.2, section=15)
    linked = tracklets.link_sections(out.join(df.select("serial", "feature"), "serial"), ["camera"], "frame", "feature").toPandas()
    assert linked.groupby("track_id")["truth"].nunique().max() == 1 and linked["track_id"].nunique() == 4


def test_no_cluster_twice_in_a_frame():
    distance = np.zeros((4, 4))
    label = tracklets.split_by_frame(np.zeros(4, int), np.array([1, 1, 2, 2]), distance)
    assert label[0] != label[1] and label[2] != label[3] and len(set(label)) == 2


def test_doubled_tracklets_merge(spark):
    rows = [("c", f, i, float(f), 0.0, float(f) + 10, 10.0) for i, own in ((1, range(20)), (2, range(5, 25)), (3, range(20))) for f in own if i != 3] + [("c", f, 3, 500.0, 0.0, 510.0, 10.0) for f in range(20)]
    df = spark.createDataFrame(rows, "camera string, frame int, id int, x1 double, y1 double, x2 double, y2 double").withColumn("box", box("x1", "y1", "x2", "y2"))
    found = tracklets.overlapping_tracklets(df, ["camera"], "frame", "id")
    assert [(r["id_1"], r["id_2"]) for r in found.collect()] == [(1, 2)]
    merged = tracklets.merge_tracklets(df, found, ["camera"], "frame", "id").toPandas()
    assert sorted(set(merged["merged_id"])) == [1, 3] and not merged.duplicated(["frame", "merged_id"]).any() and len(merged) == 45


def test_warps_split_tracks(spark):
    df = spark.createDataFrame([(1, f, float(f + (500 if f > 10 else 0)), 0.0) for f in range(20)], "id int, frame int, x double, y double")
    got = tracklets.split_warps(df, ["id"], "frame", "x", "y", 50.0).toPandas()
    assert set(got[got.frame <= 10].piece) == {0} and set(got[got.frame > 10].piece) == {1}


@pytest.fixture()
def scene(spark):
    """Three people seen by three cameras, two of them together, one later."""
    r = np.random.default_rng(3)
    points, looks = [], []
    for person, frames in ((0, range(0, 30)), (1, range(0, 30)), (2, range(25, 50))):
        path = np.cumsum(r.normal(0, 0.2, (60, 2)), 0) + person * 20
        for c in range(3):
            for f in frames:
                points.append(("s", f"c{c}", person + 1, f, *(path[f] + r.normal(0, 0.05, 2)).tolist()))
            looks.append(("s", f"c{c}", person + 1, (np.eye(3)[person] + r.normal(0, 0.05, 3)).tolist()))
    return spark.createDataFrame(points, "scene string, camera string, local_id int, frame int, x double, y double"), spark.createDataFrame(looks, "scene string, camera string, local_id int, vector array<double>")


def _pairs(points, looks):
    return identities.appearance_pairs(identities.trajectory_pairs(points, ["scene"], "frame", ["x", "y"]), looks, ["scene"])


def test_global_identities(scene):
    points, looks = scene
    found = _pairs(points, looks).cache()
    nodes = points.groupBy("scene", "camera", "local_id").agg(F.min("frame").alias("first_frame")).cache()
    first = identities.first_identities(nodes.where("first_frame = 0"), found, ["scene"])
    merged = identities.merge_identities(first, found, ["scene"])
    ids = identities.match_all(nodes, merged, found, ["scene"]).toPandas()
    assert len(ids) == 9 and ids.groupby("global_id")["local_id"].nunique().max() == 1 and ids["global_id"].nunique() == 3
    assert not ids.duplicated(["camera", "global_id"]).any()


def test_reassignment_by_looks(spark, scene):
    _, looks = scene
    named = looks.where("camera <> 'c2'").withColumn("global_id", F.col("local_id").cast("long"))
    got = identities.reassign(looks.where("camera = 'c2'"), named, ["scene"], "vector", 0.8).collect()
    assert all(r["local_id"] == r["global_id"] for r in got) and len(got) == 3


def test_representatives_and_association(spark, scene):
    _, looks = scene
    many = looks.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("key", F.col("k"))
    reps = tracklets.representatives(many, ["scene", "camera", "local_id"], "key", "vector", most=3)
    assert reps.count() == 27
    nodes = looks.select("scene", F.concat("camera", F.col("local_id").cast("string")).alias("node"), F.array(F.col("camera")).alias("frames"), "vector")
    out = tracklets.associate_tracks(nodes, ["scene"], "node", "frames", "vector").toPandas()
    assert out["cluster"].nunique() == 3 and out.groupby("cluster")["node"].agg(lambda s: len({x[-1] for x in s})).max() == 1


def test_overlapping_ranges_come_once(spark):
    r = np.random.default_rng(0)
    spans = [(k, int(a), int(a + n), k % 3) for k, (a, n) in enumerate(zip(r.integers(0, 500, 80), r.integers(0, 90, 80)))]
    df = spark.createDataFrame(spans, "id int, f int, l int, cam int")
    want = sorted((a[0], b[0], min(a[2], b[2]) - max(a[1], b[1]) + 1) for a in spans for b in spans if a[0] < b[0] and a[3] != b[3] and min(a[2], b[2]) - max(a[1], b[1]) + 1 >= 5)
    got = pairs.overlapping_ranges(df, "id", "f", "l", 5, 17, ["cam"]).collect()
    assert sorted(tuple(r) for r in got) == want
