"""Operators without SQL: merging over sensors, mask regions, online scores, galleries, predictions, BURST and PNG files."""

import json
import struct
import zlib

import numpy as np
import pytest

from trackloom.functions import geometry as G
from trackloom.operators import detection as D
from trackloom.operators import filters as X
from trackloom.operators import masks, metrics, online, tracklets
from trackloom.sources import readers


def test_identities_that_lie_together_become_one(spark):
    rows = [(1, t, float(t), 0.0, {"a": [1.0]}) for t in range(10)]
    rows += [(2, t, t - 3.5, 0.0, {"b": [2.0], "a": [9.0]}) for t in range(4, 9)]
    rows += [(3, t, t + 0.2, 5.0, {"c": [3.0]}) for t in range(0, 12, 2)]
    rows += [(4, t, t + 50.0, 0.0, None) for t in range(10)] + [(5, 0, 0.0, 0.0, {"z": [0.0]})]
    df = spark.createDataFrame(rows, "gid long, frame int, x double, y double, boxes map<string,array<double>>")
    got = tracklets.merge_across_sensors(df, "gid", "frame", ["x", "y"], "boxes", least_rows=2)
    found = {(r["merged_id"], r["frame"]): r for r in got.collect()}
    # The first rows of 1 and 2 are near each other, and so on; those of 1 and 3 are not on the average.
    assert {k for k, _ in found} == {1, 3, 4} and {r["new_id"] for r in found.values()} == {1, 2, 3}
    assert found[1, 3]["boxes"] == {"a": [1.0]} and found[1, 4]["gid"] == 1
    assert found[1, 5]["boxes"] == {"a": [9.0], "b": [2.0]} and found[1, 5]["x"] == 5.0
    assert found[4, 0]["boxes"] == {}


def test_chains_of_identities_merge_and_fill(spark):
    rows = [(7, t, 0.0, 0.0, {"a": [1.0]}) for t in range(6)] + [(8, t, 0.1, 0.0, {"b": [1.0]}) for t in range(3, 9)] + [(9, t, 0.2, 0.0, {"c": [1.0]}) for t in range(6, 14)]
    got = tracklets.merge_across_sensors(spark.createDataFrame(rows, "gid long, frame int, x double, y double, boxes map<string,array<double>>"), "gid", "frame", ["x", "y"], "boxes", ratio=0.3)
    found = {r["frame"]: r for r in got.collect()}
    assert sorted(found) == list(range(14)) and {r["merged_id"] for r in found.values()} == {9}
    assert [found[t]["gid"] for t in range(14)] == [7] * 6 + [9] * 8 and sorted(found[4]["boxes"]) == ["a", "b"]


def square(h, w, y, x, n):
    m = np.zeros((h, w), bool)
    m[y : y + n, x : x + n] = True
    return masks.from_mask(m)


@pytest.fixture()
def sides(spark):
    tracker = [("s", 0, 1, *square(40, 40, 0, 0, 10)), ("s", 0, 2, *square(40, 40, 20, 20, 10)), ("s", 0, 3, *square(40, 40, 30, 0, 4)), ("s", 1, 1, *square(40, 40, 20, 20, 10))]
    gt = [("s", 0, 5, *square(40, 40, 0, 1, 10)), ("s", 1, 5, *square(40, 40, 0, 0, 10))]
    regions = [("s", 0, *square(40, 40, 18, 18, 7)), ("s", 0, *square(40, 40, 22, 18, 20))]
    kind = "height int, width int, counts string"
    return spark.createDataFrame(tracker, f"seq string, t int, tracker_id long, {kind}"), spark.createDataFrame(gt, f"seq string, t int, gt_id long, {kind}"), spark.createDataFrame(regions, f"seq string, t int, {kind}")


def test_masks_in_regions_to_ignore(spark, sides):
    tracker, gt, regions = sides
    near = masks.similarities(gt, tracker)
    assert {(r["t"], r["gt_id"], r["tracker_id"]): round(r["similarity"], 4) for r in near.collect()} == {(0, 5, 1): round(90 / 110, 4)}
    shares = {(r["t"], r["tracker_id"]): round(r["ioa"], 2) for r in masks.ignored_shares(tracker, regions).collect()}
    assert shares == {(0, 1): 0.0, (0, 2): 0.9, (0, 3): 0.0}
    times = metrics.timeline(gt.select("seq", "t", "gt_id"), tracker.select("seq", "t", "tracker_id"), near)
    matches = D.frame_matches(times, 0.5)
    kept = D.mask_tracks(tracker, matches, masks.ignored_shares(tracker, regions))
    assert sorted((r["t"], r["tracker_id"]) for r in kept.collect()) == [(0, 1), (0, 3), (1, 1)]
    assert masks.similarities(gt.limit(0), tracker).collect() == [] == masks.ignored_shares(tracker, regions.limit(0)).collect()


def test_benchmark_rules_for_unmatched_masks(spark, sides):
    tracker, gt, regions = sides
    rows = masks.with_bounds(tracker).selectExpr("*", "cast(tracker_id as int) as class_id")
    matches = D.frame_matches(metrics.timeline(gt.select("seq", "t", "gt_id"), tracker.select("seq", "t", "tracker_id"), masks.similarities(gt, tracker)), 0.5)
    shares = masks.ignored_shares(tracker, regions)
    sizes = spark.createDataFrame([("s", 40, 60)], "seq string, height int, width int")

    def kept(ignored, class_id, valid=(1, 2, 3)):
        out = D.benchmark_tracks(rows, matches, shares, sizes, spark.createDataFrame(ignored, "seq string, class_id int"), class_id, valid)
        assert out.columns == rows.columns
        return sorted((r["t"], r["tracker_id"]) for r in out.collect())

    # A side of 4 is at most 40 / 8, and mask 2 is covered.
    assert kept([], 1) == [(0, 1), (1, 1)]
    assert kept([("s", 1)], 1) == [(0, 1)] and kept([("x", 1)], 1) == [(0, 1), (1, 1)]
    assert kept([("s", 1)], None) == [(0, 1)] and kept([], None, (2, 3)) == [(0, 1)] and kept([], None) == [(0, 1), (1, 1)]


def test_online_scores(spark):
    scores = metrics.Online()
    box = np.array([[0, 0, 10, 10.0]])
    assert scores.update([1], box, ["k"], box + 1) == [(1, "k")]
    assert scores.update([1], box, [], np.zeros((0, 4))) == []
    # The second box lies on one to ignore and does not count.
    assert scores.update([1], box, ["m", "n"], np.concatenate([box, box + 50]), box + 50) == [(1, "m")]
    s = scores.scores()
    assert (s["CLR_TP"], s["CLR_FN"], s["CLR_FP"], s["IDSW"], s["Frag"], s["CLR_Frames"]) == (2, 1, 0, 1, 0, 3)
    assert s["MOTA"] == pytest.approx((2 - 1) / 3)


def detections(boxes, scores, features=None):
    return online.Detections(np.array(boxes, float).reshape(-1, 4), np.array(scores, float), np.zeros(len(scores), int), None if features is None else np.array(features, float))


def test_a_gallery_remembers_older_looks():
    box = [0, 0, 20, 40]
    looks = [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    for gallery, same in ((100, True), (1, False)):
        tracker = online.Tracker(online.Config(fuse=False, low_band=False, high=0.3, birth=0.3, match=0.2, unconfirmed=0.9, gallery=gallery, proximity=1.1))
        ids = []
        for frame, look in enumerate([looks[0], looks[1], looks[2], looks[0]], 1):
            tracker.tracks and tracker._look(tracker.tracks[0], detections([box], [0.9], [look]), 0) if frame in (2, 3) else ids.append([t.id for t in tracker.update(frame, detections([[0, 5 * (frame > 1) * 3, 20, 40 + 15 * (frame > 1)]], [0.9], [look]))])
        assert (ids[-1] == ids[0]) == same
        assert len(tracker.tracks[0].looks) <= gallery


def test_predicted_boxes_stand_in_for_detections():
    config = online.PRESETS["cascade-overlap"]
    tracker = online.Tracker(config)
    for frame in range(1, 6):
        found = tracker.update(frame, detections([[10 * frame, 0, 10 * frame + 40, 80]], [0.9]))
    before = found[0].id
    # Without a detection the track goes on by its own prediction.
    tracker.update(6, detections([], []))
    again = tracker.update(7, detections([[70, 0, 110, 80]], [0.9]))
    assert [t.id for t in again] == [before] and tracker.next_id == before + 1


def test_noise_levels(spark):
    def level(*sure):
        joints = [(1.0 if k in sure else 0.1,) for k in range(17)]
        return spark.createDataFrame([(joints,)], "k array<struct<score:double>>").select(X.noise_level(G.F.col("k"))).first()[0]

    assert [level(), level(3), level(3, 9), level(8, 9), level(8, 9, 10)] == [4, 3, 0, 2, 0]


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(image, depth=8, filters=None):
    """A grey PNG; row y is stored with filter `filters[y]`."""
    h, w = image.shape
    if depth == 8:
        lines = image.astype(np.uint8)
    else:
        bits = ((image[:, :, None] >> np.arange(depth)[::-1]) & 1).reshape(h, -1)
        lines = np.packbits(bits, axis=1)
    raw, above = b"", np.zeros(lines.shape[1], int)
    for y, line in enumerate(lines.astype(int)):
        kind = 0 if filters is None else filters[y]
        left = np.concatenate([[0], line[:-1]])
        corner = np.concatenate([[0], above[:-1]])
        base = left + above - corner
        options = np.stack([left, above, corner])
        paeth = options[np.abs(base - options).argmin(0), np.arange(len(line))]
        guess = [np.zeros_like(line), left, above, (left + above) // 2, paeth][kind]
        raw += bytes([kind]) + ((line - guess) & 0xFF).astype(np.uint8).tobytes()
        above = line
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, 3 if depth == 8 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("depth", [1, 2, 4, 8])
def test_png_rows_of_all_filters(depth):
    r = np.random.default_rng(depth)
    image = r.integers(0, 1 << depth, (11, 13))
    assert (readers.indexed_png(png(image, depth, [k % 5 for k in range(11)])) == image).all()
    with pytest.raises(ValueError):
        readers.indexed_png(b"GIF89a")


def test_davis_folders(spark, tmp_path):
    (tmp_path / "bear").mkdir()
    first = np.zeros((6, 8), int)
    first[1:3, 1:4], first[5, 5:] = 1, 254
    second = np.zeros((6, 8), int)
    second[2:4, 2:5] = 2
    for name, image in (("00000", first), ("00001", second), ("00002", np.zeros((6, 8), int))):
        (tmp_path / "bear" / f"{name}.png").write_bytes(png(image))
    got = sorted(((r["t"], r["id"], r["void"], masks.to_mask(r["height"], r["width"], r["counts"])) for r in readers.davis(spark, f"file://{tmp_path}").collect()), key=lambda x: (x[0], x[2]))
    assert [x[:3] for x in got] == [(0, 1, False), (0, None, True), (1, 2, False)]
    assert (got[0][3] == (first == 1)).all() and (got[1][3] == (first == 254)).all() and (got[2][3] == (second == 2)).all()


def test_burst_tables(spark, tmp_path):
    seq = {"id": 4, "seq_name": "walk", "dataset": "d", "width": 8, "height": 6, "neg_category_ids": [9], "not_exhaustive_category_ids": [], "track_category_ids": {"1": 30, "2": 40}, "annotated_image_paths": ["a.jpg", "b.jpg"], "segmentations": [{"1": {"rle": "x"}, "2": {"rle": "y"}}, {"1": {"rle": "z"}}]}
    (tmp_path / "b.json").write_text(json.dumps({"split": "val", "sequences": [seq]}))
    tables = readers.burst(spark, f"file://{tmp_path}/b.json", distractors=[40])
    assert [(r["id"], r["name"], r["neg_category_ids"]) for r in tables["videos"].collect()] == [(4, "d/walk", [9])]
    assert [(r["frame_index"], r["file_name"]) for r in tables["images"].orderBy("id").collect()] == [(0, "d/walk/a.jpg"), (1, "d/walk/b.jpg")]
    notes = tables["annotations"].orderBy("image_id").collect()
    assert [(r["category_id"], r["mask"]["counts"], r["mask"]["height"]) for r in notes] == [(30, "x", 6), (30, "z", 6)]
    assert [(r["category_id"], r["video_id"]) for r in tables["tracks"].collect()] == [(30, 4)]
    assert {r["id"] for r in tables["tracks"].collect()} == {r["track_id"] for r in notes}
    assert readers.burst(spark, f"file://{tmp_path}/b.json")["annotations"].count() == 3


def test_a_cluster_without_shared_folder_is_refused():
    from trackloom import session

    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        session.shared_folder(Session())


def test_anchors_fit_their_clusters(spark):
    from trackloom.operators import retrieval

    r = np.random.default_rng(5)
    sizes = [(10, 10), (40, 80), (200, 120)]
    rows = [(float(w * r.uniform(0.9, 1.1)), float(h * r.uniform(0.9, 1.1))) for w, h in sizes for _ in range(60)] + [(1.0, 1.0), (0.0, 9.0)]
    found = retrieval.anchors(spark.createDataFrame(rows, "w double, h double"), 3, rounds=60)
    assert all(abs(a - w) < 0.15 * w and abs(b - h) < 0.15 * h for (a, b), (w, h) in zip(found, sizes))
    assert retrieval.anchors(spark.createDataFrame([], "w double, h double"), 3) == []


def test_the_frontier_has_what_nothing_beats(spark):
    from trackloom.operators import windows

    rows = [(1, 1.0, 9.0), (1, 2.0, 9.0), (1, 3.0, 5.0), (1, 3.0, 4.0), (1, 5.0, 1.0), (1, 4.0, 0.0), (2, 0.0, 0.0)]
    got = windows.frontier(spark.createDataFrame(rows, "g int, x double, y double"), ["g"], "x", "y")
    assert sorted(map(tuple, got.collect())) == [(1, 2.0, 9.0), (1, 3.0, 5.0), (1, 5.0, 1.0), (2, 0.0, 0.0)]
