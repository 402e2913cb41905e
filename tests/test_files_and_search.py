"""Readers, writers, retrieval and detection scores on small inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.functions import names as N
from trackloom.functions import vectors as V
from trackloom.operators import aggregates as A
from trackloom.operators import filters as X
from trackloom.operators import pairs, retrieval
from trackloom.sources import readers, writers


def save(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content if isinstance(content, str) else json.dumps(content))
    return f"file://{path}"


def one(df, column):
    return df.select(column.alias("x")).first()["x"]


def test_boxes(spark):
    df = spark.range(1)
    lit = F.lit
    a, b = G.box(lit(0), lit(0), lit(2), lit(2)), G.box(lit(1), lit(1), lit(3), lit(3))
    flat, far = G.box(lit(1), lit(1), lit(1), lit(4)), G.box(lit(8), lit(8), lit(9), lit(9))
    assert one(df, G.iou(a, b)) == pytest.approx(1 / 7) and one(df, G.iou(a, a)) == 1 and one(df, G.iou(flat, flat)) == 0 and one(df, G.iou(a, far)) == 0
    assert one(df, G.giou(a, far)) < 0 and one(df, G.diou(a, a)) == one(df, G.ciou(a, a)) == 1
    assert one(df, G.ioa(a, b)) == 0.25 and one(df, G.overlap_coefficient(a, b)) == 0.25
    back = G.from_xywh(*(G.to_xywh(a)[c] for c in ("x", "y", "w", "h")))
    assert one(df, back).asDict() == {"x1": 0, "y1": 0, "x2": 2, "y2": 2}
    assert one(df, G.to_xyah(flat)["a"]) == 0 and one(df, G.clamped(b, 2, 2))["x2"] == 2
    k = [[100.0, 0, 50], [0, 100, 40], [0, 0, 1]]
    assert np.allclose(np.array(G.inverse_3x3(k)) @ np.array(k), np.eye(3))
    with pytest.raises(ValueError):
        G.inverse_3x3([[1, 1, 1]] * 3)
    eye = [[1.0, 0, 0, 5], [0, 1, 0, 6], [0, 0, 1, 7]]
    point = one(df, G.back_project(lit(150.0), lit(140.0), lit(2000.0), k, eye))
    assert point.asDict() == {"x": 7.0, "y": 8.0, "z": 9.0} and one(df, G.back_project(lit(1.0), lit(1.0), lit(0.0), k, eye)) is None
    ground = G.project(G.ground_homography(k, [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 10]]), lit(60.0), lit(50.0))
    assert np.allclose([one(df, ground)["x"], one(df, ground)["y"]], [1, 1])
    assert one(df, G.world_point(F.lit(None).cast("struct<x:double,y:double,z:double>"), ground))["z"] == 0


def test_names_and_vectors(spark):
    df = spark.range(1)
    f = one(df, N.feature_name(F.lit("a/feature_12_3_10_20_30_40_095_cls2.npy")))
    assert (f["frame"], f["x1"], f["x2"], f["y1"], f["score"], f["class_id"]) == (12, 10, 20, 30, 0.95, 2)
    assert one(df, N.feature_name(F.lit("other.npy")))["frame"] is None
    assert one(df, N.class_name(F.lit(1), base=1)) == "Person" and one(df, N.class_id(F.lit("x"))) == -1
    assert one(df, N.trailing_number(F.lit("Warehouse_016"))) == 16 and one(df, N.camera_tag(F.lit("p/Camera_01/x"))) == "Camera_01"
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(df, V.normalised(v)) == [0.6, 0.8] and one(df, V.cosine(v, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(df, V.mean_of_top(F.array(F.lit(1.0), F.lit(3.0), F.lit(2.0)), 2)) == 2.5
    assert one(df, V.mean_vector(F.array(v, F.array(F.lit(1.0), F.lit(0.0))))) == [2.0, 2.0]
    joints = F.array(*[F.struct(F.lit(float(s)).alias("score")) for s in (0.9, 0.2, 0.8)])
    assert one(df, X.keypoints_sure(joints, [0, 2], 0.5)) and not one(df, X.keypoints_sure(joints, [0, 1], 0.5)) and not one(df, X.keypoints_sure(joints, [7], 0.5))
    assert one(df, A.keypoint_sides(joints))["even"] == pytest.approx(0.85)


def test_detections_and_calibration(spark, tmp_path):
    path = save(tmp_path, "d.json", {"00000001": {"Frame": 3, "ImgPath": "i", "NpyPath": "n", "Coordinate": {"x1": 1, "y1": 2, "x2": 3, "y2": 4}, "ClusterID": None, "OfflineID": None}})
    r = readers.detections(spark, path).first()
    assert (r["serial"], r["frame"], r["x2"], r["class_id"]) == ("00000001", 3, 3, -1)
    path = save(tmp_path, "c.json", {"sensors": [{"type": "camera", "id": "Camera", "homography": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "scaleFactor": 2.0}, {"type": "other", "id": "x"}]})
    assert [(r["id"], r["homography"][0]) for r in readers.calibration(spark, path).collect()] == [("Camera", [1.0, 0.0, 0.0])]
    path = save(tmp_path, "s.json", {"Warehouse_016": ["Camera", "Camera_01"]})
    assert readers.scene_cameras(spark, path).count() == 2
    path = save(tmp_path, "k.json", {"4": [{"bbox": [0, 0, 1, 1, 0.9], "keypoints": [[1, 2, 0.5]]}]})
    assert readers.keypoints(spark, path).first()["keypoints"][0]["score"] == 0.5


def test_tracklets(spark, tmp_path):
    item = {"object type": "Person", "object sc id": 7, "3d location": [1.0, 2.0, 0.0], "3d bounding box scale": [0.5, 0.6, 1.7], "3d bounding box rotation": [0, 0, 1.5], "2d bounding box visible": {"Camera": [0, 0, 5, 6], "Camera_01": [1, 1, 2, 2]}}
    path = save(tmp_path, "t.json", {"12": [item, {**item, "object id": 9, "2d bounding box visible": {}}]})
    rows = readers.tracklets(spark, path).orderBy("object_id", "camera").collect()
    assert [(r["object_id"], r["camera"]) for r in rows] == [(7, "Camera"), (7, "Camera_01"), (9, None)]
    assert rows[0]["yaw"] == 1.5 and rows[0]["box"]["x2"] == 5 and rows[2]["box"] is None
    assert readers.tracklets(spark, path, "Camera_01").count() == 1


def test_text_formats(spark, tmp_path):
    path = save(tmp_path, "mot.txt", "1,1,10,20,30,40,1,1,0.9\n0,1,1,1,1,1,1,1,1\n2,-3,1,1,1,1,1,1,1\n\n1 2 1 1 2 2 0 1 0.5\n")
    rows = sorted((r["frame"], r["id"], r["box"]["x2"], r["counts"]) for r in readers.mot(spark, path, truth=True).collect())
    assert rows == [(1, 1, 40.0, True), (1, 2, 3.0, False)]
    path = save(tmp_path, "3d.txt", "1,5,1,2,3,4,5,6,0.7,-1,-1,-1\n1,2\n")
    r = readers.box_tracks_3d(spark, path).collect()
    assert len(r) == 1 and r[0]["box"]["l"] == 4 and r[0]["score"] == 1
    path = save(tmp_path, "k.txt", "0 1 Car 0 1 -10 1 2 3 4 -1 -1 -1 -1000 -1000 -1000 -10 0.5\n0 -1 DontCare -1 -1 -10 1 2 3 4 -1 -1 -1 -1000 -1000 -1000 -10\n")
    assert sorted((r["id"], r["class_name"], r["score"]) for r in readers.kitti(spark, path).collect()) == [(-1, "DontCare", None), (1, "Car", 0.5)]
    path = save(tmp_path, "m.txt", "3 2001 2 10 20 abc\n3 10000 10 10 20 abc\n")
    assert [r["ignore"] for r in readers.mots(spark, path).orderBy("id").collect()] == [False, True]
    path = save(tmp_path, "gmc.txt", "0\t1\t0\t5\t0\t1\t6\n1\t1\t0\t0\t0\t1\t0\n")
    assert [r["warp"] for r in readers.camera_motion(spark, path).orderBy("frame").collect()][0] == [1, 0, 5, 0, 1, 6]
    path = save(tmp_path, "seqinfo.ini", "[Sequence]\nname=S1\nseqLength=600\nframeRate=30\nimWidth=1920\nimHeight=1080\n")
    assert readers.sequences(spark, path).first()["length"] == 600
    path = save(tmp_path, "log.txt", "mAP: 10.0%\nRank-1 : 50.0%\nmAP: 82.6%\n")
    assert {(r["measure"], r["value"]) for r in readers.test_logs(spark, path).collect()} == {("mAP", 82.6), ("Rank-1", 50.0)}
    path = save(tmp_path, "metrics.csv", "seq,HOTA___50,IDs\na,0.5,3\nCOMBINED,0.6,4\n")
    assert readers.metric_tables(spark, path).where("seq = 'COMBINED' and field = 'IDs'").first()["value"] == 4


def test_json_documents(spark, tmp_path):
    doc = {"images": [{"id": 1, "video_id": 3, "frame_index": 0, "file_name": "a"}], "videos": [{"id": 3, "name": "v", "neg_category_ids": [2], "not_exhaustive_category_ids": []}], "tracks": [{"id": 9, "category_id": 1, "video_id": 3}], "annotations": [{"id": 5, "image_id": 1, "track_id": 9, "category_id": 8, "bbox": [1, 2, 3, 4], "area": 12.0}], "categories": [{"id": 1, "name": "x", "merged": [{"id": 8, "name": "y"}]}]}
    tables = readers.coco_tables(spark, save(tmp_path, "tao.json", doc))
    assert readers.merged_categories(tables["annotations"], tables["categories"]).first()["category_id"] == 1
    label = {"id": "4", "category": "car", "attributes": {"Crowd": True}, "box2d": {"x1": 0, "y1": 0, "x2": 1, "y2": 1}}
    r = readers.bdd(spark, save(tmp_path, "b.json", [{"name": "f", "videoName": "v", "frameIndex": 2, "labels": [label]}])).first()
    assert (r["id"], r["frame"], r["crowd"]) == (4, 2, True)
    vis = {"annotations": [{"id": 1, "video_id": 2, "category_id": 3, "iscrowd": 0, "segmentations": [None, {"size": [2, 2], "counts": "04"}], "areas": [None, 4.0], "bboxes": [None, [0, 0, 2, 2]]}]}
    assert [(r["t"], r["area"]) for r in readers.youtube_vis(spark, save(tmp_path, "y.json", vis)).collect()] == [(1, 4.0)]


def test_features_and_zip(spark, tmp_path):
    import zipfile

    (tmp_path / "f").mkdir()
    for frame in (1, 2):
        np.save(tmp_path / "f" / f"feature_{frame}_1_10_20_30_40_09_cls0.npy", np.arange(3, dtype=np.float32))
    assert readers.features(spark, f"file://{tmp_path}/f", most_frames=1).first()["vector"] == [0, 1, 2]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.txt", "1,2\n3,4\n")
    assert readers.zipped_text(spark, f"file://{tmp_path}/z.zip").count() == 2


def test_result_files(spark, tmp_path):
    rows = [("Camera_02", 5, 3, 0.0, 0.0, 4.0, 6.0, 1.5, 2.5), ("Camera", 1, 4, 1.0, 1.0, 3.0, 3.0, None, None), ("Camera", 1, None, 1.0, 1.0, 3.0, 3.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "camera string, frame int, global_id int, x1 double, y1 double, x2 double, y2 double, wx double, wy double").withColumn("box", G.box("x1", "y1", "x2", "y2"))
    writers.write_lines(writers.submission(df), f"file://{tmp_path}/out")
    lines = [r["value"] for r in spark.read.text(f"file://{tmp_path}/out").collect()]
    assert sorted(lines) == ["0 4 0 1 1 2 2 0.000000 0.000000", "2 3 4 0 0 4 6 1.500000 2.500000"]
    mot = df.withColumn("id", F.coalesce("global_id", F.lit(1))).withColumn("score", F.lit(0.5))
    assert writers.mot_lines(mot).count() == 3 and writers.kitti_lines(mot).count() == 3
    path = f"file://{tmp_path}/mot"
    writers.write_lines(writers.mot_lines(mot.where("frame = 5")), path)
    assert readers.mot(spark, path).first()["box"]["x2"] == 4
    world = df.selectExpr("1 as scene", "0 as class_id", "global_id", "frame", "wx as x", "wy as y", "0.5D as z", "1.0D as w", "1.0D as l", "2.0D as h", "0.1D as yaw", "camera", "box", "'Person' as class_name").where("global_id is not null")
    assert writers.world_lines(world, flat=True).orderBy("line").first()["line"].split()[6] == "0.00"
    assert json.loads(writers.frame_document(world).where("frame = 5").first()["objects"])[0]["2d bounding box visible"] == {"Camera_02": [0, 0, 4, 6]}
    line = writers.evaluation_lines(world.selectExpr("frame", "global_id as id", "x", "y", "z", "l", "w", "h", "1.0D as score").where("id = 3"), frame_shift=1).first()["line"]
    assert line.startswith("6,3,1.500000,2.500000")
    images = spark.createDataFrame([(1, "a")], "id int, file_name string")
    boxes = spark.createDataFrame([(1, 2, 0.0, 0.0, 2.0, 2.0), (1, 1, 0.0, 0.0, 1.0, 1.0)], "image_id int, category_id int, x double, y double, w double, h double")
    doc = json.loads(writers.coco_document(images, boxes, spark.createDataFrame([(1, "x")], "id int, name string")).first()["document"])
    assert [a["id"] for a in doc["annotations"]] == [1, 2] and doc["annotations"][0]["category_id"] == 1
    assert writers.next_number(["exp1", "exp12", "other"]) == 13 and writers.next_number([]) == 1
    assert readers.json_safe({1: np.float32(0.5), "a": (np.int64(2), [np.arange(2)])}) == '{"1": 0.5, "a": [2, [[0, 1]]]}'


@pytest.fixture(scope="module")
def gallery(spark):
    queries = spark.createDataFrame([(0, 1, 0), (1, 2, 0), (2, 9, 0)], "q int, pid int, camid int")
    rows = spark.createDataFrame([(10, 1, 0), (11, 1, 1), (12, 2, 1), (13, 1, 2), (14, 3, 1)], "g int, pid int, camid int")
    distance = {(0, 10): 0.0, (0, 14): 0.1, (0, 11): 0.2, (0, 12): 0.3, (0, 13): 0.4, (1, 12): 0.1}
    pairs_ = [(q, g, distance.get((q, g), 0.9 + g / 1000)) for q in range(3) for g in range(10, 15)]
    return retrieval.ranked(spark.createDataFrame(pairs_, "q int, g int, distance double"), queries, rows).cache()


def test_ranking(gallery):
    got = {r["q"]: r for r in retrieval.per_query(gallery).collect()}
    assert set(got) == {0, 1}
    assert got[0]["first_rank"] == 2 and got[0]["ap"] == pytest.approx((1 / 2 + 2 / 4) / 2) and got[0]["inp"] == 0.5 and got[1]["ap"] == 1
    curve = {r["rank"]: r for r in retrieval.cmc_and_map(gallery, 3).collect()}
    assert curve[1]["cmc"] == 0.5 and curve[2]["cmc"] == 1 and curve[1]["map"] == pytest.approx(0.75)
    assert {r["k"]: r["recall"] for r in retrieval.recall_at(gallery, [1, 5]).collect()} == {1: pytest.approx(1 / 3), 5: pytest.approx(2 / 3)}
    assert [r["cmc"] for r in retrieval.single_shot_cmc(gallery, gallery.select("g", F.when(F.col("g") == 12, 2).when(F.col("g") == 14, 3).otherwise(1).alias("pid")).distinct(), 5, 3).orderBy("rank").collect()][-1] == 1


def test_reranking_keeps_groups_together(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(c, 0.1, (6, 8)) for c in (0, 1, 2)])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    rank = d.argsort(1, kind="stable").argsort(1) + 1
    edges = spark.createDataFrame([(i, j, int(rank[i, j]), float(d[i, j])) for i in range(18) for j in range(18)], "a int, b int, rank int, distance double")
    out = retrieval.jaccard_rerank(edges, 5, 3).toPandas()
    same = out["a"] // 6 == out["b"] // 6
    assert out[same]["distance"].max() < out[~same]["distance"].min()
    vectors = spark.createDataFrame([(i, x[i].tolist()) for i in range(18)], "id int, v array<double>")
    smooth = {r_["id"]: np.array(r_["v"]) for r_ in retrieval.propagated(edges.withColumn("distance", F.lit(0.5)), vectors, "v", 4).collect()}
    assert len(smooth) == 18 and all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in smooth.values())


def test_small_scores(spark):
    scores = spark.createDataFrame([(1, "a", 0.9, "b"), (1, "b", 0.8, "b"), (2, "a", 0.9, "a"), (2, "b", 0.1, "a")], "example int, class string, score double, truth string")
    assert [r["accuracy"] for r in retrieval.top_k_accuracy(scores, [1, 2]).orderBy("k").collect()] == [0.5, 1.0]
    v = spark.createDataFrame([(k % 3, 0.1 * (k % 10), int(k % 10 < 5)) for k in range(60)], "fold int, distance double, same int")
    assert all(r["accuracy"] == 1 for r in retrieval.verification(v, [0.25, 0.45, 0.8], 3).collect())
    sample = retrieval.balanced_sample(spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "pid int, k int"), "pid", "k", 4).collect()
    assert sorted(r["pid"] for r in sample) == [1] * 4 + [2] * 4
    attr = spark.createDataFrame([(1, "x", 1, 1), (1, "y", 0, 1), (2, "x", 0, 0), (2, "y", 1, 1)], "i int, a string, t int, s int")
    r = A.attribute_accuracy(attr, "i", "a", "t", "s").first()
    assert r["mean_accuracy"] == pytest.approx((1 + 0.5) / 2) and r["precision"] == 0.75 and r["recall"] == 1
    best = pairs.best_match(spark.createDataFrame([(1, "p", 5.0, 0.1), (1, "q", 1.0, 0.2), (2, "p", 9.0, 0.9)], "l int, g string, d double, s double"), "l", "d", "s", 2.0, "g").orderBy("l").collect()
    assert [(r["g"], r["within"]) for r in best] == [("q", True), ("p", False)]
