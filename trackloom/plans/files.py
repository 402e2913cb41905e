"""Sources and sinks (S and K rows): files made from the test tables, written to the shared folder and read back; keys and SQL as in `queries`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import shared_folder
from ..sources import readers, writers
from .queries import query, r6
from .tables import TRK, table, trk


def _file(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}/{name}"


def _written(lines: DataFrame, name: str) -> str:
    """The path of a text file that holds `lines` (one column)."""
    path = _file(lines.sparkSession, name)
    writers.write_lines(lines, path)
    return path


def _documents(rows: DataFrame, part, value, key=None, member: str | None = None, name: str = "documents") -> str:
    """The path of JSON documents, one for each value of `part` (a camera, a scene, a run of frames): the list of `value`, or a map from `key` to it; with `member`, as that member of an object."""
    item = F.collect_list(value) if key is None else F.map_from_entries(F.collect_list(F.struct(key, value)))
    lines = rows.groupBy(part.alias("part")).agg(item.alias("item"))
    return _apart(lines.select(F.to_json(F.col("item") if member is None else F.struct(F.col("item").alias(member)), {"ignoreNullFields": "false"}).alias("value"), "part"), name)


def _apart(lines: DataFrame, name: str) -> str:
    """The path of text files, one for each `part`, that holds its `value`: each is a document."""
    path = _file(lines.sparkSession, name)
    lines.select("value", "part").write.partitionBy("part").text(path)
    return path


def _r2(c):
    return F.round(c, 2)


@query(f"WITH {TRK} SELECT user_id % 4 AS camera, lpad(event_id::VARCHAR, 8, '0') AS serial, frame, x1::INTEGER AS x1, y1::INTEGER AS y1, x2::INTEGER AS x2, y2::INTEGER AS y2, (event_id % 7)::INTEGER AS class_id FROM trk")
def s1_detections(spark, sf):
    """One document a camera, as a map from serial to detection."""
    d = F.struct(F.col("frame").cast("int").alias("Frame"), F.lit("a.jpg").alias("ImgPath"), F.concat(F.lit("c"), F.col("camera"), F.lit(".npy")).alias("NpyPath"), F.struct(*(F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2"))).alias("Coordinate"), (F.col("event_id") % 7).cast("int").alias("ClassID"))
    rows = trk(spark, sf).withColumn("camera", F.col("user_id") % 4)
    lines = rows.groupBy("camera").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.lpad(F.col("event_id").cast("string"), 8, "0"), d)))).alias("value"))
    path = _file(spark, "detections")
    # One file a camera, as each is a document.
    lines.select("value", F.col("camera").alias("part")).write.partitionBy("part").text(path)
    found = readers.detections(spark, path)
    return found.select(F.regexp_extract("feature_path", r"c(\d+)", 1).cast("long").alias("camera"), "serial", F.col("frame").cast("long").alias("frame"), "x1", "y1", "x2", "y2", "class_id")


@query(f"WITH {TRK} SELECT 'c' || user_id % 4 AS camera, frame::INTEGER AS frame, (event_id % 7)::INTEGER AS class_id, x1::INTEGER AS x1, y1::INTEGER AS y1, x2::INTEGER AS x2, y2::INTEGER AS y2, round(score, 4) AS score FROM trk")
def s2_detection_text(spark, sf):
    line = F.concat_ws(",", F.concat(F.lit("c"), F.col("user_id") % 4), "frame", F.col("event_id") % 7, *(F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")), F.round("score", 4))
    return readers.detection_text(spark, _written(trk(spark, sf).select(line), "detections.txt"))


@query("SELECT s_suppkey AS id, round(s_acctbal, 2) AS scale, (s_nationkey + 0.5) AS x, (s_suppkey * 1.0) AS fx FROM supplier WHERE s_suppkey % 3 <> 0")
def s7_calibration(spark, sf):
    rows = table(spark, sf, "supplier")

    def matrix(n, m):
        return F.array(*(F.array(*(F.col("s_suppkey").cast("double") if i == j == 0 else F.lit(float(i == j)) for j in range(m))) for i in range(n)))

    kind = F.when(F.col("s_suppkey") % 3 != 0, "camera").otherwise("lidar")
    sensor = F.struct(kind.alias("type"), F.col("s_suppkey").cast("string").alias("id"), F.struct((F.col("s_nationkey") + 0.5).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")).alias("coordinates"), F.round("s_acctbal", 2).alias("scaleFactor"), matrix(3, 4).alias("cameraMatrix"), matrix(3, 3).alias("homography"), matrix(3, 3).alias("intrinsicMatrix"), matrix(3, 4).alias("extrinsicMatrix"))
    found = readers.calibration(spark, _documents(rows, F.col("s_nationkey"), sensor, member="sensors"))
    return found.select(F.col("id").cast("long").alias("id"), F.round("scaleFactor", 2).alias("scale"), F.col("coordinates.x").alias("x"), F.get(F.get("intrinsicMatrix", F.lit(0)), F.lit(0)).alias("fx"))


@query(f"WITH {TRK}, p AS (SELECT frame, x1, y1, (event_id % 10) / 10 AS s FROM trk WHERE user_id % 10 = 0 OR frame % 2 = 0) SELECT frame::INTEGER AS frame, x1, y1, round(s, 1) AS score FROM p")
def s9_keypoints(spark, sf):
    rows = trk(spark, sf).where("user_id % 10 = 0 or frame % 2 = 0")
    s = (F.col("event_id") % 10) / 10
    person = F.struct(F.array("x1", "y1", "x2", "y2", s).alias("bbox"), F.array(F.array("x1", "y1", s)).alias("keypoints"))
    frames = rows.groupBy("frame").agg(F.collect_list(person).alias("people"))
    found = readers.keypoints(spark, _documents(frames, F.expr("frame div 24"), F.col("people"), F.col("frame").cast("string")))
    joint = F.get("keypoints", F.lit(0))
    return found.select("frame", joint["x"].alias("x1"), joint["y"].alias("y1"), F.round(joint["score"], 1).alias("score"))


@query(f"WITH {TRK} SELECT 'Camera_' || user_id % 3 AS camera, frame::INTEGER AS frame, user_id AS object_id, round(avg(x1) OVER (PARTITION BY frame, user_id), 4) AS x, x2 - x1 AS width FROM trk")
def s10_tracklets(spark, sf):
    """Frames with their objects, and which camera sees each."""
    rows = trk(spark, sf).select("frame", F.col("user_id").alias("global_id"), F.lit("Person").alias("class_name"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(0.0).alias("z"), F.lit(0.5).alias("w"), F.lit(0.6).alias("l"), F.lit(1.7).alias("h"), F.lit(0.1).alias("yaw"), F.concat(F.lit("Camera_"), F.col("user_id") % 3).alias("camera"), "box")
    frames = writers.frame_document(rows)
    lines = frames.groupBy(F.expr("frame div 24").alias("part")).agg(F.concat(F.lit("{"), F.concat_ws(",", F.collect_list(F.concat(F.lit('"'), F.col("frame"), F.lit('":'), F.col("objects")))), F.lit("}")).alias("value"))
    found = readers.tracklets(spark, _apart(lines, "ground_truth"))
    return found.select("camera", "frame", "object_id", F.round("x", 4).alias("x"), G.width(F.col("box")).alias("width"))


@query(f"WITH {TRK} SELECT frame, user_id AS id, x1 FROM trk WHERE user_id % 9 <> 0")
def s12_text_tracks(spark, sf):
    """Lines with blanks as separators; negative ids, and lines that are too short, are left out."""
    id_ = F.when(F.col("user_id") % 9 == 0, -F.col("user_id") - 1).otherwise(F.col("user_id"))
    lines = trk(spark, sf).select(F.concat_ws(" ", "frame", id_, "x1").alias("value"))
    lines = lines.unionByName(spark.createDataFrame([("1 2",), ("",)], "value string"))
    return readers.text_tracks(spark, _written(lines, "tracks.txt"), [("frame", 0, "long"), ("id", 1, "long"), ("x1", 2, "double")], least_columns=3).drop("path")


@query(f"WITH {TRK} SELECT frame::INTEGER AS frame, user_id AS id, x1, y1, x2, y2, round(score, 4) AS score FROM trk")
def s13_mot(spark, sf):
    """Result lines written and read."""
    path = _written(writers.mot_lines(trk(spark, sf).withColumn("id", F.col("user_id"))), "mot.txt")
    return readers.mot(spark, path).select("frame", "id", *(_r2(F.col(f"box.{c}")).alias(c) for c in ("x1", "y1", "x2", "y2")), F.round("score", 4).alias("score"))


@query("SELECT 'seq-' || n_nationkey AS seq, 100 + n_nationkey AS length, 25.0 AS rate, 640 AS width, 480 AS height FROM nation")
def s14_sequences(spark, sf):
    lines = [F.lit("[Sequence]"), F.concat(F.lit("name=seq-"), F.col("n_nationkey")), F.concat(F.lit("seqLength = "), F.col("n_nationkey") + 100), F.lit("frameRate=25"), F.lit("imWidth=640"), F.lit("imHeight=480")]
    path = _file(spark, "sequences")
    table(spark, sf, "nation").select(F.concat_ws("\n", *lines).alias("value"), F.col("n_nationkey").alias("part")).write.partitionBy("part").text(path)
    return readers.sequences(spark, path)


@query(f"WITH {TRK} SELECT frame::INTEGER AS frame, user_id AS id, 'Pedestrian' AS class_name, x1, y2, round(score, 4) AS score FROM trk")
def s15_kitti(spark, sf):
    path = _written(writers.kitti_lines(trk(spark, sf).withColumn("id", F.col("user_id"))), "kitti.txt")
    return readers.kitti(spark, path).select("frame", "id", "class_name", _r2(F.col("box.x1")).alias("x1"), _r2(F.col("box.y2")).alias("y2"), F.round("score", 4).alias("score"))


@query(f"WITH {TRK} SELECT frame::INTEGER AS frame, user_id AS id, (event_id % 2 * 9 + 1)::INTEGER AS class_id, 'ab' || event_id AS counts, event_id % 2 = 1 AS ignore FROM trk")
def s16_mots(spark, sf):
    line = F.concat_ws(" ", "frame", "user_id", F.col("event_id") % 2 * 9 + 1, F.lit(40), F.lit(30), F.concat(F.lit("ab"), F.col("event_id")))
    found = readers.mots(spark, _written(trk(spark, sf).select(line), "mots.txt"))
    return found.select("frame", "id", "class_id", "counts", "ignore")


@query(f"WITH {TRK} SELECT 'v' || frame // 24 AS video, (frame % 24)::INTEGER AS frame, user_id AS id, event_type AS class_name, event_id % 5 = 0 AS crowd, x1, y2 FROM trk")
def s17_bdd(spark, sf):
    label = F.struct(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("category"), F.struct((F.col("event_id") % 5 == 0).alias("Crowd")).alias("attributes"), F.col("box").alias("box2d"))
    frames = trk(spark, sf).groupBy("frame").agg(F.collect_list(label).alias("labels"))
    item = F.struct(F.concat(F.lit("f"), F.col("frame")).alias("name"), F.concat(F.lit("v"), F.expr("frame div 24")).alias("videoName"), (F.col("frame") % 24).alias("frameIndex"), "labels")
    found = readers.bdd(spark, _documents(frames, F.expr("frame div 24"), item))
    return found.select("video", "frame", "id", "class_name", "crowd", F.col("box.x1").alias("x1"), F.col("box.y2").alias("y2"))


@query(f"WITH {TRK}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY frame) - 1 AS t FROM trk) SELECT user_id % 5 AS video, user_id AS track, CAST(t AS INTEGER) AS t, 'm' || event_id AS counts, x2 - x1 AS area FROM f WHERE event_id % 3 <> 0")
def s19_youtube_vis(spark, sf):
    rows = trk(spark, sf)
    mask = F.when(F.col("event_id") % 3 != 0, F.struct(F.array(F.lit(4), F.lit(5)).alias("size"), F.concat(F.lit("m"), F.col("event_id")).alias("counts")))
    parts = rows.select("user_id", F.struct("frame", mask.alias("m"), (F.col("x2") - F.col("x1")).alias("area")).alias("p")).groupBy("user_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    item = F.struct(F.col("user_id").alias("id"), (F.col("user_id") % 5).alias("video_id"), F.lit(1).alias("category_id"), F.lit(0).alias("iscrowd"), F.transform("ps", lambda p: p["m"]).alias("segmentations"), F.transform("ps", lambda p: p["area"]).alias("areas"))
    # Nulls in lists stand for frames without the object.
    found = readers.youtube_vis(spark, _documents(parts, F.expr("user_id div 50"), item, member="annotations"))
    return found.select("video", "track", "t", F.col("mask.counts").alias("counts"), "area")


@query("SELECT s_suppkey AS id, s_nationkey % 7 AS category_id FROM supplier")
def s20_merged_categories(spark, sf):
    """Annotations whose category was merged into another."""
    notes = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("part")).agg(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 7 + 100).alias("category_id"))).alias("annotations"))
    # The first document has the categories too.
    kinds = spark.range(7).agg(F.collect_list(F.struct("id", F.array(F.struct((F.col("id") + 100).alias("id"))).alias("merged"))).alias("categories"))
    first = notes.agg(F.min("part").alias("part")).crossJoin(kinds)
    tables = readers.coco_tables(spark, _apart(notes.join(first, "part", "left").select(F.to_json(F.struct("annotations", "categories")).alias("value"), "part"), "tao"))
    return readers.merged_categories(tables["annotations"].select("id", "category_id"), tables["categories"]).select("id", "category_id")


@query("SELECT o_custkey * 1000000 + 1 + o_orderkey % 3 AS track_id, o_custkey AS video_id, o_orderkey % 5 AS category_id, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 3 GROUP BY ALL")
def s21_burst(spark, sf):
    """A sequence a customer, a frame an order, an object by its number; category 3 is a distractor."""
    # A track has one category, so its number has the category behind it.
    name = (100 * (1 + F.col("o_orderkey") % 3) + F.col("o_orderkey") % 5).cast("string")
    frame = F.struct("o_orderkey", name.alias("name"), (F.col("o_orderkey") % 5).alias("kind"), F.concat(F.lit("r"), F.col("o_orderkey")).alias("rle"))
    own = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(frame)).alias("fs"))
    seq = F.struct(F.col("o_custkey").alias("id"), F.lit("s").alias("seq_name"), F.lit("d").alias("dataset"), F.lit(4).alias("width"), F.lit(5).alias("height"), F.map_from_entries(F.array_distinct(F.transform("fs", lambda f: F.struct(f["name"], f["kind"])))).alias("track_category_ids"), F.transform("fs", lambda f: F.concat(f["rle"], F.lit(".jpg"))).alias("annotated_image_paths"), F.transform("fs", lambda f: F.create_map(f["name"], F.struct(f["rle"].alias("rle")))).alias("segmentations"))
    path = _documents(own, F.expr("o_custkey div 100"), seq, member="sequences")
    found = readers.burst(spark, path, distractors=[3])["annotations"]
    local = F.expr("(track_id - video_id * 1000000) div 100")
    return found.groupBy((F.col("video_id") * 1_000_000 + local).alias("track_id"), "video_id", "category_id").agg(F.count("*").alias("n"))


@query(f"WITH {TRK} SELECT (frame + 1)::INTEGER AS frame, user_id AS id, x1 AS x, y2 - y1 AS l, x2 - x1 AS w FROM trk")
def s24_box_tracks_3d(spark, sf):
    """Evaluation lines with length and width exchanged, written and read."""
    rows = trk(spark, sf).select("frame", F.col("user_id").alias("id"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(0.0).alias("z"), (F.col("x2") - F.col("x1")).alias("l"), (F.col("y2") - F.col("y1")).alias("w"), F.lit(1.5).alias("h"), F.lit(1.0).alias("score"))
    found = readers.box_tracks_3d(spark, _written(writers.evaluation_lines(rows, 1, swap=True), "eval.csv"))
    return found.select("frame", "id", r6("box.x").alias("x"), r6("box.l").alias("l"), r6("box.w").alias("w"))


@query("SELECT s_name AS seq, 'balance' AS field, round(s_acctbal, 2) AS value FROM supplier UNION ALL SELECT s_name, 'nation', s_nationkey FROM supplier")
def s27_metric_tables(spark, sf):
    """A detailed table with a header, written and read."""
    path = _file(spark, "detailed.csv")
    table(spark, sf, "supplier").select(F.col("s_name").alias("seq"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")).write.option("header", "true").csv(path)
    return readers.metric_tables(spark, path).select("seq", "field", F.round("value", 2).alias("value"))


@query("SELECT n_name AS log, 'mAP' AS measure, 10.0 + n_nationkey AS value FROM nation UNION ALL SELECT n_name, 'Rank-1', 50.5 FROM nation")
def s31_test_logs(spark, sf):
    path = _file(spark, "logs")
    text = F.concat(F.lit("start\nmAP: 3.0%\nRank-1 : 50.5%\nmAP: "), F.col("n_nationkey") + 10.0, F.lit("%\nend"))
    table(spark, sf, "nation").select(text.alias("value"), F.col("n_name").alias("part")).write.partitionBy("part").text(path)
    found = readers.test_logs(spark, path)
    return found.select(F.url_decode(F.regexp_extract("path", "part=([^/]*)", 1)).alias("log"), "measure", "value")


@query("SELECT CAST(r_regionkey AS INTEGER) AS frame, 1.0 + r_regionkey AS a, 5.0 AS tx FROM region")
def s32_camera_motion(spark, sf):
    line = F.concat_ws("\t", F.lit("0"), F.col("r_regionkey") + 1.0, F.lit("0.0"), F.lit("5.0"), F.lit("0.0"), F.lit("1.0"), F.lit("7.0"))
    whole = table(spark, sf, "region").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("r_regionkey", line.alias("l")))), lambda x: x["l"])).alias("value"))
    found = readers.camera_motion(spark, _written(whole, "motion.txt"))
    return found.select("frame", F.get("warp", F.lit(0)).alias("a"), F.get("warp", F.lit(2)).alias("tx"))


@query("SELECT r_name AS scene, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS INTEGER) AS place, n_name AS camera FROM nation JOIN region ON n_regionkey = r_regionkey")
def s34_scene_cameras(spark, sf):
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    scenes = rows.groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("cameras"))
    return readers.scene_cameras(spark, _documents(scenes, F.col("r_name"), F.col("cameras"), F.col("r_name")))


@query(f"WITH {TRK}, m AS (SELECT user_id % 9 AS gid, frame, avg(x1) + 0.001 AS x, avg(y1) + 0.001 AS y FROM trk GROUP BY ALL) SELECT printf('%d %d %d %d %.2f %.2f %.2f %.2f %.2f %.2f %.2f', 1, 0, gid, frame, x, y, 3.0, 0.5, 0.5, 1.75, 0.0) AS line FROM m")
def k2_world_lines(spark, sf):
    rows = trk(spark, sf).select(F.lit(1).alias("scene"), F.lit(0).alias("class_id"), (F.col("user_id") % 9).alias("global_id"), "frame", (F.col("x1") + 0.001).alias("x"), (F.col("y1") + 0.001).alias("y"), F.lit(3.0).alias("z"), F.lit(0.5).alias("w"), F.lit(0.5).alias("l"), F.lit(1.75).alias("h"), F.lit(None).cast("double").alias("yaw"))
    return writers.world_lines(rows)


@query(f"WITH {TRK} SELECT frame || ' ' || user_id || ' 2 ' || printf('%.4f', score) || ' 4 5 m' || event_id AS line FROM trk")
def k10_mask_lines(spark, sf):
    rows = trk(spark, sf).select("frame", F.col("user_id").alias("id"), F.lit(2).alias("class_id"), "score", F.lit(4).alias("height"), F.lit(5).alias("width"), F.concat(F.lit("m"), F.col("event_id")).alias("counts"))
    return writers.mask_lines(rows)


@query(f"WITH {TRK} SELECT row_number() OVER (ORDER BY frame, x1, y1, event_id % 3, x2 - x1, y2 - y1) AS id, frame AS image_id, x1 AS x, x2 - x1 AS w, (x2 - x1) * (y2 - y1) AS area FROM trk")
def k11_coco_document(spark, sf):
    """Annotations numbered, written as a document for each run of 24 frames, and read."""
    rows = trk(spark, sf)
    notes = rows.select(F.expr("frame div 24").alias("part"), F.col("frame").alias("image_id"), (F.col("event_id") % 3).alias("category_id"), F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    images = rows.select(F.expr("frame div 24").alias("part"), F.col("frame").alias("id")).distinct()
    kinds = spark.range(3).withColumn("name", F.concat(F.lit("c"), F.col("id")))
    lines = writers.coco_document(images, notes, kinds, by="part")
    found = readers.coco_tables(spark, _apart(lines.withColumnRenamed("document", "value"), "coco"))["annotations"]
    return found.select("id", "image_id", F.get("bbox", F.lit(0)).alias("x"), F.get("bbox", F.lit(2)).alias("w"), "area")
