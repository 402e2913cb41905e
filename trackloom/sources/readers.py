"""Readers of detection, track, calibration and ground-truth files (S rows), with schemas given, never inferred."""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import box
from ..functions.names import feature_name
from . import documents

DETECTION = "Frame int, ImgPath string, NpyPath string, Coordinate struct<x1:int,y1:int,x2:int,y2:int>, ClusterID int, OfflineID int, ClassID int"
TRACKLET = "`object type` string, `object sc id` long, `object id` long, `3d location` array<double>, `3d bounding box scale` array<double>, `3d bounding box rotation` array<double>, `2d bounding box visible` map<string,array<double>>, `feature path` string"
SENSOR = "type string, id string, coordinates struct<x:double,y:double,z:double>, scaleFactor double, translationToGlobalCoordinates struct<x:double,y:double>, cameraMatrix array<array<double>>, homography array<array<double>>, intrinsicMatrix array<array<double>>, extrinsicMatrix array<array<double>>"
KEYPOINTS = "bbox array<double>, keypoints array<array<double>>"


def _items(spark: SparkSession, path: str, schema: str, member: str | None = None) -> DataFrame:
    """path, place, key and `v` of each item of documents of any size, parsed by `schema`."""
    return documents.fields(documents.items(spark, path, member), schema)


def detections(spark: SparkSession, path: str) -> DataFrame:
    """A map from serial to detection, as rows."""
    rows = _items(spark, path, f"struct<{_colons(DETECTION)}>").select("path", F.col("key").alias("serial"), F.col("v").alias("d")).where("d is not null")
    c = F.col("d.Coordinate")
    return rows.select("path", "serial", F.col("d.Frame").alias("frame"), c["x1"].alias("x1"), c["y1"].alias("y1"), c["x2"].alias("x2"), c["y2"].alias("y2"), F.coalesce("d.ClassID", F.lit(-1)).alias("class_id"), F.col("d.ImgPath").alias("image_path"), F.col("d.NpyPath").alias("feature_path"))


def _colons(ddl: str) -> str:
    """Fields of a table as fields of a struct, names quoted."""
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl))


def detection_text(spark: SparkSession, path: str) -> DataFrame:
    """Camera,frame,class,x1,y1,x2,y2,score without a header."""
    return spark.read.schema("camera string, frame int, class_id int, x1 int, y1 int, x2 int, y2 int, score double").csv(path)


def tracklets(spark: SparkSession, path: str, camera: str | None = None) -> DataFrame:
    """Frames with lists of objects, as one row for each frame, object and camera that sees it.

    Objects that no camera sees keep one row with a null camera.
    """
    rows = _items(spark, path, f"array<struct<{_colons(TRACKLET)}>>").select("path", F.col("key").alias("frame"), F.col("v").alias("objects"))
    rows = rows.select("path", F.col("frame").cast("int").alias("frame"), F.explode("objects").alias("o")).select("path", "frame", "o", F.explode_outer("o.2d bounding box visible").alias("camera", "b"))
    if camera is not None:
        rows = rows.where(F.col("camera") == camera)
    o = F.col("o")
    where, size, turn = o["3d location"], o["3d bounding box scale"], o["3d bounding box rotation"]
    return rows.select("path", "frame", "camera", o["object type"].alias("class_name"), F.coalesce(o["object id"], o["object sc id"]).alias("object_id"), *(F.get(where, i).alias(c) for i, c in enumerate("xyz")), *(F.get(size, i).alias(c) for i, c in enumerate(("w", "l", "h"))), F.get(turn, 2).alias("yaw"), F.when(F.size("b") == 4, box(*(F.get("b", i) for i in range(4)))).alias("box"), o["feature path"].alias("feature_path"))


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """Cameras of a calibration file with their matrices."""
    return _items(spark, path, f"struct<{_colons(SENSOR)}>", "sensors").where("v.type = 'camera'").select("v.*")


def keypoints(spark: SparkSession, path: str) -> DataFrame:
    """Key points by frame, each (x, y, score)."""
    rows = _items(spark, path, f"array<struct<{_colons(KEYPOINTS)}>>").select("path", F.col("key").alias("frame"), F.col("v").alias("people"))
    rows = rows.select("path", F.col("frame").cast("int").alias("frame"), F.posexplode("people").alias("person", "p"))
    joints = F.transform("p.keypoints", lambda k: F.struct(F.get(k, F.lit(0)).alias("x"), F.get(k, F.lit(1)).alias("y"), F.get(k, F.lit(2)).alias("score")))
    return rows.select("path", "frame", "person", F.col("p.bbox").alias("bbox"), joints.alias("keypoints"))


def scene_cameras(spark: SparkSession, path: str) -> DataFrame:
    """Scenes with their cameras."""
    return _items(spark, path, "array<string>").select(F.col("key").alias("scene"), F.col("v").alias("cameras")).select("scene", F.posexplode("cameras").alias("place", "camera"))


def _separated(spark: SparkSession, path: str, sep: str | None) -> DataFrame:
    """Lines as arrays of strings; commas or blanks, whichever a line has, if no separator is given.  Blank lines are skipped."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line"))
    parts = F.split("line", r"\s*,\s*|\s+") if sep is None else F.split("line", sep)
    return lines.select("path", parts.alias("p"))


def text_tracks(spark: SparkSession, path: str, columns: Sequence[tuple[str, int, str]], sep: str | None = None, least_columns: int = 0, positive_ids: bool = True, id_name: str = "id") -> DataFrame:
    """Any simple text: (name, place, type) of the columns wanted; lines with fewer than `least_columns` and, if asked, negative ids are left out."""
    rows = _separated(spark, path, sep).where(F.size("p") >= least_columns)
    out = rows.select("path", *(F.get("p", F.lit(i)).try_cast(kind).alias(name) for name, i, kind in columns))
    return out.where(F.coalesce(F.col(id_name) >= 0, F.lit(True))) if positive_ids and id_name in out.columns else out


_MOT = [("frame", 0, "double"), ("id", 1, "double"), ("left", 2, "double"), ("top", 3, "double"), ("width", 4, "double"), ("height", 5, "double"), ("score", 6, "double"), ("class_id", 7, "double"), ("visibility", 8, "double")]


def mot(spark: SparkSession, path: str, truth: bool = False) -> DataFrame:
    """MOT, head-tracking and PersonPath22 rows with whole-number frames and ids; ground truth has `counts` (not zero-marked) and a class."""
    rows = text_tracks(spark, path, _MOT, least_columns=6)
    rows = rows.select("path", F.col("frame").cast("int").alias("frame"), F.col("id").cast("long").alias("id"), box(F.col("left"), F.col("top"), F.col("left") + F.col("width"), F.col("top") + F.col("height")).alias("box"), "score", F.col("class_id").cast("int").alias("class_id"), "visibility").where("frame >= 1")
    return rows.withColumn("counts", F.col("score") != 0) if truth else rows.drop("class_id", "visibility")


_KITTI = [("frame", 0, "int"), ("id", 1, "long"), ("class_name", 2, "string"), ("truncated", 3, "int"), ("occluded", 4, "int"), ("alpha", 5, "double"), ("x1", 6, "double"), ("y1", 7, "double"), ("x2", 8, "double"), ("y2", 9, "double"), ("h", 10, "double"), ("w", 11, "double"), ("l", 12, "double"), ("x", 13, "double"), ("y", 14, "double"), ("z", 15, "double"), ("yaw", 16, "double"), ("score", 17, "double")]


def kitti(spark: SparkSession, path: str) -> DataFrame:
    """KITTI tracking text; regions to ignore have id -1."""
    rows = text_tracks(spark, path, _KITTI, sep=" ", positive_ids=False)
    return rows.withColumn("box", box("x1", "y1", "x2", "y2")).drop("x1", "y1", "x2", "y2")


def mots(spark: SparkSession, path: str, truth: bool = True) -> DataFrame:
    """Frame id class height width rle; a class of 10 in ground truth is a region to ignore."""
    rows = text_tracks(spark, path, [("frame", 0, "int"), ("id", 1, "long"), ("class_id", 2, "int"), ("height", 3, "int"), ("width", 4, "int"), ("counts", 5, "string")], sep=" ")
    return rows.withColumn("ignore", F.col("class_id") == 10) if truth else rows


def box_tracks_3d(spark: SparkSession, path: str) -> DataFrame:
    """Frame,id,x,y,z,l,w,h,...: upright boxes in the world; lines of fewer than 10 columns are left out, scores are 1."""
    names = [("frame", 0, "double"), ("id", 1, "double"), *((c, i, "double") for i, c in enumerate(("x", "y", "z", "l", "w", "h"), 2))]
    rows = text_tracks(spark, path, names, least_columns=10)
    return rows.select("path", F.col("frame").cast("int").alias("frame"), F.col("id").cast("long").alias("id"), F.struct("x", "y", "z", "l", "w", "h").alias("box"), F.lit(1.0).alias("score"))


def bdd(spark: SparkSession, path: str) -> DataFrame:
    """A list of frames with labels."""
    label = "struct<id:string,category:string,attributes:struct<Crowd:boolean,Occluded:boolean,Truncated:boolean>,box2d:struct<x1:double,y1:double,x2:double,y2:double>>"
    rows = _items(spark, path, f"struct<name:string,videoName:string,frameIndex:int,labels:array<{label}>>").select(F.col("v").alias("f"))
    rows = rows.select(F.col("f.videoName").alias("video"), F.col("f.frameIndex").alias("frame"), F.explode("f.labels").alias("o"))
    return rows.select("video", "frame", F.col("o.id").cast("long").alias("id"), F.col("o.category").alias("class_name"), F.coalesce("o.attributes.Crowd", F.lit(False)).alias("crowd"), F.col("o.box2d").alias("box"))


_TAO = {
    "images": "id long, video_id long, frame_index int, width int, height int, file_name string",
    "videos": "id long, name string, neg_category_ids array<long>, not_exhaustive_category_ids array<long>",
    "tracks": "id long, category_id long, video_id long",
    "annotations": "id long, image_id long, track_id long, category_id long, video_id long, bbox array<double>, area double, iscrowd int, score double",
    "categories": "id long, name string, merged array<struct<id:long,name:string>>",
}


def coco_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The lists of a COCO, TAO, BURST or video-segmentation document as tables."""
    own = documents.Documents(spark, path)
    return {name: documents.fields(own.items(name), f"struct<{_colons(kind)}>").select("v.*") for name, kind in _TAO.items()}


def youtube_vis(spark: SparkSession, path: str) -> DataFrame:
    """One row for each video, track and frame with a segmentation."""
    mask = "struct<size:array<int>,counts:string>"
    rows = _items(spark, path, f"struct<id:long,video_id:long,category_id:long,iscrowd:int,segmentations:array<{mask}>,areas:array<double>,bboxes:array<array<double>>>", "annotations").select(F.col("v").alias("a"))
    return rows.select(F.col("a.video_id").alias("video"), F.col("a.id").alias("track"), F.col("a.category_id").alias("class"), F.col("a.iscrowd").alias("crowd"), F.posexplode("a.segmentations").alias("t", "mask"), F.col("a.areas").alias("_areas"), F.col("a.bboxes").alias("_boxes")).select("video", "track", "class", "crowd", "t", "mask", F.get("_areas", "t").alias("area"), F.get("_boxes", "t").alias("bbox")).where("mask is not null")


def merged_categories(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations with the category that theirs was merged into."""
    merged = categories.select(F.col("id").alias("_to"), F.explode("merged").alias("m")).select("_to", F.col("m.id").alias("category_id"))
    return annotations.join(F.broadcast(merged) if _small(merged) else merged, "category_id", "left").withColumn("category_id", F.coalesce("_to", "category_id")).drop("_to")


def _small(df: DataFrame, most: int = 100_000) -> bool:
    return df.limit(most + 1).count() <= most


def camera_motion(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated affine motions; column 0 is not used, the frame is the line's place in its file."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("frame", "line")).where("trim(line) <> ''")
    p = F.split("line", "\t")
    return lines.select("path", "frame", F.transform(F.slice(p, 2, 6), lambda x: x.cast("double")).alias("warp"))


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """`seqinfo.ini` files: name, length, rate and size."""
    rows = spark.read.text(path, wholetext=True)

    def value(key: str):
        return F.nullif(F.regexp_extract("value", rf"(?m)^\s*{key}\s*=\s*(.*?)\s*$", 1), F.lit(""))

    return rows.select(value("name").alias("seq"), value("seqLength").cast("int").alias("length"), value("frameRate").cast("double").alias("rate"), value("imWidth").cast("int").alias("width"), value("imHeight").cast("int").alias("height"))


#: Patterns of file names in re-identification sets: identity, then camera.
REID_NAMES = {"market1501": r"([-\d]+)_c(\d)", "dukemtmc": r"([-\d]+)_c(\d)", "msmt17": r"(\d+)_\d+_(\d+)", "cuhk03": r"\d+_(\d+)_(\d)", "viper": r"(\d+)_(\d+)", "prid": r"cam_[ab]/person_(\d+)", "mars": r"(\d{4})C(\d)T\d+F\d+"}


def reid_items(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Image paths with identity and camera; identity -1 (junk) is left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.select("path", F.regexp_extract("path", pattern, 1).try_cast("int").alias("pid"), F.regexp_extract("path", pattern, 2).try_cast("int").alias("camid")).where("pid is not null and pid <> -1")


def reid_tracklets(items: DataFrame) -> DataFrame:
    """Images of one identity and camera as a list in order of name."""
    return items.groupBy("pid", "camid").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def test_logs(spark: SparkSession, path: str, measures: Sequence[str] = ("mAP", "Rank-1", "Rank-5", "Rank-10")) -> DataFrame:
    """`name: value%` in logs, the last of each name in each file, and `avg` over files by the caller."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    found = F.explode(F.regexp_extract_all("value", F.lit(rf"({'|'.join(measures)})\s*:\s*([\d.]+)"), F.lit(0)))
    rows = lines.select("path", found.alias("m")).select("path", F.regexp_extract("m", r"^([^\s:]+)", 1).alias("measure"), F.regexp_extract("m", r"([\d.]+)$", 1).cast("double").alias("value"))
    return rows.groupBy("path", "measure").agg(F.last("value").alias("value"))


def features(spark: SparkSession, path: str, most_frames: int | None = None) -> DataFrame:
    """`.npy` vectors under a folder with what their names tell; `most_frames` keeps the first distinct frames."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"path": rows["path"], "vector": [np.load(io.BytesIO(x), allow_pickle=False).ravel().astype(np.float32) for x in rows["content"]]})

    out = files.mapInPandas(decode, "path string, vector array<float>").withColumn("f", feature_name(F.col("path"))).select("path", "f.*", "vector")
    if most_frames is not None:
        frames = out.select("frame").distinct().orderBy("frame").limit(most_frames)
        out = out.join(frames, "frame", "left_semi")
    return out


def burst(spark: SparkSession, path: str, truth: bool = True, distractors: Sequence[int] = ()) -> dict[str, DataFrame]:
    """A BURST document as the tables of `coco_tables`: videos, images, tracks and annotations with masks.

    Videos are numbered by their place, images by video and place, and tracks by
    video and the number they have there, all in the order of the document.
    Annotations of `distractors` are left out; only ground truth leaves them out.
    """
    seq = "struct<id:long,seq_name:string,dataset:string,width:int,height:int,neg_category_ids:array<long>,not_exhaustive_category_ids:array<long>,track_category_ids:map<string,long>,annotated_image_paths:array<string>,segmentations:array<map<string,struct<rle:string,is_gt:boolean,score:double>>>>"
    rows = _items(spark, path, seq, "sequences").select(F.col("v").alias("s"))
    videos = rows.select(F.col("s.id").alias("id"), F.concat_ws("/", "s.dataset", "s.seq_name").alias("name"), "s.neg_category_ids", "s.not_exhaustive_category_ids", F.col("s.width").alias("width"), F.col("s.height").alias("height"))
    stride = F.lit(1_000_000)
    image_id = (F.col("s.id") * stride + F.col("frame_index")).alias("id")
    images = rows.select("s", F.posexplode("s.annotated_image_paths").alias("frame_index", "file")).select(image_id, F.col("s.id").alias("video_id"), "frame_index", F.col("s.width").alias("width"), F.col("s.height").alias("height"), F.concat_ws("/", "s.dataset", "s.seq_name", "file").alias("file_name"))
    masks = rows.select("s", F.posexplode("s.segmentations").alias("frame_index", "m")).select("s", "frame_index", F.explode("m").alias("local", "mask"))
    category = F.element_at("s.track_category_ids", F.col("local"))
    found = masks.select((F.col("s.id") * stride + F.col("frame_index")).alias("image_id"), category.alias("category_id"), (F.col("s.id") * stride + F.col("local").cast("long")).alias("track_id"), F.col("s.id").alias("video_id"), F.struct(F.col("s.height").alias("height"), F.col("s.width").alias("width"), F.col("mask.rle").alias("counts")).alias("mask"), F.col("mask.score").alias("score"))
    if truth and distractors:
        found = found.where(~F.col("category_id").isin(*distractors))
    tracks = found.groupBy("track_id").agg(F.min("category_id").alias("category_id"), F.min("video_id").alias("video_id")).withColumnRenamed("track_id", "id")
    return {"videos": videos, "images": images, "tracks": tracks, "annotations": found}


def indexed_png(content: bytes) -> np.ndarray:
    """Palette places (or grey values) of a PNG of one channel of 1, 2, 4 or 8 bits, without interlacing."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, data, head = 8, [], None
    while at < len(content):
        size, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if head is None or head[3] not in (0, 3) or head[2] > 8 or head[6]:
        raise ValueError("only PNG files of one channel without interlacing hold masks")
    width, height, depth = head[:3]
    stride = -(-width * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:]
        if kind == 0:
            own = line
        elif kind == 1:
            own = np.cumsum(line, dtype=np.uint8)
        elif kind == 2:
            own = line + above
        else:
            own = np.zeros(stride, np.uint8)
            left = corner = 0
            for x, (value, up) in enumerate(zip(line.tolist(), above.tolist())):
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    base = left + up - corner
                    guess = min((left, up, corner), key=lambda c: abs(base - c))
                left, corner = (value + guess) & 0xFF, up
                own[x] = left
        out[y] = above = own
    if depth == 8:
        return out
    bits = np.unpackbits(out, axis=1).reshape(height, -1, depth)
    return (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, :width]


def davis(spark: SparkSession, path: str, void: int = 254) -> DataFrame:
    """Indexed PNG masks in a folder a sequence: (seq, t, id, height, width, counts, void), a row an object; objects count from 1.

    Frames are numbered from 0 in order of their file names.  `void` marks the row
    of pixels that do not count, whose id is null.
    """
    from ..operators.masks import from_mask

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(path)
    parts = F.split("path", "/")
    rows = files.select(F.element_at(parts, -2).alias("seq"), F.element_at(parts, -1).alias("file"), "content")
    order = rows.select("seq", "file", (F.row_number().over(Window.partitionBy("seq").orderBy("file")) - 1).alias("t"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for seq, file, content in zip(frame["seq"], frame["file"], frame["content"]):
                image = indexed_png(content)
                own = [(seq, file, None if v == void else int(v), *from_mask(image == v), v == void) for v in np.unique(image) if v]
                yield pd.DataFrame(own, columns=["seq", "file", "id", "height", "width", "counts", "void"]).astype({"id": "Int64"})

    found = rows.mapInPandas(decode, "seq string, file string, id long, height int, width int, counts string, void boolean")
    return found.join(order, ["seq", "file"]).select("seq", "t", "id", "height", "width", "counts", "void")


def zipped_text(spark: SparkSession, path: str, member: str = ".txt") -> DataFrame:
    """Lines of the members of zip files."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for p, content in zip(rows["path"], rows["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith(member):
                            yield pd.DataFrame({"path": p, "member": name, "line": z.read(name).decode().splitlines()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(lines, "path string, member string, line string")


def depth_maps(spark: SparkSession, path: str, name: str = "distance_to_image_plane") -> DataFrame:
    """Depth files with one data set a frame, as (path, frame, y, x, depth_mm); needs the h5py library on the executors."""

    def samples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import h5py

        for rows in batches:
            for p, content in zip(rows["path"], rows["content"]):
                with h5py.File(io.BytesIO(content)) as f:
                    for key in f:
                        d = f[key][()]
                        ys, xs = np.nonzero(d)
                        yield pd.DataFrame({"path": p, "frame": int(key.rsplit("_", 1)[-1].split(".")[0]), "y": ys, "x": xs, "depth_mm": d[ys, xs].astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(samples, "path string, frame int, y int, x int, depth_mm double")


def metric_tables(spark: SparkSession, path: str) -> DataFrame:
    """Detailed metric files (a header, one line a sequence) as (path, seq, field, value); columns may differ by file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for p, content in zip(rows["path"], rows["value"]):
                table = pd.read_csv(io.StringIO(content), sep=None, engine="python")
                yield table.melt(id_vars=table.columns[0], var_name="field", value_name="value").rename(columns={table.columns[0]: "seq"}).assign(path=p)[["path", "seq", "field", "value"]].astype({"seq": str, "value": float})

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(read, "path string, seq string, field string, value double")


def json_safe(value) -> str:
    """JSON of nested values with string keys; numpy numbers become plain ones."""

    def plain(v):
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple, np.ndarray)):
            return [plain(x) for x in v]
        return v.item() if isinstance(v, np.generic) else v

    return json.dumps(plain(value))
