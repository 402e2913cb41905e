"""Result files (K rows): rows become lines or documents in the plan; Spark writes them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered


def camera_number(camera: Column) -> Column:
    """K1: the number at the end of a camera's name, 0 without one."""
    return F.coalesce(F.regexp_extract(camera, r"(\d+)$", 1).try_cast("int"), F.lit(0))


def submission(df: DataFrame) -> DataFrame:
    """`camera id frame-1 x y w h wx wy` lines of rows with a global id, by camera, frame and id.

    `df` has camera, frame, global_id, box, wx, wy.
    """
    b = F.col("box")
    cam = camera_number(F.col("camera"))
    rows = df.where("global_id is not null").select(cam.alias("cam"), "frame", "global_id", F.format_string("%d %d %d %d %d %d %d %.6f %.6f", cam.cast("long"), F.col("global_id").cast("long"), (F.col("frame") - 1).cast("long"), b["x1"].cast("long"), b["y1"].cast("long"), (b["x2"] - b["x1"]).cast("long"), (b["y2"] - b["y1"]).cast("long"), F.coalesce("wx", F.lit(0.0)), F.coalesce("wy", F.lit(0.0))).alias("line"))
    return rows.orderBy("cam", "frame", "global_id").select("line")


def world_lines(df: DataFrame, flat: bool = False) -> DataFrame:
    """K2, K3, K4: `scene class id frame x y z w l h yaw`, averaged over cameras; missing parts are 0, and z too with `flat`."""
    parts = ["x", "y", "z", "w", "l", "h", "yaw"]
    mean = df.groupBy("scene", "class_id", "global_id", "frame").agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in parts))
    if flat:
        mean = mean.withColumn("z", F.lit(0.0))
    head = [F.col(c).cast("long") for c in ("scene", "class_id", "global_id", "frame")]
    return mean.orderBy("scene", "frame", "global_id").select(F.format_string("%d %d %d %d " + " ".join(["%.2f"] * 7), *head, *(F.col(c) for c in parts)).alias("line"))


def frame_document(df: DataFrame) -> DataFrame:
    """K5: for each frame the list of its objects, averaged over cameras, with a map from camera to box."""
    b = F.col("box")
    mean = df.groupBy("frame", "global_id").agg(F.first("class_name", ignorenulls=True).alias("class_name"), F.array(*(F.avg(c) for c in "xyz")).alias("location"), F.array(*(F.avg(c) for c in "wlh")).alias("scale"), F.array(F.lit(0.0), F.lit(0.0), F.avg("yaw")).alias("rotation"), F.map_from_entries(F.collect_list(F.struct("camera", F.array(b["x1"], b["y1"], b["x2"], b["y2"])))).alias("boxes"))
    item = F.struct(F.col("class_name").alias("object type"), F.col("global_id").alias("object id"), F.col("location").alias("3d location"), F.col("scale").alias("3d bounding box scale"), F.col("rotation").alias("3d bounding box rotation"), F.col("boxes").alias("2d bounding box visible"))
    # Objects are written one by one and sorted as text by id: no search through the frame for each.
    bag = mean.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("global_id", F.to_json(item).alias("text")))).alias("items"))
    return bag.select("frame", F.concat(F.lit("["), F.concat_ws(",", "items.text"), F.lit("]")).alias("objects"))


def evaluation_lines(df: DataFrame, frame_shift: int = 0, swap: bool = False) -> DataFrame:
    """K6, K7: `frame,id,x,y,z,l,w,h,score,-1,-1,-1`; `swap` exchanges length and width."""
    l, w = ("w", "l") if swap else ("l", "w")
    nums = [F.col(c).cast("double") for c in ("x", "y", "z", l, w, "h")]
    return df.orderBy("frame", "id").select(F.format_string("%d,%d," + ",".join(["%.6f"] * 6) + ",%.6f,-1,-1,-1", (F.col("frame") + frame_shift).cast("long"), F.col("id").cast("long"), *nums, F.coalesce("score", F.lit(1.0)).cast("double")).alias("line"))


def mot_lines(df: DataFrame) -> DataFrame:
    """`frame,id,left,top,width,height,score,-1,-1,-1`."""
    b = F.col("box")
    return df.orderBy("frame", "id").select(F.format_string("%d,%d,%.2f,%.2f,%.2f,%.2f,%.4f,-1,-1,-1", F.col("frame").cast("long"), F.col("id").cast("long"), b["x1"], b["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"], F.col("score").cast("double")).alias("line"))


def kitti_lines(df: DataFrame, kind: str = "Pedestrian") -> DataFrame:
    """K9: KITTI tracking lines for boxes without 3-D parts."""
    b = F.col("box")
    return df.orderBy("frame", "id").select(F.format_string(f"%d %d {kind} -1 -1 -10 %.2f %.2f %.2f %.2f -1 -1 -1 -1000 -1000 -1000 -10 %.4f", F.col("frame").cast("long"), F.col("id").cast("long"), b["x1"], b["y1"], b["x2"], b["y2"], F.col("score").cast("double")).alias("line"))


def mask_lines(df: DataFrame) -> DataFrame:
    """`frame id class score height width rle`."""
    return df.orderBy("frame", "id").select(F.concat_ws(" ", "frame", "id", "class_id", F.format_string("%.4f", F.col("score").cast("double")), "height", "width", "counts").alias("line"))


def coco_document(images: DataFrame, annotations: DataFrame, categories: DataFrame, by: str | None = None) -> DataFrame:
    """JSON documents; annotations get numbers from 1 in order of image, box and category.

    With `by`, a column of images and annotations such as a scene, there is one
    document for each of its values (column `by` beside `document`), else one for
    all: that is one value, for exports that fit one.  Every document has all categories.
    """
    rows = numbered(annotations, ["image_id", "x", "y", "category_id", "w", "h"], "id")
    item = F.struct("id", "image_id", "category_id", F.array("x", "y", "w", "h").alias("bbox"), (F.col("w") * F.col("h")).alias("area"), F.lit(0).alias("iscrowd"))
    key = [by] if by else []
    a = images.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*(c for c in images.columns if c != by)))).alias("images"))
    b = rows.groupBy(*key).agg(F.sort_array(F.collect_list(item)).alias("annotations"))
    c = categories.agg(F.sort_array(F.collect_list(F.struct(*categories.columns))).alias("categories"))
    both = a.join(b, by, "full") if by else a.crossJoin(b)
    return both.crossJoin(c).select(*key, F.to_json(F.struct("images", "annotations", "categories")).alias("document"))


def metric_table(parts: DataFrame, by: str = "seq", fields: Sequence[str] | None = None) -> DataFrame:
    """K8: one row a sequence, one column a field; values by alpha have names such as HOTA___50."""
    name = F.when(F.col("alpha").isNull(), F.col("field")).otherwise(F.concat("field", F.lit("___"), F.round(F.col("alpha") * 100).cast("int").cast("string")))
    rows = parts.withColumn("name", name)
    return rows.groupBy(by).pivot("name", list(fields) if fields else None).agg(F.first("value"))


def next_number(names: Sequence[str], prefix: str = "exp") -> int:
    """The number after the greatest one among folder names such as exp3."""
    taken = [int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit()]
    return max(taken, default=0) + 1


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes lines in their order.  A sorted table is written as sorted part files; nothing is gathered into one task."""
    lines.write.mode("overwrite").text(path)
