"""Row filters and removal of noise (F, E and S rows of the inventory)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered
from .pairs import back_to_rows


def score_bands(score: Column, low: float = 0.1, high: float = 0.5) -> Column:
    """F2: "high" over `high`, "low" strictly between the two, null elsewhere (a score equal to `high` too)."""
    return F.when(score > high, "high").when((score > low) & (score < high), "low")


def size_limits(w: Column, h: Column, least_area: float, most_ratio: float) -> Column:
    """boxes of more than `least_area` and at most `most_ratio` as wide as high."""
    return (w * h > least_area) & (w / F.nullif(h.cast("double"), F.lit(0.0)) <= most_ratio)


def first_of_each(df: DataFrame, key: Sequence[str], order: Sequence[str], valid: Column | None = None) -> DataFrame:
    """Rows that are valid, and of those with an equal key the first."""
    if valid is not None:
        df = df.where(valid)
    return df.withColumn("_row", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_row = 1").drop("_row")


def short_as_noise(df: DataFrame, track: Sequence[str], id_col: str, limit: int) -> DataFrame:
    """The id of tracks of at most `limit` rows becomes -1."""
    n = F.count("*").over(Window.partitionBy(*track))
    return df.withColumn("_n", n).withColumn(id_col, F.when(F.col("_n") <= limit, F.lit(-1).cast(df.schema[id_col].dataType)).otherwise(F.col(id_col))).drop("_n")


def motionless(df: DataFrame, track: Sequence[str], x: str, y: str, limit: float) -> DataFrame:
    """tracks whose x and y both stay within less than `limit`."""
    span = df.groupBy(*track).agg((F.max(x) - F.min(x)).alias("span_x"), (F.max(y) - F.min(y)).alias("span_y"), F.count("*").alias("n_frames"))
    return span.where((F.col("span_x") < limit) & (F.col("span_y") < limit))


def long_tracks(df: DataFrame, id_col: str, frame: str, class_col: str, least: int) -> DataFrame:
    """rows with a class, in tracks of at least `least` rows, numbered from 1 in order of first appearance (then id)."""
    df = df.where(F.col(class_col).isNotNull())
    heads = df.groupBy(id_col).agg(F.count("*").alias("n"), F.min(frame).alias("begin")).where(F.col("n") >= least)
    heads = numbered(heads, ["begin", id_col], "new_id")
    return df.join(heads.select(id_col, "new_id"), id_col)


def small_ids(df: DataFrame, id_col: str, least_rows: int, camera: str | None = None, least_cameras: int = 0) -> DataFrame:
    """F8: ids with fewer than `least_rows` rows or, if asked for, fewer than `least_cameras` cameras."""
    stats = df.groupBy(id_col).agg(F.count("*").alias("n_rows"), *([F.countDistinct(camera).alias("n_cameras")] if camera else []))
    few = F.col("n_rows") < least_rows
    return stats.where(few | (F.col("n_cameras") < least_cameras) if camera else few)


def without(df: DataFrame, others: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not among the others."""
    return df.join(others.select(*key).distinct(), list(key), "left_anti")


def distant_outliers(df: DataFrame, group: Sequence[str], member: str, x: str, y: str, least: int = 3, limit: float = 7.0) -> DataFrame:
    """in each group of at least `least` members whose farthest pair is over `limit` apart, the member with the greatest sum of distances.

    Ties go to the smaller member.  A member has one row in a group; those at one
    place meet others once, and their sums are equal to the last bit.
    """
    places = df.groupBy(*group, F.col(x).alias("ax"), F.col(y).alias("ay")).agg(F.count("*").alias("n"))
    others = places.select(*group, F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("n").alias("m"))
    pairs = places.join(others, list(group)).withColumn("d", F.sqrt(F.pow(F.col("ax") - F.col("bx"), F.lit(2.0)) + F.pow(F.col("ay") - F.col("by"), F.lit(2.0))))
    sums = pairs.groupBy(*group, "ax", "ay").agg(F.sum(F.col("d") * F.col("m")).alias("total"), F.max("d").alias("far"), (F.sum("m") - 1).alias("others"))
    sums = back_to_rows(df.select(*group, F.col(member).alias("a"), F.col(x).alias("ax"), F.col(y).alias("ay")), sums, [*group, "ax", "ay"]).where("others > 0")
    w = Window.partitionBy(*group)
    sums = sums.withColumn("far", F.max("far").over(w)).withColumn("_row", F.row_number().over(w.orderBy(F.round("total", 9).desc(), "a")))
    return sums.where((F.col("_row") == 1) & (F.col("others") + 1 >= least) & (F.col("far") > limit)).select(*group, F.col("a").alias(member), F.col("total").alias("distance_sum"))


def keypoints_sure(keypoints: Column, joints: Sequence[int], limit: float) -> Column:
    """whether all the joints' scores reach `limit`."""
    return F.forall(F.array(*[F.lit(j) for j in joints]), lambda j: F.coalesce(F.get(keypoints, j)["score"] >= limit, F.lit(False)))


def frame_range(df: DataFrame, frame: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """frames from `first` to `last`, both included."""
    if first is not None:
        df = df.where(F.col(frame) >= first)
    return df if last is None else df.where(F.col(frame) <= last)


def first_frames(df: DataFrame, group: Sequence[str], frame: str, n: int) -> DataFrame:
    """Rows of the first `n` distinct frames of each group."""
    return df.withColumn("_rank", F.dense_rank().over(Window.partitionBy(*group).orderBy(frame))).where(F.col("_rank") <= n).drop("_rank")


def completed(df: DataFrame, id_col: str, frame: str, total: int) -> DataFrame:
    """whether each id has been seen up to the end."""
    return df.groupBy(id_col).agg(F.max(frame).alias("last_frame")).withColumn("completed", F.col("last_frame") >= total)


def dense_ids(df: DataFrame, group: Sequence[str], id_col: str) -> DataFrame:
    """Ids replaced by 0, 1, ... in their order, per group, as `dense_id`."""
    return df.withColumn("dense_id", F.dense_rank().over(Window.partitionBy(*group).orderBy(id_col)) - 1)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def repeated_ids(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, which an evaluation must not have."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def unique_across(df: DataFrame, id_col: str, owner: str) -> DataFrame:
    """`unique_id` keeps an id for its least owner and gives (id, owner) pairs of others numbers above all ids, in order."""
    pairs = df.select(id_col, owner).distinct().withColumn("_rank", F.row_number().over(Window.partitionBy(id_col).orderBy(owner)))
    top = pairs.agg(F.max(id_col).alias("_top"))
    moved = numbered(pairs.where("_rank > 1"), [id_col, owner], "_n").crossJoin(F.broadcast(top)).withColumn("unique_id", F.col("_top") + F.col("_n"))
    named = pairs.where("_rank = 1").select(id_col, owner, F.col(id_col).alias("unique_id")).unionByName(moved.select(id_col, owner, "unique_id"))
    return df.join(named, [id_col, owner])


def timesteps(df: DataFrame, video: str, order: str) -> DataFrame:
    """Place of each image in its video, from 0."""
    return df.withColumn("timestep", F.row_number().over(Window.partitionBy(video).orderBy(order)) - 1)


def noise_level(keypoints: Column, sure: float = 0.75) -> Column:
    """4 without a sure joint, 3 with one, 2 with two of which none is of the head (places 0 to 4), else 0."""
    places = F.filter(F.transform(keypoints, lambda k, i: F.when(k["score"] > sure, i)), lambda i: i.isNotNull())
    n = F.size(places)
    return F.when(n == 0, 4).when(n == 1, 3).when((n == 2) & (F.array_min(places) > 4), 2).otherwise(0)


def without_noise_images(df: DataFrame, keypoints: DataFrame, key: Sequence[str], global_id: str = "global_id", box: str = "box", joints: str = "keypoints", widest: float = 3.0, tallest: float = 5.0, small: float = 100.0) -> DataFrame:
    """rows with a global id and key points, whose box is no sliver and whose key points are sure enough.

    Noise level 2 is let pass where the box's shorter side is under `small`.
    `keypoints` has the key and `joints`; of several, the first by level counts.
    """
    levels = keypoints.groupBy(*key).agg(F.min(noise_level(F.col(joints))).alias("_level"))
    b = F.col(box)
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    fits = (w <= widest * h) & (h <= tallest * w)
    sure = (F.col("_level") < 2) | ((F.col("_level") == 2) & (F.least(w, h) < small))
    return df.where(F.col(global_id).isNotNull()).join(levels, list(key)).where(fits & sure).drop("_level")


def eligible(df: DataFrame, n: str, score: str, least_rows: int, most_score: float, class_col: str | None = None, posed: Sequence[str] = ("Person", "FourierGR1T2", "AgilityDigit")) -> DataFrame:
    """representatives of tracks of at least `least_rows` rows whose condition is at most `most_score`; with `class_col` only classes that have a pose are held to it."""
    good = F.col(score) <= most_score
    if class_col is not None:
        good = good | ~F.col(class_col).isin(*posed)
    return df.where((F.col(n) >= least_rows) & good)


def largest(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """The greatest value of a column, over all rows or by group."""
    return df.groupBy(*by).agg(F.max(column).alias(column))


def numeric_order(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in order of columns that hold numbers as text, those that are none at the end, as text."""
    return df.orderBy(*(c for name in columns for c in (F.col(name).try_cast("long").asc_nulls_last(), F.col(name))))


def numeric_places(df: DataFrame, *columns: str, name: str = "place") -> DataFrame:
    """Each row's place (from 1) in the order of `numeric_order`, numbered by ranges."""
    keys = {f"_key_{i}_{kind}": c for i, column in enumerate(columns) for kind, c in (("none", F.col(column).try_cast("long").isNull()), ("number", F.col(column).try_cast("long")), ("text", F.col(column)))}
    return numbered(df.withColumns(keys), list(keys), name).drop(*keys)


def countable(df: DataFrame, visibility: str = "visibility", least: float = 0.4, classes: Sequence[int] | None = None, class_col: str = "class_id", counts: str | None = "counts") -> DataFrame:
    """ground-truth rows that are visible enough, of one of `classes` and not marked as not to count."""
    rows = df.where(F.col(visibility) > least)
    if classes is not None:
        rows = rows.where(F.col(class_col).isin(*classes))
    return rows if counts is None else rows.where(F.col(counts))


def earliest(df: DataFrame, group: Sequence[str], first_frame: str, *ties: str) -> DataFrame:
    """Of each group (a scene's open tracks, say) the row that begins first."""
    return df.withColumn("_row", F.row_number().over(Window.partitionBy(*group).orderBy(first_frame, *ties))).where("_row = 1").drop("_row")
