"""Points and boxes at one place meet others once, with the results of all pairs (which do not come to an end for this many)."""

from pyspark.sql import functions as F

from trackloom.functions.geometry import box
from trackloom.operators import filters, pairs


def points(spark, n):
    return spark.range(n).selectExpr("id % 2 as t", "id", "cast(id div 2 % 5 * 10 as double) as x", "0.0D as y")


def test_many_points_at_few_places(spark):
    rows = points(spark, 120_000)
    out = filters.distant_outliers(rows, ["t"], "id", "x", "y").orderBy("t").collect()
    assert [(r.t, r.id, r.distance_sum) for r in out] == [(t, t, 12_000 * 100.0) for t in (0, 1)]
    right = rows.where("x < 20").withColumnRenamed("id", "r")
    near = pairs.nearest(rows, right, ["t"], "id", "r", ["x", "y"])
    assert near.count() == 120_000 and near.where("r <> if(id div 2 % 5 = 0, t, t + 2) or distance <> greatest(id div 2 % 5 * 10 - 10, 0)").isEmpty()


def test_many_boxes_of_few_kinds(spark):
    rows = points(spark, 120_000).withColumn("box", box(F.col("x"), F.col("y"), F.col("x") + 8, F.lit(8.0)))
    right = rows.where("id >= 10").withColumnRenamed("id", "r")
    top = pairs.top_overlaps(rows, right, ["t"], "id", "r", alone=0.9)
    assert top.count() == 120_000 and top.where("r <> id % 10 + 10 or iou <> 1 or near <> 11999").isEmpty()
    one = rows.where("id < 10").withColumnRenamed("id", "r")
    assert pairs.best_overlap(rows, one, ["t"], "id", "r").where("r = id % 10").count() == 120_000
