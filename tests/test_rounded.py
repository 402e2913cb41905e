"""Doubles rounded without decimals, and values of pairs told once for equal boxes."""

import math
import random

from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.operators import pairs


def test_rounded_is_round(spark):
    r = random.Random(3)
    values = [r.uniform(-2, 2) for _ in range(20_000)] + [r.randrange(-3000, 3000) / r.randrange(1, 6000) for _ in range(20_000)]
    values += [k / 2e6 for k in range(-2001, 2001)] + [math.nextafter(k / 2e6, s) for k in range(-2001, 2001) for s in (-9, 9)]
    values += [0.0, -0.0, -1e-9, 1e-9, 99.9999995, 1e8, -1e8, 123456.7890125, 1e300, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    both = df.select("v", F.round("v", 6).cast("string").alias("a"), G.rounded(F.col("v")).cast("string").alias("b"))
    assert both.where("not (a <=> b)").collect() == []


def test_equal_boxes_are_told_once_and_all_members_are_paired(spark):
    left = spark.createDataFrame([(f, i, float(i % 3)) for f in range(2) for i in range(30)], "f int, l int, a double")
    right = spark.createDataFrame([(f, i, float(i % 2)) for f in range(1, 3) for i in range(40)], "f int, r int, b double")
    seen = []

    def of(met):
        seen.append(met.count())
        return met.where("a <> b").withColumn("d", F.col("a") - F.col("b"))

    got = sorted(map(tuple, pairs.kinds_meeting(left, right, ["f"], "l", "r", "a", "b", of).collect()))
    assert got == sorted((1, i, j, float(i % 3 - j % 2)) for i in range(30) for j in range(40) if i % 3 != j % 2)
    assert seen == [3 * 2]


def test_solids_that_meet_have_the_iou_of_each_pair(spark):
    r = random.Random(5)
    rows = [(k % 3, k, *(r.uniform(0, 9) for _ in range(3)), *(r.uniform(1, 8) for _ in range(3))) for k in range(60)]
    df = spark.createDataFrame(rows, "f int, i int, x double, y double, z double, l double, w double, h double").select("f", "i", F.struct("x", "y", "z", "l", "w", "h").alias("s"))
    got = {tuple(x) for x in pairs.solids_meeting(df, ["f"], "i", "s", "p", "q").collect()}
    one, two = df.select("f", F.col("i").alias("p"), F.col("s").alias("a")), df.select("f", F.col("i").alias("q"), F.col("s").alias("b"))
    assert got == {tuple(x) for x in one.join(two, "f").where("p < q").select("f", "p", "q", G.iou_3d(F.col("a"), F.col("b")).alias("iou")).where("iou > 0").collect()}
    assert 0 < len(got) < 3 * 190
