"""Values of the rows from each one on: right, and by a frame that grows backwards, as one that begins at each row is read again for every row."""

from pyspark.sql import functions as F

from trackloom.operators import detection as D
from trackloom.operators import windows as W

AGAIN = "currentrow$(), unboundedfollowing$()"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_envelope_of_precision(spark):
    rows = [("a", k, 100 - k, k % 3 == 0) for k in range(40)] + [("b", 0, 1, False)]
    df = spark.createDataFrame(rows, "kind string, id int, score int, hit boolean").withColumn("hit", F.col("hit").cast("int"))
    totals = spark.createDataFrame([("a", 14), ("b", 1)], "kind string, n_gt int")
    got = D.precision_recall(df, ["kind"], "score", "hit", totals, "id")
    assert AGAIN not in plan(got)
    own = {r["id"]: r["envelope"] for r in got.where("kind = 'a'").collect()}
    precision = [sum(k % 3 == 0 for k in range(n + 1)) / (n + 1) for n in range(40)]
    assert own == {n: max(precision[n:]) for n in range(40)}


def test_envelope_and_nearest_value(spark):
    values = [0, 0, 3, 0, 0, 0, 0, 5, 0, 0]
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)], "track string, t int, v int")
    upper, near = W.envelope(df, ["track"], "t", "v"), W.nearest_nonzero(df, ["track"], "t", "v")
    assert AGAIN not in plan(upper) and AGAIN not in plan(near)
    assert [r["envelope"] for r in upper.orderBy("t").collect()] == [max(values[k:]) for k in range(10)]
    assert [r["v"] for r in near.orderBy("t").collect()] == [3, 3, 3, 3, 3, 5, 5, 5, 5, 5]
