"""The star-schema test tables in the roles of the tracking model, in Spark and as SQL with the same columns.

`ev` numbers events by six-hour frames; `trk` keeps the first event of each user
(a track) and frame, with a box and a point made from the event's number.  Even
users stand for ground truth, odd ones for a tracker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import box
from ..operators.filters import first_of_each

FRAME = 21_600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    sec = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return rows.select("event_id", "user_id", "event_type", "value", sec.alias("sec"), F.expr(f"{_SPARK_SEC} div {FRAME}").alias("frame"))


_SPARK_SEC = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"
_EXTRA = {
    "x1": "cast((event_id * 37) % 100 as double)",
    "y1": "cast((event_id * 53) % 100 as double)",
    "x2": "cast((event_id * 37) % 100 + 40 + event_id % 60 as double)",
    "y2": "cast((event_id * 53) % 100 + 30 + event_id % 50 as double)",
    "score": "cast(event_id % 101 as double) / 101",
}


def trk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_of_each(ev(spark, sf_dir), ["user_id", "frame"], ["event_id"])
    rows = rows.withColumns({k: F.expr(v) for k, v in _EXTRA.items()})
    return rows.withColumn("box", box("x1", "y1", "x2", "y2"))


EV = f"ev AS (SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(floor(epoch(ts)) AS BIGINT) // {FRAME} AS frame FROM events)"
TRK = EV + ", trk AS (SELECT * EXCLUDE (rn), " + ", ".join(f"{v} AS {k}" for k, v in _EXTRA.items()) + " FROM (SELECT *, row_number() OVER (PARTITION BY user_id, frame ORDER BY event_id) AS rn FROM ev) WHERE rn = 1)"
#: SQL forms of geometry, for boxes with prefixes a and b.
INTER = "(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0))"
AREA = "((a.x2 - a.x1) * (a.y2 - a.y1))"
AREB = "((b.x2 - b.x1) * (b.y2 - b.y1))"
IOU = f"({INTER} / ({AREA} + {AREB} - {INTER}))"
