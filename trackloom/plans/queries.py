"""Operators of the inventory on the test tables, each with SQL that must give the same rows.

broken by a unique key, so that both sides agree to the last digit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import names as N
from ..functions import vectors as V
from ..operators import aggregates as A
from ..operators import detection as D
from ..operators import filters as X
from ..operators import metrics as M
from ..operators import online, pairs, ranking, retrieval, windows
from ..sources import writers
from .tables import AREA, EV, FRAME, INTER, IOU, TRK, ev, table, trk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


def q6(df, *names):
    """`df` with doubles as `r6` rounds them, where there are many; they are columns already, so each is worked out once."""
    return df.withColumns({n: G.rounded(F.col(n)) for n in names})


# Tracks as ordered rows.


@query(f"WITH {EV} SELECT user_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n_rows, count(DISTINCT event_type) AS n_event_type FROM ev GROUP BY user_id HAVING count(*) > 3")
def a5_track_summary(spark, sf):
    rows = ev(spark, sf).groupBy("user_id").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("n_rows"), F.countDistinct("event_type").alias("n_event_type"))
    return rows.where("n_rows > 3")


@query(f"WITH {EV} SELECT * EXCLUDE (rn) FROM (SELECT user_id, frame, event_type, event_id, row_number() OVER (PARTITION BY user_id, frame, event_type ORDER BY event_id) AS rn FROM ev WHERE value > 0) WHERE rn = 1")
def s5_dedup_first(spark, sf):
    return X.first_of_each(ev(spark, sf), ["user_id", "frame", "event_type"], ["event_id"], F.col("value") > 0).select("user_id", "frame", "event_type", "event_id")


@query(f"WITH {EV} SELECT frame, event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_user_id FROM ev GROUP BY ALL")
def w1_tumbling_counts(spark, sf):
    rows = ev(spark, sf).withColumn("frame", windows.tumbling(F.col("sec"), FRAME))
    return A.counts(rows, ["frame", "event_type"], ["user_id"])


@query(f"WITH {EV}, s AS (SELECT user_id, frame // 4 AS section, round(sum(value), 6) AS total FROM ev GROUP BY ALL) SELECT a.user_id, a.section, a.total, b.total AS previous FROM s a LEFT JOIN s b ON a.user_id = b.user_id AND b.section = a.section - 1")
def w2_previous_section(spark, sf):
    rows = ev(spark, sf).groupBy("user_id", F.expr("frame div 4").alias("section")).agg(r6(F.sum("value")).alias("total"))
    return windows.previous_section(rows, ["user_id"], "section", "total")


@query(f"""WITH {TRK}, n AS (SELECT *, lead(frame) OVER w AS nf, lead(x1) OVER w AS nx, lead(value) OVER w AS nv FROM trk WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
g AS (SELECT *, unnest(CASE WHEN nf - frame BETWEEN 2 AND 20 THEN range(frame, nf) ELSE [frame] END) AS f FROM n)
SELECT user_id, f AS frame, round(x1 + (CASE WHEN f > frame THEN (nx - x1) * (f - frame) / (nf - frame) ELSE 0 END), 6) AS x1, round(value + (CASE WHEN f > frame THEN (nv - value) * (f - frame) / (nf - frame) ELSE 0 END), 6) AS value, event_type, f > frame AS filled FROM g""")
def w3_gap_fill_linear(spark, sf):
    out = windows.fill_gaps(trk(spark, sf), ["user_id"], "frame", ["x1", "value"], ["event_type"], max_gap=20)
    return out.select("user_id", "frame", r6("x1").alias("x1"), r6("value").alias("value"), "event_type", "filled")


@query(f"""WITH {EV}, z AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN round(value, 4) ELSE 0.0 END AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM ev),
k AS (SELECT *, last_value(CASE WHEN v <> 0 THEN r END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS br, first_value(CASE WHEN v <> 0 THEN r END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ar FROM z)
SELECT k.event_id, k.user_id, coalesce(n.v, k.v) AS v FROM k LEFT JOIN z n ON n.user_id = k.user_id AND n.r = CASE WHEN k.ar IS NOT NULL AND (k.br IS NULL OR k.ar - k.r < k.r - k.br) THEN k.ar ELSE k.br END""")
def w6_nearest_nonzero(spark, sf):
    rows = ev(spark, sf).select("event_id", "user_id", F.expr("case when event_id % 3 = 0 then round(value, 4) else 0.0D end").alias("v"))
    return windows.nearest_nonzero(rows, ["user_id"], "event_id", "v")


@query(f"WITH {EV}, s AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS d FROM ev) SELECT user_id, round(coalesce(sum(d), 0), 4) AS path_length, count(*) AS n_points FROM s GROUP BY user_id")
def w14_path_length(spark, sf):
    return windows.path_length(ev(spark, sf), ["user_id"], "event_id", ["value"]).withColumn("path_length", F.round("path_length", 4))


@query(f"WITH {EV} SELECT event_id, user_id, list_sort(list(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS history FROM ev")
def w10_history(spark, sf):
    return windows.history(ev(spark, sf).select("event_id", "user_id"), ["user_id"], "event_id", "event_id", 5)


@query(f"WITH {EV} SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r FROM ev) WHERE r % 5 = 0")
def w12_stride_sample(spark, sf):
    return windows.stride(ev(spark, sf).select("event_id", "user_id"), ["user_id"], ["event_id"], 5)


@query("SELECT o_orderkey, o_custkey, CASE WHEN r <= n // 2 THEN 'train' ELSE 'val' END AS half FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)")
def w13_half_split(spark, sf):
    return windows.halves(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"])


@query(f"WITH {EV}, r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM ev) SELECT event_id, user_id, CAST(i AS INTEGER) AS pick FROM r, range(8) t(i) WHERE floor(i * n / 8.0) = r")
def w15_even_sample(spark, sf):
    return windows.even_sample(ev(spark, sf).select("event_id", "user_id"), ["user_id"], ["event_id"], 8)


@query(f"WITH {TRK}, b AS (SELECT user_id, frame, CASE WHEN frame - lag(frame) OVER (PARTITION BY user_id ORDER BY frame) > 3 THEN 1 ELSE 0 END AS n FROM trk) SELECT user_id, frame, sum(n) OVER (PARTITION BY user_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS session FROM b")
def r10_track_sessions(spark, sf):
    return windows.sessions(trk(spark, sf).select("user_id", "frame"), ["user_id"], "frame", 3)


@query(f"""WITH {TRK}, d AS (SELECT user_id, frame, x1 - lag(x1, 6) OVER w AS dx, y1 - lag(y1, 6) OVER w AS dy FROM trk WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
u AS (SELECT user_id, frame, CASE WHEN sqrt(dx * dx + dy * dy) > 0.05 THEN dx / sqrt(dx * dx + dy * dy) END AS c, CASE WHEN sqrt(dx * dx + dy * dy) > 0.05 THEN dy / sqrt(dx * dx + dy * dy) END AS s FROM d)
SELECT user_id, frame, round(coalesce(atan2(sum(s) OVER w, sum(c) OVER w), 0.0), 5) AS yaw FROM u WINDOW w AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 43 PRECEDING AND CURRENT ROW)""")
def p18_circular_yaw(spark, sf):
    return windows.motion_yaw(trk(spark, sf), ["user_id"], "frame", "x1", "y1").select("user_id", "frame", F.round("yaw", 5).alias("yaw"))


@query(f"WITH {EV} SELECT event_id, user_id, max(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM (SELECT *, round(value, 4) AS v FROM ev)")
def w8_envelope(spark, sf):
    return windows.envelope(ev(spark, sf).withColumn("v", F.round("value", 4)), ["user_id"], "event_id", "v").select("event_id", "user_id", "envelope")


# Filters.


@query(f"WITH {TRK} SELECT event_id, CASE WHEN score > 0.5 THEN 'high' WHEN score > 0.1 AND score < 0.5 THEN 'low' END AS band, score > 0.1 AS kept FROM trk")
def f2_score_bands(spark, sf):
    return trk(spark, sf).select("event_id", X.score_bands(F.col("score")).alias("band"), (F.col("score") > 0.1).alias("kept"))


@query(f"WITH {TRK} SELECT event_id FROM trk WHERE (x2 - x1) * (y2 - y1) > 3000 AND (x2 - x1) / (y2 - y1) <= 1.6")
def f3_size_limits(spark, sf):
    b = F.col("box")
    return trk(spark, sf).where(X.size_limits(G.width(b), G.height(b), 3000, 1.6)).select("event_id")


@query(f"WITH {EV} SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY user_id, event_type) <= 10 THEN -1 ELSE user_id END AS user_id FROM ev")
def f4_short_tracks(spark, sf):
    rows = ev(spark, sf).withColumn("own", F.col("user_id"))
    return X.short_as_noise(rows, ["own", "event_type"], "user_id", 10).select("event_id", "user_id")


@query(f"WITH {TRK} SELECT user_id, max(x1) - min(x1) AS span_x, max(y1) - min(y1) AS span_y, count(*) AS n_frames FROM trk GROUP BY user_id HAVING max(x1) - min(x1) < 99 AND max(y1) - min(y1) < 99")
def f5_motionless(spark, sf):
    return X.motionless(trk(spark, sf), ["user_id"], "x1", "y1", 99)


@query(f"WITH {TRK}, h AS (SELECT user_id, count(*) AS n, min(frame) AS f FROM trk WHERE event_type <> 'click' GROUP BY user_id HAVING count(*) >= 20), m AS (SELECT user_id, row_number() OVER (ORDER BY f, user_id) AS new_id FROM h) SELECT user_id, frame, new_id FROM trk JOIN m USING (user_id) WHERE event_type <> 'click'")
def f6_long_tracks(spark, sf):
    rows = trk(spark, sf).withColumn("kind", F.when(F.col("event_type") != "click", F.col("event_type")))
    return X.long_tracks(rows, "user_id", "frame", "kind", 20).select("user_id", "frame", F.col("new_id").cast("long").alias("new_id"))


@query(f"WITH {EV} SELECT user_id, count(*) AS n_rows, count(DISTINCT event_type) AS n_cameras FROM ev GROUP BY user_id HAVING count(*) < 60 OR count(DISTINCT event_type) < 5")
def f8_small_ids(spark, sf):
    return X.small_ids(ev(spark, sf), "user_id", 60, "event_type", 5)


@query(f"""WITH {TRK}, p AS (SELECT a.frame, a.user_id, sqrt((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2) AS d FROM trk a JOIN trk b ON a.frame = b.frame AND a.user_id <> b.user_id),
s AS (SELECT frame, user_id, sum(d) AS t, max(d) AS m, count(*) AS n FROM p GROUP BY ALL),
r AS (SELECT *, max(m) OVER (PARTITION BY frame) AS far, row_number() OVER (PARTITION BY frame ORDER BY round(t, 9) DESC, user_id) AS k FROM s)
SELECT frame, user_id, round(t, 4) AS distance_sum FROM r WHERE k = 1 AND n >= 2 AND far > 7""")
def f9_distant_outlier(spark, sf):
    return X.distant_outliers(trk(spark, sf), ["frame"], "user_id", "x1", "y1").withColumn("distance_sum", F.round("distance_sum", 4))


@query(f"WITH {EV} SELECT event_id, user_id, frame FROM (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY frame) AS r FROM ev) WHERE r <= 3")
def f10_first_frames(spark, sf):
    return X.first_frames(ev(spark, sf), ["user_id"], "frame", 3).select("event_id", "user_id", "frame")


@query(f"WITH {EV} SELECT user_id, max(frame) AS last_frame, max(frame) >= 79000 AS completed FROM ev GROUP BY user_id")
def f14_completed(spark, sf):
    return X.completed(ev(spark, sf), "user_id", "frame", 79_000)


@query("SELECT o_orderkey, o_custkey, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) - 1 AS dense_id FROM orders")
def e10_dense_relabel(spark, sf):
    return X.dense_ids(table(spark, sf, "orders"), ["o_orderstatus"], "o_custkey").select("o_orderkey", "o_custkey", F.col("dense_id").cast("long").alias("dense_id"))


@query(f"WITH {EV} SELECT user_id, frame, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) > 1")
def e11_repeated_ids(spark, sf):
    return X.repeated_ids(ev(spark, sf), ["user_id", "frame"])


@query(f"WITH {EV} SELECT event_id, frame, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY value DESC, event_id) AS r FROM ev) WHERE r <= 5")
def e12_topk_per_group(spark, sf):
    out = X.top_per_group(ev(spark, sf), ["frame"], [F.desc("value"), F.asc("event_id")], 5)
    return out.select("event_id", "frame", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {EV}, p AS (SELECT DISTINCT user_id, event_type FROM ev), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS r FROM p), m AS (SELECT user_id, event_type, (SELECT max(user_id) FROM p) + row_number() OVER (ORDER BY user_id, event_type) AS u FROM k WHERE r > 1) SELECT ev.event_id, coalesce(m.u, ev.user_id) AS unique_id FROM ev LEFT JOIN m ON m.user_id = ev.user_id AND m.event_type = ev.event_type")
def e13_unique_track_ids(spark, sf):
    return X.unique_across(ev(spark, sf), "user_id", "event_type").select("event_id", "unique_id")


@query(f"WITH {EV} SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS timestep FROM ev")
def e14_timesteps(spark, sf):
    return X.timesteps(ev(spark, sf), "user_id", "event_id").select("event_id", F.col("timestep").cast("long").alias("timestep"))


# Boxes and points.

_PAIR = f"WITH {TRK}, p AS (SELECT a.frame, a.user_id AS gt, b.user_id AS tr, {IOU} AS iou, {INTER} AS inter, {AREA} AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ab, (greatest(a.x2, b.x2) - least(a.x1, b.x1)) * (greatest(a.y2, b.y2) - least(a.y1, b.y1)) AS hull, ((a.x1 + a.x2 - b.x1 - b.x2) / 2) ** 2 + ((a.y1 + a.y2 - b.y1 - b.y2) / 2) ** 2 AS c2, (greatest(a.x2, b.x2) - least(a.x1, b.x1)) ** 2 + (greatest(a.y2, b.y2) - least(a.y1, b.y1)) ** 2 AS d2 FROM trk a JOIN trk b ON a.frame = b.frame AND a.user_id % 2 = 0 AND b.user_id % 2 = 1)"


def _sides(spark, sf, where=None, exact=(), **values):
    """All pairs of a frame, with `values` of their boxes a and b, rounded but for those named in `exact`."""
    rows = trk(spark, sf)
    gt = rows.where("user_id % 2 = 0").select("frame", F.col("user_id").alias("gt"), F.col("box").alias("a"))
    tr = rows.where("user_id % 2 = 1").select("frame", F.col("user_id").alias("tr"), F.col("box").alias("b"))

    def of(met):
        met = met if where is None else met.where(where)
        return q6(met.withColumns(values), *(n for n in values if n not in exact)) if values else met

    return pairs.kinds_meeting(gt, tr, ["frame"], "gt", "tr", "a", "b", of)


@query(f"{_PAIR} SELECT frame, gt, tr, round(iou, 6) AS iou, round(inter / aa, 6) AS ioa FROM p")
def p8_iou(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _sides(spark, sf, iou=G.iou(a, b), ioa=G.ioa(a, b))


@query(f"{_PAIR} SELECT frame, gt, tr, round(inter / least(aa, ab), 6) AS overlap FROM p")
def p10_overlap(spark, sf):
    return _sides(spark, sf, overlap=G.overlap_coefficient(F.col("a"), F.col("b")))


@query(f"{_PAIR} SELECT frame, gt, tr, round(iou - (hull - (aa + ab - inter)) / hull, 6) AS giou, round(iou - c2 / d2, 6) AS diou, round(iou ** 2, 6) AS alpha_iou FROM p")
def p11_giou(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _sides(spark, sf, giou=G.giou(a, b), diou=G.diou(a, b), alpha_iou=G.alpha_iou(a, b))


@query(f"WITH {TRK}, c AS (SELECT frame, user_id, x1 AS x, y1 AS y, score * 10 AS z, x2 - x1 AS l, y2 - y1 AS w, 20 + user_id % 7 AS h FROM trk), p AS (SELECT a.frame, a.user_id AS gt, b.user_id AS tr, greatest(least(a.x + a.l / 2, b.x + b.l / 2) - greatest(a.x - a.l / 2, b.x - b.l / 2), 0) * greatest(least(a.y + a.w / 2, b.y + b.w / 2) - greatest(a.y - a.w / 2, b.y - b.w / 2), 0) * greatest(least(a.z + a.h / 2, b.z + b.h / 2) - greatest(a.z - a.h / 2, b.z - b.h / 2), 0) AS i, a.l * a.w * a.h + b.l * b.w * b.h AS s FROM c a JOIN c b ON a.frame = b.frame AND a.user_id < b.user_id) SELECT frame, gt, tr, round(i / (s - i), 6) AS iou FROM p WHERE i > 0")
def p12_iou3d(spark, sf):
    solid = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("score") * 10).alias("z"), (F.col("x2") - F.col("x1")).alias("l"), (F.col("y2") - F.col("y1")).alias("w"), (20 + F.col("user_id") % 7).cast("double").alias("h"))
    return q6(pairs.solids_meeting(trk(spark, sf).select("frame", "user_id", solid.alias("s")), ["frame"], "user_id", "s", "gt", "tr"), "iou")


@query(f"WITH {TRK} SELECT event_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h, round((x2 - x1) / (y2 - y1), 6) AS aspect, greatest(x1, 20) AS left, least(x2, 120) AS right FROM trk")
def p1_box_forms(spark, sf):
    b = F.col("box")
    c, y = G.to_cxcywh(b), G.to_xyah(b)
    return trk(spark, sf).select("event_id", c["cx"].alias("cx"), c["cy"].alias("cy"), c["w"].alias("w"), c["h"].alias("h"), r6(y["a"]).alias("aspect"), F.greatest(b["x1"], F.lit(20.0)).alias("left"), G.clamped(b, 120, 1000)["x2"].alias("right"))


HOMOGRAPHY = [[1.2, 0.1, 5.0], [0.05, 0.9, -3.0], [0.001, 0.002, 1.0]]


@query(f"WITH {TRK} SELECT event_id, round((1.2 * fx + 0.1 * fy + 5.0) / (0.001 * fx + 0.002 * fy + 1), 6) AS wx, round((0.05 * fx + 0.9 * fy - 3.0) / (0.001 * fx + 0.002 * fy + 1), 6) AS wy FROM (SELECT event_id, (x1 + x2) / 2 AS fx, y2 AS fy FROM trk)")
def p3_homography(spark, sf):
    f = G.foot(F.col("box"))
    # The matrix is inverted twice: as a camera's would be once, on the driver.
    world = G.project(G.inverse_3x3(G.inverse_3x3(HOMOGRAPHY)), f["x"], f["y"])
    return trk(spark, sf).select("event_id", r6(world["x"]).alias("wx"), r6(world["y"]).alias("wy"))


@query(f"{_PAIR} SELECT frame, gt, tr, round(greatest(0, 1 - sqrt(c2) / 50), 6) AS similarity, round(1 - iou * 0.9, 6) AS cost FROM p")
def p14_distance_similarity(spark, sf):
    a, b = F.col("a"), F.col("b")
    ca, cb = G.to_cxcywh(a), G.to_cxcywh(b)
    d = F.sqrt((ca["cx"] - cb["cx"]) * (ca["cx"] - cb["cx"]) + (ca["cy"] - cb["cy"]) * (ca["cy"] - cb["cy"]))
    return _sides(spark, sf, similarity=G.distance_similarity(d, 50.0), cost=G.fuse_score(G.iou(a, b), F.lit(0.9)))


@query("SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS serial, CASE p_partkey % 8 WHEN 0 THEN 'Person' WHEN 1 THEN 'Forklift' WHEN 2 THEN 'NovaCarter' WHEN 3 THEN 'Transporter' WHEN 4 THEN 'FourierGR1T2' WHEN 5 THEN 'AgilityDigit' ELSE 'Unknown' END AS class_name FROM part")
def p19_class_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", N.serial(F.col("p_partkey")).alias("serial"), N.class_name(F.col("p_partkey") % 8).alias("class_name"))


# Joins.


@query(f"{_PAIR}, n AS (SELECT frame, gt, count(*) FILTER (iou >= 0.2) AS k, max(iou) AS m, arg_max(tr, iou * 1e6 - tr * 1e-6) AS tr FROM p GROUP BY ALL) SELECT frame, gt, tr, round(m, 6) AS iou FROM n WHERE k = 1 AND m >= 0.3")
def j2_best_iou_assign(spark, sf):
    rows = trk(spark, sf)
    gt = rows.where("user_id % 2 = 0").withColumnRenamed("user_id", "gt")
    tr = rows.where("user_id % 2 = 1").withColumnRenamed("user_id", "tr")
    return pairs.best_overlap(gt, tr, ["frame"], "gt", "tr", alone=0.2, least=0.3).withColumn("iou", r6("iou"))


@query(f"WITH {TRK}, g AS (SELECT frame, user_id AS gt, x1, y1 FROM trk WHERE user_id % 2 = 0), t AS (SELECT frame, user_id AS tr, x1 AS tx, y1 AS ty FROM trk WHERE user_id % 2 = 1), p AS (SELECT g.frame, gt, tr, sqrt((x1 - tx) ** 2 + (y1 - ty) ** 2) AS d, row_number() OVER (PARTITION BY g.frame, gt ORDER BY sqrt((x1 - tx) ** 2 + (y1 - ty) ** 2), tr) AS r FROM g LEFT JOIN t ON g.frame = t.frame) SELECT frame, gt, tr, round(d, 6) AS distance FROM p WHERE r = 1")
def j3_nearest_gt(spark, sf):
    rows = trk(spark, sf)
    gt = rows.where("user_id % 2 = 0").select("frame", F.col("user_id").alias("gt"), "x1", "y1")
    tr = rows.where("user_id % 2 = 1").select("frame", F.col("user_id").alias("tr"), "x1", "y1")
    return pairs.nearest(gt, tr, ["frame"], "gt", "tr", ["x1", "y1"]).withColumn("distance", r6("distance"))


@query(f"WITH {TRK}, n AS (SELECT user_id, count(*) AS n FROM trk GROUP BY user_id), s AS (SELECT a.user_id AS id_1, b.user_id AS id_2, count(*) AS n_shared FROM trk a JOIN trk b ON a.frame = b.frame AND a.user_id < b.user_id GROUP BY ALL) SELECT id_1, id_2, n_shared, x.n AS n_1, y.n AS n_2, n_shared / least(x.n, y.n) AS ratio FROM s JOIN n x ON x.user_id = id_1 JOIN n y ON y.user_id = id_2")
def j5_pair_overlap(spark, sf):
    return pairs.overlap_ratio(trk(spark, sf).select("frame", "user_id"), "frame", "user_id")


@query(f"WITH {TRK} SELECT a.user_id AS id_1, b.user_id AS id_2, count(*) AS n_shared, round(min(sqrt((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2)), 6) AS least, round(avg(sqrt((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2)), 6) AS mean, round(max(sqrt((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2)), 6) AS greatest FROM trk a JOIN trk b ON a.frame = b.frame AND a.user_id < b.user_id GROUP BY ALL")
def j6_frame_distance(spark, sf):
    out = pairs.meeting_paths(trk(spark, sf), "user_id", "frame", ["x1", "y1"])
    return out.select("id_1", "id_2", "n_shared", *(r6(c).alias(c) for c in ("least", "mean", "greatest")))


@query(f"WITH {TRK}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY frame) AS p FROM trk) SELECT a.user_id AS id_1, b.user_id AS id_2, count(*) AS n_points, round(avg(sqrt((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2)), 6) AS distance FROM k a JOIN k b ON a.p = b.p AND a.user_id < b.user_id GROUP BY ALL")
def j7_positional_distance(spark, sf):
    return pairs.positional_distance(trk(spark, sf), "user_id", "frame", ["x1", "y1"]).withColumn("distance", r6("distance"))


@query(f"WITH {EV}, s AS (SELECT user_id * 100 + frame // 16 % 100 AS id, user_id % 4 AS cam, min(frame) AS f, max(frame) AS l FROM ev GROUP BY ALL) SELECT a.id AS id_1, b.id AS id_2, least(a.l, b.l) - greatest(a.f, b.f) + 1 AS n_shared FROM s a JOIN s b ON a.id < b.id AND a.cam <> b.cam AND least(a.l, b.l) - greatest(a.f, b.f) + 1 >= 12")
def j10_range_overlap(spark, sf):
    rows = ev(spark, sf).groupBy(F.expr("user_id * 100 + (frame div 16) % 100").alias("id"), (F.col("user_id") % 4).alias("cam")).agg(F.min("frame").alias("f"), F.max("frame").alias("l"))
    return pairs.overlapping_ranges(rows, "id", "f", "l", 12, 16, ["cam"])


_EMB = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(f"WITH {_EMB} SELECT a.vec_id AS member_1, b.vec_id AS member_2, a.label, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id")
def p16_cosine(spark, sf):
    return pairs.feature_pairs(table(spark, sf, "embeddings"), ["label"], "vec_id", "embedding").withColumn("cosine", r6("cosine"))


@query(f"WITH {_EMB}, n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS l FROM e) SELECT vec_id, list_transform(v, lambda x: round(CASE WHEN abs(l - 1) <= 0.001 OR l = 0 THEN x ELSE x / l END, 6)) AS unit FROM n")
def p17_normalise(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", V.rounded(V.normalised(F.col("embedding")), 6).alias("unit"))


@query(f"WITH {_EMB}, a AS (SELECT label AS set_1, v FROM e WHERE vec_id % 2 = 0), b AS (SELECT label AS set_2, v FROM e WHERE vec_id % 2 = 1), p AS (SELECT set_1, set_2, list_cosine_similarity(a.v, b.v) AS s FROM a, b), k AS (SELECT *, row_number() OVER (PARTITION BY set_1, set_2 ORDER BY s DESC) AS r FROM p) SELECT set_1, set_2, round(avg(s) FILTER (r <= 5), 6) AS mean_of_top, count(*) FILTER (s >= 0.3) AS n_over, any_value(n.c) AS n_1, any_value(m.c) AS n_2, count(*) FILTER (s >= 0.3) >= least(any_value(n.c), any_value(m.c), 5) AS similar FROM k JOIN (SELECT set_1 AS s1, count(*) AS c FROM a GROUP BY 1) n ON s1 = set_1 JOIN (SELECT set_2 AS s2, count(*) AS c FROM b GROUP BY 1) m ON s2 = set_2 GROUP BY set_1, set_2")
def j12_topk_pair_mean(spark, sf):
    rows = table(spark, sf, "embeddings")
    out = pairs.set_similarity(rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1"), [], "label", "label", "embedding", 5, 0.3)
    return out.withColumn("mean_of_top", r6("mean_of_top"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority LIKE '1%')")
def j15_anti(spark, sf):
    """Customers without an open order of the first priority: all have some order."""
    orders = table(spark, sf, "orders").where("o_orderstatus = 'P' and o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return X.without(table(spark, sf, "customer"), orders, ["c_custkey"]).select("c_custkey", "c_name")


@query(f"WITH {EV}, m AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN event_type END AS t FROM ev) SELECT event_id, coalesce(t, first_value(t IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS t FROM m")
def j16_fill_from_track(spark, sf):
    rows = ev(spark, sf).withColumn("t", F.expr("case when event_id % 4 = 0 then event_type end"))
    return pairs.fill_from_track(rows, ["user_id"], "event_id", "t").select("event_id", "t")


# Aggregations and sets.


@query("SELECT p_brand, count(*) AS n_rows, round(avg(p_retailprice), 6) AS mean_p_retailprice, round(stddev_pop(p_retailprice), 6) AS std_p_retailprice, round(avg(p_size), 6) AS mean_p_size, round(stddev_pop(p_size), 6) AS std_p_size FROM part GROUP BY p_brand")
def a2_class_mean_std(spark, sf):
    out = A.mean_and_deviation(table(spark, sf, "part"), ["p_brand"], ["p_retailprice", "p_size"])
    return out.select("p_brand", "n_rows", *(r6(c).alias(c) for c in out.columns[2:]))


@query("SELECT l_orderkey, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount, count(*) AS n_sensors FROM lineitem GROUP BY l_orderkey")
def a4_fuse_mean(spark, sf):
    out = A.fused(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_quantity", "l_discount"])
    return out.select("l_orderkey", r6("l_quantity").alias("l_quantity"), r6("l_discount").alias("l_discount"), "n_sensors")


@query(f"WITH {EV}, v AS (SELECT user_id, event_type, count(*) AS votes FROM ev GROUP BY ALL) SELECT user_id, event_type, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS r FROM v) WHERE r = 1")
def a6_majority_class(spark, sf):
    return A.majority(ev(spark, sf), ["user_id"], "event_type")


@query("SELECT r_name, n_name, l_returnflag, round(sum(l_quantity), 4) AS quantity, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name, n_name), (r_name), (l_returnflag), ())")
def a14_grouping_sets(spark, sf):
    supplier, nation, region = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    places = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity").join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    return A.roll_up(rows, [["r_name", "n_name"], ["r_name"], ["l_returnflag"], []], [F.round(F.sum("l_quantity"), 4).alias("quantity"), F.count("*").alias("n")])


@query(f"WITH {_EMB}, p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id), c AS (SELECT label, a, sum(CASE WHEN s > 0.2 THEN s ELSE 0 END) AS t FROM p GROUP BY ALL) SELECT label, a AS member, round(t, 5) AS centrality FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(t, 9) DESC, a) AS r FROM c) WHERE r = 1")
def a10_medoid(spark, sf):
    found = pairs.similarity_sums(table(spark, sf, "embeddings"), ["label"], "vec_id", "embedding", 0.2)
    return A.medoid_of_sums(found, ["label"]).withColumn("centrality", F.round("centrality", 5))


@query("SELECT o_orderkey AS k FROM orders UNION ALL SELECT c_custkey + (SELECT max(o_orderkey) + 1 FROM orders) FROM customer")
def u1_union_offset(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return A.offset_union(a, table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), ["k"])


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority LIKE '1%'")
def u2_except(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).exceptAll(table(spark, sf, "orders").where("o_orderstatus = 'P' and o_orderpriority like '1%'").select(F.col("o_custkey").alias("k")).distinct()).distinct()


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def u3_intersect(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")))


@query(f"WITH {TRK} SELECT user_id % 10 AS slot, frame, event_id FROM trk WHERE user_id % 20 < 10 UNION ALL SELECT user_id % 10, frame, event_id FROM trk t WHERE user_id % 20 >= 10 AND NOT EXISTS (SELECT 1 FROM trk o WHERE o.user_id % 20 < 10 AND o.user_id % 10 = t.user_id % 10 AND o.frame = t.frame)")
def u5_keep_first(spark, sf):
    rows = trk(spark, sf).select((F.col("user_id") % 10).alias("slot"), "frame", "event_id", (F.col("user_id") % 20).alias("m"))
    return A.keep_first(rows.where("m < 10").drop("m"), rows.where("m >= 10").drop("m"), ["slot", "frame"])


# Retrieval.

_NN = f"{_EMB}, q AS (SELECT * FROM e WHERE vec_id % 10 = 0), g AS (SELECT * FROM e WHERE vec_id % 10 <> 0), d AS (SELECT q.vec_id AS q, g.vec_id AS g, round(1 - list_cosine_similarity(q.v, g.v), 9) AS distance, CAST(q.label = g.label AS INTEGER) AS hit FROM q, g WHERE NOT (q.label = g.label AND q.vec_id % 4 = g.vec_id % 4)), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, g) AS rank FROM d)"


def _ranked(spark, sf):
    rows = table(spark, sf, "embeddings")
    queries, gallery = rows.where("vec_id % 10 = 0"), rows.where("vec_id % 10 <> 0")
    found = pairs.distances(queries, gallery, "vec_id", "vec_id", "embedding").withColumn("distance", F.round("distance", 9))
    return retrieval.ranked(found, queries.select(F.col("vec_id").alias("q"), F.col("label").alias("pid"), (F.col("vec_id") % 4).alias("camid")), gallery.select(F.col("vec_id").alias("g"), F.col("label").alias("pid"), (F.col("vec_id") % 4).alias("camid")))


def _searched(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("camid", F.col("vec_id") % 4)
    return rows.where("vec_id % 10 = 0"), rows.where("vec_id % 10 <> 0"), "vec_id", "vec_id", "embedding", "label", "camid"


@query(f"WITH {_EMB}, d AS (SELECT a.vec_id AS q, b.vec_id AS g, 1 - list_cosine_similarity(a.v, b.v) AS x FROM e a, e b WHERE a.vec_id % 10 = 0 AND b.vec_id % 10 <> 0) SELECT q, g, round(x, 6) AS distance, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY x, g) AS r FROM d) WHERE r <= 10")
def j18_knn(spark, sf):
    rows = table(spark, sf, "embeddings")
    out = pairs.neighbours(rows.where("vec_id % 10 = 0"), rows.where("vec_id % 10 <> 0"), "vec_id", "vec_id", "embedding", 10)
    return out.select("q", "g", r6("distance").alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_NN}, s AS (SELECT *, sum(hit) OVER (PARTITION BY q ORDER BY rank) AS seen FROM r), p AS (SELECT q, min(rank) AS f, avg(seen / rank) AS ap, count(*) / max(rank) AS inp FROM s WHERE hit = 1 GROUP BY q) SELECT CAST(i AS INTEGER) AS rank, round((SELECT count(*) FROM p WHERE f <= i) / (SELECT count(*) FROM p), 6) AS cmc, round((SELECT avg(ap) FROM p), 6) AS map, round((SELECT avg(inp) FROM p), 6) AS minp FROM range(1, 21) t(i)")
def m13_cmc_map(spark, sf):
    out = retrieval.cmc_and_map(ranking.hit_ranks(*_searched(spark, sf)), 20)
    return out.select("rank", *(r6(c).alias(c) for c in ("cmc", "map", "minp")))


@query(f"WITH {_NN}, s AS (SELECT *, sum(hit) OVER (PARTITION BY q ORDER BY rank) AS seen FROM r) SELECT q, min(rank) AS first_rank, max(rank) AS last_rank, count(*) AS n_hits, round(avg(seen / rank), 6) AS ap, round(avg((seen / rank + CASE WHEN rank > 1 THEN (seen - 1) / (rank - 1) ELSE 1 END) / 2), 6) AS ap_trapezoid FROM s WHERE hit = 1 GROUP BY q")
def m15_trapezoid_ap(spark, sf):
    out = retrieval.per_query(ranking.hit_ranks(*_searched(spark, sf)))
    return out.select("q", F.col("first_rank").cast("long").alias("first_rank"), F.col("last_rank").cast("long").alias("last_rank"), "n_hits", r6("ap").alias("ap"), r6("ap_trapezoid").alias("ap_trapezoid"))


@query(f"WITH {_NN}, f AS (SELECT q, min(rank) FILTER (hit = 1) AS m FROM r GROUP BY q) SELECT k, round(avg(CASE WHEN m <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM f, (VALUES (1), (5), (10)) t(k) GROUP BY k")
def m17_recall_at_k(spark, sf):
    searched = _searched(spark, sf)
    ranks = ranking.with_all_queries(ranking.hit_ranks(*searched), searched[0], "vec_id")
    return retrieval.recall_at(ranks, [1, 5, 10]).withColumn("recall", r6("recall"))


@query(f"WITH {_NN}, c AS (SELECT distance, sum(hit) AS p, sum(1 - hit) AS n FROM r GROUP BY distance), s AS (SELECT sum(p) OVER w / (SELECT sum(hit) FROM r) AS tpr, sum(n) OVER w / (SELECT sum(1 - hit) FROM r) AS fpr FROM c WINDOW w AS (ORDER BY distance ROWS UNBOUNDED PRECEDING)) SELECT k AS fpr, round(coalesce(max(tpr) FILTER (s.fpr <= k), 0), 6) AS tpr FROM s, (VALUES (0.001::DOUBLE), (0.01::DOUBLE), (0.1::DOUBLE)) t(k) GROUP BY k")
def m16_roc(spark, sf):
    return ranking.roc_at(*_searched(spark, sf), rates=(0.001, 0.01, 0.1)).withColumn("tpr", r6("tpr"))


@query(f"WITH {_EMB}, d AS (SELECT a.vec_id AS q, b.vec_id AS g, b.v, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_cosine_similarity(a.v, b.v), b.vec_id) AS r FROM e a, e b WHERE a.vec_id % 10 = 0), u AS (SELECT q, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM d WHERE r <= 5), m AS (SELECT q, i, round(avg(x), 6) AS x FROM u GROUP BY ALL) SELECT q, list(x ORDER BY i) AS embedding FROM m GROUP BY q")
def c19_query_expansion(spark, sf):
    rows = table(spark, sf, "embeddings")
    near = pairs.neighbours(rows.where("vec_id % 10 = 0"), rows, "vec_id", "vec_id", "embedding", 5)
    out = retrieval.expanded(near, rows.select(F.col("vec_id").alias("id"), "embedding"), "q", "g", "embedding")
    return out.select("q", V.rounded(F.col("embedding"), 6).alias("embedding"))


@query(f"WITH {_EMB}, d AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, 1 - list_cosine_similarity(a.v, b.v) AS x FROM e a, e b WHERE a.vec_id <> b.vec_id) SELECT a, round(max(x) FILTER (same), 6) AS hardest_positive, round(min(x) FILTER (NOT same), 6) AS hardest_negative FROM d GROUP BY a")
def c23_hardest(spark, sf):
    out = pairs.hardest(table(spark, sf, "embeddings"), "vec_id", "label", "embedding")
    return out.select("a", r6("hardest_positive").alias("hardest_positive"), r6("hardest_negative").alias("hardest_negative"))


@query("SELECT vec_id, label, 1.0 / count(*) OVER (PARTITION BY label) AS weight FROM embeddings")
def c22_inverse_frequency(spark, sf):
    return retrieval.inverse_frequency(table(spark, sf, "embeddings").select("vec_id", "label"), "label")


# Detection scores.


@query("""WITH s AS (SELECT l.doc_id, l.toxic AS hit, (l.doc_id * 7919) % 1009 + l.toxic * 300 AS score FROM labels l),
c AS (SELECT *, sum(hit) OVER w AS tp, row_number() OVER w AS n FROM s WINDOW w AS (ORDER BY score DESC, doc_id)),
p AS (SELECT *, tp / n AS pr, tp / (SELECT sum(hit) FROM s) AS re FROM c),
e AS (SELECT *, max(pr) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM p),
k AS (SELECT i, (SELECT env FROM e WHERE re >= i / 100 ORDER BY n LIMIT 1) AS v FROM range(101) t(i))
SELECT 'toxic' AS kind, round(sum(coalesce(v, 0)) / 101, 6) AS ap FROM k""")
def m11_average_precision(spark, sf):
    rows = table(spark, sf, "labels").select(F.lit("toxic").alias("kind"), "doc_id", F.col("toxic").alias("hit"), F.expr("(doc_id * 7919) % 1009 + toxic * 300").alias("score"))
    totals = rows.groupBy("kind").agg(F.sum("hit").alias("n_gt"))
    return D.average_precision(rows, ["kind"], "score", "hit", totals, "doc_id").select("kind", r6("ap").alias("ap"))


@query(f"""{_PAIR}, o AS (SELECT *, row_number() OVER (PARTITION BY frame, gt ORDER BY iou DESC, tr) AS a FROM p WHERE iou > 0.45), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame, tr ORDER BY iou DESC, gt) AS b FROM o WHERE a = 1) WHERE b = 1),
x AS (SELECT g.event_type AS t, f.event_type AS d FROM trk g LEFT JOIN m ON m.frame = g.frame AND m.gt = g.user_id LEFT JOIN trk f ON f.frame = m.frame AND f.user_id = m.tr WHERE g.user_id % 2 = 0 UNION ALL SELECT NULL, f.event_type FROM trk f LEFT JOIN m ON m.frame = f.frame AND m.tr = f.user_id WHERE f.user_id % 2 = 1 AND m.gt IS NULL)
SELECT coalesce(t, 'background') AS truth_class, coalesce(d, 'background') AS found_class, count(*) AS n FROM x GROUP BY ALL""")
def m12_confusion(spark, sf):
    rows = trk(spark, sf)
    gt = rows.where("user_id % 2 = 0").select("frame", F.col("user_id").alias("gt"), F.col("event_type").alias("class"))
    tr = rows.where("user_id % 2 = 1").select("frame", F.col("user_id").alias("tr"), F.col("event_type").alias("class"))
    boxes = rows.withColumns({"gt": F.col("user_id"), "tr": F.col("user_id")})
    found = pairs.top_overlaps(boxes.where("user_id % 2 = 0"), boxes.where("user_id % 2 = 1"), ["frame"], "gt", "tr")
    return D.confusion(found, gt, tr, ["frame"], "gt", "tr", "iou")


def _two_sides(spark, sf):
    """The tracks of either side, by sequence and time."""
    rows = trk(spark, sf).withColumn("seq", F.expr("frame div 24"))
    gt = rows.where("user_id % 2 = 0").select("seq", F.col("frame").alias("t"), F.col("user_id").alias("gt_id"), F.col("box").alias("gt_box"))
    return gt, rows.where("user_id % 2 = 1").select("seq", F.col("frame").alias("t"), F.col("user_id").alias("tracker_id"), F.col("box").alias("tracker_box"))


def _times(spark, sf):
    """Two sides of the tracks in five sequences, by IoU."""
    return M.box_timeline(*_two_sides(spark, sf), alike=True)


@query(f"WITH {TRK} SELECT frame // 24 AS seq, CAST(count(*) FILTER (user_id % 2 = 1) AS DOUBLE) AS Dets, CAST(count(*) FILTER (user_id % 2 = 0) AS DOUBLE) AS GT_Dets, CAST(count(DISTINCT user_id) FILTER (user_id % 2 = 1) AS DOUBLE) AS IDs, CAST(count(DISTINCT user_id) FILTER (user_id % 2 = 0) AS DOUBLE) AS GT_IDs, CAST(count(DISTINCT frame) AS DOUBLE) AS Frames FROM trk GROUP BY ALL")
def m9_counts(spark, sf):
    return M.finals(M.evaluate(M.timeline(*_two_sides(spark, sf)), ["Count"]), "Count")


@query()
def m1_hota(spark, sf):
    return M.summary(M.finals(M.evaluate(_times(spark, sf), ["HOTA"]), "HOTA"))


@query()
def m3_clear(spark, sf):
    return M.finals(M.evaluate(_times(spark, sf), ["CLEAR"]), "CLEAR")


@query()
def m4_identity(spark, sf):
    return M.finals(M.evaluate(_times(spark, sf), ["Identity"]), "Identity")


@query()
def m5_vace(spark, sf):
    return M.finals(M.evaluate(_times(spark, sf), ["VACE"]), "VACE")


@query()
def e1_frame_matches(spark, sf):
    return D.frame_matches(_times(spark, sf), 0.3)


@query()
def r2_online_track(spark, sf):
    rows = ev(spark, sf).withColumns({"x1": F.expr("cast((user_id * 37) % 900 + (frame % 60) as double)"), "y1": F.expr("cast((user_id * 53) % 700 + (frame % 40) as double)"), "score": F.expr("cast(event_id % 101 as double) / 101")})
    rows = X.first_of_each(rows, ["user_id", "frame"], ["event_id"]).select((F.col("user_id") % 4).alias("camera"), "frame", "x1", "y1", (F.col("x1") + 60).alias("x2"), (F.col("y1") + 90).alias("y2"), "score", F.lit(0).alias("class_id"))
    return online.track(rows, "camera", "two-band")


@query(f"WITH {TRK} SELECT user_id % 4 || ' ' || user_id || ' ' || (frame - 1) || ' ' || CAST(x1 AS BIGINT) || ' ' || CAST(y1 AS BIGINT) || ' ' || CAST(x2 - x1 AS BIGINT) || ' ' || CAST(y2 - y1 AS BIGINT) || ' ' || printf('%.6f', x1 / 10) || ' ' || printf('%.6f', y1 / 10) AS line FROM trk WHERE user_id % 3 <> 0")
def k1_submission_lines(spark, sf):
    rows = trk(spark, sf).select(F.concat(F.lit("Camera_"), F.lpad((F.col("user_id") % 4).cast("string"), 2, "0")).alias("camera"), "frame", F.expr("case when user_id % 3 <> 0 then user_id end").alias("global_id"), "box", (F.col("x1") / 10).alias("wx"), (F.col("y1") / 10).alias("wy"))
    return writers.submission(rows)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track summary: first and last frame, rows and classes of each track that is long enough."""
    return a5_track_summary(spark, sf_dir)
