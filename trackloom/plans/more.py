"""Further operators of the inventory on the test tables; keys and SQL as in `queries`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import names as N
from ..operators import aggregates as A
from ..operators import detection as D
from ..operators import filters as X
from ..operators import graph, identities, metrics, pairs, ranking, retrieval, tracklets, windows
from ..session import checkpoints
from ..sources import writers
from .queries import _EMB, _NN, _PAIR, _ranked, _searched, _sides, _times, query, r6
from .tables import EV, TRK, ev, table, trk


@query("SELECT l_returnflag, l_linestatus, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_l_suppkey FROM lineitem GROUP BY ALL")
def a1_label_counts(spark, sf):
    return A.counts(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_suppkey"])


@query(f"WITH {EV}, v AS (SELECT user_id, event_type, round(sum(value), 6) AS votes FROM ev GROUP BY ALL) SELECT user_id, event_type, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS r FROM v) WHERE r = 1")
def a7_weighted_majority(spark, sf):
    rows = ev(spark, sf).groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 6).alias("w"))
    return A.majority(rows, ["user_id"], "event_type", F.col("w"))


@query("SELECT s_nationkey, round(coalesce(sum(s_acctbal * s_suppkey) / nullif(sum(s_suppkey), 0), 0.0), 3) AS mean FROM supplier GROUP BY s_nationkey")
def a13_weighted_mean(spark, sf):
    return table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.round(A.weighted_mean("s_acctbal", "s_suppkey"), 3).alias("mean"))


@query(f"WITH {EV} SELECT user_id, event_type, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n_frames FROM ev GROUP BY ALL")
def a16_extents(spark, sf):
    return windows.extent(ev(spark, sf), ["user_id", "event_type"], "frame")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'")
def j14_lookup(spark, sf):
    names = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return pairs.lookup(table(spark, sf, "orders"), names, ["o_custkey"]).select("o_orderkey", "c_name")


@query(f"{_PAIR} SELECT frame, gt, tr, round(sqrt(c2), 6) AS distance, sqrt(c2) <= 40 AS within FROM (SELECT *, row_number() OVER (PARTITION BY frame, gt ORDER BY (sqrt(c2) > 40), round(sqrt(c2), 9), round(iou, 9) DESC, tr) AS r FROM p) WHERE r = 1")
def j19_best_match(spark, sf):
    a, b = G.to_cxcywh(F.col("a")), G.to_cxcywh(F.col("b"))
    d = F.round(F.sqrt((a["cx"] - b["cx"]) * (a["cx"] - b["cx"]) + (a["cy"] - b["cy"]) * (a["cy"] - b["cy"])), 9)
    every = trk(spark, sf)
    gt = every.where("user_id % 2 = 0").select("frame", F.col("user_id").alias("gt"), F.col("box").alias("a"))
    # Equal boxes of a frame meet others once; among equal ones the least user is taken.
    tr = every.where("user_id % 2 = 1").groupBy("frame", F.col("box").alias("b")).agg(F.min("user_id").alias("tr"))
    rows = gt.select("frame", "a").distinct().join(tr, "frame").select("frame", "a", "tr", d.alias("distance"), F.round(G.iou(F.col("a"), F.col("b")), 9).alias("iou")).withColumn("key", F.struct("frame", "a"))
    best = pairs.best_match(rows, "key", "distance", "iou", 40.0, "tr").drop("key")
    return pairs.back_to_rows(gt, best, ["frame", "a"]).select("frame", "gt", "tr", r6("distance").alias("distance"), "within")


@query(f"WITH RECURSIVE {_EMB}, p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.25), w AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS node, a AS root FROM w UNION SELECT w.b, r.root FROM r JOIN w ON r.node = w.a) SELECT node, min(root) AS root FROM r GROUP BY node")
def c13_components(spark, sf):
    return graph.components(pairs.feature_links(table(spark, sf, "embeddings"), ["label"], "vec_id", "embedding", 0.25), "member_1", "member_2")


@query(f"{_PAIR} SELECT frame, gt, tr, inter AS area, round(inter / aa, 6) AS ioa FROM p WHERE inter > 0")
def p15_intersections(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _sides(spark, sf, where=G.intersection(a, b) > 0, exact=("area",), area=G.intersection(a, b), ioa=G.ioa(a, b))


@query(f"WITH {TRK} SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN round((event_id % 5) * (x1 - 50) / 100, 6) ELSE round(1.2 * x1 + 0.1 * y1 + 5, 6) END AS x, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 5 AS DOUBLE) + 7 ELSE 0.0 END AS z FROM trk")
def p6_world_points(spark, sf):
    k = [[100.0, 0.0, 50.0], [0.0, 100.0, 40.0], [0.0, 0.0, 1.0]]
    pose = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 7.0]]
    by_depth = G.back_project(F.col("x1"), F.col("y1"), F.expr("(event_id % 5) * 1000.0D"), k, pose)
    by_plane = G.project([[1.2, 0.1, 5.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], F.col("x1"), F.col("y1"))
    rows = trk(spark, sf).withColumn("w", G.world_point(by_depth, by_plane))
    return rows.select("event_id", r6("w.x").alias("x"), r6("w.z").alias("z"))


@query("SELECT s_suppkey, CAST(regexp_extract(s_name, '(\\d+)$', 1) AS INTEGER) AS number, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS serial FROM supplier")
def p22_name_parts(spark, sf):
    rows = table(spark, sf, "supplier")
    return rows.select("s_suppkey", writers.camera_number(F.col("s_name")).alias("number"), N.serial(F.col("s_suppkey"), 6).alias("serial"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def p23_json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(f"WITH {TRK}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS c, lead(frame) OVER w AS nf, lead(x1) OVER w AS nx FROM trk WINDOW w AS (PARTITION BY user_id ORDER BY frame)), g AS (SELECT *, unnest(CASE WHEN nf - frame BETWEEN 2 AND 5 AND c > 40 THEN range(frame, nf) ELSE [frame] END) AS f FROM n) SELECT user_id, f AS frame, round(x1 + (CASE WHEN f > frame THEN (nx - x1) * (f - frame) / (nf - frame) ELSE 0 END), 6) AS x1, f > frame AS filled FROM g")
def w5_fill_short_gaps(spark, sf):
    out = windows.fill_gaps(trk(spark, sf), ["user_id"], "frame", ["x1"], max_gap=5, min_length=40)
    return out.select("user_id", "frame", r6("x1").alias("x1"), "filled")


@query(f"""WITH RECURSIVE {TRK}, o AS (SELECT user_id, frame, x1, y1, row_number() OVER (PARTITION BY user_id ORDER BY frame) AS k FROM trk),
r AS (SELECT user_id, k, frame, x1, y1, 0.0::DOUBLE AS sx, 0.0::DOUBLE AS sy, 0::BIGINT AS piece FROM o WHERE k = 1 UNION ALL
SELECT user_id, k, frame, x1, y1, CASE WHEN sqrt(vx * vx + vy * vy) > 45 THEN 0.0 ELSE vx END, CASE WHEN sqrt(vx * vx + vy * vy) > 45 THEN 0.0 ELSE vy END, piece + CASE WHEN sqrt(vx * vx + vy * vy) > 45 THEN 1 ELSE 0 END
FROM (SELECT o.*, r.piece, (1 - pow(0.5, o.frame - r.frame)) * (o.x1 - r.x1) / (o.frame - r.frame) + pow(0.5, o.frame - r.frame) * r.sx AS vx, (1 - pow(0.5, o.frame - r.frame)) * (o.y1 - r.y1) / (o.frame - r.frame) + pow(0.5, o.frame - r.frame) * r.sy AS vy FROM o JOIN r ON o.user_id = r.user_id AND o.k = r.k + 1))
SELECT user_id, frame, x1, y1, piece FROM r""")
def w7_warp_pieces(spark, sf):
    return tracklets.split_warps(trk(spark, sf).select("user_id", "frame", "x1", "y1"), ["user_id"], "frame", "x1", "y1", 45.0)


@query(f"WITH {EV} SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM ev) WHERE r % greatest(n // 10, 1) = 0")
def w12_spread_sample(spark, sf):
    return windows.spread(ev(spark, sf).select("event_id", "user_id"), ["user_id"], ["event_id"], 10)


@query(f"WITH {TRK} SELECT event_id FROM trk WHERE frame BETWEEN 78900 AND 78960")
def f10_frame_range(spark, sf):
    return X.frame_range(trk(spark, sf), "frame", 78_900, 78_960).select("event_id")


@query(f"WITH {TRK} SELECT event_id, row_number() OVER (ORDER BY frame, user_id) AS n FROM trk QUALIFY n <= 25")
def t3_first_rows(spark, sf):
    rows = trk(spark, sf).orderBy("frame", "user_id").limit(25)
    return rows.select("event_id", F.row_number().over(Window.orderBy("frame", "user_id")).cast("long").alias("n"))


@query()
def t4_suppressed(spark, sf):
    rows = trk(spark, sf).select("frame", "event_id", "x1", "y1", "x2", "y2", "score")
    return D.suppressed(rows, ["frame"], "event_id", 0.5)


@query()
def c6_clustered_detections(spark, sf):
    rows = table(spark, sf, "embeddings").select((F.col("vec_id") % 4).alias("camera"), F.expr("vec_id div 8").alias("frame"), "vec_id", "embedding")
    return tracklets.cluster_detections(rows, ["camera"], "frame", "vec_id", "embedding", cut=0.7, section=20)


@query()
def c8_merged_tracklets(spark, sf):
    rows = trk(spark, sf).select((F.col("user_id") % 4).alias("camera"), "frame", "user_id", "box")
    found = tracklets.overlapping_tracklets(rows, ["camera"], "frame", "user_id", ratio=0.5, coefficient=0.55)
    return tracklets.merge_tracklets(rows, found, ["camera"], "frame", "user_id").drop("box")


@query()
def c14_representatives(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", "vec_id", "embedding")
    return tracklets.representatives(rows, ["label"], "vec_id", "embedding", most=5, reach=0.7)


def _scene(spark, sf):
    """All tracks over three cameras: users by number, points by frame, vectors by label."""
    rows = trk(spark, sf).select(F.lit(1).alias("scene"), (F.col("user_id") % 3).alias("camera"), F.expr("user_id div 3").alias("local_id"), "frame", F.expr("cast((user_id div 3) * 10 + event_id % 2 as double)").alias("x"), F.expr("cast(frame % 50 as double)").alias("y"))
    looks = table(spark, sf, "embeddings").select(F.lit(1).alias("scene"), (F.col("vec_id") % 3).alias("camera"), F.expr("vec_id div 3").alias("local_id"), F.col("embedding").alias("vector"))
    return rows, looks


@query()
def c16_global_identities(spark, sf):
    checkpoints(spark)
    points, looks = _scene(spark, sf)
    # No step looks at pairs farther apart than the widest limit of `match_all`, so these leave no task.
    found = identities.appearance_pairs(identities.trajectory_pairs(points, ["scene"], "frame", ["x", "y"], most=3.0), looks, ["scene"]).checkpoint()
    nodes = points.groupBy("scene", "camera", "local_id").agg(F.min("frame").alias("first_frame")).checkpoint()
    early = identities.first_identities(nodes.where("camera < 2"), found, ["scene"], near=1.5, alike=-1.0)
    return identities.match_all(nodes, identities.merge_identities(early, found, ["scene"], alike=-1.0), found, ["scene"], alike=-1.0)


@query()
def c18_reranked(spark, sf):
    rows = table(spark, sf, "embeddings")
    return retrieval.jaccard_rerank(pairs.neighbours(rows, rows, "vec_id", "vec_id", "embedding", 30).select(F.col("q").alias("a"), F.col("g").alias("b"), "rank", "distance"), 10, 4, vectors=rows.select(F.col("vec_id").alias("id"), "embedding"))


@query()
def c20_propagated(spark, sf):
    rows = table(spark, sf, "embeddings")
    near = pairs.neighbours(rows, rows, "vec_id", "vec_id", "embedding", 8).select(F.col("q").alias("a"), F.col("g").alias("b"), "rank", "distance")
    return retrieval.propagated(near, rows.select(F.col("vec_id").alias("id"), "embedding"), "embedding", 8)


@query()
def m6_track_ap(spark, sf):
    rows = trk(spark, sf).withColumn("video", F.expr("frame div 24")).withColumn("area", G.area(F.col("box")))
    gt = rows.where("user_id % 2 = 0").select("video", F.col("frame").alias("t"), F.col("user_id").alias("gt_track"), "area", "box")
    own = rows.where("user_id % 2 = 1").select("video", F.col("frame").alias("t"), F.col("user_id").alias("track"), "area", "box", "score")
    ious = D.track_iou(gt, own, G.intersection(F.col("gt_box"), F.col("box"))).select("video", "gt_track", "track", "iou")
    kind = F.lit("person").alias("class")
    tracks = own.groupBy("video", "track").agg(F.avg("score").alias("score")).select("video", kind, "track", "score", F.lit(False).alias("ignored"))
    truth = gt.select("video", kind, "gt_track", F.lit(False).alias("ignored")).distinct()
    return D.track_ap(D.track_matches(ious, tracks, truth), truth)


@query()
def m14_single_shot_cmc(spark, sf):
    gallery = table(spark, sf, "embeddings").where("vec_id % 10 <> 0").select(F.col("vec_id").alias("g"), F.col("label").alias("pid"))
    return retrieval.single_shot_cmc(_ranked(spark, sf), gallery, 4, 10)


@query(f"WITH {_NN}, gr AS (SELECT q % 5 AS fold, 0.1::DOUBLE * k AS threshold, sum(CASE WHEN (distance < 0.1::DOUBLE * k) = (hit = 1) THEN 1 ELSE 0 END) AS good, count(*) AS n FROM r, range(1, 20) t(k) GROUP BY ALL), a AS (SELECT threshold, sum(good) AS good, sum(n) AS n FROM gr GROUP BY threshold), c AS (SELECT gr.*, row_number() OVER (PARTITION BY fold ORDER BY (a.good - gr.good) / nullif(a.n - gr.n, 0) DESC, threshold) AS place FROM gr JOIN a USING (threshold)) SELECT fold, threshold, good / n AS accuracy FROM c WHERE place = 1")
def m18_verification(spark, sf):
    queries, *rest = _searched(spark, sf)
    return retrieval.best_thresholds(ranking.threshold_counts(queries.withColumn("fold", F.col("vec_id") % 5), *rest, "fold", [0.1 * k for k in range(1, 20)]))


@query()
def m8_travelled(spark, sf):
    rows = trk(spark, sf).withColumns({"seq": F.expr("frame div 24"), "t": F.col("frame")})
    gt = rows.where("user_id % 2 = 0").select("seq", "t", F.col("user_id").alias("gt_id"), F.col("x1").alias("x"), F.col("y1").alias("y"), "box")
    own = rows.where("user_id % 2 = 1").select("seq", "t", F.col("user_id").alias("tracker_id"), "box")
    return metrics.travelled_boxes(gt, own, 0.4)


@query(f"WITH {TRK} SELECT printf('%d,%d,%.2f,%.2f,%.2f,%.2f,%.4f,-1,-1,-1', frame, user_id, x1, y1, x2 - x1, y2 - y1, score) AS line FROM trk")
def k9_mot_lines(spark, sf):
    return writers.mot_lines(trk(spark, sf).withColumn("id", F.col("user_id")))


@query(f"WITH {TRK} SELECT printf('%d,%d,%.6f,%.6f,%.6f,%.6f,%.6f,%.6f,%.6f,-1,-1,-1', frame + 1, user_id, x1, y1, 0.0, x2 - x1, y2 - y1, 1.5, 1.0) AS line FROM trk")
def k7_evaluation_lines(spark, sf):
    rows = trk(spark, sf).select("frame", F.col("user_id").alias("id"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(0.0).alias("z"), (F.col("x2") - F.col("x1")).alias("l"), (F.col("y2") - F.col("y1")).alias("w"), F.lit(1.5).alias("h"), F.lit(1.0).alias("score"))
    return writers.evaluation_lines(rows, frame_shift=1)


@query(f"WITH {TRK}, m AS (SELECT user_id % 9 AS gid, frame, avg(x1) + 0.001 AS x, avg(y1) + 0.001 AS y FROM trk GROUP BY ALL) SELECT printf('%d %d %d %d %.2f %.2f %.2f %.2f %.2f %.2f %.2f', 1, 0, gid, frame, x, y, 0.0, 0.5, 0.5, 1.75, 0.0) AS line FROM m")
def k4_world_lines(spark, sf):
    rows = trk(spark, sf).select(F.lit(1).alias("scene"), F.lit(0).alias("class_id"), (F.col("user_id") % 9).alias("global_id"), "frame", (F.col("x1") + 0.001).alias("x"), (F.col("y1") + 0.001).alias("y"), F.lit(3.0).alias("z"), F.lit(0.5).alias("w"), F.lit(0.5).alias("l"), F.lit(1.75).alias("h"), F.lit(None).cast("double").alias("yaw"))
    return writers.world_lines(rows, flat=True)


@query()
def k8_metric_table(spark, sf):
    return writers.metric_table(metrics.evaluate(_times(spark, sf), ["CLEAR", "Count"]), "seq", ["CLR_TP", "CLR_FN", "CLR_FP", "IDSW", "Dets", "IDs"])
