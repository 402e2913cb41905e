"""Scores of a tracker whose boxes meet no other track's, so that SQL can tell every match; keys and SQL as in `queries`.

Ground truth is a user's row in four of five frames.  A tracker follows in six of
seven, moved aside by up to 45 of the box's 100, and changes its id every five
frames; now and then it sees a box where nothing is.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import detection as D
from ..operators import metrics as M
from ..operators import pairs
from ..sources import writers
from .queries import query, r6
from .tables import TRK, trk

_APART = f"""WITH {TRK}, base AS (SELECT *, frame // 24 AS seq, frame % 24 + 1 AS t, user_id * 1000.0 + frame % 24 AS x, event_id % 45 + 0.5 AS dx FROM trk),
gt AS (SELECT seq, t, user_id AS gt_id, x FROM base WHERE event_id % 5 <> 0),
longest AS (SELECT seq, max(t) AS n_times FROM gt GROUP BY seq),
tr AS (SELECT seq, t, user_id AS owner, user_id * 4 + (frame // 5) % 3 AS tracker_id, dx FROM base WHERE event_id % 7 <> 0 UNION ALL SELECT seq, t, NULL, 10000000 + user_id, NULL FROM base WHERE event_id % 11 = 0),
m AS (SELECT gt.seq, gt.t, gt_id, tracker_id, x, (100 - dx) / (100 + dx) AS s FROM gt JOIN tr ON gt.seq = tr.seq AND gt.t = tr.t AND owner = gt_id),
g AS (SELECT seq, gt_id, count(*) AS n FROM gt GROUP BY ALL), k AS (SELECT seq, tracker_id, count(*) AS n FROM tr GROUP BY ALL),
size AS (SELECT seq, (SELECT count(*) FROM gt WHERE gt.seq = q.seq) AS n_gt, (SELECT count(*) FROM tr WHERE tr.seq = q.seq) AS n_tr FROM (SELECT DISTINCT seq FROM base) q)"""


def _apart(spark, sf):
    """Both sides, with ids and boxes."""
    rows = trk(spark, sf).withColumns({"seq": F.expr("frame div 24"), "t": F.expr("frame % 24 + 1"), "x": F.expr("user_id * 1000.0D + frame % 24"), "dx": F.expr("event_id % 45 + 0.5D")})
    gt = rows.where("event_id % 5 <> 0").select("seq", "t", F.col("user_id").alias("gt_id"), "x", G.box(F.col("x"), F.lit(0.0), F.col("x") + 100, F.lit(50.0)).alias("gt_box"))
    follows = rows.where("event_id % 7 <> 0").select("seq", "t", F.expr("user_id * 4 + (frame div 5) % 3").alias("tracker_id"), G.box(F.col("x") + F.col("dx"), F.lit(0.0), F.col("x") + F.col("dx") + 100, F.lit(50.0)).alias("tracker_box"))
    ghosts = rows.where("event_id % 11 = 0").select("seq", "t", (F.col("user_id") + 10_000_000).alias("tracker_id"), G.box(F.col("x"), F.lit(1000.0), F.col("x") + 50, F.lit(1050.0)).alias("tracker_box"))
    return gt, follows.unionByName(ghosts)


def _near(spark, sf):
    gt, tracker = _apart(spark, sf)
    return gt, tracker, pairs.similarities(gt, tracker, ["seq", "t"], "gt_id", "tracker_id", G.iou(F.col("gt_box"), F.col("tracker_box")))


def _times(spark, sf):
    return M.box_timeline(*_apart(spark, sf))


_HOTA = """, a AS (SELECT i * 0.05 AS a FROM range(1, 20) q(i)), c AS (SELECT a, seq, gt_id, tracker_id, count(*) AS c, sum(s) AS loc FROM m, a WHERE s >= a - 1e-9 GROUP BY ALL),
h AS (SELECT a, c.seq, sum(c) AS tp, sum(loc) AS loc, sum(c * c / (g.n + k.n - c)) AS ass FROM c JOIN g ON g.seq = c.seq AND g.gt_id = c.gt_id JOIN k ON k.seq = c.seq AND k.tracker_id = c.tracker_id GROUP BY ALL),
f AS (SELECT a, size.seq, coalesce(tp, 0) / greatest(1, n_gt + n_tr - coalesce(tp, 0)) AS det, coalesce(ass, 0) / greatest(1, coalesce(tp, 0)) AS ass, CASE WHEN tp > 0 THEN loc / tp ELSE 1.0 END AS loc FROM a CROSS JOIN size LEFT JOIN h USING (a, seq) WHERE n_gt > 0 OR n_tr > 0)
SELECT seq, round(avg(sqrt(det * ass)), 6) AS HOTA, round(avg(det), 6) AS DetA, round(avg(ass), 6) AS AssA, round(avg(loc), 6) AS LocA FROM f GROUP BY seq"""


def _summary(parts):
    out = M.summary(M.finals(parts, "HOTA"))
    return out.select("seq", *(r6(c).alias(c) for c in ("HOTA", "DetA", "AssA", "LocA")))


@query(_APART + _HOTA)
def m1_hota_apart(spark, sf):
    return _summary(M.evaluate(_times(spark, sf), ["HOTA"]))


@query(_APART.replace("size AS (SELECT", "cut AS (SELECT tr.* FROM tr JOIN longest USING (seq) WHERE t <= n_times), size AS (SELECT").replace("(SELECT count(*) FROM tr WHERE", "(SELECT count(*) FROM cut tr WHERE").replace("k AS (SELECT seq, tracker_id, count(*) AS n FROM tr", "k AS (SELECT seq, tracker_id, count(*) AS n FROM (SELECT tr.* FROM tr JOIN longest USING (seq) WHERE t <= n_times)") + _HOTA)
def m2_hota3d(spark, sf):
    """The same boxes with a height, in the world."""

    def solid(b):
        return F.struct(((b["x1"] + b["x2"]) / 2).alias("x"), ((b["y1"] + b["y2"]) / 2).alias("y"), F.lit(10.0).alias("z"), (b["x2"] - b["x1"]).alias("l"), (b["y2"] - b["y1"]).alias("w"), F.lit(20.0).alias("h"))

    gt, tracker = _apart(spark, sf)
    a = gt.select("seq", F.col("t").alias("frame"), F.col("gt_id").alias("id"), solid(F.col("gt_box")).alias("box"))
    b = tracker.select("seq", F.col("t").alias("frame"), F.col("tracker_id").alias("id"), solid(F.col("tracker_box")).alias("box"))
    return _summary(M.world_evaluate(a, b, ["HOTA"]))


_CLEAR = """, both_sides AS (SELECT seq, t, row_number() OVER (PARTITION BY seq ORDER BY t) AS place FROM (SELECT seq, t FROM gt INTERSECT SELECT seq, t FROM tr)),
hit AS (SELECT m.*, place, lag(tracker_id) OVER w AS was, lag(place) OVER w AS before FROM m JOIN both_sides USING (seq, t) WHERE s >= 0.5 WINDOW w AS (PARTITION BY seq, gt_id ORDER BY t)),
sums AS (SELECT seq, count(*) AS tp, sum(s) AS motp, count(*) FILTER (was <> tracker_id) AS idsw FROM hit GROUP BY seq),
frag AS (SELECT seq, sum(n - 1) AS frag FROM (SELECT seq, gt_id, count(*) FILTER (before IS NULL OR before < place - 1) AS n FROM hit GROUP BY ALL) GROUP BY seq),
share AS (SELECT g.seq, count(*) FILTER (c / n > 0.8) AS mt, count(*) FILTER (c / n BETWEEN 0.2 AND 0.8) AS pt, count(*) AS ids FROM g JOIN (SELECT g.seq, g.gt_id, count(hit.t) AS c FROM g LEFT JOIN hit USING (seq, gt_id) GROUP BY ALL) q USING (seq, gt_id) GROUP BY g.seq)
SELECT seq, CAST(coalesce(tp, 0) AS DOUBLE) AS CLR_TP, CAST(n_gt - coalesce(tp, 0) AS DOUBLE) AS CLR_FN, CAST(n_tr - coalesce(tp, 0) AS DOUBLE) AS CLR_FP, CAST(coalesce(idsw, 0) AS DOUBLE) AS IDSW, CAST(coalesce(frag, 0) AS DOUBLE) AS Frag, CAST(mt AS DOUBLE) AS MT, CAST(pt AS DOUBLE) AS PT, CAST(ids - mt - pt AS DOUBLE) AS ML, round((coalesce(tp, 0) - (n_tr - coalesce(tp, 0)) - coalesce(idsw, 0)) / greatest(1, n_gt), 6) AS MOTA, round(coalesce(motp, 0) / greatest(1, coalesce(tp, 0)), 6) AS MOTP FROM size LEFT JOIN sums USING (seq) LEFT JOIN frag USING (seq) LEFT JOIN share USING (seq) WHERE n_gt > 0 AND n_tr > 0"""


@query(_APART + _CLEAR)
def m3_clear_apart(spark, sf):
    out = M.finals(M.evaluate(_times(spark, sf), ["CLEAR"]), "CLEAR")
    return out.select("seq", *(F.col(c) for c in ("CLR_TP", "CLR_FN", "CLR_FP", "IDSW", "Frag", "MT", "PT", "ML")), r6("MOTA").alias("MOTA"), r6("MOTP").alias("MOTP"))


_OVERLAP = ", o AS (SELECT seq, gt_id, tracker_id, count(*) FILTER (s >= 0.5) AS c, count(*) AS both_seen FROM m GROUP BY ALL)"


@query(_APART + _OVERLAP + ", b AS (SELECT seq, sum(c) AS tp FROM (SELECT seq, gt_id, max(c) AS c FROM o GROUP BY ALL) GROUP BY seq) SELECT seq, CAST(coalesce(tp, 0) AS DOUBLE) AS IDTP, CAST(n_gt - coalesce(tp, 0) AS DOUBLE) AS IDFN, CAST(n_tr - coalesce(tp, 0) AS DOUBLE) AS IDFP, round(coalesce(tp, 0) / greatest(1, 0.5 * (n_gt + n_tr)), 6) AS IDF1 FROM size LEFT JOIN b USING (seq) WHERE n_gt > 0 OR n_tr > 0")
def m4_identity_apart(spark, sf):
    out = M.finals(M.evaluate(_times(spark, sf), ["Identity"]), "Identity")
    return out.select("seq", "IDTP", "IDFN", "IDFP", r6("IDF1").alias("IDF1"))


@query(_APART + _OVERLAP + """, b AS (SELECT seq, sum(s) AS stda FROM (SELECT o.seq, o.gt_id, max(c / (g.n + k.n - both_seen)) AS s FROM o JOIN g ON g.seq = o.seq AND g.gt_id = o.gt_id JOIN k ON k.seq = o.seq AND k.tracker_id = o.tracker_id GROUP BY ALL) GROUP BY seq),
ng AS (SELECT seq, t, count(*) AS n FROM gt GROUP BY ALL), nk AS (SELECT seq, t, count(*) AS n FROM tr GROUP BY ALL),
fr AS (SELECT seq, t, sum(s) AS s FROM m GROUP BY ALL), fda AS (SELECT ng.seq, sum(coalesce(s, 0) / (0.5 * (ng.n + nk.n))) AS fda FROM ng JOIN nk USING (seq, t) LEFT JOIN fr USING (seq, t) GROUP BY ng.seq),
busy AS (SELECT seq, count(DISTINCT t) AS n FROM (SELECT seq, t FROM gt UNION ALL SELECT seq, t FROM tr) GROUP BY seq),
ids AS (SELECT seq, (SELECT count(*) FROM g WHERE g.seq = q.seq) AS a, (SELECT count(*) FROM k WHERE k.seq = q.seq) AS b FROM busy q)
SELECT seq, round(coalesce(stda, 0) / (0.5 * (ids.a + ids.b)), 6) AS ATA, round(coalesce(fda, 0) / busy.n, 6) AS SFDA FROM busy JOIN ids USING (seq) LEFT JOIN b USING (seq) LEFT JOIN fda USING (seq)""")
def m5_vace_apart(spark, sf):
    out = M.finals(M.evaluate(_times(spark, sf), ["VACE"]), "VACE")
    return out.select("seq", r6("ATA").alias("ATA"), r6("SFDA").alias("SFDA"))


@query(_APART + """, own AS (SELECT seq, gt_id, sum(d) AS d FROM (SELECT seq, gt_id, abs(x - lag(x) OVER (PARTITION BY seq, gt_id ORDER BY t)) AS d FROM gt) GROUP BY ALL),
way AS (SELECT seq, gt_id, tracker_id, sum(d) AS d FROM (SELECT seq, gt_id, tracker_id, abs(x - lag(x) OVER (PARTITION BY seq, gt_id, tracker_id ORDER BY t)) AS d FROM m WHERE s >= 0.4) GROUP BY ALL),
best AS (SELECT seq, gt_id, max(coalesce(d, 0)) AS d FROM way GROUP BY ALL)
SELECT own.seq, round(CASE WHEN sum(own.d) > 0 THEN coalesce(sum(best.d), 0) / sum(own.d) ELSE 0 END, 6) AS IDEucl FROM own LEFT JOIN best USING (seq, gt_id) GROUP BY own.seq""")
def m8_travelled_apart(spark, sf):
    gt, tracker = _apart(spark, sf)
    near = M.near_pairs(M.box_timeline(gt, tracker), 0.4)
    way = M.travelled(gt.select("seq", "t", "gt_id", "x", F.lit(0.0).alias("y")), near)
    return way.withColumn("IDEucl", r6("IDEucl"))


@query(_APART + " SELECT seq, t, gt_id, tracker_id, round(s, 6) AS similarity FROM m WHERE s >= 0.6")
def e1_matches_apart(spark, sf):
    return D.frame_matches(_times(spark, sf), 0.6).withColumn("similarity", r6("similarity"))


@query(_APART + ", hit AS (SELECT seq, count(*) AS tp FROM m WHERE s >= 0.5 GROUP BY seq) SELECT seq, CAST(coalesce(tp, 0) AS DOUBLE) AS CLR_TP, CAST(n_gt - coalesce(tp, 0) AS DOUBLE) AS CLR_FN, CAST(n_tr AS DOUBLE) AS Dets, CAST(n_gt AS DOUBLE) AS GT_Dets FROM size LEFT JOIN hit USING (seq) WHERE n_gt > 0 AND n_tr > 0")
def k8_metric_table_apart(spark, sf):
    return writers.metric_table(M.evaluate(_times(spark, sf), ["CLEAR", "Count"]), "seq", ["CLR_TP", "CLR_FN", "Dets", "GT_Dets"])


@query(_APART + ", gone AS (SELECT seq, t, tracker_id FROM m WHERE s >= 0.5 AND gt_id % 6 = 0) SELECT tr.seq, tr.t, tr.tracker_id FROM tr LEFT JOIN gone USING (seq, t, tracker_id) WHERE gone.seq IS NULL")
def e1_without_distractors(spark, sf):
    gt, tracker, _ = _near(spark, sf)
    found = D.frame_matches(_times(spark, sf), 0.5)
    return D.without_distractors(tracker.select("seq", "t", "tracker_id"), found, gt, F.col("gt_id") % 6 == 0)


@query(_APART + ", ign AS (SELECT seq, t, tracker_id FROM tr WHERE tracker_id >= 10000000 AND tracker_id % 4 = 0) SELECT tr.seq, tr.t, tr.tracker_id FROM tr LEFT JOIN ign USING (seq, t, tracker_id) WHERE ign.seq IS NULL")
def e2_without_ignored(spark, sf):
    """Boxes that no ground truth matches and a region covers, here every fourth user's."""
    _, tracker, _ = _near(spark, sf)
    found = D.frame_matches(_times(spark, sf), 0.5)
    regions = F.when(F.col("tracker_id") % 4 == 0, G.box(F.lit(0.0), F.lit(1000.0), F.col("tracker_box.x2"), F.lit(1050.0)))
    covered = tracker.withColumn("region", regions).where("region is not null").select("seq", "t", "tracker_id", G.ioa(F.col("tracker_box"), F.col("region")).alias("ioa"))
    return D.without_ignored(tracker, covered, found).select("seq", "t", "tracker_id")
