"""Matching beyond one matrix (C4, C5, C10, C12, C13, C15, C17, W2), motion, and further operators on the test tables; keys and SQL as in `queries`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import names as N
from ..operators import filters as X
from ..operators import identities, matching, online, tracklets
from ..session import checkpointed
from .queries import query, r6
from .tables import AREA, AREB, EV, INTER, TRK, ev, table, trk

#: Seconds within which two events may be a couple.
_WITHIN = 40_000
_PLACED = f"WITH RECURSIVE {EV}, o AS (SELECT user_id, sec, event_id, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS place FROM ev)"


def _placed(spark, sf):
    order = Window.partitionBy("user_id").orderBy("sec", "event_id")
    return ev(spark, sf).select("user_id", "sec", "event_id", F.row_number().over(order).alias("place"))


def _couples(spark, sf, steps):
    """Events of a user at odd places with those `steps` places on or back, and the seconds between."""
    rows = _placed(spark, sf)
    left = rows.where("place % 2 = 1").select("user_id", F.col("event_id").alias("l"), F.col("sec").alias("s"), F.explode(F.array(*(F.col("place") + d for d in steps))).alias("place"))
    right = rows.select("user_id", "place", F.col("event_id").alias("r"), F.col("sec").alias("t"))
    return left.join(right, ["user_id", "place"]).select("user_id", "l", "r", F.abs(F.col("t") - F.col("s")).cast("double").alias("gap"))


@query(f"""{_PLACED}, w AS (SELECT user_id, place, greatest({_WITHIN} - (sec - lag(sec) OVER (PARTITION BY user_id ORDER BY place)), 0) AS w FROM o),
d(user_id, place, best, before) AS (SELECT user_id, 1::BIGINT, 0::BIGINT, 0::BIGINT FROM o WHERE place = 1
UNION ALL SELECT d.user_id, w.place, greatest(d.best, d.before + w.w)::BIGINT, d.best FROM d JOIN w ON w.user_id = d.user_id AND w.place = d.place + 1)
SELECT user_id, max(best) AS worth FROM d GROUP BY user_id HAVING max(best) > 0""")
def c17_assignment(spark, sf):
    """Events coupled with neighbours in time, for the greatest sum of what each couple is below the limit: a user's events form one long part."""
    out = matching.assignment(_couples(spark, sf, (-1, 1)), ["user_id"], "l", "r", "gap", float(_WITHIN))
    return out.groupBy("user_id").agg(F.sum(_WITHIN - F.col("gap")).cast("long").alias("worth")).where("worth > 0")


@query(f"""{_PLACED}, e AS (SELECT a.user_id, a.event_id AS l, b.event_id AS r, abs(b.sec - a.sec) AS gap FROM o a JOIN o b ON a.user_id = b.user_id AND a.place % 2 = 1 AND abs(a.place - b.place) IN (1, 3)),
g(user_id, l, r, gap, rest) AS (SELECT user_id, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, list(struct_pack(gap := gap, l := l, r := r) ORDER BY gap, l, r) FROM e WHERE gap < {_WITHIN} GROUP BY user_id
UNION ALL SELECT user_id, rest[1].l, rest[1].r, rest[1].gap, list_filter(rest, lambda x: x.l <> rest[1].l AND x.r <> rest[1].r) FROM g WHERE len(rest) > 0)
SELECT user_id, l, r, gap FROM g WHERE l IS NOT NULL""")
def c4_greedy_couples(spark, sf):
    """The closest couple of events of a user first, then the closest of the others, and so on."""
    edges = _couples(spark, sf, (-3, -1, 1, 3)).withColumn("score", _WITHIN - F.col("gap"))
    out = matching.greedy(edges, ["user_id"], "l", "r", "score")
    return out.select("user_id", "l", "r", (_WITHIN - F.col("score")).cast("long").alias("gap"))


@query(f"""WITH {TRK}, c AS (SELECT DISTINCT user_id % 4 AS camera, frame // 4 AS section, user_id // 4 AS local_id FROM trk),
r AS (SELECT *, section - row_number() OVER (PARTITION BY camera, local_id ORDER BY section) AS run FROM c),
f AS (SELECT *, min(section) OVER (PARTITION BY camera, local_id, run) AS first FROM r)
SELECT camera, section, local_id, dense_rank() OVER (PARTITION BY camera ORDER BY first, local_id) - 1 AS track_id FROM f""")
def w2_linked_sections(spark, sf):
    """Clusters of sections of four frames; a user's vectors point its own way, so links are clear."""
    rows = trk(spark, sf).select((F.col("user_id") % 4).alias("camera"), "frame", F.expr("frame div 4").alias("section"), F.expr("user_id div 4").alias("local_id"))
    width = rows.agg(F.max("local_id")).first()[0] or 0
    rows = rows.withColumn("vector", F.transform(F.sequence(F.lit(0), F.lit(int(width))), lambda k: (k == F.col("local_id")).cast("double")))
    return tracklets.link_sections(rows, ["camera"], "frame", "vector").select("camera", "section", "local_id", "track_id").distinct()


@query("""WITH n AS (SELECT c_custkey AS id, c_nationkey AS nation, c_custkey // 30 AS part FROM customer),
g AS (SELECT id, nation, part, row_number() OVER (PARTITION BY nation, part ORDER BY id) AS place FROM n)
SELECT id, min(id) OVER (PARTITION BY nation, part, CASE WHEN nation % 3 = 0 THEN place % 2 WHEN nation % 3 = 1 THEN (place + 1) // 2 ELSE 0 END) AS cluster FROM g""")
def c10_associated(spark, sf):
    """Customers of a nation in runs of thirty keys are alike; of a third of the nations, those at odd and even places are too far apart; of another, only two next to each other are not in one frame."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.expr("c_custkey div 30").alias("part"))
    rows = checkpointed(rows.withColumn("place", F.row_number().over(Window.partitionBy("nation", "part").orderBy("id"))))
    a = rows.select("nation", "part", F.col("id").alias("a"), F.col("place").alias("p"))
    b = rows.select("nation", "part", F.col("id").alias("b"), F.col("place").alias("q"))
    both = a.join(b, ["nation", "part"]).where("a < b")
    alike = both.select("a", "b", (F.lit(0.9) - 0.01 * (F.col("q") - F.col("p"))).alias("similarity"))
    places = both.where("nation % 3 = 0").select("a", "b", F.lit(5.0).alias("mean_distance"), F.when((F.col("p") - F.col("q")) % 2 != 0, 11.0).otherwise(1.0).alias("least_distance"))
    # Two are in a frame together unless they are the first and second of a couple.
    seen = rows.where("nation % 3 = 1").withColumn("couple", F.expr("(place + 1) div 2"))
    times = both.where("nation % 3 = 1 and (p + 1) div 2 <> (q + 1) div 2").select(F.explode(F.array("a", "b")).alias("id"), F.concat_ws(":", "a", "b").alias("frame"))
    return matching.associate(seen.select("id").unionByName(rows.where("nation % 3 <> 1").select("id")), matching.overruled(alike, places, ["a", "b"]), times)


_PEOPLE = f"WITH {EV}, t AS (SELECT DISTINCT user_id, user_id // 3 AS person, user_id % 3 AS camera FROM ev)"


def _people(spark, sf):
    """Tracks: three cameras see each person; a track's neighbours by number are near it."""
    users = ev(spark, sf).select("user_id").distinct()
    return checkpointed(users.select(F.lit(1).alias("scene"), (F.col("user_id") % 3).alias("camera"), F.expr("user_id div 3").alias("local_id"), "user_id"))


def _near(tracks, steps=(1, 2)):
    """Pairs of tracks whose numbers differ by `steps`, of different cameras; alike within a person."""
    a = tracks.select("scene", F.struct("camera", "local_id").alias("a"), F.explode(F.array(*(F.col("user_id") + d for d in steps))).alias("user_id"), F.col("user_id").alias("u"))
    b = tracks.select("scene", F.struct("camera", "local_id").alias("b"), "user_id")
    alike = F.when(F.col("a.local_id") == F.col("b.local_id"), 0.9).otherwise(0.3)
    return a.join(b, ["scene", "user_id"]).where("a.camera <> b.camera").select("scene", "a", "b", F.lit(1.0).alias("distance"), alike.alias("similarity"))


@query(f"""{_PEOPLE}, f AS (SELECT t.user_id, person, camera, min(camera) OVER (PARTITION BY person) AS c FROM t)
SELECT camera, person AS local_id, dense_rank() OVER (ORDER BY c, person) AS global_id FROM f""")
def c12_first_identities(spark, sf):
    """Each track is near the next ones by number; those of a person are alike as well, so its first camera names it."""
    tracks = _people(spark, sf)
    return identities.first_identities(tracks, _near(tracks), ["scene"]).select("camera", "local_id", "global_id")


@query(f"""{_PEOPLE}, g AS (SELECT *, user_id - row_number() OVER (ORDER BY user_id) AS run FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY user_id) AS place FROM g)
SELECT camera, person AS local_id, min(user_id) OVER (PARTITION BY run, (place - 1) // 3) AS global_id FROM k""")
def c13_merged_identities(spark, sf):
    """Tracks each an identity, each linked with the next by number: an identity grows until it has all three cameras."""
    tracks = _people(spark, sf)
    links = _near(tracks, (1,)).withColumn("similarity", F.lit(0.9))
    ids = tracks.withColumn("global_id", F.col("user_id"))
    return identities.merge_identities(ids.drop("user_id"), links, ["scene"]).select("camera", "local_id", "global_id")


@query(f"""WITH {TRK}, t AS (SELECT user_id, user_id % 3 AS camera, user_id // 3 AS local_id, min(event_id) AS e FROM trk GROUP BY ALL),
p AS (SELECT a.user_id AS a, a.camera, a.local_id, b.user_id AS b, b.local_id AS gid, abs(a.e % 97 - b.e % 89) / 10.0 AS distance, (a.e + b.e) % 10 / 10.0 AS similarity
FROM t a JOIN t b ON a.user_id // 30 = b.user_id // 30 AND a.camera <> 0 AND b.camera = 0 AND abs(a.e % 97 - b.e % 89) / 10.0 <= 4.0 AND (a.e + b.e) % 10 / 10.0 >= 0.2),
x AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY distance, similarity DESC, gid) = 1)
SELECT camera, local_id, gid AS global_id FROM x QUALIFY row_number() OVER (PARTITION BY gid, camera ORDER BY distance, similarity DESC, camera, local_id) = 1""")
def c15_match_round(spark, sf):
    """Tracks of cameras 1 and 2 take identities of camera 0, each identity one of a camera."""
    tracks = trk(spark, sf).groupBy("user_id").agg(F.min("event_id").alias("e")).select(F.lit(1).alias("scene"), (F.col("user_id") % 3).alias("camera"), F.expr("user_id div 3").alias("local_id"), "user_id", "e", F.expr("user_id div 30").alias("tens"))
    named = tracks.where("camera = 0").withColumn("global_id", F.col("local_id"))
    a = tracks.where("camera <> 0").select("scene", "tens", F.struct("camera", "local_id").alias("a"), F.col("e").alias("ea"))
    b = named.select("scene", "tens", F.struct("camera", "local_id").alias("b"), F.col("e").alias("eb"))
    pairs = a.join(b, ["scene", "tens"]).select("scene", "a", "b", F.expr("abs(ea % 97 - eb % 89) / 10.0D").alias("distance"), F.expr("(ea + eb) % 10 / 10.0D").alias("similarity"))
    out = identities.match_round(tracks.where("camera <> 0"), named.select("scene", "camera", "local_id", "global_id"), pairs, ["scene"], 4.0, 0.2)
    return out.select("camera", "local_id", "global_id")


def _standing(spark, sf, frames):
    """Suppliers stand in a row before the camera of their nation, in every one of `frames` frames."""
    rows = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("camera"), F.col("s_suppkey").alias("key"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(frames).cast("long"))).alias("frame"))
    return rows.withColumns({"x": F.col("key") * 200.0, "score": F.lit(0.9), "class_id": F.lit(0)})


def _boxed(rows, x, y=None):
    y = F.lit(0.0) if y is None else y
    return rows.withColumns({"x1": x, "y1": y, "x2": x + 100, "y2": y + 100})


@query("""SELECT s_nationkey::BIGINT AS camera, f AS frame, row_number() OVER (PARTITION BY s_nationkey, f ORDER BY s_suppkey) AS track_id, round(s_suppkey * 200.0 - 130 * f * (f + 1) / 2 + 130, 4) AS x1
FROM supplier, range(1, 11) t(f)""")
def r9_camera_motion(spark, sf):
    """The camera moves on, each frame further than before; its motions, a file's rows in effect, keep everybody's track."""
    rows = _standing(spark, sf, 10)
    shift = -130 * F.col("frame") * (F.col("frame") + 1) / 2 + 130
    rows = _boxed(rows, F.col("x") + shift)
    motions = rows.select("camera", "frame").distinct().select("camera", "frame", F.array(F.lit(1.0), F.lit(0.0), -130.0 * F.col("frame"), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("warp"))
    return online.track(rows, "camera", "two-band", motions=motions).select("camera", "frame", "track_id", F.round("x1", 4).alias("x1"))


@query("""WITH s AS (SELECT s_nationkey::BIGINT AS camera, s_suppkey AS k, s_suppkey % 2 = 1 AS moves, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n, count(*) OVER (PARTITION BY s_nationkey) AS m, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 2 ORDER BY s_suppkey) AS nth FROM supplier)
SELECT camera, f AS frame, CASE WHEN moves AND f >= 5 THEN m + nth ELSE n END AS track_id FROM s, range(1, 10) t(f) WHERE NOT (moves AND f IN (5, 6))""")
def r6_gated_tracks(spark, sf):
    """Everybody looks as before, but from frame 5 on half of them stand where their motion cannot have brought them: these are new tracks, which show after three hits.

    They go to a row of their own, so that nobody comes to a place where another stood, however long the row is.
    """
    rows = _standing(spark, sf, 9)
    rows = _boxed(rows, F.col("x"), F.when((F.col("key") % 2 == 1) & (F.col("frame") >= 5), 1_000_000.0).otherwise(0.0))
    looks = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.cos(F.col("key") * (k + 1) * 0.7))
    return online.track(rows.withColumn("feature", looks), "camera", "cascade").select("camera", "frame", "track_id")


@query(f"""WITH {TRK}, d AS (SELECT user_id % 4 AS camera, frame // 4 AS section, frame, user_id, user_id // 8 AS couple, event_id FROM trk),
m AS (SELECT camera, section, couple FROM d GROUP BY camera, section, couple, frame HAVING count(DISTINCT user_id) > 1),
c AS (SELECT d.*, CASE WHEN m.camera IS NULL THEN -1 - couple ELSE user_id END AS cluster FROM d LEFT JOIN (SELECT DISTINCT * FROM m) m USING (camera, section, couple)),
f AS (SELECT *, min(frame * 1000000 + event_id) OVER (PARTITION BY camera, section, cluster) AS first FROM c)
SELECT camera, section, event_id, dense_rank() OVER (PARTITION BY camera, section ORDER BY first) - 1 AS local_id FROM f""")
def c3_split_clusters(spark, sf):
    """Two users of a camera look nearly alike: where they are in a frame together they are told apart, else they are one."""
    rows = trk(spark, sf).select((F.col("user_id") % 4).alias("camera"), "frame", "event_id", "user_id", F.expr("user_id div 8").alias("couple"))
    # A couple is three digits, each a place that is 1: two couples have at most two in common, so cosines of 0.68 at most.
    base = 1
    while base**3 <= int(rows.agg(F.max("couple")).first()[0] or 0):
        base += 1
    own = (F.expr("user_id div 4") % 2).cast("double") * 0.2
    digits = [F.expr(f"couple div {base**k} % {base}") for k in range(3)]
    looks = F.array(*(F.when(d == k, F.lit(1.0)).otherwise(0.0) for d in digits for k in range(base)), own)
    return tracklets.cluster_detections(rows.select("camera", "frame", "event_id", looks.alias("look")), ["camera"], "frame", "event_id", "look", cut=0.3, section=4).select("camera", "section", "event_id", "local_id")


@query(f"""WITH {TRK}, r AS (SELECT *, user_id % 4 AS camera FROM trk), n AS (SELECT camera, user_id, count(*) AS n FROM r GROUP BY ALL),
p AS (SELECT a.camera, a.user_id AS id_1, b.user_id AS id_2, count(*) AS n_shared, avg({INTER} / least({AREA}, {AREB})) AS overlap FROM r a JOIN r b ON a.camera = b.camera AND a.frame = b.frame AND a.user_id < b.user_id GROUP BY ALL)
SELECT p.camera, id_1, id_2, n_shared, round(overlap, 6) AS overlap FROM p JOIN n x ON x.camera = p.camera AND x.user_id = id_1 JOIN n y ON y.camera = p.camera AND y.user_id = id_2
WHERE n_shared / least(x.n, y.n) >= 0.3 AND overlap >= 0.2""")
def c7_overlapping_tracklets(spark, sf):
    rows = trk(spark, sf).withColumn("camera", F.col("user_id") % 4)
    found = tracklets.overlapping_tracklets(rows, ["camera"], "frame", "user_id", ratio=0.3, coefficient=0.2)
    return found.select("camera", "id_1", "id_2", "n_shared", r6("overlap").alias("overlap"))


@query(f"WITH {TRK} SELECT user_id, event_id, frame FROM trk QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, (x2 - x1) * (y2 - y1) DESC, event_id) = 1")
def a11_best_view(spark, sf):
    rows = trk(spark, sf)
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return tracklets.best_view(rows, ["user_id"], F.col("event_id") % 3, area, "event_id").select("user_id", "event_id", "frame")


@query("""WITH e AS (SELECT vec_id, vec_id % 8 AS scene, label::BIGINT AS global_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT a.scene, a.vec_id, b.global_id, count(*) AS n FROM e a JOIN e b ON a.scene = b.scene AND a.vec_id % 3 = 0 AND b.vec_id % 3 <> 0 AND list_cosine_similarity(a.v, b.v) >= 0.15 GROUP BY ALL),
w AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, global_id) = 1)
SELECT e.scene, e.vec_id AS local_id, w.global_id FROM e LEFT JOIN w ON w.vec_id = e.vec_id WHERE e.vec_id % 3 = 0""")
def c11_reassigned(spark, sf):
    rows = table(spark, sf, "embeddings").select((F.col("vec_id") % 8).alias("scene"), F.lit(0).alias("camera"), F.col("vec_id").alias("local_id"), F.col("label").cast("long").alias("global_id"), F.col("embedding").cast("array<double>").alias("vector"))
    out = identities.reassign(rows.where("local_id % 3 = 0").drop("global_id"), rows.where("local_id % 3 <> 0"), ["scene"], "vector", 0.15)
    return out.select("scene", "local_id", "global_id")


@query(f"WITH {TRK} SELECT user_id, frame, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rank FROM trk QUALIFY rank <= 5")
def t5_best_five(spark, sf):
    return X.top_per_group(trk(spark, sf), ["user_id"], [F.desc("score"), F.asc("event_id")], 5).select("user_id", "frame", F.col("rank").cast("long").alias("rank"))


#: A camera whose projections SQL can write down: u = (2 X + 1006) / 10 and v = (2 Y + 508) / 10 on the ground.
_INTRINSIC = [[2.0, 0.0, 100.0], [0.0, 2.0, 50.0], [0.0, 0.0, 1.0]]
_EXTRINSIC = [[1.0, 0.0, 0.0, 3.0], [0.0, 1.0, 0.0, 4.0], [0.0, 0.0, 1.0, 10.0]]


@query(f"WITH {TRK} SELECT event_id, round(5 * (x1 + x2) / 2 - 503, 6) AS x, round(5 * y2 - 254, 6) AS y FROM trk")
def p4_ground_points(spark, sf):
    point = G.project(G.ground_homography(_INTRINSIC, _EXTRINSIC), (F.col("x1") + F.col("x2")) / 2, F.col("y2"))
    return trk(spark, sf).select("event_id", point.alias("p")).select("event_id", r6("p.x").alias("x"), r6("p.y").alias("y"))


@query(f"WITH {TRK}, d AS (SELECT *, nullif(event_id % 50, 0) / 10 AS m FROM trk) SELECT event_id, round(m * (y1 - 50) / 2 + 1, 6) AS x, round(m * (x1 - 100) / 2 + 2, 6) AS y, round(m + 3, 6) AS z FROM d")
def p5_depth_points(spark, sf):
    """Every fiftieth box has no depth."""
    world = [[0.0, 1.0, 0.0, 1.0], [1.0, 0.0, 0.0, 2.0], [0.0, 0.0, 1.0, 3.0], [0.0, 0.0, 0.0, 1.0]]
    point = G.back_project(F.col("x1"), F.col("y1"), F.col("event_id") % 50 * 100, _INTRINSIC, world)
    return trk(spark, sf).select("event_id", point.alias("p")).select("event_id", *(r6(f"p.{c}").alias(c) for c in "xyz"))


@query(f"WITH {TRK} SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN frame::INTEGER END AS frame, CASE WHEN event_id % 4 <> 3 THEN x1::INTEGER END AS x1, CASE WHEN event_id % 4 <> 3 THEN y2::INTEGER END AS y2, CASE WHEN event_id % 4 <> 3 THEN (event_id % 100) / 100 END AS score, CASE WHEN event_id % 4 = 1 THEN (event_id % 6)::INTEGER END AS class_id FROM trk")
def s4_feature_names(spark, sf):
    """Names with a class and without, and others that are no feature files."""
    whole = F.concat_ws("_", F.lit("a/feature"), "frame", F.lit("7"), *(F.col(c).cast("int") for c in ("x1", "x2", "y1", "y2")), F.concat(F.lit("0"), F.lpad((F.col("event_id") % 100).cast("string"), 2, "0")))
    end = F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("_cls"), F.col("event_id") % 6)).otherwise("")
    path = F.when(F.col("event_id") % 4 == 3, F.lit("a/other.npy")).otherwise(F.concat(whole, end, F.lit(".npy")))
    return trk(spark, sf).select("event_id", N.feature_name(path).alias("n")).select("event_id", "n.frame", "n.x1", "n.y2", "n.score", "n.class_id")
