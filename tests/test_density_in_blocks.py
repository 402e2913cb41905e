"""Clusters of a large group without a matrix of the group, and counts of neighbours without pairs."""

import numpy as np
from pyspark.sql import functions as F

from trackloom.operators import assignment, pairs, tracklets


def test_no_matrix_where_no_cluster_is_twice_in_a_frame(spark):
    r = np.random.default_rng(6)
    v = np.round(r.normal(size=(90, 3)), 1)
    rows = spark.createDataFrame([(0, k, x) for k, x in enumerate(v.tolist())], "g long, id long, v array<double>")

    def refuse(*_):
        raise AssertionError("a matrix of the whole part")

    d = 1 - np.maximum(assignment.cosine_matrix(v, v), 0.0)
    np.fill_diagonal(d, 0)
    for method, want in (("density", assignment.noise_as_singletons(assignment.dbscan(d, 0.02, 4))), ("linkage", assignment.single_linkage(d, 0.02))):
        # Both kernels take a matrix; they go to the tasks in the closure's globals.
        held = {k: tracklets.__dict__[k] for k in ("dbscan", "single_linkage")}
        run = tracklets.cluster_detections.__globals__
        try:
            run.update(dict.fromkeys(held, refuse))
            made = {}

            class Groups:
                def __getattr__(self, name):
                    return getattr(rows, name)

                def select(self, *columns):
                    made["rows"] = rows.select(*columns).toPandas()
                    return self

                def groupBy(self, *_):
                    return self

                def applyInPandas(self, function, _):
                    return function(made["rows"])

            got = tracklets.cluster_detections(Groups(), ["g"], "id", "id", "v", cut=0.02, method=method, reach=0.02)
        finally:
            run.update(held)
        label = got.sort_values("id")["local_id"].to_numpy()
        assert (label[:, None] == label[None]).tolist() == (want[:, None] == want[None]).tolist()


def test_counts_of_neighbours(spark):
    r = np.random.default_rng(7)
    v = r.normal(size=(60, 3))
    rows = spark.createDataFrame([(k % 2, k, x) for k, x in enumerate(v.tolist())], "g long, id long, v array<double>")
    s = assignment.cosine_matrix(v, v)
    want = {k: sum(1 for j in range(k % 2, 60, 2) if j != k and s[k, j] >= 0.5) for k in range(60)}
    got = {x["id"]: x["n"] for x in pairs.near_counts(rows, ["g"], "id", "v", 0.5).collect()}
    assert got == {k: n for k, n in want.items() if n}
    ends = pairs.feature_pairs(rows, ["g"], "id", "v", 0.5).select(F.explode(F.array("member_1", "member_2")).alias("id")).groupBy("id").count()
    assert got == {x["id"]: x["count"] for x in ends.collect()}
