"""Clusters of all vectors of a track."""

import numpy as np

from trackloom.operators import assignment, tracklets


def test_blocks_cluster_as_the_whole_matrix():
    r = np.random.default_rng(1)
    for k in range(30):
        v = r.normal(size=(60, 4))
        v[:3] = 0
        want = assignment.dbscan(1 - assignment.cosine_matrix(v, v), 0.1 + k / 100, 4)
        assert (assignment.dbscan_vectors(v, 0.1 + k / 100, 4, cells=300) == want).all()


def test_representatives_look_at_every_vector(spark):
    # A cluster of 2100 on odd keys; another of 2000 on even ones.
    rows = [(1, 2 * k + 1, [1.0, 0.0]) for k in range(2100)] + [(1, 2 * k, [0.0, 1.0]) for k in range(2000)]
    df = spark.createDataFrame(rows, "track int, key int, vector array<double>")
    got = tracklets.representatives(df, ["track"], "key", "vector", most=4).collect()
    assert sorted(r["key"] for r in got) == [1, 3, 5, 7]
