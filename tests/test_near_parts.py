"""Parts of vectors that hang together, found in blocks, as from the whole matrix; clusters of a window part by part."""

import numpy as np
import pytest

from trackloom.operators import assignment as K
from trackloom.operators import tracklets


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("least", [-np.inf, 0.0, 0.9])
def test_parts_in_blocks_as_from_the_matrix(seed, least):
    v = np.random.default_rng(seed).normal(size=(60, 3))
    v[11] = 0
    s = K.cosine_matrix(v, v)
    distance = 1 - np.where(s < least, 0.0, s)
    np.fill_diagonal(distance, 0)
    want = K.single_linkage(distance, 0.05)
    first = {c: k for k, c in reversed(list(enumerate(want.tolist())))}
    assert K.near_parts(v, 0.05, least, cells=150).tolist() == [first[c] for c in want.tolist()]


def test_a_window_of_many_objects_has_no_matrix_of_its_own(spark, monkeypatch):
    # Looks of 700 objects, each at right angles to the others, twice in a frame and in two frames.
    rows = spark.range(2800).selectExpr("0 as camera", "id div 2 % 2 as frame", "id", "id div 4 as thing", "id % 2 as which")
    looks = rows.selectExpr("camera", "frame", "id", "thing", "which", "transform(sequence(0, 1399), k -> cast(k = 2 * thing as double) + cast(k = 2 * thing + 1 as double) * 0.2 * which) as look")
    sizes = spark.sparkContext.accumulator(0)
    whole = K.cosine_matrix

    def watched(a, b):
        sizes.add(int(len(a) * len(b) > 1_500_000))
        return whole(a, b)

    monkeypatch.setattr(tracklets, "cosine_matrix", watched)
    got = tracklets.cluster_detections(looks, ["camera"], "frame", "id", "look", cut=0.3).select("thing", "which", "local_id").distinct().collect()
    assert len(got) == 1400 == len({r["local_id"] for r in got}) and sizes.value == 0
