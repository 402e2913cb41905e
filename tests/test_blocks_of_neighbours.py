"""Nearest neighbours in blocks: matrices of some cells, ties by id, and what is no number last."""

import numpy as np
import pytest

from trackloom.operators import pairs


@pytest.mark.parametrize("k", [1, 3, 7, 20])
def test_nearest_of_is_a_stable_sort(k):
    r = np.random.default_rng(k)
    d = np.round(r.random((9, 12)), 1)
    d[2], d[3, 2:], d[4] = 0.5, np.nan, np.nan
    i, j = pairs.nearest_of(d, k)
    want = np.argsort(d, 1, kind="stable")[:, :k]
    assert i.tolist() == np.repeat(np.arange(9), want.shape[1]).tolist() and j.tolist() == want.ravel().tolist()


def test_a_meeting_holds_no_matrix_of_its_size(spark):
    r = np.random.default_rng(1)
    v = np.round(r.normal(size=(300, 4)), 1)
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(v.tolist())], "id long, v array<double>")
    got = pairs.neighbours(rows.where("id % 3 = 0"), rows, "id", "id", "v", 5, group=64, part=100, cells=250).collect()
    s = v @ v.T / (np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None])
    want = {(q, k + 1): 1 - s[q, g] for q in range(0, 300, 3) for k, g in enumerate(np.argsort(1 - s[q], kind="stable")[:5])}
    assert {(x["q"], x["rank"]) for x in got} == set(want)
    assert all(abs(x["distance"] - want[x["q"], x["rank"]]) < 1e-12 for x in got)
