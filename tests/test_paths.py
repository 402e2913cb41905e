"""Paths that meet in blocks against all pairs of rows, with a frame and a track that hold a third of the rows."""

from collections import defaultdict

import numpy as np
import pytest

from trackloom.operators import pairs


@pytest.mark.parametrize("text", [False, True])
@pytest.mark.parametrize("block,section", [(3, 5), (256, 256)])
def test_paths_as_pairs_of_rows(spark, text, block, section):
    r = np.random.default_rng(2)
    rows = []
    for k in range(160):
        t = 7 if k % 3 == 0 else int(r.integers(-12, 20))
        track = 4 if k % 3 == 1 else int(r.integers(0, 12))
        rows.append((f"t{track}" if text else track, t, *r.integers(0, 50, 2).astype(float).tolist()))
    more = [(None, 7, 1.0, 1.0), ("x" if text else 99, None, 1.0, 1.0), ("y" if text else 98, 7, None, 1.0)]
    want = defaultdict(list)
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] == b[1]:
                want[a[0], b[0]].append(np.hypot(a[2] - b[2], a[3] - b[3]))
    df = spark.createDataFrame(rows + more, f"track {'string' if text else 'long'}, t int, x double, y double")
    got = {(g["id_1"], g["id_2"]): g for g in pairs.meeting_paths(df, "track", "t", ["x", "y"], block, section).collect()}
    assert set(got) == set(want)
    for k, ds in want.items():
        assert (got[k]["n_shared"], got[k]["least"], got[k]["mean"], got[k]["greatest"]) == pytest.approx((len(ds), min(ds), np.mean(ds), max(ds)))
    counts = pairs.meeting_paths(df.where("x is not null"), "track", "t", (), block, section)
    assert counts.columns == ["id_1", "id_2", "n_shared"] and {(g[0], g[1]): g[2] for g in counts.collect()} == {k: len(ds) for k, ds in want.items()}
    assert pairs.meeting_paths(df.limit(0), "track", "t", ["x"], block, section).collect() == []
