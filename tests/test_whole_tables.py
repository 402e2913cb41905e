"""Registered queries take the whole of their tables, not a subset of ids."""

import numpy as np
import pytest

from trackloom.plans import more
from trackloom.plans import queries as plans
from trackloom.plans.tables import FRAME


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """240 vectors of 3 labels and 70 users with two events each: ids beyond the former cuts."""
    at = tmp_path_factory.mktemp("small")
    r = np.random.default_rng(3)
    rows = [(int(k), int(k % 3), [float(x) for x in r.normal(size=6)]) for k in range(240)]
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    spark.range(140).selectExpr("id as event_id", "id div 2 as user_id", "'a' as event_type", "1.0D as value", f"timestamp_seconds(id % 2 * {FRAME}) as ts").write.parquet(f"{at}/events.parquet")
    v = np.array([x[2] for x in rows], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    return str(at), v @ v.T


def test_components_of_the_table(spark, small):
    at, cosine = small
    root = list(range(240))
    for a in range(240):
        for b in range(a + 1, 240):
            if a % 3 == b % 3 and cosine[a, b] >= 0.25 and root[a] != root[b]:
                p, q = sorted((root[a], root[b]))
                root = [p if x == q else x for x in root]
    want = {k: root[k] for k in range(240) if any(k != j and root[j] == root[k] for j in range(240))}
    assert {r["node"]: r["root"] for r in more.c13_components(spark, at).collect()} == want


@pytest.mark.parametrize("name, column", [("c18_reranked", "a"), ("c20_propagated", "id")])
def test_every_vector_has_a_result(spark, small, name, column):
    got = plans.QUERIES[name](spark, small[0]).select(column).distinct().collect()
    assert sorted(r[column] for r in got) == list(range(240))


def test_every_track_has_an_identity(spark, small):
    got = plans.QUERIES["c16_global_identities"](spark, small[0]).collect()
    assert sorted((r["camera"], r["local_id"]) for r in got) == sorted((u % 3, u // 3) for u in range(70))


def test_every_vector_is_an_anchor(spark, small):
    at, cosine = small
    got = {r["a"]: (r["hardest_positive"], r["hardest_negative"]) for r in plans.QUERIES["c23_hardest"](spark, at).collect()}
    same = np.arange(240)[:, None] % 3 == np.arange(240)[None] % 3
    own = same & ~np.eye(240, dtype=bool)
    assert sorted(got) == list(range(240))
    for a in range(240):
        assert got[a] == pytest.approx(((1 - cosine[a][own[a]]).max(), (1 - cosine[a][~same[a]]).min()), abs=2e-6)


def test_every_vector_is_in_a_set_and_every_track_in_pairs(spark, small):
    sets = plans.QUERIES["j12_topk_pair_mean"](spark, small[0]).collect()
    assert len(sets) == 9 and all(r["n_1"] == 40 and r["n_2"] == 40 for r in sets)
    found = plans.QUERIES["j7_positional_distance"](spark, small[0]).select("id_1", "id_2").collect()
    assert sorted(map(tuple, found)) == [(a, b) for a in range(70) for b in range(a + 1, 70)]
