"""Sums and links that blocks of vectors return, against all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackloom.operators import aggregates as A
from trackloom.operators import graph, pairs


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(5)
    rows = [(int(k), int(k % 2) if k % 10 else 0, [float(x) for x in r.normal(size=3)] if k % 17 else [0.0] * 3) for k in range(90)]
    rows += [(200, 2, [1.0, 0.0, 0.0]), (201, 0, None), (None, 0, [1.0, 1.0, 1.0])]
    return spark.createDataFrame(rows, "m long, g int, v array<float>").withColumn("c", F.col("m") % 4).cache()


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of a few rows, so that members meet over many of them."""
    whole = pairs.meeting
    monkeypatch.setattr(pairs, "meeting", lambda *a, **k: whole(*a, **(k | {"group": 7, "part": 11})))


def test_medoid_of_sums(vectors, small_blocks):
    got = A.medoid_of_sums(pairs.similarity_sums(vectors, ["g"], "m", "v", 0.2), ["g"]).collect()
    want = A.medoid(pairs.feature_pairs(vectors, ["g"], "m", "v"), ["g"], 0.2).collect()
    assert {(r.g, r.member, round(r.centrality, 9)) for r in got} == {(r.g, r.member, round(r.centrality, 9)) for r in want} and len(want) == 2


def test_cluster_sums(vectors, small_blocks):
    got = pairs.cluster_sums(vectors, ["g"], "m", "c", "v", 0.1).collect()
    every = pairs.feature_pairs(vectors, ["g"], "m", "v").selectExpr("member_1 % 4 as a", "member_2 % 4 as b", "if(cosine > 0.1, cosine, 0) as s")
    want = every.groupBy("a", "b").agg(F.sum("s").alias("s")).collect()
    assert {(r.cluster_1, r.cluster_2): round(r.centrality, 9) for r in got} == {(r.a, r.b): round(r.s, 9) for r in want}


@pytest.mark.parametrize("least", [0.5, 0.97])
def test_links_connect_what_pairs_connect(vectors, small_blocks, least):
    links = pairs.feature_links(vectors, ["g"], "m", "v", least)
    every = pairs.feature_pairs(vectors, ["g"], "m", "v", least)
    assert {tuple(r) for r in graph.components(links, "member_1", "member_2").collect()} == {tuple(r) for r in graph.components(every, "member_1", "member_2").collect()}


def test_a_group_has_as_many_blocks_as_it_needs(spark):
    """A row was copied for all the blocks of the table, though it meets those of its group only."""
    rows = spark.range(400).selectExpr("id % 100 as g", "id as m").repartition(3)
    found = pairs.meeting(rows, rows.select(*(F.col(c).alias(c) for c in rows.columns)), lambda a, b: pa.table({"n": [len(a)], "m": [len(b)]}), "n long, m long", group=4, part=4, by=["g"]).collect()
    assert [tuple(r) for r in found] == [(4, 4)] * 100
