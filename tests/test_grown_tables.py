"""Queries against their SQL on small tables that hold what larger ones bring: zeros from below, long rows of suppliers, tracks that share a mask."""

import duckdb
import numpy as np
import pytest

import __spark_entry__
from test_queries import normal
from trackloom.operators import runs
from trackloom.plans.tables import FRAME


@pytest.fixture
def same(spark, tmp_path):
    def check(name, **tables):
        duck = duckdb.connect()
        for table, df in tables.items():
            df.write.parquet(f"{tmp_path}/{table}.parquet")
            duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        got = normal(__spark_entry__.queries()[name](spark, str(tmp_path)).toPandas())
        assert got == normal(duck.sql(__spark_entry__.oracle_sql()[name]).df())
        return got[0]

    return check


def events(spark, rows):
    """(event_id, user_id, frame) as events."""
    return spark.createDataFrame(rows, "event_id long, user_id long, frame long").selectExpr("event_id", f"timestamp_seconds(frame * {FRAME} + event_id % 1000) as ts", "user_id", "array('a', 'b')[event_id % 2] as event_type", "1.0D as value")


@pytest.mark.parametrize("name", ["p17_normalise", "w11_smoothed_features"])
def test_zeros_keep_their_sign(spark, same, name):
    rows = [(0, 0, [0.6, -1e-8, 0.8]), (1, 0, [3.0, 1e-8, -4.0]), (2, 1, [-2e-7, 5.0, 0.0])]
    assert any("-0.0" in r for r in same(name, embeddings=spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")))


def test_moved_objects_meet_nobody_in_a_long_row(spark, same):
    rows = spark.createDataFrame([(k, 0) for k in (0, 1, 2, 3, 5001, 5003)], "s_suppkey long, s_nationkey int")
    same("r6_gated_tracks", supplier=rows)


def test_two_tracks_on_one_mask(spark, same):
    rows = events(spark, [(421, 1, 0), (841, 3, 0), (3, 3, 1), (6, 3, 2), (9, 3, 3)])
    assert same("m6_mask_track_matches", events=rows)


def test_shared_masks_come_in_pieces():
    masks = [runs.of_lengths([k, 30, 5]) for k in range(20)]
    pieces = list(runs.shared_pieces(masks, masks, 50))
    assert len(pieces) > 3 and all(len(i) < 50 + len(masks) for i, _, _ in pieces)
    whole = runs.shared(masks, masks)
    assert len(whole[0]) == 400 and all((np.concatenate(x) == y).all() for x, y in zip(zip(*pieces), whole))
