"""The near-duplicate stage's threshold, and tables and filter sized for it."""

import math

import pytest

import corpus_pipeline
from trackloom.llm import neardup


def test_stage_links_from_080_up(spark):
    # One changed word inside 50 distinct ones: 41 of 51 runs are shared (0.804); inside 44: 35 of 45 (0.778).
    rows = []
    for k, n in enumerate((50, 44)):
        base = [f"w{k}x{i}" for i in range(n)]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join([*base[:20], "other", *base[21:]]))]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 10, 11]


@pytest.mark.parametrize("share", [80, 85, 90, 100])
def test_tables_and_filter_keep_the_stated_miss(share):
    s, n = share / 100, neardup.half_count(share)
    assert 2 * neardup.ROWS * n <= neardup.SIGNATURE
    assert 1 - (1 - (1 - s**neardup.ROWS) ** n) ** 2 <= neardup.MISS
    below = sum(math.comb(neardup.SIGNATURE, k) * s**k * (1 - s) ** (neardup.SIGNATURE - k) for k in range(neardup.least_agreement(share)))
    assert below < neardup.FILTER_MISS


def test_share_beyond_the_minhashes_is_refused():
    with pytest.raises(ValueError):
        neardup.half_count(60)
