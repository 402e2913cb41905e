"""C17 and C4: groups of few pairs are solved many in a task, without looking for connected parts."""

import random

import numpy as np
import pytest

from trackloom.operators import matching
from trackloom.operators.assignment import assign


@pytest.mark.parametrize("keyed", [True, False])
def test_small_groups_need_no_parts(spark, monkeypatch, keyed):
    r = random.Random(4)
    rows = list({(g, l, k): (g, l, k, float(r.randint(1, 30))) for g in range(40 if keyed else 1) for l in range(6) for k in r.sample(range(8), 3)}.values())
    table = spark.createDataFrame(rows, "g long, l long, r long, c double")
    key = ["g"] if keyed else []
    want, worth = set(), 0.0
    for g in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == g]
        used: tuple[set, set] = set(), set()
        for _, l, k, _ in sorted(own, key=lambda x: (-x[3], x[1], x[2])):
            if l not in used[0] and k not in used[1]:
                used[0].add(l)
                used[1].add(k)
                want.add((g, l, k) if keyed else (l, k))
        table_of = np.zeros((6, 8))
        for _, l, k, c in own:
            table_of[l, k] = max(0.0, 25 - c)
        worth += table_of[assign(-table_of)].sum()

    def refuse(*_):
        raise AssertionError("connected parts of small groups")

    monkeypatch.setattr(matching, "parts", refuse)
    assert {tuple(x[c] for c in (*key, "l", "r")) for x in matching.greedy(table, key, "l", "r", "c").collect()} == want
    got = matching.assignment(table, key, "l", "r", "c", 25.0).collect()
    assert sum(25 - x["c"] for x in got) == worth
    assert len({(*(x[c] for c in key), x["l"]) for x in got}) == len({(*(x[c] for c in key), x["r"]) for x in got}) == len(got)
