"""Matching and association over sparse tables of pairs, where a scene is too large for one matrix.

Groups, such as a frame or a scene, are columns; ids of both sides are of one type.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import checkpoints
from .graph import components

#: Pairs of a connected part that one task solves; larger parts are solved by an auction over the table.
MOST_PAIRS = 200_000


def heaviest(left: np.ndarray, right: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """C17: which pairs make the matching of greatest total worth; nodes may stay alone.

    Rows of a sparse table: each pair has the numbers of its two nodes.  Nodes of
    the left side enter one after the other, each by the shortest path over what
    the prices leave of the worths, to a free node or to one that had better be
    alone.
    """
    n, m = int(left.max(initial=-1)) + 1, int(right.max(initial=-1)) + 1
    around: list[list[tuple[int, float, int]]] = [[] for _ in range(n)]
    for k, (i, j, w) in enumerate(zip(left.tolist(), right.tolist(), worth.tolist())):
        if w > 0:
            around[i].append((j, w, k))
    u, v = [max((w for _, w, _ in x), default=0.0) for x in around], [0.0] * m
    mate, owner = [-1] * n, [-1] * m  # a left node's pair, a right node's left node
    target = right.tolist()
    for start in range(n):
        if not around[start]:
            continue
        reach, came, done = {}, {}, {start: 0.0}
        heap: list[tuple[float, int]] = []
        # Ending at a left node leaves it alone, at a free right node takes that.
        end, shortest = ("left", start), u[start]
        node, base = start, 0.0
        while True:
            for j, w, k in around[node]:
                d = base + u[node] + v[j] - w
                if d < reach.get(j, shortest) - 1e-15:
                    reach[j], came[j] = d, (node, k)
                    heappush(heap, (d, j))
            while heap and reach[heap[0][1]] < heap[0][0]:
                heappop(heap)
            if not heap or heap[0][0] >= shortest:
                break
            base, j = heappop(heap)
            if owner[j] < 0:
                end, shortest = ("right", j), base
                break
            node = owner[j]
            done[node] = base
            if base + u[node] < shortest:
                end, shortest = ("left", node), base + u[node]
        for i, d in done.items():
            if d < shortest:
                u[i] -= shortest - d
        for j, d in reach.items():
            if d < shortest:
                v[j] += shortest - d
        if end[0] == "left":
            if end[1] == start:
                continue
            j = target[mate[end[1]]]
            mate[end[1]] = -1
        else:
            j = end[1]
        while True:
            i, k = came[j]
            before, owner[j] = mate[i], i
            mate[i] = k
            if i == start:
                break
            j = target[before]
    return np.array(sorted(k for k in mate if k >= 0), np.int64)


def parts(pairs: DataFrame, group: Sequence[str], left: str, right: str, name: str = "part") -> DataFrame:
    """`pairs` with the connected part of each: its least node (group, side, id)."""
    ends = [F.struct(*group, F.lit(side).alias("side"), F.col(c).alias("id")) for side, c in enumerate((left, right))]
    roots = components(pairs.select(ends[0].alias("_a"), ends[1].alias("_b")), "_a", "_b")
    return pairs.withColumn("_node", ends[0]).join(roots.select(F.col("node").alias("_node"), F.col("root").alias(name)), "_node").drop("_node")


def assignment(pairs: DataFrame, group: Sequence[str], left: str, right: str, cost: str, limit: float, most_pairs: int = MOST_PAIRS, resolution: float = 1e-6) -> DataFrame:
    """C17: of `pairs` those of an assignment within each group, none of which costs over `limit`; the greatest sum of `limit` less cost.

    Groups of up to `most_pairs` pairs are solved without a matrix, many of them in a
    task (`_dealt`).  Of larger ones the connected parts are: a part of up to
    `most_pairs` pairs in one task, a larger one by an auction whose rounds are joins
    (costs then count in steps of `resolution`).  Pairs with a null are left out; of a
    pair that comes again the least cost counts.  Columns: group, left, right, cost.
    """
    spark = pairs.sparkSession
    checkpoints(spark)
    key = list(group)
    own = pairs.select(*key, F.col(left).alias("_l"), F.col(right).alias("_r"), F.col(cost).cast("double").alias("_c")).where(F.col("_c") <= limit)
    own = own.dropna().groupBy(*key, "_l", "_r").agg(F.min("_c").alias("_c")).checkpoint()

    def solve(rows: pa.Table) -> pa.Table:
        l, r = _nodes(rows, key)
        order = np.lexsort((r, l))
        return rows.take(order[heaviest(l[order], r[order], limit - rows["_c"].to_numpy()[order])])

    out, large = _dealt(own, key, solve, most_pairs)
    if large is not None:
        nodes = large.groupBy("part").agg(F.count_distinct("_l").alias("_nodes"))
        worth = F.round((F.lit(limit) - F.col("_c")) / resolution).cast("long") * (F.col("_nodes") + 1)
        out = out.unionByName(_auction(large.join(nodes, "part").select(*key, "_l", "_r", "_c", worth.alias("_w")), key).select(*own.columns))
    return out.withColumnsRenamed({"_l": left, "_r": right, "_c": cost})


def _nodes(rows: pa.Table, key: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the left and of the right nodes of a table of pairs, by group and then id."""
    table = rows.to_pandas()
    group = table.groupby(key, sort=True).ngroup().to_numpy() if key else np.zeros(len(table), int)
    sides = []
    for c in ("_l", "_r"):
        ids = np.unique(table[c].to_numpy(), return_inverse=True)[1]
        sides.append(np.unique(group * (int(ids.max(initial=0)) + 1) + ids, return_inverse=True)[1])
    return sides[0], sides[1]


def _dealt(own: DataFrame, key: list[str], solve: Callable[[pa.Table], pa.Table], most_pairs: int, task_pairs: int = 50_000) -> tuple[DataFrame, DataFrame | None]:
    """What `solve` makes of the pairs `own` (key, _l, _r and a number), and the connected parts that are too large for it (None without any).

    Groups are dealt by a hash to tasks of some `task_pairs` pairs, as no pair
    reaches beyond its group; connected parts are only looked for in groups of more
    than `most_pairs` pairs.
    """
    names, schema = own.columns, to_arrow_schema(own.schema)

    def each(rows: pa.Table) -> pa.Table:
        return solve(rows.select(names)).cast(schema)

    sizes = own.groupBy(*key).agg(F.count("*").alias("_n"))
    many = sizes.where(F.col("_n") > max(1, most_pairs)).checkpoint()
    whole = not many.isEmpty()
    few = own if not whole else own.join(many.drop("_n"), key, "left_anti") if key else own.limit(0)
    tasks = F.lit(max(1, -(-own.count() // max(1, min(task_pairs, most_pairs)))))
    out = few.groupBy(F.pmod(F.xxhash64(*key) if key else F.lit(0).cast("long"), tasks).alias("_task")).applyInArrow(each, own.schema)
    if not whole:
        return out, None
    rows = parts(own.join(many.drop("_n"), key, "left_semi") if key else own, key, "_l", "_r").checkpoint()
    large = rows.groupBy("part").agg(F.count("*").alias("_n")).where(F.col("_n") > max(1, most_pairs)).select("part").checkpoint()
    out = out.unionByName(rows.join(large, "part", "left_anti").groupBy("part").applyInArrow(each, own.schema))
    return out, None if large.isEmpty() else rows.join(large, "part", "left_semi")


def _auction(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of an assignment of greatest total `_w`: whole numbers that are multiples of one more than the left nodes of their part.

    Each round every open left node bids for the right node that leaves it most at
    the present prices, up to what its second best would leave it and one more; a
    right node goes to the highest bid and its holder is open again.  Prices begin
    at 0 and a node to whom nothing is left worth its price retires, so the total is
    less than one step a node from the greatest: it is the greatest.
    """
    l, r = [*key, "_l"], [*key, "_r"]
    pairs = pairs.where("_w > 0").checkpoint()
    held = pairs.groupBy(*r).agg(F.lit(0).cast("long").alias("_p"), F.min(F.when(F.lit(False), F.col("_l"))).alias("_h")).checkpoint()
    open_ = pairs.select(*l).distinct().checkpoint()
    while not open_.isEmpty():
        left = pairs.join(open_, l).join(held.select(*r, "_p"), r).withColumn("_left", F.col("_w") - F.col("_p")).where("_left > 0")
        best = left.groupBy(*l).agg(F.min(F.struct((-F.col("_left")).alias("m"), "_r", "_p")).alias("_best")).select(*l, F.col("_best._r").alias("_to"), F.col("_best._p").alias("_at"), (-F.col("_best.m")).alias("_most"))
        second = left.join(best.select(*l, "_to"), l).where("_r <> _to").groupBy(*l).agg(F.max("_left").alias("_next"))
        bids = best.join(second, l, "left").select(*l, F.col("_to").alias("_r"), (F.col("_at") + F.col("_most") - F.coalesce("_next", F.lit(0)) + 1).alias("_bid")).checkpoint()
        won = bids.groupBy(*r).agg(F.min(F.struct((-F.col("_bid")).alias("m"), "_l")).alias("_top")).select(*r, (-F.col("_top.m")).alias("_new"), F.col("_top._l").alias("_to"))
        moved = held.join(won, r, "left").checkpoint()
        lost = bids.join(won.select(*r, "_to"), r).where("_l <> _to").select(*l)
        back = moved.where("_to is not null and _h is not null").select(*key, F.col("_h").alias("_l"))
        open_ = lost.unionByName(back).checkpoint()
        held = moved.select(*r, F.coalesce("_new", "_p").alias("_p"), F.coalesce("_to", "_h").alias("_h"))
    return pairs.join(held.where("_h is not null").select(*r, F.col("_h").alias("_l")), [*l, "_r"])


def greedy(pairs: DataFrame, group: Sequence[str], left: str, right: str, score: str, least: float = 0.0, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """C4: of `pairs` with a score over `least`, again and again the best whose two nodes are free (equal scores: the smaller left id, then right id).

    Groups of up to `most_pairs` pairs are solved many in a task (`_dealt`), of larger
    ones the connected parts of up to as many pairs.  In larger parts
    each round takes every pair that is the best of both its nodes: no better
    pair can take a node of it before, so all rounds together take what one pair at
    a time would.  Of a pair that comes again the greatest score counts; pairs with
    a null are left out.  Columns: group, left, right, score.
    """
    checkpoints(pairs.sparkSession)
    key = list(group)
    own = pairs.select(*key, F.col(left).alias("_l"), F.col(right).alias("_r"), F.col(score).cast("double").alias("_s")).where(F.col("_s") > least)
    own = own.dropna().groupBy(*key, "_l", "_r").agg(F.max("_s").alias("_s")).checkpoint()

    def solve(rows: pa.Table) -> pa.Table:
        l, r = _nodes(rows, key)
        taken, kept = (np.zeros(len(l), bool), np.zeros(len(r), bool)), []
        for k in np.lexsort((r, l, -rows["_s"].to_numpy())).tolist():
            if not taken[0][l[k]] and not taken[1][r[k]]:
                taken[0][l[k]] = taken[1][r[k]] = True
                kept.append(k)
        return rows.take(pa.array(kept, pa.int64()))

    out, large = _dealt(own, key, solve, most_pairs)
    if large is not None:
        out = out.unionByName(_greedy_rounds(large.select(*own.columns), key))
    return out.withColumnsRenamed({"_l": left, "_r": right, "_s": score})


def _greedy_rounds(rows: DataFrame, key: list[str]) -> DataFrame:
    rows = rows.withColumn("_key", F.struct((-F.col("_s")).alias("m"), "_l", "_r")).checkpoint()
    taken = []
    while not rows.isEmpty():
        first = [rows.groupBy(*key, c).agg(F.min("_key").alias(f"_first{c}")) for c in ("_l", "_r")]
        own = rows.join(first[0], [*key, "_l"]).join(first[1], [*key, "_r"]).where("_key = _first_l and _key = _first_r")
        taken.append(own.select(*key, "_l", "_r", "_s").checkpoint())
        for c in ("_l", "_r"):
            rows = rows.join(taken[-1].select(*key, c), [*key, c], "left_anti")
        rows = rows.checkpoint()
    return reduce(DataFrame.unionByName, taken)


def overruled(pairs: DataFrame, places: DataFrame, key: Sequence[str], near: float = 0.5, far: float = 10.0) -> DataFrame:
    """`pairs` (key, similarity) overruled by place: 1 where `mean_distance` is under `near`, -10 where `least_distance` is over `far`.

    A pair that only `places` has counts if it is overruled, and is left out else.
    """
    both = pairs.join(places.select(*key, "mean_distance", "least_distance"), list(key), "full")
    said = F.when(F.col("least_distance") > far, -10.0).when(F.col("mean_distance") < near, 1.0).otherwise(F.col("similarity"))
    return both.select(*key, said.alias("similarity")).where("similarity is not null")


def associate(nodes: DataFrame, pairs: DataFrame, frames: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """Clusters merged by average similarity, the most similar first, until none is over `least`: (id, cluster), named by the least member.

    `nodes` has id; `pairs` has a, b, similarity (a pair it lacks counts 0, and of
    one that comes again, either way round, the last in order); `frames` has id,
    frame.  Clusters with a pair of negative similarity, or with members in one
    frame, never merge.  Two clusters that are each other's most similar merge at
    once with all other such couples: an average is at most the greater of its
    parts, so merging elsewhere never brings forth a better partner, and the result
    is that of one merge at a time.  Similarities are compared to nine decimals;
    equal ones go by the lesser names.
    """
    checkpoints(nodes.sparkSession)
    one = pairs.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("s"), F.min("similarity").alias("low"))
    one = one.select("a", "b", F.when(F.col("low") < 0, F.col("low")).otherwise(F.col("s")).alias("s")).dropna().checkpoint()
    # Only clusters that similarity over 0 connects can ever merge; what is forbidden matters only among them.
    label = components(one.where("s > 0"), "a", "b")
    tables = [one.select("a", "b", "s", (F.col("s") < 0).alias("never"))]
    if frames is not None:
        seen = frames.select("id", "frame").dropna().distinct().join(label.select(F.col("node").alias("id"), "root"), "id")
        other = seen.select(F.col("id").alias("b"), "frame", "root")
        tables.append(seen.withColumnRenamed("id", "a").join(other, ["root", "frame"]).where("a < b").select("a", "b").distinct().select("a", "b", F.lit(0.0).alias("s"), F.lit(True).alias("never")))
    table = reduce(DataFrame.unionByName, tables).groupBy("a", "b").agg(F.sum("s").alias("s"), F.max("never").alias("never")).checkpoint()
    name = nodes.select("id").dropna().distinct().select("id", F.col("id").alias("cluster")).checkpoint()
    while True:
        size = name.groupBy("cluster").agg(F.count("*").alias("n"))
        both = table.where("not never").join(size.select(F.col("cluster").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("cluster").alias("b"), F.col("n").alias("nb")), "b")
        both = both.withColumn("mean", F.round(F.col("s") / (F.col("na") * F.col("nb")), 9)).where(F.col("mean") > least)
        key = F.struct((-F.col("mean")).alias("m"), "a", "b")
        both = both.select("a", "b", key.alias("k")).checkpoint()
        if both.isEmpty():
            return name
        top = both.select(F.col("a").alias("c"), "k").unionByName(both.select(F.col("b").alias("c"), "k")).groupBy("c").agg(F.min("k").alias("k"))
        merged = both.join(top.select(F.col("c").alias("a"), F.col("k").alias("ka")), "a").join(top.select(F.col("c").alias("b"), F.col("k").alias("kb")), "b").where("k = ka and k = kb").select(F.col("b").alias("old"), F.col("a").alias("new")).checkpoint()
        for c in ("a", "b"):
            table = table.join(merged.withColumnRenamed("old", c), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
        table = table.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s"), F.max("never").alias("never")).checkpoint()
        name = name.join(merged.withColumnRenamed("old", "cluster"), "cluster", "left").select("id", F.coalesce("new", "cluster").alias("cluster")).checkpoint()
