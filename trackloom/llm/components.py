"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, rows: int | None = None) -> DataFrame:
    """(node, root) for every node that is in an edge; the root is the least node of its component.

    `edges` has two columns of one orderable type, taken in order; loops and
    repeated edges are allowed.  Both steps are grouped minima and equi-joins,
    so a hub with many edges is pre-aggregated or split, and each round is
    written to the shared folder.  `rows` says about how many edges there are, if
    that is known.
    """
    u, v = edges.columns
    state = scratch.save(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct(), "star-0", rows=rows, least=1)
    mark, k = None, 0
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if k:
            scratch.drop(f"star-{k - 1}")
        if now[0] == 0 or now == mark:
            break
        mark, k = now, k + 1
        state = scratch.save(_small_star(_large_star(state)), f"star-{k}", rows=2 * now[0], least=1)
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
