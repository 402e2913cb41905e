"""Aggregations and set operations (A, U and T rows of the inventory)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


def counts(df: DataFrame, by: Sequence[str], distinct: Sequence[str] = ()) -> DataFrame:
    """A1, A5: rows and distinct values in each group."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), *(F.countDistinct(c).alias(f"n_{c}") for c in distinct))


def mean_and_deviation(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A2, A3: mean and population deviation of each column, and the number of rows."""
    each = [f(F.col(c)).alias(f"{n}_{c}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), *each)


def fused(df: DataFrame, by: Sequence[str], columns: Sequence[str], angles: Sequence[str] = ()) -> DataFrame:
    """A4, K3: what several sensors say of one object in a frame, averaged; nulls are left out and 0.0 stands where all are null."""
    each = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns] + [F.coalesce(G.circular_mean(F.col(c)), F.lit(0.0)).alias(c) for c in angles]
    return df.groupBy(*by).agg(*each, F.count("*").alias("n_sensors"))


def majority(df: DataFrame, by: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """The most frequent value of each group (the heaviest, with `weight`); ties go to the smaller one."""
    n = F.count("*") if weight is None else F.sum(weight)
    per = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("votes"))
    w = Window.partitionBy(*by).orderBy(F.desc("votes"), value)
    return per.withColumn("_row", F.row_number().over(w)).where("_row = 1").drop("_row")


def roll_up(df: DataFrame, sets: Sequence[Sequence[str]], additive: Sequence[Column]) -> DataFrame:
    """Sums over several groupings at once; a column that a grouping lacks is null there."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(*additive)


def weighted_mean(value: str, weight: str) -> Column:
    """Mean of finals with weights, 0.0 where they add up to nothing."""
    return F.coalesce(F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0)), F.lit(0.0))


def medoid(pairs: DataFrame, group: Sequence[str], limit: float) -> DataFrame:
    """A10: of each group the member with the greatest sum of similarities over `limit`; ties go to the smaller one.

    `pairs` has member_1, member_2 and cosine, each pair once.
    """
    both = pairs.select(*group, F.col("member_1").alias("m"), "cosine").unionByName(pairs.select(*group, F.col("member_2").alias("m"), "cosine"))
    sums = both.groupBy(*group, "m").agg(F.sum(F.when(F.col("cosine") > limit, F.col("cosine")).otherwise(0.0)).alias("centrality"))
    return medoid_of_sums(sums.withColumnRenamed("m", "member"), group)


def medoid_of_sums(sums: DataFrame, group: Sequence[str]) -> DataFrame:
    """A10 from (group, member, centrality), as `pairs.similarity_sums` gives."""
    w = Window.partitionBy(*group).orderBy(F.round("centrality", 9).desc(), "member")
    return sums.withColumn("_row", F.row_number().over(w)).where("_row = 1").select(*group, "member", "centrality")


def cluster_centrality(pairs: DataFrame, meet: DataFrame, limit: float) -> DataFrame:
    """For each pair of clusters the sum of member similarities over `limit`; -1 if they share a frame.

    `pairs`: cluster_1, cluster_2, cosine; `meet`: cluster_1, cluster_2 of those that share a frame.
    """
    sums = pairs.groupBy("cluster_1", "cluster_2").agg(F.sum(F.when(F.col("cosine") > limit, F.col("cosine")).otherwise(0.0)).alias("centrality"))
    return marked_centrality(sums, meet)


def marked_centrality(sums: DataFrame, meet: DataFrame) -> DataFrame:
    """A9 from (cluster_1, cluster_2, centrality), as `pairs.cluster_sums` gives."""
    out = sums.join(meet.select("cluster_1", "cluster_2").distinct().withColumn("_meet", F.lit(True)), ["cluster_1", "cluster_2"], "left")
    return out.withColumn("centrality", F.when(F.col("_meet"), -1.0).otherwise(F.col("centrality"))).drop("_meet")


def keypoint_sides(keypoints: Column) -> Column:
    """Mean score of joints with even and with odd numbers."""

    def mean(parity: int) -> Column:
        own = F.filter(keypoints, lambda _, i: i % 2 == parity)
        return F.aggregate(own, F.lit(0.0), lambda s, k: s + k["score"]) / F.nullif(F.size(own), F.lit(0))

    return F.struct(mean(0).alias("even"), mean(1).alias("odd"))


def offset_union(left: DataFrame, right: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Two datasets in one, the ids of the second moved past the greatest of the first."""
    top = left.agg(*((F.coalesce(F.max(c), F.lit(-1)) + 1).alias(f"_{c}") for c in ids))
    moved = right.crossJoin(F.broadcast(top)).select(*((F.col(c) + F.col(f"_{c}")).alias(c) if c in ids else F.col(c) for c in right.columns))
    return left.unionByName(moved)


def keep_first(first: DataFrame, second: DataFrame, key: Sequence[str]) -> DataFrame:
    """All rows of the first, and those of the second whose key it lacks."""
    return first.unionByName(second.join(first.select(*key).distinct(), list(key), "left_anti"))


def attribute_accuracy(df: DataFrame, instance: str, attribute: str, truth: str, said: str) -> DataFrame:
    """Mean accuracy over attributes, and accuracy, precision, recall and F1 over instances.

    `truth` and `said` are 0 or 1.  A share without cases counts as 0.
    """

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    hit = F.sum(F.col(truth) * F.col(said))
    either = F.sum(F.greatest(truth, said))
    by_attribute = df.groupBy(attribute).agg((share(hit, F.sum(truth)) / 2 + share(F.sum((1 - F.col(truth)) * (1 - F.col(said))), F.sum(1 - F.col(truth))) / 2).alias("balanced"))
    by_instance = df.groupBy(instance).agg(share(hit, either).alias("accuracy"), share(hit, F.sum(said)).alias("precision"), share(hit, F.sum(truth)).alias("recall"))
    of_instances = by_instance.agg(*(F.avg(c).alias(c) for c in ("accuracy", "precision", "recall")))
    f1 = share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return by_attribute.agg(F.avg("balanced").alias("mean_accuracy")).crossJoin(F.broadcast(of_instances)).withColumn("f1", f1)
