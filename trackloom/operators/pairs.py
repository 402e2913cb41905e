"""Joins of detections, tracks and vectors (J rows of the inventory)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import geometry as G
from ..functions import vectors as V
from .assignment import cosine_matrix


def attach_first(left: DataFrame, right: DataFrame, key: Sequence[str], order: Sequence[str], take: Sequence[str]) -> DataFrame:
    """Each left row with the first right row of its key, nulls where there is none."""
    once = right.withColumn("_row", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_row = 1")
    return left.join(once.select(*key, *take), list(key), "left")


def back_to_rows(rows: DataFrame, found: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows with what was found for their `key`, nulls being equal too."""
    names = [f"_k{k}" for k in range(len(key))]
    found = found.withColumnsRenamed(dict(zip(key, names)))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(key, names)]
    return rows.join(found, same).drop(*names)


def top_overlaps(left: DataFrame, right: DataFrame, frame: Sequence[str], left_id: str, right_id: str, box: str = "box", alone: float = 0.4) -> DataFrame:
    """For each left box the right box of its frame with the greatest IoU, and `near`, how many reach IoU `alone`.

    Ties go to the smaller right id.  Equal boxes of a frame meet others once, so
    a frame has as many pairs as it has different boxes.
    """
    a = left.select(*frame, F.col(left_id), F.col(box).alias("_a"))
    b = right.groupBy(*frame, F.col(box).alias("_b")).agg(F.min(right_id).alias("_r"), F.count("*").alias("_n"))
    pairs = a.select(*frame, "_a").distinct().join(b, list(frame)).withColumn("iou", G.iou(F.col("_a"), F.col("_b")))
    best = pairs.groupBy(*frame, "_a").agg(F.sum(F.when(F.col("iou") >= alone, F.col("_n")).otherwise(0)).alias("near"), F.max(F.struct("iou", (-F.col("_r")).alias("m"))).alias("top"))
    return back_to_rows(a, best, [*frame, "_a"]).select(*frame, left_id, (-F.col("top")["m"]).alias(right_id), F.col("top")["iou"].alias("iou"), "near")


def best_overlap(left: DataFrame, right: DataFrame, frame: Sequence[str], left_id: str, right_id: str, box: str = "box", alone: float = 0.4, least: float = 0.8) -> DataFrame:
    """`top_overlaps` where just one right box reaches IoU `alone` and the best reaches `least`."""
    best = top_overlaps(left, right, frame, left_id, right_id, box, alone)
    return best.where((F.col("near") == 1) & (F.col("iou") >= least)).drop("near")


def nearest(left: DataFrame, right: DataFrame, frame: Sequence[str], left_id: str, right_id: str, coordinates: Sequence[str]) -> DataFrame:
    """The nearest right point of each left point's frame (null without any); ties go to the smaller id.

    Points of a frame at one place meet others once.
    """
    b = right.groupBy(*frame, *(F.col(c).alias(f"_{c}") for c in coordinates)).agg(F.min(right_id).alias(right_id))
    d2 = sum((F.pow(F.col(c) - F.col(f"_{c}"), F.lit(2.0)) for c in coordinates[1:]), F.pow(F.col(coordinates[0]) - F.col(f"_{coordinates[0]}"), F.lit(2.0)))
    pairs = left.select(*frame, *coordinates).distinct().join(b, list(frame), "left").withColumn("_near", F.when(F.col(right_id).isNotNull(), F.struct(F.sqrt(d2).alias("d"), F.col(right_id).alias("i"))))
    best = pairs.groupBy(*frame, *coordinates).agg(F.min("_near").alias("_near"))
    out = back_to_rows(left.select(*frame, left_id, *coordinates), best, [*frame, *coordinates]).groupBy(*frame, left_id).agg(F.min("_near").alias("_near"))
    return out.select(*frame, left_id, F.col("_near")["i"].alias(right_id), F.col("_near")["d"].alias("distance"))


def similarities(gt: DataFrame, tracker: DataFrame, frame: Sequence[str], gt_id: str, tracker_id: str, similarity: Column, gt_col: str = "gt_box", tracker_col: str = "tracker_box") -> DataFrame:
    """Ground truth with tracker rows of the same frame, and their similarity."""
    pairs = gt.select(*frame, gt_id, gt_col).join(tracker.select(*frame, tracker_id, tracker_col), list(frame))
    return pairs.select(*frame, gt_id, tracker_id, similarity.alias("similarity"))


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """`df` by `by` in parts for every core: a small table whose pairs are many would be put together into a few tasks."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 6 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *by)


def kinds_meeting(left: DataFrame, right: DataFrame, frame: Sequence[str], left_id: str, right_id: str, left_of: str, right_of: str, values: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All pairs of rows of a frame, with values of `left_of` and `right_of`.

    Equal ones of a frame are a kind: `values` gets a row a pair of kinds, may add
    columns and leave rows out, and what is left goes to all the kinds' members.
    """
    one = left.groupBy(*frame, left_of).agg(F.collect_list(left_id).alias("_l"))
    two = right.groupBy(*frame, right_of).agg(F.collect_list(right_id).alias("_r"))
    met = values(dealt(one, *frame).join(dealt(two, *frame), list(frame))).drop(left_of, right_of)
    names = [c for c in met.columns if c not in ("_l", "_r", *frame)]
    some = met.select(*frame, *names, "_r", F.explode("_l").alias(left_id))
    return some.select(*frame, left_id, F.explode("_r").alias(right_id), *names)


def solids_meeting(df: DataFrame, frame: Sequence[str], id_col: str, solid: str, first: str, second: str) -> DataFrame:
    """Pairs of a frame's upright boxes that share volume, the smaller id `first`, with their `iou`."""
    rows = dealt(df.select(*frame, id_col, *(c.alias(n) for n, c in G.solid_ends(F.col(solid)).items())), *frame)
    ends = [c for c in rows.columns if c not in (*frame, id_col)]
    one, two = (rows.select(*frame, F.col(id_col).alias(name), *(F.col(c).alias(f"{p}_{c}") for c in ends)) for p, name in (("a", first), ("b", second)))
    met = one.join(two, list(frame)).where(F.col(first) < F.col(second)).withColumn("_both", G.shared_volume("a_", "b_")).where("_both > 0")
    return met.select(*frame, first, second, (F.col("_both") / (F.col("a_volume") + F.col("b_volume") - F.col("_both"))).alias("iou"))


def shared_frames(df: DataFrame, frame: Sequence[str], id_col: str, value: Column | None = None) -> DataFrame:
    """For each pair of ids that meet in a frame, how many frames they share.

    With `value`, an expression over structs a and b of the two rows, its least,
    mean and greatest are returned too.  Pairs are taken once (id_1 < id_2).
    """
    rest = [c for c in df.columns if c not in (*frame, id_col)]
    a = df.select(*frame, F.col(id_col).alias("id_1"), F.struct(*rest).alias("a") if rest else F.lit(None).alias("a"))
    b = df.select(*frame, F.col(id_col).alias("id_2"), F.struct(*rest).alias("b") if rest else F.lit(None).alias("b"))
    pairs = a.join(b, list(frame)).where("id_1 < id_2")
    more = [] if value is None else [F.min(value).alias("least"), F.avg(value).alias("mean"), F.max(value).alias("greatest")]
    return pairs.groupBy("id_1", "id_2").agg(F.count("*").alias("n_shared"), *more)


def _met(one: pa.Table, two: pa.Table, same: bool, track: str, frame: str, coordinates: Sequence[str]) -> pa.Table:
    """What the paths of two blocks share: a row a pair of tracks, the smaller id first."""
    sides = []
    for table in (one, two):
        ids = table[track].combine_chunks().dictionary_encode()
        at = table[frame].to_numpy()
        code = ids.indices.to_numpy()
        # Rows of a track that fall on one frame are told apart by their number.
        order = np.lexsort((code, at))
        at, code = at[order], code[order]
        first = np.concatenate([[True], (at[1:] != at[:-1]) | (code[1:] != code[:-1])])
        begin = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        layer = np.arange(len(at)) - begin
        again = np.lexsort((layer, at))
        xs = np.stack([table[c].to_numpy()[order][again].astype(float) for c in coordinates]) if coordinates else np.zeros((0, len(at)))
        at, layer = at[again], layer[again]
        edges = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (layer[1:] != layer[:-1]), [True]]))
        pieces: dict = {}
        for a, b in zip(edges[:-1], edges[1:]):
            pieces.setdefault(at[a], []).append(slice(int(a), int(b)))
        sides.append((ids.dictionary, code[again], xs, pieces))
    (left, i, x, here), (right, j, y, there) = sides
    shape = len(left), len(right)
    n, total, least, most = np.zeros(shape, np.int64), np.zeros(shape), np.full(shape, np.inf), np.full(shape, -np.inf)
    for t in here.keys() & there.keys():
        for a in here[t]:
            for b in there[t]:
                cells = np.ix_(i[a], j[b])
                n[cells] += 1
                if coordinates:
                    d = np.sqrt(sum((x[c, a][:, None] - y[c, b][None]) ** 2 for c in range(len(x))))
                    total[cells] += d
                    least[cells] = np.minimum(least[cells], d)
                    most[cells] = np.maximum(most[cells], d)
    a, b = np.nonzero(n)
    ids = left.take(pa.array(a)), right.take(pa.array(b))
    ordered = pc.less(*ids)
    out = pa.table({"id_1": pc.if_else(ordered, *ids), "id_2": pc.if_else(ordered, *ids[::-1]), "n": n[a, b], "total": total[a, b], "least": least[a, b], "greatest": most[a, b]})
    # Within a block each pair comes from both sides, and each track meets itself.
    return out.filter(ordered) if same else out


def meeting_paths(df: DataFrame, track: str, frame: str, coordinates: Sequence[str] = (), block: int = 256, section: int = 256) -> DataFrame:
    """(id_1, id_2, n_shared, and with coordinates least, mean, greatest distance) of all pairs of tracks that meet in a frame, id_1 < id_2.

    Blocks of some `block` tracks meet over `section` frames at a time, so a task
    holds a few matrices of that size whatever a frame or a track holds, and a row
    a pair and section leaves it.  Frames are whole numbers; rows with a null track,
    frame or coordinate meet nothing; rows of a track that repeat a frame all count.
    """
    rows = df.select(track, F.col(frame).cast("long").alias(frame), *coordinates).dropna()
    blocks = max(1, -(-rows.select(track).distinct().count() // block))
    rows = rows.withColumns({"_block": F.pmod(F.xxhash64(track), F.lit(blocks)).cast("int"), "_section": F.floor(F.col(frame) / section)})
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = rows.withColumn("_other", other).withColumns({"_a": F.least("_block", "_other"), "_b": F.greatest("_block", "_other")}).drop("_other")
    kind = dict(rows.dtypes)[track]
    schema = f"id_1 {kind}, id_2 {kind}, n long, total double, least double, greatest double"
    empty = to_arrow_schema(T.StructType.fromDDL(schema)).empty_table()

    def meet(table: pa.Table) -> pa.Table:
        a, b = table["_a"][0].as_py(), table["_b"][0].as_py()
        one, two = (table.filter(pc.equal(table["_block"], k)) for k in (a, b))
        return _met(one, two, a == b, track, frame, coordinates) if len(one) and len(two) else empty

    parts = rows.groupBy("_a", "_b", "_section").applyInArrow(meet, schema)
    more = [F.min("least").alias("least"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("greatest").alias("greatest")] if coordinates else []
    return parts.groupBy("id_1", "id_2").agg(F.sum("n").alias("n_shared"), *more)


def overlap_ratio(df: DataFrame, frame: str, id_col: str, value: Column | None = None) -> DataFrame:
    """`shared_frames` with the lengths of both tracks and the share of the shorter one."""
    lengths = df.groupBy(id_col).agg(F.countDistinct(frame).alias("n"))
    one = lengths.select(F.col(id_col).alias("id_1"), F.col("n").alias("n_1"))
    two = lengths.select(F.col(id_col).alias("id_2"), F.col("n").alias("n_2"))
    shared = meeting_paths(df, id_col, frame) if value is None else shared_frames(df, [frame], id_col, value)
    return shared.join(one, "id_1").join(two, "id_2").withColumn("ratio", F.col("n_shared") / F.least("n_1", "n_2"))


def positional_distance(df: DataFrame, track: str, order: str, coordinates: Sequence[str]) -> DataFrame:
    """Mean distance of tracks, the first rows with the first, the second with the second and so on, up to the shorter one."""
    df = df.withColumn("_place", F.row_number().over(Window.partitionBy(track).orderBy(order)))
    return meeting_paths(df, track, "_place", coordinates).select("id_1", "id_2", F.col("n_shared").alias("n_points"), F.col("mean").alias("distance"))


def overlapping_ranges(df: DataFrame, id_col: str, first: str, last: str, least: int = 1, bucket: int = 100, apart: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows whose ranges of frames share at least `least` frames, both ends included.

    Ranges are dealt to buckets of `bucket` frames and meet by equal bucket; a
    pair counts in the bucket where its overlap begins, so it comes once.  Rows
    equal in a column of `apart` (such as a camera) are no pair.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(first).cast("long").alias("f"), F.col(last).cast("long").alias("l"), *apart)
    own = own.withColumn("b", F.explode(F.sequence(F.floor(F.col("f") / bucket), F.floor(F.col("l") / bucket))))
    a, c = own.alias("a"), own.alias("c")
    begin = F.greatest("a.f", "c.f")
    shared = F.least("a.l", "c.l") - begin + 1
    pairs = a.join(c, F.col("a.b") == F.col("c.b")).where((F.col("a.id") < F.col("c.id")) & (shared >= least) & (F.floor(begin / bucket) == F.col("a.b")))
    for name in apart:
        pairs = pairs.where(F.col(f"a.{name}") != F.col(f"c.{name}"))
    return pairs.select(F.col("a.id").alias("id_1"), F.col("c.id").alias("id_2"), shared.alias("n_shared"))


def _cosines(one: pa.Table, two: pa.Table) -> np.ndarray:
    """Cosines of two blocks; no number where a vector is zero."""
    x, y = stacked(one["v"]), stacked(two["v"])
    s = cosine_matrix(x, y)
    s[np.linalg.norm(x, axis=1) == 0] = s[:, np.linalg.norm(y, axis=1) == 0] = np.nan
    return s


def _members(df: DataFrame, group: Sequence[str], member: str, vector: str, *more: Column) -> tuple[DataFrame, DataFrame]:
    own = df.where(F.col(member).isNotNull() & F.col(vector).isNotNull()).select(*group, F.col(member).alias("member"), F.col(vector).cast("array<double>").alias("v"), *more)
    # Columns of its own: a cogroup takes columns of one origin for one.
    return own, own.select(*(F.col(c).alias(c) for c in own.columns))


def feature_pairs(df: DataFrame, group: Sequence[str], member: str, vector: str, least: float | None = None) -> DataFrame:
    """Cosine of all pairs of vectors of a group (member_1 < member_2), those of at least `least`.

    A group's vectors meet in blocks (`meeting`), so a group of any size is spread
    over tasks.  A zero vector has no cosine and is in no pair; members or vectors
    that are null take no part.
    """
    kinds = dict(df.dtypes)
    own, other = _members(df, group, member, vector)

    def kernel(one: pa.Table, two: pa.Table) -> pa.Table:
        s = _cosines(one, two)
        i, j = np.nonzero(~np.isnan(s) if least is None else s >= least - 1e-12)
        first, second = one["member"].combine_chunks().take(pa.array(i)), two["member"].combine_chunks().take(pa.array(j))
        out = pa.table({**{c: one[c].combine_chunks().take(pa.array(i)) for c in group}, "member_1": first, "member_2": second, "cosine": s[i, j]})
        return out.filter(pc.less(first, second))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in group) + f", member_1 {kinds[member]}, member_2 {kinds[member]}, cosine double"
    return meeting(own, other, kernel, schema.removeprefix(", "), group=1024, part=4096, by=group)


def near_counts(df: DataFrame, group: Sequence[str], member: str, vector: str, least: float) -> DataFrame:
    """(member, n): how many others of its group have a cosine of at least `least` with each member that has any.

    A block returns a row a member, so pairs are never written out.
    """
    own, other = _members(df, group, member, vector)

    def kernel(one: pa.Table, two: pa.Table) -> pa.Table:
        ids = pa.chunked_array([*one["member"].chunks, *two["member"].chunks]).dictionary_encode().combine_chunks().indices.to_numpy()
        n = np.zeros(len(one), np.int64)
        for at in range(0, len(one), 256):
            near = _cosines(one.slice(at, 256), two) >= least - 1e-12
            near &= ids[at : min(at + 256, len(one)), None] != ids[None, len(one) :]
            n[at : at + 256] = near.sum(1)
        return pa.table({"member": one["member"], "n": n})

    found = meeting(own, other, kernel, f"member {dict(df.dtypes)[member]}, n long", group=4096, part=4096, by=group)
    return found.groupBy("member").agg(F.sum("n").alias("n")).where("n > 0").withColumnRenamed("member", member)


def similarity_sums(df: DataFrame, group: Sequence[str], member: str, vector: str, limit: float) -> DataFrame:
    """A10: (group, member, centrality): for each member of `feature_pairs` the sum of its cosines over `limit`.

    A block returns a row a member, so pairs are never written out.  Repeated members are one.
    """
    kinds = dict(df.dtypes)
    own, other = _members(df, group, member, vector)

    def kernel(one: pa.Table, two: pa.Table) -> pa.Table:
        s = _cosines(one, two)
        ids = pa.chunked_array([*one["member"].chunks, *two["member"].chunks]).dictionary_encode().combine_chunks().indices.to_numpy()
        s[ids[: len(one), None] == ids[None, len(one) :]] = np.nan
        out = {**{c: one[c] for c in group}, "member": one["member"], "total": np.where(s > limit, s, 0.0).sum(1), "n": (~np.isnan(s)).sum(1)}
        return pa.table(out)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in group), f"member {kinds[member]}, total double, n long"])
    found = meeting(own, other, kernel, schema, group=1024, part=4096, by=group)
    return found.groupBy(*group, "member").agg(F.sum("total").alias("centrality"), F.sum("n").alias("n")).where("n > 0").drop("n")


def cluster_sums(df: DataFrame, group: Sequence[str], member: str, cluster: str, vector: str, limit: float) -> DataFrame:
    """(cluster_1, cluster_2, centrality): the sum of cosines over `limit` of the pairs of `feature_pairs`, the smaller member's cluster first.

    A block returns a row a pair of clusters.
    """
    kinds = dict(df.dtypes)
    own, other = _members(df.where(F.col(cluster).isNotNull()), group, member, vector, F.col(cluster).alias("cluster"))

    def kernel(one: pa.Table, two: pa.Table) -> pa.Table:
        one, two = one.sort_by("member"), two.sort_by("member")
        s = _cosines(one, two)
        # How far the members go that are not over each one's.
        joint = pa.concat_tables([one.select(["member"]), two.select(["member"])]).append_column("k", pa.array(np.arange(len(one) + len(two)))).sort_by([("member", "ascending"), ("k", "descending")])["k"].to_numpy()
        before = np.cumsum(joint >= len(one))[np.argsort(joint)][: len(one)]
        s[np.arange(len(two))[None] < before[:, None]] = np.nan
        rows, columns = one["cluster"].combine_chunks().dictionary_encode(), two["cluster"].combine_chunks().dictionary_encode()
        shape = len(rows.dictionary), len(columns.dictionary)
        i, j = rows.indices.to_numpy(), columns.indices.to_numpy()
        over, there = np.where(s > limit, s, 0.0), ~np.isnan(s)
        total, n = np.zeros(shape), np.zeros(shape, np.int64)
        for x in range(shape[0]):
            total[x] = np.bincount(j, over[i == x].sum(0), shape[1])
            n[x] = np.bincount(j, there[i == x].sum(0), shape[1])
        x, y = np.nonzero(n)
        return pa.table({"cluster_1": rows.dictionary.take(pa.array(x)), "cluster_2": columns.dictionary.take(pa.array(y)), "total": total[x, y]})

    found = meeting(own, other, kernel, f"cluster_1 {kinds[cluster]}, cluster_2 {kinds[cluster]}, total double", group=1024, part=4096, by=group)
    return found.groupBy("cluster_1", "cluster_2").agg(F.sum("total").alias("centrality"))


def feature_links(df: DataFrame, group: Sequence[str], member: str, vector: str, least: float) -> DataFrame:
    """(member_1, member_2): links that connect the same members as the pairs of `feature_pairs` of at least `least` do.

    A block returns a spanning forest of its pairs, so fewer links than it has members.
    """
    kinds = dict(df.dtypes)
    own, other = _members(df, group, member, vector)

    def kernel(one: pa.Table, two: pa.Table) -> pa.Table:
        s = _cosines(one, two)
        near = s >= least - 1e-12
        ids = pa.chunked_array([*one["member"].chunks, *two["member"].chunks]).combine_chunks()
        code = ids.dictionary_encode().indices.to_numpy()
        near &= code[: len(one), None] != code[None, len(one) :]
        # Breadth first over both sides; each one reached keeps the one it was reached from.
        i, j = [], []
        free, open_ = np.ones(len(two), bool), np.ones(len(one), bool)
        for k in range(len(one)):
            if not open_[k]:
                continue
            open_[k], todo = False, [k]
            while todo:
                a = todo.pop()
                reached = np.flatnonzero(near[a] & free)
                free[reached] = False
                i += [a] * len(reached)
                j += reached.tolist()
                for b in reached:
                    back = np.flatnonzero(near[:, b] & open_)
                    open_[back] = False
                    i += back.tolist()
                    j += [b] * len(back)
                    todo += back.tolist()
        first, second = ids.take(pa.array(i, pa.int64())), ids.take(pa.array(np.asarray(j, np.int64) + len(one)))
        return pa.table({"member_1": first, "member_2": second})

    return meeting(own, other, kernel, f"member_1 {kinds[member]}, member_2 {kinds[member]}", group=1024, part=4096, by=group)


def set_similarity(left: DataFrame, right: DataFrame, key: Sequence[str], left_set: str, right_set: str, vector: str, k: int = 5, limit: float = 0.8) -> DataFrame:
    """Sets of vectors compared: mean of the k best cosines, and whether min(n1, n2, k) pairs are over `limit`.

    Vectors meet in blocks (`meeting`); of each pair of sets a block returns its k
    best cosines and its count, so pairs of vectors are never written out.  With
    `key`, only vectors equal in it are compared.  A pair with a zero vector has no
    cosine and does not count.
    """
    a = left.select(*key, F.col(left_set).alias("set_1"), F.col(vector).cast("array<double>").alias("v"))
    b = right.select(*key, F.col(right_set).alias("set_2"), F.col(vector).cast("array<double>").alias("v"))
    n1 = a.groupBy("set_1").agg(F.count("*").alias("n_1"))
    n2 = b.groupBy("set_2").agg(F.count("*").alias("n_2"))
    kinds = dict(a.dtypes)["set_1"], dict(b.dtypes)["set_2"]

    def kernel(one: pa.Table, two: pa.Table) -> pa.Table:
        s = cosine_matrix(stacked(one["v"]), stacked(two["v"]))
        s[np.linalg.norm(stacked(one["v"]), axis=1) == 0] = s[:, np.linalg.norm(stacked(two["v"]), axis=1) == 0] = np.nan
        rows, columns = one["set_1"].combine_chunks().dictionary_encode(), two["set_2"].combine_chunks().dictionary_encode()
        i, j = rows.indices.to_numpy(), columns.indices.to_numpy()
        first, second, tops, over, n = [], [], [], [], []
        for x in range(len(rows.dictionary)):
            for y in range(len(columns.dictionary)):
                own = s[np.ix_(i == x, j == y)].ravel()
                own = own[~np.isnan(own)]
                first.append(x)
                second.append(y)
                tops.append(-np.sort(-own)[:k] if len(own) <= 4 * k else -np.sort(np.partition(-own, k)[:k]))
                over.append(int((own >= limit).sum()))
                n.append(len(own))
        return pa.table({"set_1": rows.dictionary.take(pa.array(first)), "set_2": columns.dictionary.take(pa.array(second)), "tops": pa.array(tops, pa.list_(pa.float64())), "n_over": pa.array(over, pa.int64()), "n_pairs": pa.array(n, pa.int64())})

    found = meeting(a, b, kernel, f"set_1 {kinds[0]}, set_2 {kinds[1]}, tops array<double>, n_over long, n_pairs long", by=key)
    best = V.mean_of_top(F.flatten(F.collect_list("tops")), k).alias("mean_of_top")
    out = found.groupBy("set_1", "set_2").agg(best, F.sum("n_over").alias("n_over"), F.sum("n_pairs").alias("n_pairs")).where("n_pairs > 0").drop("n_pairs")
    out = out.join(n1, "set_1").join(n2, "set_2")
    return out.withColumn("similar", F.col("n_over") >= F.least("n_1", "n_2", F.lit(k)))


def best_match(pairs: DataFrame, left: str, distance: str, similarity: str, limit: float, tie: str) -> DataFrame:
    """For each left id the pair within `limit` of least distance, then greatest similarity, then least tie column; without any, the nearest."""
    w = Window.partitionBy(left).orderBy(F.col(distance) > limit, distance, F.desc(similarity), tie)
    return pairs.withColumn("_row", F.row_number().over(w)).where("_row = 1").drop("_row").withColumn("within", F.col(distance) <= limit)


def lookup(df: DataFrame, names: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows with the value of a dimension, null where it has none."""
    return df.join(names, list(key), "left")


def fill_from_track(df: DataFrame, track: Sequence[str], frame: str, value: str) -> DataFrame:
    """Missing values of a track take its first one by frame."""
    first = F.min_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.col(frame))).over(Window.partitionBy(*track))
    return df.withColumn(value, F.coalesce(F.col(value), first))


def stacked(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def meeting(left: DataFrame, right: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str, group: int = 1024, part: int = 8192, by: Sequence[str] = (), spread: int = 1) -> DataFrame:
    """What `kernel` makes of every group of `left` rows and every part of `right` rows.

    Groups and parts are of bounded size (`group` and `part` rows or so), dealt out
    by a hash of the rows; rows equal in `by` (not null), if given, meet only each other, and
    have as many groups and parts as they need.  A row is sent once for each group
    or part of the other side; `spread` is how many of them there are at least, as
    long as each has 512 rows.
    """
    empty = T.StructType.fromDDL(schema)

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        return kernel(one, two) if len(one) and len(two) else to_arrow_schema(empty).empty_table()

    def needed(df: DataFrame, n: int, name: str) -> DataFrame:
        rows = F.count("*")
        return df.groupBy(*by).agg(F.greatest(F.ceil(rows / n), F.least(F.lit(spread), F.ceil(rows / 512)), F.lit(1)).cast("long").alias(name))

    sizes = needed(left, group, "_groups").join(needed(right, part, "_parts"), list(by)) if by else None
    counts = () if by else tuple(F.lit(max(1, -(-rows // n), min(spread, -(-rows // 512)))).cast("long") for rows, n in ((left.count(), group), (right.count(), part)))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        rest = [c for c in df.columns if c not in by]
        df = df.join(sizes, list(by)) if by else df.withColumns({"_groups": counts[0], "_parts": counts[1]})
        n, m = ("_groups", "_parts") if own == "_a" else ("_parts", "_groups")
        dealt = df.withColumn(own, F.pmod(F.xxhash64(*rest), F.col(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1)))
        return dealt.drop("_groups", "_parts")

    a, b = dealt(left, "_a", "_b"), dealt(right, "_b", "_a")
    return a.groupBy(*by, "_a", "_b").cogroup(b.groupBy(*by, "_a", "_b")).applyInArrow(meet, schema)


def _vectors(df: DataFrame, id_col: str, vector: str, *more: str) -> DataFrame:
    return df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"), *more)


def distances(queries: DataFrame, gallery: DataFrame, query_id: str, gallery_id: str, vector: str) -> DataFrame:
    """(q, g, distance): 1 - cosine (1 with a zero vector) of each query with each gallery row, by matrix products in blocks.

    Rows with a null id or vector are left out.
    """
    a, b = _vectors(queries, query_id, vector), _vectors(gallery, gallery_id, vector)

    def kernel(one: pa.Table, two: pa.Table) -> pa.Table:
        d = 1 - cosine_matrix(stacked(one["v"]), stacked(two["v"]))
        n, m = d.shape
        return pa.table({"q": one["id"].combine_chunks().take(pa.array(np.repeat(np.arange(n), m))), "g": two["id"].combine_chunks().take(pa.array(np.tile(np.arange(m), n))), "distance": d.ravel()})

    return meeting(a, b, kernel, f"q {dict(a.dtypes)['id']}, g {dict(b.dtypes)['id']}, distance double", group=512, part=4096)


def nearest_of(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k least numbers of each row, by row and number; equal numbers go by column, and what is no number comes last."""
    if d.shape[1] > k:
        most = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        i, j = np.nonzero((d <= most) | np.isnan(most))
    else:
        i, j = (x.ravel() for x in np.indices(d.shape))
    order = np.lexsort((j, d[i, j], i))
    i, j = i[order], j[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept]


def neighbours(queries: DataFrame, gallery: DataFrame, query_id: str, gallery_id: str, vector: str, k: int, metric: str = "cosine", group: int = 32_768, part: int = 32_768, cells: int = 1_000_000) -> DataFrame:
    """The k nearest gallery rows of each query, by distance, then gallery id: (q, g, distance, rank).

    The distance is 1 - cosine (1 with a zero vector) or the squared Euclidean one.
    Groups of queries meet parts of the gallery, each of bounded size, in matrix
    products of some `cells` numbers; every meeting keeps k rows a query, so pairs are
    never written out.  Rows with a null id or vector are left out.
    """
    a, b = _vectors(queries, query_id, vector), _vectors(gallery, gallery_id, vector)

    def kernel(one: pa.Table, two: pa.Table) -> pa.Table:
        two = two.sort_by("id")
        x, y = stacked(one["v"]), stacked(two["v"])
        rows, columns, distances = [], [], []
        step = max(1, cells // len(y))
        for at in range(0, len(x), step):
            some = x[at : at + step]
            if metric == "cosine":
                d = 1 - cosine_matrix(some, y)
            else:
                d = np.maximum((some * some).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * some @ y.T, 0)
            # The gallery is in order of ids, so equal distances are, too.
            i, j = nearest_of(d, k)
            rows.append(i + at)
            columns.append(j)
            distances.append(d[i, j])
        return pa.table({"q": one["id"].combine_chunks().take(pa.array(np.concatenate(rows))), "g": two["id"].combine_chunks().take(pa.array(np.concatenate(columns))), "distance": np.concatenate(distances)})

    found = meeting(a, b, kernel, f"q {dict(a.dtypes)['id']}, g {dict(b.dtypes)['id']}, distance double", group, part, spread=8)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "g"))).where(F.col("rank") <= k)


def hardest(rows: DataFrame, id_col: str, identity: str, vector: str) -> DataFrame:
    """For each row the distance to the farthest other one of its identity and to the nearest of another (null without any).

    Rows meet in blocks that return one row an anchor.  Equal ids are one anchor, with a distance to itself left out.
    """
    own = _vectors(rows, id_col, vector, F.col(identity).alias("label"))

    def kernel(one: pa.Table, two: pa.Table) -> pa.Table:
        d = 1 - cosine_matrix(stacked(one["v"]), stacked(two["v"]))
        same = np.asarray(one["label"].to_pylist(), object)[:, None] == np.asarray(two["label"].to_pylist(), object)[None]
        self = np.asarray(one["id"].to_pylist(), object)[:, None] == np.asarray(two["id"].to_pylist(), object)[None]
        far, near = np.where(same & ~self, d, -np.inf).max(1), np.where(~same & ~self, d, np.inf).min(1)
        return pa.table({"a": one["id"].combine_chunks(), "hardest_positive": pa.array(far, mask=np.isinf(far)), "hardest_negative": pa.array(near, mask=np.isinf(near))})

    found = meeting(own, own, kernel, f"a {dict(own.dtypes)['id']}, hardest_positive double, hardest_negative double")
    return found.groupBy("a").agg(F.max("hardest_positive").alias("hardest_positive"), F.min("hardest_negative").alias("hardest_negative"))


def gathered_paths(df: DataFrame, track: Sequence[str], frame: str, coordinates: Sequence[str] = ()) -> DataFrame:
    """A row a track (its columns `track`): frames `t` and coordinates `x0`, `x1` and so on, as arrays; rows with a null frame are left out."""
    point = F.struct(F.col(frame).alias("t"), *(F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(coordinates)))
    rows = df.where(F.col(frame).isNotNull()).groupBy(*track).agg(F.collect_list(point).alias("_path"))
    return rows.select(*track, *(F.col(f"_path.{c}").alias(c) for c in ("t", *(f"x{k}" for k in range(len(coordinates))))))


class _Side:
    """The points of a block's tracks, in steps of some tracks; a step has its points by frame."""

    def __init__(self, table: pa.Table, codes: np.ndarray, dims: Sequence[str], step: int):
        lengths = pc.list_value_length(table["t"]).to_numpy()
        owner, n = np.repeat(np.arange(len(table)), lengths), len(table)
        columns = [table[c].combine_chunks().flatten() for c in dims]
        known = np.ones(len(owner), bool)
        for column in columns:
            known &= column.is_valid().to_numpy(zero_copy_only=False)
        x = [column.to_numpy(zero_copy_only=False) for column in columns]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        self.whole = bool(known.all())
        self.steps = []
        for i in range(0, n, step):
            here = slice(ends[i], ends[min(n, i + step)])
            self.steps.append((i, min(n, i + step) - i, codes[here], owner[here] - i, known[here], [v[here] for v in x]))


def _by_frame(codes: np.ndarray, owner: np.ndarray, known: np.ndarray, x: list[np.ndarray]) -> dict[int, list[tuple[np.ndarray, list[np.ndarray]]]]:
    """Tracks and coordinates of each frame; rows of a track that repeat a frame come in pieces of their own."""
    at = np.flatnonzero(known)
    at = at[np.lexsort((owner[at], codes[at]))]
    codes, owner = codes[at], owner[at]
    first = np.concatenate([[True], (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])]) if len(at) else np.zeros(0, bool)
    layer = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    again = np.lexsort((layer, codes))
    codes, owner, layer, at = codes[again], owner[again], layer[again], at[again]
    edges = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (layer[1:] != layer[:-1]), [True]])) if len(at) else np.zeros(1, int)
    pieces: dict = {}
    for a, b in zip(edges[:-1], edges[1:]):
        pieces.setdefault(int(codes[a]), []).append((owner[a:b], [v[at[a:b]] for v in x]))
    return pieces


def _shared(one: tuple, two: tuple, known: bool, n_codes: int, width: int = 2048) -> np.ndarray:
    """How many rows of one frame each two tracks of two steps have; with `known`, of rows with coordinates only."""
    total = np.zeros((one[1], two[1]), np.int64)
    for low in range(0, n_codes, width):
        sides = []
        for _, n, codes, owner, valid, _ in (one, two):
            here = (codes >= low) & (codes < low + width) & (valid if known else True)
            size = min(width, n_codes - low)
            sides.append(np.bincount(owner[here] * size + codes[here] - low, minlength=n * size).reshape(n, size).astype(np.float32))
        total += (sides[0] @ sides[1].T).astype(np.int64)
    return total


def _distances(here: dict, there: dict, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sum and least (no number without any) of the distances of each two tracks over the frames they share, from `_by_frame` of both."""
    total, least = np.zeros(shape), np.full(shape, np.nan)
    sums, lows = total.ravel(), least.ravel()
    places, one, two = np.empty(total.size, np.intp), np.empty(total.size), np.empty(total.size)
    for t in here.keys() & there.keys():
        for i, x in here[t]:
            for j, y in there[t]:
                n = len(i) * len(j)
                at, d, e = (v[:n].reshape(len(i), len(j)) for v in (places, one, two))
                np.add.outer(i * shape[1], j, out=at)
                d[:] = 0
                for p, q in zip(x, y):
                    np.subtract.outer(p, q, out=e)
                    np.multiply(e, e, out=e)
                    np.add(d, e, out=d)
                np.sqrt(d, out=d)
                np.take(sums, at, out=e, mode="clip")
                np.add(e, d, out=e)
                sums[at] = e
                np.take(lows, at, out=e, mode="clip")
                np.fmin(e, d, out=e)
                lows[at] = e
    return total, least


def path_pairs(paths: DataFrame, key: Sequence[str], track: str, apart: str | None = None, carry: Sequence[str] = (), every: bool = False, most: float | None = None, block: int = 4096, points: int = 2_000_000, steps: tuple[int, int] = (128, 1024)) -> DataFrame:
    """Pairs of tracks of a `key` (columns of `gathered_paths`) that have a frame in common, or with `every` all pairs.

    Result: key, id_1, id_2, n_shared, with coordinates the mean `distance` and the
    `least` over the frames shared, and for columns of `carry` structs a and b.  The
    smaller track comes first; with `apart` (such as a camera) tracks that differ in
    it meet, the one of the smaller value first, and apart_1 and apart_2 are given.
    `most` leaves out pairs of a greater mean distance.

    Blocks of some `block` tracks and `points` points (a track is never cut) meet,
    so a pair is finished in one task and leaves it as a row of the result: pairs
    are neither joined nor shuffled.  A task goes through its tracks in `steps`.
    """
    kinds = dict(paths.dtypes)
    dims = [c for c in paths.columns if c[:1] == "x" and c[1:].isdigit() and kinds[c] == "array<double>"]
    group = [*key, *([apart] if apart else [])]
    paths = paths.select(*group, track, "t", *dims, *([F.struct(*carry).alias("_carry")] if carry else []))
    if not apart:
        paths = paths.where(F.col(track).isNotNull())
    needed = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.size("t")) / points), F.lit(1)).cast("long")
    sizes = paths.groupBy(*group).agg(needed.alias("_n"))
    own = paths.join(sizes, group).withColumn("_k", F.pmod(F.xxhash64(track), F.col("_n"))).drop("_n")
    blocks = sizes.select(*group, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_k"))
    names = [*([apart] if apart else []), "_k"]
    a, b = (blocks.withColumnsRenamed({c: f"_{c}_{k}" for c in names}) for k in (1, 2))
    couples = (a.join(b, list(key)) if key else a.crossJoin(b)).where(F.col(f"_{apart}_1") < F.col(f"_{apart}_2") if apart else F.col("__k_1") <= F.col("__k_2"))
    marks = [f"_{c}_{k}" for k in (1, 2) for c in names]

    def side(k: int) -> DataFrame:
        met = couples if apart or k == 1 else couples.where("__k_1 < __k_2")
        return own.join(met.withColumns({c: F.col(f"_{c}_{k}") for c in names}), [*group, "_k"]).drop(*names).withColumn("_side", F.lit(k))

    carried = dict(paths.dtypes).get("_carry")
    columns = {c: kinds[c] for c in key} | ({"apart_1": kinds[apart], "apart_2": kinds[apart]} if apart else {}) | {"id_1": kinds[track], "id_2": kinds[track], "n_shared": "long"}
    columns |= {"distance": "double", "least": "double"} if dims else {}
    columns |= {"a": carried, "b": carried} if carry else {}
    schema = ", ".join(f"`{c}` {kind}" for c, kind in columns.items())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        same = not apart and table["__k_1"][0] == table["__k_2"][0]
        one, two = (table.filter(pc.equal(table["_side"], k)) for k in (1, 2))
        if same:
            two = one
        if not len(one) or not len(two):
            return
        both = one if same else pa.concat_tables([one, two])
        where = 0 if same else len(one)
        rank = None if apart else pc.rank(both[track].combine_chunks(), tiebreaker="first").to_numpy()
        times = pa.chunked_array([c for t in (one, two) for c in [t["t"].combine_chunks().flatten()]]).combine_chunks().dictionary_encode()
        codes, n_codes = times.indices.to_numpy(), len(times.dictionary)
        cut = len(one["t"].combine_chunks().flatten())
        left, right = _Side(one, codes[:cut], dims, steps[0]), _Side(two, codes[cut:], dims, steps[1])
        ids = both[track].combine_chunks()
        more = both["_carry"].combine_chunks() if carry else None
        there = [_by_frame(*s[2:]) for s in right.steps] if dims else []
        for one_step in left.steps:
            here = _by_frame(*one_step[2:]) if dims else {}
            for k, two_step in enumerate(right.steps):
                n = _shared(one_step, two_step, False, n_codes)
                keep = np.ones(n.shape, bool) if every else n > 0
                if same:
                    keep &= rank[one_step[0] : one_step[0] + one_step[1], None] < rank[None, two_step[0] : two_step[0] + two_step[1]]
                if dims:
                    known = n if left.whole and right.whole else _shared(one_step, two_step, True, n_codes)
                    total, least = _distances(here, there[k], n.shape)
                    mean = np.divide(total, known, out=np.full(n.shape, np.nan), where=known > 0)
                    if most is not None:
                        keep &= (known > 0) & (mean <= most)
                i, j = np.nonzero(keep)
                if not len(i):
                    continue
                first, second = i + one_step[0], j + two_step[0] + where
                if not apart and not same:
                    first, second = np.where(rank[first] < rank[second], first, second), np.where(rank[first] < rank[second], second, first)
                first, second = pa.array(first), pa.array(second)
                out = {c: pa.repeat(table[c][0], len(i)) for c in key}
                if apart:
                    out |= {f"apart_{k}": pa.repeat(table[f"_{apart}_{k}"][0], len(i)) for k in (1, 2)}
                out |= {"id_1": ids.take(first), "id_2": ids.take(second), "n_shared": pa.array(n[i, j])}
                if dims:
                    none = known[i, j] == 0
                    out |= {"distance": pa.array(mean[i, j], mask=none), "least": pa.array(least[i, j], mask=none)}
                if carry:
                    out |= {"a": more.take(first), "b": more.take(second)}
                yield pa.RecordBatch.from_pydict(out)

    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A given number of partitions, as what is small on disk is still much work.
    return side(1).unionByName(side(2)).repartition(parts, *key, *marks).groupBy(*key, *marks).applyInArrow(meet, schema)


def same_camera_overlap(df: DataFrame, camera: str, id_col: str, frame: str) -> DataFrame:
    """(camera, id_1, id_2, n_shared): tracks of one camera that are in a frame together, so they cannot be one object."""
    rows = df.select(camera, frame, id_col).distinct()
    return path_pairs(gathered_paths(rows, [camera, id_col], frame), [camera], id_col)


def mark_incompatible(scores: DataFrame, apart: DataFrame | Column, score: str, kind: str = "similarity") -> DataFrame:
    """`scores` (camera, id_1, id_2, score) where pairs of `apart` have similarity -1, or the greatest finite distance there is.

    `apart` is a table of pairs, or a condition on the rows of `scores`, which needs no join.
    """
    if isinstance(apart, Column):
        marked = scores.withColumn("_apart", apart)
    else:
        marked = scores.join(apart.select("camera", "id_1", "id_2").distinct().withColumn("_apart", F.lit(True)), ["camera", "id_1", "id_2"], "left")
    if kind == "similarity":
        worst = F.lit(-1.0)
    else:
        top = scores.where(F.col(score) < float("inf")).agg(F.max(score).alias("_top"))
        marked, worst = marked.crossJoin(F.broadcast(top)), F.col("_top")
    return marked.withColumn(score, F.when(F.col("_apart"), worst).otherwise(F.col(score))).drop("_apart", "_top")
