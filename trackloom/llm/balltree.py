"""Centroid clustering of whole-number vectors, filtered by partition-local ball trees.

Each task packs the vectors of its partition into blocks and builds a ball tree over
each: a node stores the integer sum, the count, the centre and the radius of its
vectors.  Trees are built once and written; every round takes them again.  For a
node, a centroid whose distance to the centre is greater than the nearest one's by more
than twice the radius is nearest to none of its vectors (triangle inequality), so it is
left out below.  With one centroid left, the whole ball goes to it by its sum and
count; else the search goes on in the halves, down to leaves, where squared distances
are whole numbers and exact.  Distances to centres are doubles and compared with a
margin far above their error, so rounding never decides.

A round sends at most k sums a task; centroids, at most k vectors, are all that the
driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Vectors of one tree, and of a leaf.
BLOCK, LEAF = 4096, 32
#: Whole numbers whose squares add up exactly in doubles (over 64 components and more).
_EXACT = 1 << 21
_MARGIN = 1e-9


def largest(width: int) -> int:
    """Greatest component for which squared distances fit 64 bits."""
    return int((2**62 / max(1, width)) ** 0.5) // 2


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of integer vectors, exact."""
    top = max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0))
    if top * top * max(1, points.shape[1]) < 1 << 50:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)
    out = np.empty((len(points), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        gap = points - c
        out[:, k] = (gap * gap).sum(1)
    return out


class Tree:
    """A ball tree over integer vectors; `order` says which row stands where."""

    def __init__(self, points: np.ndarray, order, lo, hi, child, centre, radius, total):
        self.points, self.order, self.lo, self.hi, self.child = points, order, lo, hi, child
        self.centre, self.radius, self.total = centre, radius, total

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        """Halves a ball at the median of its widest component, until it has `leaf` vectors or no width."""
        order = np.arange(len(points))
        lo, hi, child, centre, radius, total = [0], [len(points)], [], [], [], []
        k = 0
        while k < len(lo):
            a, b = lo[k], hi[k]
            own = points[order[a:b]]
            total.append(own.sum(0))
            centre.append(total[-1] / max(1, b - a))
            gap = own - centre[-1]
            radius.append(float(np.sqrt((gap * gap).sum(1).max(initial=0.0))))
            spread = own.max(0) - own.min(0) if b > a else np.zeros(points.shape[1])
            if b - a <= leaf or not spread.any():
                child.append(-1)
            else:
                mid = (a + b) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, int(spread.argmax())], mid - a)]
                child.append(len(lo))
                lo += [a, mid]
                hi += [mid, b]
            k += 1
        whole = np.array(total, np.int64).reshape(len(lo), points.shape[1])
        return cls(points[order], order, np.array(lo), np.array(hi), np.array(child), np.array(centre).reshape(whole.shape), np.array(radius), whole)

    def packed(self) -> dict[str, bytes]:
        small = np.abs(self.points).max(initial=0) < 1 << 15
        nodes = np.stack([self.lo, self.hi, self.child]).astype("<i4")
        return {"points": self.points.astype("<i2" if small else "<i8").tobytes(), "nodes": nodes.tobytes(), "balls": np.column_stack([self.radius, self.centre]).astype("<f8").tobytes(), "totals": self.total.astype("<i8").tobytes()}

    @classmethod
    def unpacked(cls, n: int, points: bytes, nodes: bytes, balls: bytes, totals: bytes) -> Tree:
        lo, hi, child = np.frombuffer(nodes, "<i4").reshape(3, -1).astype(np.int64)
        total = np.frombuffer(totals, "<i8").reshape(len(lo), -1)
        flat = np.frombuffer(points, "<i2" if len(points) == 2 * n * total.shape[1] else "<i8").astype(np.int64)
        ball = np.frombuffer(balls, "<f8").reshape(len(lo), -1)
        return cls(flat.reshape(n, total.shape[1]), None, lo, hi, child, ball[:, 1:], ball[:, 0], total)

    def filtered(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, centroid of each) that go to one centroid whole, and (leaves, candidates of each) that do not."""
        node, near = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        c = centroids.astype(np.float64)
        whole, leaves = ([], []), ([], [])
        while len(node):
            gap = self.centre[node][:, None, :] - c
            far = np.sqrt((gap * gap).sum(2))
            best = np.where(near, far, np.inf).min(1)
            reach = 2 * self.radius[node]
            near &= far <= (best + reach + _MARGIN * (1 + best + reach + far.max(1)))[:, None]
            one = near.sum(1) == 1
            last = ~one & (self.child[node] < 0)
            whole[0].append(node[one])
            whole[1].append(near[one].argmax(1))
            leaves[0].append(node[last])
            leaves[1].append(near[last])
            on = ~one & ~last
            down = self.child[node[on]]
            node, near = np.concatenate([down, down + 1]), np.concatenate([near[on], near[on]])
        return (*(np.concatenate(x) for x in whole), *(np.concatenate(x) for x in leaves))

    def _rows(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all vectors of the nodes, and which node each is of."""
        n = self.hi[nodes] - self.lo[nodes]
        owner = np.repeat(np.arange(len(nodes)), n)
        return self.lo[nodes][owner] + np.arange(n.sum()) - (np.cumsum(n) - n)[owner], owner

    def _leaf_rows(self, leaves: np.ndarray, near: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, owner = self._rows(leaves)
        gap = squared(self.points[rows], centroids)
        gap[~near[owner]] = np.iinfo(np.int64).max
        return rows, gap.argmin(1)

    def sums(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and exact sum of the vectors nearest to each centroid (ties: the smaller number)."""
        node, owner, leaves, near = self.filtered(centroids)
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), self.points.shape[1]), np.int64)
        np.add.at(count, owner, self.hi[node] - self.lo[node])
        np.add.at(total, owner, self.total[node])
        rows, own = self._leaf_rows(leaves, near, centroids)
        np.add.at(count, own, 1)
        np.add.at(total, own, self.points[rows])
        return count, total

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and squared distance of each vector, in the tree's order."""
        node, owner, leaves, near = self.filtered(centroids)
        out = np.zeros(len(self.points), np.int64)
        rows, of = self._rows(node)
        out[rows] = owner[of]
        rows, own = self._leaf_rows(leaves, near, centroids)
        out[rows] = own
        gap = np.empty(len(out), np.int64)
        for k in np.unique(out):
            at = np.flatnonzero(out == k)
            gap[at] = squared(self.points[at], centroids[k : k + 1])[:, 0]
        return out, gap


_TREES = "n long, ids array<long>, points binary, nodes binary, balls binary, totals binary"


def _whole(flat: np.ndarray, width: int, scale: float) -> np.ndarray:
    top = largest(width)
    return np.clip(np.floor(scale * flat.astype(np.float64)), -top, top).astype(np.int64).reshape(-1, width)


def _build(width: int, scale: float):
    def one(ids: list, values: np.ndarray) -> pa.RecordBatch:
        tree = Tree.build(values)
        row = {"n": len(ids), "ids": [ids[k] for k in tree.order.tolist()]} | tree.packed()
        return pa.RecordBatch.from_pylist([row], pa.schema([("n", pa.int64()), ("ids", pa.list_(pa.int64())), *((x, pa.binary()) for x in ("points", "nodes", "balls", "totals"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0
        for batch in batches:
            ids += batch.column("id").to_pylist()
            parts.append(_whole(batch.column("vector").flatten().to_numpy(zero_copy_only=False), width, scale))
            n += batch.num_rows
            if n >= BLOCK:
                values = np.concatenate(parts)
                while n >= BLOCK:
                    yield one(ids[:BLOCK], values[:BLOCK])
                    ids, values, n = ids[BLOCK:], values[BLOCK:], n - BLOCK
                parts = [values]
        if n:
            yield one(ids, np.concatenate(parts))

    return run


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Tree]]:
    for batch in batches:
        for row in batch.to_pylist():
            yield row["ids"], Tree.unpacked(*(row[x] for x in ("n", "points", "nodes", "balls", "totals")))


def _summed(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, 0
        for _, tree in _trees(batches):
            n, s = tree.sums(centroids)
            count, total = count + n, total + s
        if not np.isscalar(count):
            own = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(own, pa.int32()), "n": pa.array(count[own], pa.int64()), "total": pa.array(total[own].tolist(), pa.list_(pa.int64()))})

    return run


def _labelled(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches):
            own, gap = tree.assigned(centroids)
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "cluster": pa.array(own, pa.int32()), "distance": pa.array(gap, pa.int64())})

    return run


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the mean of the vectors nearest to each; one without vectors stays."""
    width = centroids.shape[1]
    parts = trees.mapInArrow(_summed(centroids), "cluster int, n long, total array<long>")
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[k]) for k in range(width))).alias("total"))
    out = centroids.copy()
    for row in sums.collect():  # at most one a centroid
        out[row["cluster"]] = [x // row["n"] for x in row["total"]]
    return out


def cluster(df: DataFrame, work: Scratch, k: int = 16, rounds: int = 3, width: int = 64, scale: float = 64.0, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept.

    Kept are vectors of exactly `width` components, none null or non-finite.  A
    component x counts as floor(scale * x); one beyond `largest(width)` either way
    counts as that, as distances have 64 bits.  The first centroids are the k
    kept vectors whose ids have the smallest sha256 of `seed:<id>` (of rows with
    one id, the lesser vectors first); rows without an id are clustered but are no
    first centroids.  With fewer vectors there are fewer centroids, with none no
    rows.  Inertias beyond 64 bits are null.  Other columns are not read.
    """
    usable = F.col(vector_col).isNotNull() & (F.size(vector_col) == width) & F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = df.where(usable).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    first = rows.where("id is not null").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), "vector").limit(k).collect()  # k vectors
    centroids = _whole(np.array([r["vector"] for r in first], np.float64).reshape(-1), width, scale)
    trees = work.save(rows.mapInArrow(_build(width, scale), _TREES), "trees")
    for _ in range(rounds if first else 0):
        centroids = moved(trees, centroids)
    shown = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    names = df.sparkSession.createDataFrame(shown, "cluster int, centroid_sha256 string")
    none = "id long, cluster int, distance long"
    labels = work.save(trees.mapInArrow(_labelled(centroids), none) if first else trees.where("false").select(F.lit(None).cast("long").alias("id"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), "labels")
    work.drop("trees")
    by = labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    whole = by.agg(F.sum("own").alias("all"))
    sums = reduce(lambda a, b: a.join(F.broadcast(b), "cluster"), [by.crossJoin(F.broadcast(whole)), names])  # a row a centroid
    long = lambda c: F.expr(f"try_cast({c} as long)")
    return labels.join(F.broadcast(sums), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", long("own").alias("cluster_inertia"), long("`all`").alias("inertia"), "centroid_sha256")
