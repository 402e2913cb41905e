"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into equal segments; each is described by its mean and its
deviation.  For two vectors the squared distance is at least the sum over segments
of length * ((difference of means)^2 + (difference of deviations)^2), so the inner
product, (|x|^2 + |y|^2 - distance^2) / 2, is at most the inner product of the
two descriptions (means and deviations, scaled by the root of the length).  Few
segments give a loose bound, more a tight one.  A block of candidates is bounded
coarse to fine against each query's worst kept score; exact scores are computed
for the survivors only.  The result is exact.

Queries and candidates meet in pairs of a query group and a candidate slice, each
of bounded size, and every pair keeps k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (2, 8, 16)
GROUP, SLICE, ROWS, STEP = 4096, 16384, 256, 2048


def descriptions(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Scaled means and deviations of `segments` stretches of each vector (the last may be longer)."""
    width = vectors.shape[1]
    edges = [width * s // segments for s in range(segments + 1)]
    out = np.empty((len(vectors), 2 * segments))
    for s, (a, b) in enumerate(zip(edges, edges[1:])):
        part = vectors[:, a:b]
        root = np.sqrt(b - a)
        out[:, 2 * s] = part.mean(1) * root
        out[:, 2 * s + 1] = part.std(1) * root
    return out


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score): the k best of `vectors` for each query, the query's own id left out.

    Vectors hold whole numbers as doubles; ties go to the smaller id.  Where sums
    of products could pass 2**53, which doubles no longer hold exactly, scores are
    summed as Python's integers; one beyond 63 bits counts as the greatest or least
    that 63 bits and a sign hold.
    """
    width = vectors.shape[1] if vectors.ndim == 2 else 0
    levels = [n for n in LEVELS if n <= width // 2]
    bounds = [(descriptions(queries, n), descriptions(vectors, n)) for n in levels]
    largest = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, width)
    slack = 1e-9 * (1 + largest)
    out: list[list[np.ndarray]] = [[], [], []]
    for a in range(0, len(queries), ROWS):
        rows = slice(a, min(a + ROWS, len(queries)))
        n = rows.stop - a
        worst = np.full(n, -np.inf)
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for c in range(0, len(vectors), STEP):
            near = np.arange(c, min(c + STEP, len(vectors)))
            on = np.arange(n)
            for own, theirs in bounds:
                if np.isneginf(worst).any():
                    break
                alive = own[rows][on] @ theirs[near].T >= worst[on, None] - slack
                near, on = near[alive.any(0)], on[alive.any(1)]
                if not len(near) or not len(on):
                    break
            if not len(near) or not len(on):
                continue
            score = queries[rows][on] @ vectors[near].T
            i, j = np.nonzero((score >= worst[on, None] - (slack if largest >= 1 << 53 else 0)) & (ids[near] != query_ids[rows][on, None]))
            if largest >= 1 << 53:
                own = [max(1 - (1 << 63), min((1 << 63) - 1, sum(int(p) * int(q) for p, q in zip(x, y)))) for x, y in zip(queries[rows][on[i]], vectors[near[j]])]
                score = np.array(own, object).astype(np.int64)
            else:
                score = score[i, j].astype(np.int64)
            held = [np.concatenate(x) for x in zip(held, (on[i], ids[near[j]], score))]
            order = np.lexsort((held[1], -held[2], held[0]))
            held = [x[order] for x in held]
            first = np.searchsorted(held[0], np.arange(n))
            rank = np.arange(len(order)) - first[held[0]]
            held = [x[rank < k] for x in held]
            count = np.bincount(held[0], minlength=n)
            last = np.cumsum(count) - 1
            full = count >= k
            worst[full] = held[2][last[full]]
        out[0].append(query_ids[rows][held[0]])
        out[1].append(held[1])
        out[2].append(held[2])
    if not out[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out[0]), np.concatenate(out[1]), np.concatenate(out[2])


def _packed(scale: float):
    """Blocks of whole-number vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, ids = batch.column("vector"), batch.column("id").to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            length = np.diff(column.offsets.to_numpy())
            at = np.concatenate([[0], np.cumsum(length)])
            whole = np.floor(scale * flat)
            for width in np.unique(length):
                rows = np.flatnonzero(length == width)
                for i in range(0, len(rows), 1024):
                    part = rows[i : i + 1024]
                    values = whole[at[part][:, None] + np.arange(width)] if width else np.zeros((len(part), 0))
                    yield pa.RecordBatch.from_pydict({"width": pa.array([int(width)], pa.int64()), "n": pa.array([len(part)], pa.int64()), "ids": pa.array([ids[part].astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([values.astype("<f8").tobytes()], pa.binary())})

    return run


def _unpacked(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(b"".join(table["ids"].to_pylist()), "<i8")
    return ids, np.frombuffer(b"".join(table["vectors"].to_pylist()), "<f8").reshape(len(ids), width)


def top_k(df: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `is_query` selects, the k rows of greatest inner product.

    Components x count as floor(scale * x).  A query's own id is no candidate of
    it; ties go to the smaller id; with fewer candidates all are returned.  Rows
    without an id, and vectors that are null or hold null or non-finite
    components, take no part.  Scores beyond 63 bits count as the greatest or least
    that 63 bits and a sign hold.  Vectors are compared with those of their length only.  Of several query rows with one id the least vector is taken; as
    candidates all of them count.
    """
    usable = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    schema = "width long, n long, ids binary, vectors binary"
    rows = df.where(usable).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("asked"))
    asked = rows.where("asked").groupBy("id").agg(F.min("vector").alias("vector"))
    counts = rows.agg(F.count("*").alias("n"), F.count_if("asked").alias("q")).first()
    groups, slices = max(1, ceil(counts["q"] / GROUP)), max(1, ceil(counts["n"] / SLICE))
    blocks = rows.select("id", "vector").mapInArrow(_packed(scale), schema)
    queries = asked.mapInArrow(_packed(scale), schema)
    # Blocks are dealt out by their content, so that a retried task deals them alike.
    place = F.xxhash64("width", "ids")
    blocks = blocks.withColumn("slice", F.pmod(place, F.lit(slices))).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    queries = queries.withColumn("g", F.pmod(place, F.lit(groups))).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = (np.zeros(0, np.int64),) * 3
        if len(left) and len(right):
            width = left["width"][0].as_py()
            out = search(*_unpacked(left, width), *_unpacked(right, width), k)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    best = queries.groupBy("width", "g", "slice").cogroup(blocks.groupBy("width", "g", "slice")).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
