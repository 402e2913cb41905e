"""Tracking metrics (M rows): one sequence at a time, additive parts first, finals after combining.

`evaluate` gives the additive parts of each sequence as a long table (seq, metric,
field, alpha, value); `combine` adds them up over any grouping and `finals` turns
them into ratios.  A sequence is the parallel unit; its kernel sees ids and
the pairs that are similar of one frame after the other, read from Arrow arrays, so
it holds what the sequence has, never ids by ids.  Plain counts need no kernel.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .assignment import assign, assign_kinds, assign_members, assign_pairs, assign_sparse, box_pairs, iou_matrix
from .times import list_parts, meetings

ALPHAS = np.arange(1, 20) * 0.05
EPS = np.finfo(float).eps


class Frame(NamedTuple):
    """What is present at one time: places of ground-truth and tracker ids, and the pairs with a similarity, as places in these two.

    Where ids are like each other, `kinds` says of which kind each one is, and pairs are of kinds.
    """

    gt: np.ndarray
    tracker: np.ndarray
    rows: np.ndarray
    columns: np.ndarray
    similarity: np.ndarray
    kinds: tuple[np.ndarray, np.ndarray] | None = None

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each kind has."""
        return tuple(np.bincount(kind, minlength=1) for kind in self.kinds)

    def table(self) -> np.ndarray:
        """Similarities of kinds by kinds."""
        out = np.zeros([len(n) for n in self.counts()])
        out[self.rows, self.columns] = self.similarity
        return out

    def spread(self) -> "Frame":
        """The frame with pairs of ids."""
        if self.kinds is None:
            return self
        whole = self.table()[np.ix_(*self.kinds)]
        i, j = np.nonzero(whole)
        return Frame(self.gt, self.tracker, i, j, whole[i, j])


def _codes(frames: Sequence[Frame], n_tracker: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The pairs of ids that any frame has: ground truth, tracker, and each frame's pairs as places among them."""
    codes = [f.gt[f.rows].astype(np.int64) * max(1, n_tracker) + f.tracker[f.columns] for f in frames]
    known, at = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]), return_inverse=True)
    return known // max(1, n_tracker), known % max(1, n_tracker), known, np.split(at, np.cumsum([len(c) for c in codes])[:-1]) if codes else []


def _seen(frames: Sequence[Frame], n_gt: int, n_tracker: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many frames each id is."""
    return tuple(np.bincount(np.concatenate([np.zeros(0, np.int64), *x]), minlength=n).astype(float) for x, n in (([f.gt for f in frames], n_gt), ([f.tracker for f in frames], n_tracker)))


class Parts(NamedTuple):
    field: str
    alpha: float | None
    value: float


#: Rows of a table of ids by ids that are worked on at a time.
STEP = 1024


def _dense_alignment(frames: Sequence[Frame], gt_count: np.ndarray, tracker_count: np.ndarray) -> np.ndarray:
    """M1: how well all ids fit each other all along, as a table."""
    out = np.zeros((len(gt_count), len(tracker_count)))
    for f in frames:
        if not len(f.rows):
            continue
        f = f if f.kinds else f._replace(kinds=(np.arange(len(f.gt)), np.arange(len(f.tracker))))
        s, (n, m) = f.table(), f.counts()
        rest = (s @ m)[:, None] + (n @ s)[None] - s
        share = np.divide(s, rest, out=np.zeros_like(s), where=rest > EPS)
        for k in range(0, len(f.gt), STEP):
            out[np.ix_(f.gt[k : k + STEP], f.tracker)] += share[np.ix_(f.kinds[0][k : k + STEP], f.kinds[1])]
    for k in range(0, len(out), STEP):
        own = out[k : k + STEP]
        own /= np.maximum(gt_count[k : k + STEP, None] + tracker_count[None] - own, EPS)
    return out


def _pair_alignment(frames: Sequence[Frame], n_tracker: int, gt_count: np.ndarray, tracker_count: np.ndarray) -> list[np.ndarray]:
    """M1: how well the pairs of each frame fit each other all along."""
    left, right, known, places = _codes(frames, n_tracker)
    potential = np.zeros(len(known))
    for f, at in zip(frames, places):
        s = f.similarity
        rest = np.bincount(f.rows, s, len(f.gt))[f.rows] + np.bincount(f.columns, s, len(f.tracker))[f.columns] - s
        potential[at] += np.divide(s, rest, out=np.zeros_like(s), where=rest > EPS)
    alignment = potential / np.maximum(gt_count[left] + tracker_count[right] - potential, EPS)
    return [alignment[at] for at in places]


def hota_parts(frames: Sequence[Frame], n_gt: int, n_tracker: int) -> list[Parts]:
    """M1: matches by alpha, with a global alignment that favours pairs that fit each other all along.

    Where ids are like each other and most of them meet, the alignment is a table of
    ids by ids, and a frame's pairs are made when it is its turn.
    """
    gt_count, tracker_count = _seen(frames, n_gt, n_tracker)
    met = sum(int((n[f.rows] * m[f.columns]).sum()) for f in frames if f.kinds for n, m in [f.counts()])
    dense = met * 8 > n_gt * n_tracker
    if dense:
        table = _dense_alignment(frames, gt_count, tracker_count)
    else:
        frames = [f.spread() for f in frames]
        aligned = _pair_alignment(frames, n_tracker, gt_count, tracker_count)
    codes, similar = [np.zeros(0, np.int64)], [np.zeros(0)]
    for k, f in enumerate(frames):
        f = f.spread()
        score = f.similarity * (table[f.gt[f.rows], f.tracker[f.columns]] if dense else aligned[k])
        some = np.flatnonzero(score > 0)
        chosen = some[assign_sparse(f.rows[some], f.columns[some], score[some])]
        codes.append(f.gt[f.rows[chosen]].astype(np.int64) * n_tracker + f.tracker[f.columns[chosen]])
        similar.append(f.similarity[chosen])
    s = np.concatenate(similar)
    known, at = np.unique(np.concatenate(codes), return_inverse=True)
    left, right = known // max(1, n_tracker), known % max(1, n_tracker)
    either = gt_count[left] + tracker_count[right]
    gt, tracker = gt_count.sum(), tracker_count.sum()
    out = []
    for alpha in ALPHAS:
        ok = s >= alpha - EPS
        c, tp = np.bincount(at[ok], minlength=len(known)).astype(float), float(ok.sum())
        sums = {
            "TP": tp,
            "FN": gt - tp,
            "FP": tracker - tp,
            "Loc_sum": s[ok].sum(),
            "Ass_sum": (c * c / np.maximum(1, either - c)).sum(),
            "AssRe_sum": (c * c / np.maximum(1, gt_count[left])).sum(),
            "AssPr_sum": (c * c / np.maximum(1, tracker_count[right])).sum(),
        }
        out += [Parts(k, round(float(alpha), 2), float(v)) for k, v in sums.items()]
    return out


class Clear:
    """M3: matches that go on from the frame before come first; switches count against the last id a track ever had.

    A frame with one side empty is passed over: what was matched before it goes on
    after it.  Ids are any hashable values; frames are taken one at a time.
    """

    def __init__(self, threshold: float = 0.5):
        self.threshold, self.frames = threshold, 0
        self.tp = self.fn = self.fp = self.switches = 0
        self.overlap = 0.0
        self.last: dict = {}
        self.before: dict = {}
        self.present: Counter = Counter()
        self.matched: Counter = Counter()
        self.starts: Counter = Counter()

    def update(self, gt: Sequence, tracker: Sequence, similarity: np.ndarray) -> list[tuple]:
        """Takes a frame's ids and their similarities; returns the pairs that match."""
        similarity = np.asarray(similarity, float).reshape(len(gt), len(tracker))
        rows, columns = np.nonzero(similarity >= self.threshold - EPS)
        return self.update_pairs(gt, tracker, rows, columns, similarity[rows, columns])

    def update_pairs(self, gt: Sequence, tracker: Sequence, rows: np.ndarray, columns: np.ndarray, similarity: np.ndarray, kinds: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple]:
        """`update` with the similarities of the pairs that have one, by row and column, or by `kinds` of ids that are like each other."""
        self.frames += 1
        self.present.update(gt)
        if not len(gt) or not len(tracker):
            self.fn += len(gt)
            self.fp += len(tracker)
            return []
        near = similarity >= self.threshold - EPS
        rows, columns, similarity = rows[near], columns[near], similarity[near]
        place = {k: j for j, k in enumerate(tracker)}
        went_on = np.array([place.get(self.before.get(g), -1) for g in gt])
        if kinds is None:
            score = similarity + 1000.0 * (went_on[rows] == columns)
            some = np.flatnonzero(score > EPS)
            at = some[assign_sparse(rows[some], columns[some], score[some])]
            pairs, value = [(gt[i], tracker[j]) for i, j in zip(rows[at], columns[at])], similarity[at]
        else:
            i, j, value = self._among_kinds(went_on, rows, columns, similarity, kinds)
            pairs = [(gt[a], tracker[b]) for a, b in zip(i, j)]
        for g, k in pairs:
            self.switches += g in self.last and self.last[g] != k
            self.starts[g] += g not in self.before
            self.matched[g] += 1
            self.last[g] = k
        self.before = dict(pairs)
        self.tp += len(pairs)
        self.fn += len(gt) - len(pairs)
        self.fp += len(tracker) - len(pairs)
        self.overlap += float(value.sum())
        return pairs

    @staticmethod
    def _among_kinds(went_on: np.ndarray, rows: np.ndarray, columns: np.ndarray, similarity: np.ndarray, kinds: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of both sides and similarities of the matches.

        A pair that goes on is worth 1000 more than others, which are worth 1 at most:
        prices of 500 for both its ends show that every best assignment has all of
        these.  The others are matched by kinds.
        """
        some = np.flatnonzero(similarity > EPS)
        some = some[np.lexsort((columns[some], rows[some]))]
        rows, columns, similarity = rows[some], columns[some], similarity[some]
        width = int(kinds[1].max(initial=0)) + 1
        code = rows.astype(np.int64) * width + columns
        i = np.flatnonzero(went_on >= 0)
        j = went_on[i]
        own = kinds[0][i].astype(np.int64) * width + kinds[1][j]
        at = np.minimum(np.searchsorted(code, own), max(0, len(code) - 1))
        there = code[at] == own if len(code) else np.zeros(len(i), bool)
        i, j, at = i[there], j[there], at[there]
        free = tuple(np.ones(len(kind), bool) for kind in kinds)
        free[0][i], free[1][j] = False, False
        more_i, more_j, more = assign_members(rows, columns, similarity, kinds, free)
        return np.concatenate([i, more_i]), np.concatenate([j, more_j]), similarity[np.concatenate([at, more])]

    def parts(self, n_gt: int | None = None) -> dict[str, float]:
        """Additive parts so far; `n_gt` is the number of ground-truth ids (default: those seen)."""
        shares = [self.matched[g] / n for g, n in self.present.items()]
        mostly, partly = sum(x > 0.8 for x in shares), sum(0.2 <= x <= 0.8 for x in shares)
        n_gt = len(self.present) if n_gt is None else n_gt
        return {"CLR_TP": self.tp, "CLR_FN": self.fn, "CLR_FP": self.fp, "IDSW": self.switches, "MOTP_sum": self.overlap, "MT": mostly, "PT": partly, "ML": n_gt - mostly - partly, "Frag": sum(max(0, n - 1) for n in self.starts.values()), "CLR_Frames": self.frames}


def clear_parts(frames: Sequence[Frame], n_gt: int, n_tracker: int, threshold: float = 0.5) -> list[Parts]:
    """M3: the parts of a sequence; without rows on one side no frame counts."""
    state = Clear(threshold)
    for f in frames:
        state.update_pairs(f.gt.tolist(), f.tracker.tolist(), f.rows, f.columns, f.similarity, f.kinds)
    sums = state.parts(n_gt) | ({} if n_gt and n_tracker else {"CLR_Frames": 0})
    return [Parts(k, None, float(v)) for k, v in sums.items()]


class Online:
    """Scores of a tracker while it runs; frames are taken in order, boxes as corners.

    Tracker boxes that are matched to a box to ignore, by IoU of 0.5 or more, are
    taken out first; the others are matched with the ground truth.
    """

    def __init__(self, threshold: float = 0.5):
        self.clear = Clear(threshold)

    def update(self, gt_ids: Sequence, gt_boxes: np.ndarray, tracker_ids: Sequence, tracker_boxes: np.ndarray, ignored_boxes: np.ndarray | None = None) -> list[tuple]:
        """Takes a frame; returns the pairs that match."""
        tracker_ids, tracker_boxes = list(tracker_ids), np.asarray(tracker_boxes, float).reshape(-1, 4)
        if ignored_boxes is not None and len(ignored_boxes) and len(tracker_ids):
            apart = 1 - iou_matrix(ignored_boxes, tracker_boxes)
            _, hit = assign_pairs(apart, 0.5)
            kept = np.setdiff1d(np.arange(len(tracker_ids)), hit)
            tracker_ids, tracker_boxes = [tracker_ids[k] for k in kept], tracker_boxes[kept]
        return self.clear.update(list(gt_ids), tracker_ids, iou_matrix(gt_boxes, tracker_boxes))

    def scores(self) -> dict[str, float]:
        """Parts so far, with MOTA and MOTP."""
        p = self.clear.parts()
        return p | {"MOTA": (p["CLR_TP"] - p["CLR_FP"] - p["IDSW"]) / max(1, p["CLR_TP"] + p["CLR_FN"]), "MOTP": p["MOTP_sum"] / max(1, p["CLR_TP"])}


def identity_parts(frames: Sequence[Frame], n_gt: int, n_tracker: int, threshold: float = 0.5) -> list[Parts]:
    """M4: one matching of whole tracks with the most matched detections."""
    left, right, overlap = _overlaps(frames, n_tracker, threshold)
    tp = float(overlap[assign_sparse(left, right, overlap)].sum())
    gt, tracker = sum(len(f.gt) for f in frames), sum(len(f.tracker) for f in frames)
    return [Parts("IDTP", None, tp), Parts("IDFN", None, gt - tp), Parts("IDFP", None, tracker - tp)]


def _overlaps(frames: Sequence[Frame], n_tracker: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of ids that overlap by `threshold` in a frame: ground truth, tracker, in how many frames."""
    near = []
    for f in frames:
        ok = f.similarity >= threshold
        near.append(f._replace(rows=f.rows[ok], columns=f.columns[ok], similarity=f.similarity[ok]).spread())
    left, right, known, places = _codes(near, n_tracker)
    return left, right, np.bincount(np.concatenate([np.zeros(0, np.int64), *places]), minlength=len(known)).astype(float)


def vace_parts(frames: Sequence[Frame], n_gt: int, n_tracker: int, threshold: float = 0.5) -> list[Parts]:
    """M5: tracks matched by the share of their frames in which they overlap; detections matched frame by frame."""
    left, right, overlap = _overlaps(frames, n_tracker, threshold)
    gt_count, tracker_count = _seen(frames, n_gt, n_tracker)
    together = np.zeros(len(overlap))
    fda, busy = 0.0, 0
    for f in frames:
        here, there = np.zeros(n_gt, bool), np.zeros(n_tracker, bool)
        here[f.gt], there[f.tracker] = True, True
        together += here[left] & there[right]
        busy += bool(len(f.gt) or len(f.tracker))
        if len(f.gt) and len(f.tracker):
            if f.kinds:
                best = float((assign_kinds(f.rows, f.columns, f.similarity, *f.counts()) * f.similarity).sum())
            else:
                best = float(f.similarity[assign_sparse(f.rows, f.columns, f.similarity)].sum())
            fda += best / (0.5 * (len(f.gt) + len(f.tracker)))
    share = overlap / np.maximum(gt_count[left] + tracker_count[right] - together, 1)
    sums = {"STDA": share[assign_sparse(left, right, share)].sum(), "VACE_IDs": n_tracker, "VACE_GT_IDs": n_gt, "FDA": fda, "num_non_empty_timesteps": busy}
    return [Parts(k, None, float(v)) for k, v in sums.items()]


#: M1, M3, M4, M5 by a kernel; M9 ("Count") is a plain aggregation.
KERNELS = {"HOTA": hota_parts, "CLEAR": clear_parts, "Identity": identity_parts, "VACE": vace_parts}


def frames_of(times: pa.Table) -> tuple[list[Frame], int, int]:
    """Frames in order of time from rows (t, gt_ids, tracker_ids, pairs), which may say what ids are like each other."""
    times = times.sort_by("t")
    gt_all, tracker_all = (np.unique(list_parts(times[c])[1]) for c in ("gt_ids", "tracker_ids"))
    frames = [Frame(np.searchsorted(gt_all, gt_ids), np.searchsorted(tracker_all, tracker_ids), i[s > 0], j[s > 0], s[s > 0], kinds) for gt_ids, tracker_ids, i, j, s, kinds in meetings(times)]
    return frames, len(gt_all), len(tracker_all)


def timeline(gt: DataFrame, tracker: DataFrame, similarity: DataFrame | None = None) -> DataFrame:
    """One row for each time of a sequence: ids of both sides and pairs of similarity over 0.

    Inputs: gt(seq, t, gt_id), tracker(seq, t, tracker_id), similarity(seq, t, gt_id,
    tracker_id, similarity); without the last there are no pairs.  Times without
    rows on one side have an empty array.
    """
    key = ["seq", "t"]
    a = gt.groupBy(*key).agg(F.collect_set("gt_id").alias("gt_ids"))
    b = tracker.groupBy(*key).agg(F.collect_set("tracker_id").alias("tracker_ids"))
    out = a.join(b, key, "full_outer")

    def filled(name: str):
        kind = dict(out.dtypes)[name]
        return F.coalesce(name, F.array().cast(kind)).alias(name)

    if similarity is None:
        return out.select(*key, filled("gt_ids"), filled("tracker_ids"))
    pairs = similarity.where("similarity > 0").groupBy(*key).agg(F.collect_list(F.struct("gt_id", "tracker_id", F.col("similarity").cast("double").alias("similarity"))).alias("pairs"))
    out = out.join(pairs, key, "left")
    return out.select(*key, filled("gt_ids"), filled("tracker_ids"), filled("pairs"))


def _without_copies(ids: pa.Array, low: np.ndarray, high: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """The least id of each different box, with its corners, and which of these each id is like (itself if it comes twice)."""
    order = pc.sort_indices(ids).to_numpy()
    if len(ids) == 0 or pc.count_distinct(ids, mode="all").as_py() < len(ids):
        return ids, low, high, ids
    _, first, kind = np.unique(np.hstack([low, high])[order], axis=0, return_index=True, return_inverse=True)
    like = np.empty(len(ids), np.int64)
    like[order] = order[first][kind.ravel()]
    names = order[np.sort(first)]
    return ids.take(pa.array(names)), low[names], high[names], ids.take(pa.array(like))


def box_timeline(gt: DataFrame, tracker: DataFrame, gt_box: str = "gt_box", tracker_box: str = "tracker_box", alike: bool = False) -> DataFrame:
    """`timeline` by the IoU of boxes: gt(seq, t, gt_id, box), tracker(seq, t, tracker_id, box).

    Boxes are corners (x1, y1, x2, y2), or upright ones in the world (x, y, z, l, w, h).
    A time's boxes meet in arrays, those that can overlap only, so that pairs are
    neither joined nor gathered row by row.  With `alike`, equal boxes of a time meet
    others once: `pairs` has the least id of each, and arrays gt_like and tracker_like
    give the one that each id is like, which `evaluate` and `frame_matches` know.
    """
    key = ["seq", "t"]
    solid = "z" in gt.schema[gt_box].dataType.names
    fields = ("x", "y", "z", "l", "w", "h") if solid else ("x1", "y1", "x2", "y2")

    def bag(df: DataFrame, id_col: str, box: str, name: str) -> DataFrame:
        return df.groupBy(*key).agg(F.collect_list(F.struct(F.col(id_col).alias("id"), *(F.col(f"{box}.{c}").cast("double").alias(c) for c in fields))).alias(name))

    rows = bag(gt, "gt_id", gt_box, "a").join(bag(tracker, "tracker_id", tracker_box, "b"), key, "full_outer").select(*key, "a", "b")
    kinds = [dict(df.dtypes)[c] for df, c in ((gt, "seq"), (gt, "t"), (gt, "gt_id"), (tracker, "tracker_id"))]

    def corners(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        ids, *values = column.flatten().flatten()
        values = np.stack([x.to_numpy(zero_copy_only=False) for x in values], 1)
        half = len(fields) // 2
        if solid:
            return ids, values[:, :half] - values[:, half:] / 2, values[:, :half] + values[:, half:] / 2
        return ids, values[:, :half], values[:, half:]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A time leaves on its own: its pairs may be many.
        for row in (batch.slice(k, 1) for batch in batches for k in range(len(batch))):
            (gt_ids, *one), (tracker_ids, *two) = (corners(row.column(c)) for c in ("a", "b"))
            likes = []
            if alike:
                (gt_names, *one, like), (tracker_names, *two, other) = _without_copies(gt_ids, *one), _without_copies(tracker_ids, *two)
                likes = [like, other]
            else:
                gt_names, tracker_names = gt_ids, tracker_ids
            i, j, value = box_pairs(one, two)
            pairs = pa.StructArray.from_arrays([gt_names.take(pa.array(i)), tracker_names.take(pa.array(j)), pa.array(value)], names=["gt_id", "tracker_id", "similarity"])
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (gt_ids, tracker_ids, pairs, *likes)]
            yield pa.RecordBatch.from_arrays([row.column("seq"), row.column("t"), *lists], names=["seq", "t", "gt_ids", "tracker_ids", "pairs", *["gt_like", "tracker_like"][: len(likes)]])

    more = f", gt_like array<{kinds[2]}>, tracker_like array<{kinds[3]}>" if alike else ""
    return rows.mapInArrow(each, f"seq {kinds[0]}, t {kinds[1]}, gt_ids array<{kinds[2]}>, tracker_ids array<{kinds[3]}>, pairs array<struct<gt_id:{kinds[2]},tracker_id:{kinds[3]},similarity:double>>{more}")


def _counts(times: DataFrame) -> DataFrame:
    """M9: detections, ids and times of each sequence, as parts."""
    dets = times.groupBy("seq").agg(F.sum(F.size("tracker_ids")).alias("Dets"), F.sum(F.size("gt_ids")).alias("GT_Dets"), F.count("*").alias("Frames"))
    for name, ids in (("IDs", "tracker_ids"), ("GT_IDs", "gt_ids")):
        own = times.select("seq", F.explode(ids).alias("id")).groupBy("seq").agg(F.countDistinct("id").alias(name))
        dets = dets.join(own, "seq", "left").fillna(0, [name])
    names = ["Dets", "GT_Dets", "IDs", "GT_IDs", "Frames"]
    parts = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).cast("double").alias("value")) for n in names))).alias("x")
    return dets.select("seq", parts).select("seq", F.lit("Count").alias("metric"), "x.field", F.lit(None).cast("double").alias("alpha"), "x.value")


def evaluate(times: DataFrame, metrics: Sequence[str] = (*KERNELS, "Count"), lengths: DataFrame | None = None) -> DataFrame:
    """Additive parts of each sequence: (seq, metric, field, alpha, value).

    `lengths` has (seq, n_times) where sequences have times without any row;
    frames are counted by it, and sequences it lacks keep the times seen.
    """
    chosen = [m for m in metrics if m in KERNELS]

    def run(rows: pa.Table) -> pa.Table:
        frames, n_gt, n_tracker = frames_of(rows)
        found = [(m, *p) for m in chosen for p in KERNELS[m](frames, n_gt, n_tracker)]
        seq = rows["seq"].combine_chunks().take(pa.array([0] * len(found)))
        return pa.table({"seq": seq, "metric": pa.array([x[0] for x in found], pa.string()), "field": pa.array([x[1] for x in found], pa.string()), "alpha": pa.array([x[2] for x in found], pa.float64()), "value": pa.array([x[3] for x in found], pa.float64())})

    kind = times.schema["seq"].dataType.simpleString()
    out = []
    if chosen:
        out.append(times.select("seq", "t", "gt_ids", "tracker_ids", "pairs", *(c for c in ("gt_like", "tracker_like") if c in times.columns)).groupBy("seq").applyInArrow(run, f"seq {kind}, metric string, field string, alpha double, value double"))
    if "Count" in metrics:
        out.append(_counts(times))
    parts = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    if lengths is None:
        return parts
    frames = F.col("field").isin("CLR_Frames", "Frames") & (F.col("value") > 0)
    value = F.when(frames, F.coalesce(F.col("n_times").cast("double"), F.col("value"))).otherwise(F.col("value"))
    return parts.join(lengths.select("seq", "n_times"), "seq", "left").withColumn("value", value).drop("n_times")


def combine(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Additive parts summed over sequences (or by some of the other columns)."""
    return parts.groupBy(*by, "metric", "field", "alpha").agg(F.sum("value").alias("value"))


def _share(a: str, b: str) -> str:
    return f"({a}) / greatest(1.0, {b})"


_FINALS = {
    "HOTA": {
        "DetRe": _share("TP", "TP + FN"),
        "DetPr": _share("TP", "TP + FP"),
        "DetA": _share("TP", "TP + FN + FP"),
        "AssA": _share("Ass_sum", "TP"),
        "AssRe": _share("AssRe_sum", "TP"),
        "AssPr": _share("AssPr_sum", "TP"),
        "LocA": "greatest(1e-10, Loc_sum) / greatest(1e-10, TP)",
        "HOTA": f"sqrt(({_share('TP', 'TP + FN + FP')}) * ({_share('Ass_sum', 'TP')}))",
        "OWTA": f"sqrt(({_share('TP', 'TP + FN')}) * ({_share('Ass_sum', 'TP')}))",
    },
    "CLEAR": {
        "MOTA": _share("CLR_TP - CLR_FP - IDSW", "CLR_TP + CLR_FN"),
        "MOTP": _share("MOTP_sum", "CLR_TP"),
        "MODA": _share("CLR_TP - CLR_FP", "CLR_TP + CLR_FN"),
        "sMOTA": _share("MOTP_sum - CLR_FP - IDSW", "CLR_TP + CLR_FN"),
        "MOTAL": _share("CLR_TP - CLR_FP - if(IDSW > 0, log10(IDSW), 0)", "CLR_TP + CLR_FN"),
        "CLR_Re": _share("CLR_TP", "CLR_TP + CLR_FN"),
        "CLR_Pr": _share("CLR_TP", "CLR_TP + CLR_FP"),
        "CLR_F1": _share("CLR_TP", "CLR_TP + 0.5 * CLR_FN + 0.5 * CLR_FP"),
        "FP_per_frame": _share("CLR_FP", "CLR_Frames"),
        "MTR": _share("MT", "MT + PT + ML"),
        "PTR": _share("PT", "MT + PT + ML"),
        "MLR": _share("ML", "MT + PT + ML"),
    },
    "Identity": {
        "IDR": _share("IDTP", "IDTP + IDFN"),
        "IDP": _share("IDTP", "IDTP + IDFP"),
        "IDF1": _share("IDTP", "IDTP + 0.5 * IDFN + 0.5 * IDFP"),
    },
    "VACE": {"ATA": "STDA / nullif(0.5 * (VACE_IDs + VACE_GT_IDs), 0)", "SFDA": "FDA / nullif(num_non_empty_timesteps, 0)"},
}


def finals(parts: DataFrame, metric: str, by: Sequence[str] = ("seq",)) -> DataFrame:
    """One row for each group (and alpha, for HOTA) with parts and ratios as columns."""
    names = {"HOTA": ["TP", "FN", "FP", "Loc_sum", "Ass_sum", "AssRe_sum", "AssPr_sum"], "CLEAR": ["CLR_TP", "CLR_FN", "CLR_FP", "IDSW", "MOTP_sum", "MT", "PT", "ML", "Frag", "CLR_Frames"], "Identity": ["IDTP", "IDFN", "IDFP"], "VACE": ["STDA", "VACE_IDs", "VACE_GT_IDs", "FDA", "num_non_empty_timesteps"], "Count": ["Dets", "GT_Dets", "IDs", "GT_IDs", "Frames"]}[metric]
    key = [*by, *["alpha"] * (metric == "HOTA")]
    wide = parts.where(F.col("metric") == metric).groupBy(*key).pivot("field", names).agg(F.sum("value"))
    return wide.withColumns({name: F.expr(rule) for name, rule in _FINALS.get(metric, {}).items()})


def summary(hota: DataFrame, by: Sequence[str] = ("seq",)) -> DataFrame:
    """Means over alpha, and the values at the lowest alpha."""
    names = ["HOTA", "DetA", "AssA", "DetRe", "DetPr", "AssRe", "AssPr", "LocA", "OWTA"]
    first = [F.min_by(c, "alpha").alias(f"{c}(0)") for c in ("HOTA", "LocA")]
    out = hota.groupBy(*by).agg(*(F.avg(c).alias(c) for c in names), *first)
    return out.withColumn("HOTALocA(0)", F.col("HOTA(0)") * F.col("LocA(0)"))


def near_pairs(times: DataFrame, least: float) -> DataFrame:
    """(seq, t, gt_id, tracker_id) of all pairs of a timeline with a similarity of at least `least`, which is over 0."""
    return times.select("seq", "t", F.inline(F.filter("pairs", lambda p: p["similarity"] >= least))).drop("similarity")


def travelled(gt: DataFrame, matches: DataFrame) -> DataFrame:
    """M8: share of the ground truth's travelled distance that one tracker id each covers.

    gt(seq, t, gt_id, x, y); matches(seq, t, gt_id, tracker_id) holds all pairs at or
    over the similarity threshold, not only one a row.  Distances are window sums; the assignment is one kernel a
    sequence, by connected parts.
    """
    from .windows import path_length

    pairs = path_length(matches.join(gt, ["seq", "t", "gt_id"]), ["seq", "gt_id", "tracker_id"], "t", ["x", "y"]).select("seq", "gt_id", "tracker_id", "path_length")
    return _covered(gt, pairs)


def _covered(gt: DataFrame, pairs: DataFrame) -> DataFrame:
    """M8 from the distances of pairs (seq, gt_id, tracker_id, path_length)."""
    from .windows import path_length

    whole = path_length(gt.select("seq", "t", "gt_id", "x", "y"), ["seq", "gt_id"], "t", ["x", "y"]).select("seq", "gt_id", F.col("path_length").alias("own"))
    rows = whole.join(pairs, ["seq", "gt_id"], "left")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        total = own.drop_duplicates("gt_id")["own"].sum()
        found = own.dropna(subset=["tracker_id"])
        covered = 0.0
        if len(found):
            i, j, way = pd.factorize(found["gt_id"])[0], pd.factorize(found["tracker_id"])[0], found["path_length"].to_numpy(float)
            order = np.lexsort((j, i))
            order = order[way[order] > 0]
            best = assign_sparse(i[order], j[order], way[order])
            covered = way[order][best].sum()
        return pd.DataFrame({"seq": own["seq"].iloc[:1], "IDEucl": [covered / total if total else 0.0]})

    kind = gt.schema["seq"].dataType.simpleString()
    return rows.groupBy("seq").applyInPandas(run, f"seq {kind}, IDEucl double")


def travelled_boxes(gt: DataFrame, tracker: DataFrame, least: float, group: int = 512, part: int = 2048) -> DataFrame:
    """`travelled` of gt(seq, t, gt_id, x, y, box) and tracker(seq, t, tracker_id, box), matched where the IoU is at least `least`, over 0.

    Blocks of `group` and `part` tracks of a sequence meet over all their times, so a
    row leaves a pair of tracks that moved together, none a pair of boxes.  An id has one row a time.
    """
    from .pairs import meeting

    kinds = dict(gt.dtypes) | dict(tracker.dtypes)

    def paths(df: DataFrame, id_col: str, *more: str) -> DataFrame:
        own = [F.col(c).cast("double").alias(c) for c in more] + [F.col(f"box.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]
        # Names of their own: both sides may come from one table.
        return df.groupBy(F.col("seq").alias("_s"), id_col).agg(F.collect_list(F.struct("t", *own)).alias("path")).select(F.col("_s").alias("seq"), id_col, "path")

    def by_time(table: pa.Table) -> dict:
        path = table["path"].combine_chunks()
        owner = np.repeat(np.arange(len(table)), pc.list_value_length(path).to_numpy(zero_copy_only=False))
        times, *values = path.flatten().flatten()
        times, values = times.to_numpy(zero_copy_only=False), np.stack([v.to_numpy(zero_copy_only=False) for v in values])
        order = np.argsort(times, kind="stable")
        begins = np.flatnonzero(np.diff(times[order], prepend=times[order[:1]] - 1))
        return {times[order[k]]: (owner[at], values[:, at]) for k, at in zip(begins, np.split(order, begins[1:]))}

    def kernel(one: pa.Table, two: pa.Table) -> pa.Table:
        here, there = by_time(one), by_time(two)
        last = np.full((2, len(one), len(two)), np.nan)
        total = np.zeros(last.shape[1:])
        for t in sorted(here.keys() & there.keys()):
            (i, (x, y, *a)), (j, b) = here[t], there[t]
            a, b = [v[:, None] for v in a], [v[None] for v in b]
            both = np.maximum(np.minimum(a[2], b[2]) - np.maximum(a[0], b[0]), 0) * np.maximum(np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]), 0)
            union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
            k, m = np.nonzero(both >= least * np.where(union > 0, union, np.inf) - 1e-9 * np.abs(union))
            near = both[k, m] / union[k, m] >= least
            k, m = k[near], m[near]
            p, q = i[k], j[m]
            total[p, q] += np.nan_to_num(np.sqrt((x[k] - last[0, p, q]) ** 2 + (y[k] - last[1, p, q]) ** 2))
            last[0, p, q], last[1, p, q] = x[k], y[k]
        p, q = np.nonzero(total)
        return pa.table({"seq": one["seq"].take(pa.array(p)), "gt_id": one["gt_id"].take(pa.array(p)), "tracker_id": two["tracker_id"].take(pa.array(q)), "path_length": total[p, q]})

    schema = f"seq {kinds['seq']}, gt_id {kinds['gt_id']}, tracker_id {kinds['tracker_id']}, path_length double"
    return _covered(gt, meeting(paths(gt, "gt_id", "x", "y"), paths(tracker, "tracker_id"), kernel, schema, group, part, by=["seq"]))


def world_evaluate(gt: DataFrame, tracker: DataFrame, metrics: Sequence[str] = (*KERNELS, "Count")) -> DataFrame:
    """`evaluate` for upright boxes in the world, similar by their 3-D IoU.

    Both tables have seq, frame (from 1), id and box (x, y, z, l, w, h), of one class.
    Times are those up to the last ground-truth frame of a sequence.  Ids are not
    numbered anew: each side has as many as its greatest id and one more.
    """
    lengths = gt.groupBy("seq").agg(F.max("frame").alias("n_times"))
    tracker = tracker.join(lengths, "seq").where(F.col("frame") <= F.col("n_times")).drop("n_times")
    a = gt.select("seq", F.col("frame").alias("t"), F.col("id").alias("gt_id"), "box")
    b = tracker.select("seq", F.col("frame").alias("t"), F.col("id").alias("tracker_id"), "box")
    parts = evaluate(box_timeline(a, b, "box", "box"), metrics, lengths)
    absent = [df.groupBy("seq").agg((F.max("id") + 1 - F.countDistinct("id")).alias(name)) for df, name in ((gt, "_gt"), (tracker, "_tracker"))]
    out = parts.join(absent[0], "seq", "left").join(absent[1], "seq", "left")
    more = F.when(F.col("field").isin("ML", "GT_IDs", "VACE_GT_IDs"), F.col("_gt")).when(F.col("field").isin("IDs", "VACE_IDs"), F.col("_tracker")).otherwise(0)
    return out.withColumn("value", F.col("value") + F.coalesce(more, F.lit(0))).drop("_gt", "_tracker")
