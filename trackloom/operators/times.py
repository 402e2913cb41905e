"""Rows of a timeline (ids of both sides and their pairs, as Arrow lists) in numpy, without an object a pair or a matrix a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def list_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's values begin and end, and all values one after the other."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy()
    return at - at[0], column.flatten().to_numpy(zero_copy_only=False)


def meetings(rows: pa.Table | pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray] | None]]:
    """For each row: the sorted ids of both sides, and its pairs in their order, as places of both ids and similarities.

    With `gt_like` and `tracker_like`, which say what id each one is like, pairs are
    of kinds, and the kind of each id is given at last; where all kinds have one id,
    as without these columns, it is None.
    """
    gt_at, gt = list_parts(rows.column("gt_ids"))
    tracker_at, tracker = list_parts(rows.column("tracker_ids"))
    likes = [list_parts(rows.column(c))[1] for c in ("gt_like", "tracker_like")] if "gt_like" in rows.schema.names else None
    pairs = rows.column("pairs")
    if isinstance(pairs, pa.ChunkedArray):
        pairs = pairs.combine_chunks()
    at = pairs.offsets.to_numpy()
    at = at - at[0]
    own = pairs.flatten()
    left, right, value = (x.to_numpy(zero_copy_only=False) for x in own.flatten())
    for k in range(len(rows)):
        spans = slice(gt_at[k], gt_at[k + 1]), slice(tracker_at[k], tracker_at[k + 1])
        sides = [np.unique(ids[span], return_index=True) for ids, span in zip((gt, tracker), spans)]
        names = [ids for ids, _ in sides]
        kinds = None
        if likes:
            alike = [like[span][first] for like, span, (_, first) in zip(likes, spans, sides)]
            if any((a != ids).any() for a, ids in zip(alike, names)):
                names, kinds = zip(*(np.unique(a, return_inverse=True) for a in alike))
        here = slice(at[k], at[k + 1])
        i, j = (np.searchsorted(ids, x[here]) if here.stop > here.start else np.zeros(0, int) for ids, x in zip(names, (left, right)))
        # Of a pair that is given twice the last counts.
        code = i.astype(np.int64) * len(names[1]) + j
        _, last = np.unique(code[::-1], return_index=True)
        last = len(code) - 1 - last
        yield sides[0][0], sides[1][0], i[last], j[last], value[here][last], kinds
