"""Small dense kernels in numpy: assignment, suppression, clustering.

They run inside grouped Arrow functions, on one frame or one window at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """C17: rows and columns of an assignment of least total cost, min(rows, columns) pairs.

    Shortest augmenting paths with potentials, one row after the other.  Equal
    costs are settled by the lowest column, so the result is deterministic.
    """
    cost = np.asarray(cost, float)
    n, m = cost.shape
    if not n or not m:
        return np.zeros(0, int), np.zeros(0, int)
    if n > m:
        columns, rows = assign(cost.T)
        order = np.argsort(rows, kind="stable")
        return rows[order], columns[order]
    u, v = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        reach = np.full(m, np.inf)
        via = np.full(m, -1)
        done = np.zeros(m, bool)
        i, j = row, -1
        while True:
            if j >= 0:
                done[j] = True
                i = owner[j]
            base = reach[j] if j >= 0 else 0.0
            offer = base + cost[i] - u[i] - v
            better = ~done & (offer < reach - 1e-15)
            reach[better] = offer[better]
            via[better] = j
            j = int(np.argmin(np.where(done, np.inf, reach)))
            if owner[j] < 0:
                break
        shortest = reach[j]
        u[row] += shortest
        seen = np.flatnonzero(done)
        u[owner[seen]] += shortest - reach[seen]
        v[seen] -= shortest - reach[seen]
        while j >= 0:
            k = via[j]
            owner[j] = row if k < 0 else owner[k]
            j = k
    columns = np.flatnonzero(owner >= 0)
    order = np.argsort(owner[columns], kind="stable")
    return owner[columns][order], columns[order]


def _blocks(near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of each connected part of a table of pairs that has a pair."""
    n, m = near.shape
    rows = np.where(near.any(1), np.arange(n), n)
    while True:
        # A column has the least label among its rows, a row the least among its columns.
        columns = np.where(near, rows[:, None], n).min(0, initial=n)
        low = np.minimum(rows, np.where(near, columns[None], n).min(1, initial=n))
        if (low == rows).all():
            break
        rows = low
    row_order, column_order = np.argsort(rows, kind="stable"), np.argsort(columns, kind="stable")
    for label in np.unique(rows[rows < n]):
        i = row_order[np.searchsorted(rows[row_order], label) : np.searchsorted(rows[row_order], label, "right")]
        j = column_order[np.searchsorted(columns[column_order], label) : np.searchsorted(columns[column_order], label, "right")]
        yield i, j


def assign_pairs(cost: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """C17: rows and columns of an assignment none of whose pairs costs over `limit`, by row.

    Leaving a row and a column alone costs `limit` together, so a pair is worth
    `limit` less its cost.  Parts of the table that no allowed pair connects are
    solved one by one.
    """
    cost = np.asarray(cost, float)
    allowed = np.isfinite(cost) & (cost <= limit)
    rows, columns = [np.zeros(0, int)], [np.zeros(0, int)]
    for i, j in _blocks(allowed):
        part, ok = cost[np.ix_(i, j)], allowed[np.ix_(i, j)]
        if len(i) == 1 or len(j) == 1:
            at = np.unravel_index(int(np.argmin(np.where(ok, part, np.inf))), part.shape)
            a, b = np.array([at[0]]), np.array([at[1]])
        else:
            a, b = assign(np.where(ok, part - limit, 0.0))
            keep = ok[a, b]
            a, b = a[keep], b[keep]
        rows.append(i[a])
        columns.append(j[b])
    rows, columns = np.concatenate(rows), np.concatenate(columns)
    order = np.argsort(rows, kind="stable")
    return rows[order], columns[order]


def _parts(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The connected part of each pair of a row i and a column j; parts are numbered by their least row."""
    if not len(i):
        return np.zeros(0, int)
    n, m = int(i.max()) + 1, int(j.max()) + 1
    label = np.arange(n)
    while True:
        # A column has the least label among its rows, a row the least among its columns.
        columns = np.full(m, n)
        np.minimum.at(columns, j, label[i])
        low = label.copy()
        np.minimum.at(low, i, columns[j])
        low = low[low]
        if (low == label).all():
            return label[i]
        label = low


def assign_sparse(i: np.ndarray, j: np.ndarray, score: np.ndarray) -> np.ndarray:
    """C17: which of the pairs (row, column, score over 0), given by row and column, make up an assignment of greatest total score.

    Connected parts of the pairs are solved one by one, so memory goes with the
    largest part; parts with one row or one column take their best pair at once.
    """
    i, j, score = np.asarray(i), np.asarray(j), np.asarray(score, float)
    part = _parts(i, j)
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1)) if len(order) else np.zeros(1, int)
    begin, size = edges[:-1], np.diff(edges)
    if not len(begin):
        return np.zeros(0, int)
    one_row, one_column = (np.minimum.reduceat(x[order], begin) == np.maximum.reduceat(x[order], begin) for x in (i, j))
    star = one_row | one_column
    # The first pair of the greatest score of each part.
    best = np.repeat(np.maximum.reduceat(score[order], begin), size) == score[order]
    first = np.minimum.reduceat(np.where(best, np.arange(len(order)), len(order)), begin)
    chosen = [order[first[star]]]
    for k in np.flatnonzero(~star):
        own = order[begin[k] : begin[k] + size[k]]
        rows, r = np.unique(i[own], return_inverse=True)
        columns, c = np.unique(j[own], return_inverse=True)
        cost = np.zeros((len(rows), len(columns)))
        place = np.full(cost.shape, -1)
        cost[r, c], place[r, c] = -score[own], own
        at = place[assign(cost)]
        chosen.append(at[at >= 0])
    return np.sort(np.concatenate(chosen))


def transport(cost: np.ndarray, supply: np.ndarray, room: np.ndarray) -> np.ndarray:
    """C17: how many of each row's `supply` go to each column of `room`, for the least total cost; as many as the smaller side has.

    `assign` with rows and columns that stand for several equal ones: shortest
    augmenting paths, each for as many as it can take, so the work goes with the
    different rows and columns, not with how often they come.
    """
    cost, supply, room = np.asarray(cost, float), np.asarray(supply, np.int64), np.asarray(room, np.int64)
    if supply.sum() > room.sum():
        return transport(cost.T, room, supply).T
    n, m = cost.shape
    u, v, flow = np.zeros(n), np.zeros(m), np.zeros((n, m), np.int64)
    left, room = supply.copy(), room.copy()
    for row in range(n):
        while left[row]:
            reach, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
            came, base = np.full(n, -1), np.zeros(n)
            came[row], fresh, at = m, np.array([row]), 0.0
            while True:
                if len(fresh):
                    offers = at + cost[fresh] - u[fresh][:, None] - v
                    who = offers.argmin(0)
                    offer = offers[who, np.arange(m)]
                    better = ~done & (offer < reach - 1e-15)
                    reach[better], via[better] = offer[better], fresh[who[better]]
                j = int(np.argmin(np.where(done, np.inf, reach)))
                at = reach[j]
                if room[j]:
                    break
                done[j] = True
                fresh = np.flatnonzero((flow[:, j] > 0) & (came < 0))
                came[fresh], base[fresh] = j, at
            seen = came >= 0
            u[seen] += at - base[seen]
            v[done] -= at - reach[done]
            path, k = [(via[j], j, 1)], via[j]
            while k != row:
                path += [(k, came[k], -1), (via[came[k]], came[k], 1)]
                k = via[came[k]]
            some = min([left[row], room[j], *(flow[a, b] for a, b, way in path if way < 0)])
            for a, b, way in path:
                flow[a, b] += way * some
            left[row] -= some
            room[j] -= some
    return flow


def assign_kinds(i: np.ndarray, j: np.ndarray, score: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """C17: `assign_sparse` where row i stands for `rows[i]` equal ones and column j for `columns[j]`: how often each pair is taken."""
    out = np.zeros(len(i), np.int64)
    there = np.flatnonzero((rows[i] > 0) & (columns[j] > 0))
    i, j, score = i[there], j[there], score[there]
    if (rows[i] == 1).all() and (columns[j] == 1).all():
        out[there[assign_sparse(i, j, score)]] = 1
        return out
    part = _parts(i, j)
    order = np.argsort(part, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        left, r = np.unique(i[own], return_inverse=True)
        right, c = np.unique(j[own], return_inverse=True)
        cost = np.zeros((len(left), len(right)))
        cost[r, c] = -score[own]
        out[there[own]] = transport(cost, rows[left], columns[right])[r, c]
    return out


def dealt_out(kinds: np.ndarray, kind: np.ndarray, free: np.ndarray) -> np.ndarray:
    """For each of `kinds` a place of its own among the `free` ones of that `kind`, the first for the first."""
    own = np.flatnonzero(free)
    own = own[np.argsort(kind[own], kind="stable")]
    order = np.argsort(kinds, kind="stable")
    nth = np.empty(len(kinds), np.int64)
    nth[order] = np.arange(len(kinds)) - np.searchsorted(kinds[order], kinds[order])
    return own[np.searchsorted(kind[own], kinds) + nth]


def assign_members(i: np.ndarray, j: np.ndarray, score: np.ndarray, kinds: tuple[np.ndarray, np.ndarray], free: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """C17: an assignment of greatest total score of members of equal kinds: places of rows and of columns, and which pair of kinds each is.

    Pairs (i, j, score over 0) are of kinds; `kinds` says of which kind each member
    is and `free` which may be taken.  Members of a kind are taken in their order.
    """
    n = [np.bincount(kind[f], minlength=int(kind.max(initial=-1)) + 1) for kind, f in zip(kinds, free)]
    at = np.repeat(np.arange(len(i)), assign_kinds(i, j, score, *n))
    return dealt_out(i[at], kinds[0], free[0]), dealt_out(j[at], kinds[1], free[1]), at


def assign_within(cost: np.ndarray, limit: float) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """C17: the pairs of `assign_pairs`, and the rows and columns left over."""
    cost = np.asarray(cost, float)
    n, m = cost.shape
    rows, columns = assign_pairs(cost, limit)
    return list(zip(rows.tolist(), columns.tolist())), np.setdiff1d(np.arange(n), rows).tolist(), np.setdiff1d(np.arange(m), columns).tolist()


def greedy_pairs(score: np.ndarray, least: float = 0.0) -> list[tuple[int, int]]:
    """C4: again and again the pair of greatest score over `least` among rows and columns still free."""
    score = np.array(score, float)
    out = []
    while score.size and score.max() > least:
        i, j = np.unravel_index(int(np.argmax(score)), score.shape)
        out.append((int(i), int(j)))
        score[i, :] = score[:, j] = -np.inf
    return out


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of all pairs of corner boxes."""
    a, b = np.asarray(a, float).reshape(-1, 4), np.asarray(b, float).reshape(-1, 4)
    low = np.maximum(a[:, None, :2], b[None, :, :2])
    high = np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.clip(high - low, 0, None).prod(2)
    own = np.clip(a[:, 2:] - a[:, :2], 0, None).prod(1)
    other = np.clip(b[:, 2:] - b[:, :2], 0, None).prod(1)
    union = own[:, None] + other[None] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def box_pairs(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], cells: int = 2_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, IoU) of the pairs with IoU over 0 of upright boxes given by their low and high corners, by row and column.

    Boxes are looked for along the axis on which fewest can meet, at most some
    `cells` pairs at a time, so the whole matrix is never held.
    """
    (low, high), (low_2, high_2) = ((np.asarray(x, float) for x in side) for side in (one, two))
    n, d = low.shape
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not n or not len(low_2):
        return empty
    own, other = (np.clip(h - x, 0, None).prod(1) for x, h in ((low, high), (low_2, high_2)))
    real = np.flatnonzero(~np.isnan(low_2).any(1) & ~np.isnan(high_2).any(1))
    if not len(real):
        return empty
    choices = []
    for c in range(d):
        order = real[np.argsort(low_2[real, c], kind="stable")]
        begins = low_2[order, c]
        widest = max(0.0, float((high_2[order, c] - begins).max()))
        first = np.searchsorted(begins, low[:, c] - widest)
        count = np.where(np.isnan(low[:, c]), 0, np.maximum(np.searchsorted(begins, high[:, c], "right") - first, 0))
        choices.append((int(count.sum()), c, order, first, count))
    _, _, order, first, count = min(choices, key=lambda x: x[:2])
    ends = np.cumsum(count)
    found, at = [], 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + cells, "right")))
        i = np.repeat(np.arange(at, to), count[at:to])
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(count[at:to]) - count[at:to], count[at:to]) + np.repeat(first[at:to], count[at:to])]
        both = np.clip(np.minimum(high[i], high_2[j]) - np.maximum(low[i], low_2[j]), 0, None).prod(1)
        union = own[i] + other[j] - both
        iou = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
        i, j, iou = (x[iou != 0] for x in (i, j, iou))
        by = np.lexsort((j, i))
        found.append((i[by], j[by], iou[by]))
        at = to
    return tuple(np.concatenate(x) for x in zip(*found))


def meeting_boxes(a: np.ndarray, b: np.ndarray, cells: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of corner boxes `a` and `b` in lots, so that boxes that overlap are in one lot: as many connected parts as make some `cells` pairs.

    Boxes that meet none of the other side are in no lot; a part is never cut.
    """
    i, j, _ = box_pairs((a[:, :2], a[:, 2:]), (b[:, :2], b[:, 2:]))
    part = _parts(i, j)
    sides = []
    for x in (i, j):
        own, first = np.unique(x, return_index=True)
        order = np.argsort(part[first], kind="stable")
        sides.append((own[order], part[first][order]))
    names = np.unique(part)
    ends = [np.searchsorted(label, names, "right").tolist() for _, label in sides]
    begin, last = (0, 0), (0, 0)
    for end in zip(*ends):
        if last != begin and (end[0] - begin[0]) * (end[1] - begin[1]) > cells:
            yield tuple(np.sort(sides[k][0][begin[k] : last[k]]) for k in (0, 1))
            begin = last
        last = end
    if last != begin:
        yield tuple(np.sort(sides[k][0][begin[k] : last[k]]) for k in (0, 1))


def suppress(boxes: np.ndarray, scores: np.ndarray, limit: float, classes: np.ndarray | None = None, most: int | None = None) -> np.ndarray:
    """T4: indices kept by greedy non-maximum suppression, by falling score (equal scores: the earlier first).

    A box that is suppressed suppresses nothing itself.  With `classes`, boxes of
    different classes do not meet.
    """
    boxes, scores = np.asarray(boxes, float).reshape(-1, 4), np.asarray(scores, float)
    order = np.argsort(-scores, kind="stable")
    kept: list[int] = []
    alive = np.ones(len(order), bool)
    for k, i in enumerate(order):
        if not alive[k]:
            continue
        kept.append(int(i))
        if most is not None and len(kept) >= most:
            break
        rest = order[k + 1 :]
        hit = iou_matrix(boxes[i], boxes[rest])[0] > limit
        if classes is not None:
            hit &= np.asarray(classes)[rest] == np.asarray(classes)[i]
        alive[k + 1 :] &= ~hit
    return np.array(kept, int)


def single_linkage(distance: np.ndarray, cut: float) -> np.ndarray:
    """Labels of single-linkage clusters cut at `cut`: components of the pairs at most `cut` apart, numbered by first member."""
    n = len(distance)
    label = np.full(n, -1)
    near = np.asarray(distance) <= cut
    count = 0
    for i in range(n):
        if label[i] < 0:
            todo = [i]
            label[i] = count
            while todo:
                k = todo.pop()
                fresh = np.flatnonzero(near[k] & (label < 0))
                label[fresh] = count
                todo += fresh.tolist()
            count += 1
    return label


def dbscan(distance: np.ndarray, reach: float, least: int) -> np.ndarray:
    """Density clusters by a distance matrix; -1 for noise.

    A point with at least `least` points within `reach` (itself included) is a
    core; clusters grow from cores in order, and a border point goes to the first.
    """
    near = np.asarray(distance) <= reach
    core = near.sum(1) >= least
    label = np.full(len(near), -1)
    count = 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        label[i] = count
        todo = [i]
        while todo:
            k = todo.pop(0)
            if core[k]:
                fresh = np.flatnonzero(near[k] & (label < 0))
                label[fresh] = count
                todo += fresh.tolist()
        count += 1
    return label


def dbscan_vectors(v: np.ndarray, reach: float, least: int, cells: int = 4_000_000, least_similarity: float = -np.inf) -> np.ndarray:
    """`dbscan` by cosine distance (cosines under `least_similarity` count as 0), in blocks of rows of at most `cells` distances; the whole matrix is never held."""
    n = len(v)
    step = max(1, cells // max(n, 1))

    def near(rows: np.ndarray) -> np.ndarray:
        s = cosine_matrix(rows, v)
        return 1 - np.where(s < least_similarity, 0.0, s) <= reach

    core = np.concatenate([near(v[i : i + step]).sum(1) >= least for i in range(0, n, step)] or [np.zeros(0, bool)])
    label = np.full(n, -1)
    count = 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        label[i] = count
        todo = [i]
        while todo:
            some, todo = todo[:step], todo[step:]
            fresh = np.flatnonzero(near(v[some]).any(0) & (label < 0))
            label[fresh] = count
            todo += fresh[core[fresh]].tolist()
        count += 1
    return label


def near_parts(v: np.ndarray, near: float, least: float = -np.inf, cells: int = 4_000_000) -> np.ndarray:
    """Which part each vector is in, where cosine distances of at most `near` connect (cosines under `least` count as 0); in blocks of at most `cells` distances.

    Parts are called by their first member.
    """
    n = len(v)
    label, step, i = np.arange(n), 1, 0
    while i < n:
        step = max(1, cells // (n - i))
        s = cosine_matrix(v[i : i + step], v[i:])
        a, b = np.nonzero(1 - np.where(s < least, 0.0, s) <= near)
        a, b = label[a + i], label[b + i]
        links = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
        if links.size:
            to = np.arange(n)
            while True:
                low = to.copy()
                for x, y in (links, links[::-1]):
                    np.minimum.at(low, x, to[y])
                low = low[low]
                if (low == to).all():
                    break
                to = low
            label = to[label]
        i += step
    return label


def noise_as_singletons(label: np.ndarray) -> np.ndarray:
    """Each noise point becomes a cluster of its own, after the others."""
    out = np.array(label)
    noise = np.flatnonzero(out < 0)
    out[noise] = out.max(initial=-1) + 1 + np.arange(len(noise))
    return out


def associate(similarity: np.ndarray, frames: list[set], average: bool = True, least: float = 0.0, guard: bool = True) -> np.ndarray:
    """Clusters merged pair by pair, the most similar first, until no pair is over `least`.

    The similarity of clusters is the sum over their members, divided by the
    number of pairs with `average`.  With `guard`, clusters that have a frame in common, or a
    pair of negative similarity, never merge.
    """
    total = np.array(similarity, float)
    n = len(total)
    np.fill_diagonal(total, 0)
    size = np.ones(n)
    blocked = np.zeros((n, n), bool)
    if guard:
        blocked |= total < 0
        for i in range(n):
            for j in range(i):
                if frames[i] & frames[j]:
                    blocked[i, j] = blocked[j, i] = True
    label, alive = np.arange(n), np.ones(n, bool)
    while True:
        score = total / (size[:, None] * size[None]) if average else total.copy()
        score[~alive] = -np.inf
        score[:, ~alive] = -np.inf
        score[blocked] = -np.inf
        np.fill_diagonal(score, -np.inf)
        if not n or score.max() <= least:
            break
        i, j = sorted(np.unravel_index(int(np.argmax(score)), score.shape))
        total[i] += total[j]
        total[:, i] += total[:, j]
        blocked[i] |= blocked[j]
        blocked[:, i] |= blocked[:, j]
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def cosine_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of all pairs; 0 with a zero vector."""
    a, b = np.atleast_2d(np.asarray(a, float)), np.atleast_2d(np.asarray(b, float))
    scale = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None]
    return np.divide(a @ b.T, scale, out=np.zeros((len(a), len(b))), where=scale > 0)
