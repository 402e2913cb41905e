"""Boxes, points and projections as Column expressions.

A box is a struct of corners x1, y1, x2, y2; every function returns a Column, so
that whole queries stay inside generated code.  Row ids such as P8 refer to the
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F



def box(x1, y1, x2, y2) -> Column:
    """A box from corner columns."""
    return F.struct(*(F.col(c).cast("double").alias(n) if isinstance(c, str) else c.cast("double").alias(n) for c, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"))))


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Left, top, width, height to corners."""
    return box(x, y, x + w, y + h)


def from_cxcywh(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """Centre and size to corners."""
    return box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def from_xyah(cx: Column, cy: Column, aspect: Column, h: Column) -> Column:
    """Centre, aspect ratio (w/h) and height to corners."""
    return from_cxcywh(cx, cy, aspect * h, h)


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def area(b: Column) -> Column:
    """Area; an inverted box has none."""
    return F.greatest(width(b), F.lit(0.0)) * F.greatest(height(b), F.lit(0.0))


def to_xywh(b: Column) -> Column:
    """Corners to left, top, width, height."""
    return F.struct(b["x1"].alias("x"), b["y1"].alias("y"), width(b).alias("w"), height(b).alias("h"))


def to_cxcywh(b: Column) -> Column:
    """Corners to centre and size."""
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("cx"), ((b["y1"] + b["y2"]) / 2).alias("cy"), width(b).alias("w"), height(b).alias("h"))


def to_xyah(b: Column) -> Column:
    """Corners to centre, aspect ratio and height (null ratio for a flat box)."""
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("cx"), ((b["y1"] + b["y2"]) / 2).alias("cy"), (width(b) / F.nullif(height(b), F.lit(0.0))).alias("a"), height(b).alias("h"))


def normalised(b: Column, image_w, image_h) -> Column:
    """Pixel corners to shares of the image."""
    return box(b["x1"] / image_w, b["y1"] / image_h, b["x2"] / image_w, b["y2"] / image_h)


def pixels(b: Column, image_w, image_h) -> Column:
    """Shares of the image to pixel corners."""
    return box(b["x1"] * image_w, b["y1"] * image_h, b["x2"] * image_w, b["y2"] * image_h)


def foot(b: Column) -> Column:
    """The middle of the lower edge."""
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("x"), b["y2"].alias("y"))


def clamped(b: Column, image_w, image_h, least: float = 0.0) -> Column:
    """A box inside the image; with `least`, at least so many pixels wide and high."""
    x1, y1 = F.greatest(b["x1"], F.lit(0.0)), F.greatest(b["y1"], F.lit(0.0))
    x2, y2 = F.least(b["x2"], F.lit(image_w).cast("double")), F.least(b["y2"], F.lit(image_h).cast("double"))
    return box(x1, y1, F.greatest(x2, x1 + least), F.greatest(y2, y1 + least))


def intersection(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def _ratio(x: Column, y: Column) -> Column:
    return F.when(y > 0, x / y).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = intersection(a, b)
    return _ratio(both, area(a) + area(b) - both)


def ioa(a: Column, b: Column) -> Column:
    """Share of a that b covers; 0 for an empty a."""
    return _ratio(intersection(a, b), area(a))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """P10: intersection over the smaller area; 0 where that is empty."""
    return _ratio(intersection(a, b), F.least(area(a), area(b)))


def _hull(a: Column, b: Column) -> tuple[Column, Column]:
    return F.greatest(a["x2"], b["x2"]) - F.least(a["x1"], b["x1"]), F.greatest(a["y2"], b["y2"]) - F.least(a["y1"], b["y1"])


def giou(a: Column, b: Column) -> Column:
    """IoU less the share of the hull that neither box covers."""
    w, h = _hull(a, b)
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return iou(a, b) - _ratio(w * h - union, w * h)


def _centre_term(a: Column, b: Column) -> Column:
    w, h = _hull(a, b)
    dx = (a["x1"] + a["x2"] - b["x1"] - b["x2"]) / 2
    dy = (a["y1"] + a["y2"] - b["y1"] - b["y2"]) / 2
    return _ratio(dx * dx + dy * dy, w * w + h * h)


def diou(a: Column, b: Column) -> Column:
    """IoU less the squared distance of centres over the squared diagonal of the hull."""
    return iou(a, b) - _centre_term(a, b)


def ciou(a: Column, b: Column) -> Column:
    """DIoU less a term for unlike aspect ratios."""
    turn = F.atan2(width(a), height(a)) - F.atan2(width(b), height(b))
    v = turn * turn * (4.0 / 9.869604401089358)
    return diou(a, b) - F.when(v > 0, v * v / (1 - iou(a, b) + v)).otherwise(F.lit(0.0))


def alpha_iou(a: Column, b: Column, alpha: float = 2.0) -> Column:
    """IoU to the power alpha."""
    return F.pow(iou(a, b), F.lit(alpha))


def iou_3d(a: Column, b: Column) -> Column:
    """IoU of upright boxes given by centre x, y, z and size l (along x), w (along y), h; yaw plays no part."""

    def shared(c: str, s: str) -> Column:
        top = F.least(a[c] + a[s] / 2, b[c] + b[s] / 2)
        return F.greatest(top - F.greatest(a[c] - a[s] / 2, b[c] - b[s] / 2), F.lit(0.0))

    both = shared("x", "l") * shared("y", "w") * shared("z", "h")
    return _ratio(both, a["l"] * a["w"] * a["h"] + b["l"] * b["w"] * b["h"] - both)


def solid_ends(s: Column) -> dict[str, Column]:
    """Where an upright box begins and ends along each axis, and its volume, as columns: to be told once a row, not once a pair."""
    ends = {}
    for c, size in (("x", "l"), ("y", "w"), ("z", "h")):
        ends |= {f"{c}1": s[c] - s[size] / 2, f"{c}2": s[c] + s[size] / 2}
    return ends | {"volume": s["l"] * s["w"] * s["h"]}


def shared_volume(a: str, b: str) -> Column:
    """Volume that two upright boxes share, from their `solid_ends` with prefixes `a` and `b`."""

    def shared(c: str) -> Column:
        return F.greatest(F.least(F.col(f"{a}{c}2"), F.col(f"{b}{c}2")) - F.greatest(F.col(f"{a}{c}1"), F.col(f"{b}{c}1")), F.lit(0.0))

    return shared("x") * shared("y") * shared("z")


def distance_similarity(d: Column, zero_at: float = 2.0) -> Column:
    """1 at distance 0, falling to 0 at `zero_at`."""
    return F.greatest(F.lit(0.0), 1 - d / zero_at)


def inverse_3x3(m: Sequence[Sequence[float]]) -> list[list[float]]:
    """Inverse of a constant 3x3 matrix, found once on the driver by cofactors."""
    (a, b, c), (d, e, f), (g, h, i) = m
    cof = [[e * i - f * h, c * h - b * i, b * f - c * e], [f * g - d * i, a * i - c * g, c * d - a * f], [d * h - e * g, b * g - a * h, a * e - b * d]]
    det = a * cof[0][0] + b * cof[1][0] + c * cof[2][0]
    if det == 0:
        raise ValueError("a singular matrix has no inverse")
    return [[x / det for x in row] for row in cof]


def project(matrix: Sequence[Sequence[float]], x: Column, y: Column) -> Column:
    """A point through a 3x3 matrix, divided by its third coordinate (null where that is 0)."""
    u, v, w = (x * float(r[0]) + y * float(r[1]) + float(r[2]) for r in matrix)
    w = F.nullif(w, F.lit(0.0))
    return F.struct((u / w).alias("x"), (v / w).alias("y"))


def ground_homography(intrinsic: Sequence[Sequence[float]], extrinsic: Sequence[Sequence[float]]) -> list[list[float]]:
    """Pixel to ground plane (z = 0): the inverse of K [r1 r2 t]."""
    plane = [[row[0], row[1], row[3]] for row in extrinsic]
    return inverse_3x3([[sum(k * p for k, p in zip(row, column)) for column in zip(*plane)] for row in intrinsic])


def back_project(x: Column, y: Column, depth_mm: Column, intrinsic: Sequence[Sequence[float]], camera_to_world: Sequence[Sequence[float]]) -> Column:
    """P5: a pixel with depth in millimetres to world metres; null for no depth."""
    metres = F.nullif(depth_mm.cast("double"), F.lit(0.0)) / 1000.0
    k = inverse_3x3(intrinsic)
    camera = [metres * (x * float(r[0]) + y * float(r[1]) + float(r[2])) for r in k]
    world = [sum((c * float(m) for c, m in zip(camera, row)), F.lit(float(row[3]))) for row in camera_to_world[:3]]
    return F.when(metres.isNotNull(), F.struct(*(v.alias(n) for v, n in zip(world, "xyz"))))


def world_point(by_depth: Column, by_homography: Column) -> Column:
    """The depth point, else the ground point (z = 0), else null."""
    flat = F.when(by_homography.isNotNull(), F.struct(by_homography["x"].alias("x"), by_homography["y"].alias("y"), F.lit(0.0).alias("z")))
    return F.coalesce(by_depth, flat)


def circular_mean(angle: Column) -> Column:
    """Direction of the sum of unit vectors, an aggregate."""
    return F.atan2(F.sum(F.sin(angle)), F.sum(F.cos(angle)))


def fuse_score(similarity: Column, score: Column) -> Column:
    """Cost of IoU weighed with the detection's score."""
    return 1 - similarity * score


def fuse_iou(appearance_cost: Column, similarity: Column) -> Column:
    """Cost of appearance weighed with IoU."""
    return 1 - (1 - appearance_cost) * (1 + similarity) / 2


def fuse_motion(cost: Column, gate_distance: Column, limit: float, share: float = 0.98) -> Column:
    """Cost mixed with the squared Mahalanobis distance; infinite beyond the gate."""
    return F.when(gate_distance > limit, F.lit(float("inf"))).otherwise(share * cost + (1 - share) * gate_distance)


def project_by(matrix: Column, x: Column, y: Column) -> Column:
    """`project` with a matrix that is a column of nested arrays; null where there is none."""

    def row(i: int) -> Column:
        r = F.get(matrix, F.lit(i))
        return F.get(r, F.lit(0)) * x + F.get(r, F.lit(1)) * y + F.get(r, F.lit(2))

    w = F.nullif(row(2), F.lit(0.0))
    return F.when(w.isNotNull(), F.struct((row(0) / w).alias("x"), (row(1) / w).alias("y")))


def rounded(value: Column, digits: int = 6) -> Column:
    """`F.round` of doubles, the same to the last bit, without a decimal for each.

    Where a tie is not near, the nearest whole number of units is known from the
    product and its quotient is the double nearest to that decimal; the others
    (ties, large values, NaN) go through `F.round`.
    """
    unit = float(10**digits)
    scaled = value * F.lit(unit)
    tie = F.abs(scaled - F.floor(scaled) - 0.5)
    return F.when((F.abs(scaled) < 1e8) & (tie > 1e-5), F.floor(scaled + 0.5) / F.lit(unit)).otherwise(F.round(value, digits))


def half_even(value: Column, digits: int = 6) -> Column:
    """P20: rounded to `digits` places, a tie to the even neighbour."""
    return F.bround(value, digits)
