"""Operators over ordered rows of a track (W rows of the inventory), as window functions.

`track` names the columns that identify a track; frames are whole numbers.  All
shuffle once, on the track, and leave the order of rows open.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(track: Sequence[str], *order: str):
    return Window.partitionBy(*track).orderBy(*order)


def tumbling(frame: Column, size: int) -> Column:
    """Number of the section of `size` frames that a frame is in."""
    return F.floor(frame / size).cast("long")


def previous_section(df: DataFrame, track: Sequence[str], section: str, value: str) -> DataFrame:
    """`value` of the section right before, null where that section has no row."""
    w = _over(track, section)
    before = F.lag(F.struct(section, value)).over(w)
    return df.withColumn("previous", F.when(before[section] == F.col(section) - 1, before[value]))


def fill_gaps(df: DataFrame, track: Sequence[str], frame: str, linear: Sequence[str], carried: Sequence[str] = (), max_gap: int | None = None, min_length: int = 0, angle: Sequence[str] = ()) -> DataFrame:
    """A row for every frame that is missing inside a track.

    `linear` columns run straight from the row before the gap to the row after;
    `carried` ones keep the value of the row before.  Gaps of more than `max_gap` frames,
    and tracks of at most `min_length` rows, are left as they are.  `filled` tells
    new rows.  Angles are taken as plain numbers, as all others.
    """
    linear = [*linear, *angle]
    w = _over(track, frame)
    own = df.select(*track, frame, *linear, *carried)
    ahead = own.withColumn("_next", F.lead(F.struct(frame, *linear)).over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*track)))
    step = F.col("_next")[frame] - F.col(frame)
    fits = (step > 1) & (F.col("_n") > min_length)
    if max_gap is not None:
        fits = fits & (step <= max_gap)
    frames = F.when(fits, F.sequence(F.col(frame), F.col("_next")[frame] - 1)).otherwise(F.array(F.col(frame)))
    out = ahead.withColumn("_f", F.explode(frames))
    share = (F.col("_f") - F.col(frame)) / F.when(step > 0, step).otherwise(F.lit(1))
    values = [F.when(F.col("_f") == F.col(frame), F.col(c).cast("double")).otherwise(F.col(c) + (F.col("_next")[c] - F.col(c)) * share).alias(c) for c in linear]
    return out.select(*track, F.col("_f").alias(frame), *values, *carried, (F.col("_f") != F.col(frame)).alias("filled"))


def nearest_nonzero(df: DataFrame, track: Sequence[str], order: str, value: str) -> DataFrame:
    """Zeros replaced by the nearest value that is not zero, by row; the earlier one in a tie.  All-zero tracks stay."""
    w = _over(track, order)
    df = df.withColumn("_row", F.row_number().over(w))
    known = F.when(F.col(value) != 0, F.struct(F.col("_row").alias("r"), F.col(value).alias("v")))
    back = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # Backwards: a frame that begins at each row would be read again for every row.
    ahead = F.last(known, ignorenulls=True).over(Window.partitionBy(*track).orderBy(F.desc("_row")).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_back", back).withColumn("_ahead", ahead)
    row = F.col("_row")
    later = F.col("_back").isNull() | (F.col("_ahead")["r"] - row < row - F.col("_back")["r"])
    near = F.when(F.col("_ahead").isNotNull() & later, F.col("_ahead")["v"]).otherwise(F.col("_back")["v"])
    return df.withColumn(value, F.coalesce(near, F.col(value))).drop("_row", "_back", "_ahead")


def path_length(df: DataFrame, track: Sequence[str], order: str, coordinates: Sequence[str]) -> DataFrame:
    """Sum of the distances between consecutive points of each track (0 for one point)."""
    w = _over(track, order)
    squares = [F.pow(F.col(c) - F.lag(c).over(w), F.lit(2.0)) for c in coordinates]
    step = F.sqrt(sum(squares[1:], squares[0]))
    return df.withColumn("_step", step).groupBy(*track).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("path_length"), F.count("*").alias("n_points"))


def history(df: DataFrame, track: Sequence[str], order: str, value: str, size: int = 50) -> DataFrame:
    """The last `size` values up to each row, oldest first."""
    return df.withColumn("history", F.collect_list(value).over(_over(track, order).rowsBetween(1 - size, 0)))


def motion_yaw(df: DataFrame, track: Sequence[str], frame: str, x: str, y: str, gap: int = 6, size: int = 50, still: float = 0.05) -> DataFrame:
    """Heading of each row from the moves over `gap` rows among its last `size` rows.

    Moves of at most `still` are left out; the heading is the circular mean, 0.0
    without moves.
    """
    w = _over(track, frame)
    dx, dy = F.col(x) - F.lag(x, gap).over(w), F.col(y) - F.lag(y, gap).over(w)
    df = df.withColumn("_dx", dx).withColumn("_dy", dy)
    length = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    near = w.rowsBetween(gap + 1 - size, 0)
    moved = length > still
    s = F.sum(F.when(moved, F.col("_dy") / length)).over(near)
    c = F.sum(F.when(moved, F.col("_dx") / length)).over(near)
    return df.withColumn("yaw", F.coalesce(F.atan2(s, c), F.lit(0.0))).drop("_dx", "_dy")


def stride(df: DataFrame, track: Sequence[str], order: Sequence[str], step: int) -> DataFrame:
    """Every `step`-th row of each track, the first one included."""
    return df.withColumn("_row", F.row_number().over(_over(track, *order)) - 1).where(F.col("_row") % step == 0).drop("_row")


def spread(df: DataFrame, track: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """Rows at an even step of n div `most` (at least 1), so that about `most` remain."""
    df = df.withColumn("_row", F.row_number().over(_over(track, *order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*track)))
    return df.where(F.expr(f"_row % greatest(_n div {int(most)}, 1) = 0")).drop("_row", "_n")


def halves(df: DataFrame, track: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`half` is "train" for the first n div 2 + 1 rows of a track, "val" for the others."""
    df = df.withColumn("_row", F.row_number().over(_over(track, *order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*track)))
    return df.withColumn("half", F.when(F.expr("_row <= _n div 2"), "train").otherwise("val")).drop("_row", "_n")


def even_sample(df: DataFrame, track: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """`size` rows of each track at even places, repeated where it has fewer."""
    df = df.withColumn("_row", F.row_number().over(_over(track, *order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*track)))
    picks = F.expr(f"filter(sequence(0, {int(size) - 1}), i -> cast(floor(i * _n / {float(size)}) as int) = _row)")
    return df.withColumn("pick", F.explode(picks)).drop("_row", "_n")


def extent(df: DataFrame, track: Sequence[str], frame: str) -> DataFrame:
    """First and last frame and number of rows of each track."""
    return df.groupBy(*track).agg(F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.count("*").alias("n_frames"))


def sessions(df: DataFrame, track: Sequence[str], frame: str, buffer: int) -> DataFrame:
    """A track number that grows when more than `buffer` frames pass without a row."""
    w = _over(track, frame)
    fresh = F.when(F.col(frame) - F.lag(frame).over(w) > buffer, 1).otherwise(0)
    return df.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def envelope(df: DataFrame, group: Sequence[str], order: str, value: str) -> DataFrame:
    """The greatest value at or after each row, which makes a curve fall monotonically."""
    w = Window.partitionBy(*group).orderBy(F.desc_nulls_last(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("envelope", F.max(value).over(w))


def frontier(df: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Rows that no other row of the group beats in x and y: each has the greatest y among those of as great an x; equal rows count once."""
    ahead = Window.partitionBy(*group).orderBy(F.desc(x)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    beyond = Window.partitionBy(*group).orderBy(F.desc(x), F.desc(y)).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_top", F.max(y).over(ahead)).withColumn("_before", F.max(y).over(beyond))
    return rows.where((F.col(y) == F.col("_top")) & (F.col("_before").isNull() | (F.col(y) > F.col("_before")))).drop("_top", "_before")


def smoothed_features(df: DataFrame, track: Sequence[str], order: str, vector: str, alpha: float = 0.9) -> DataFrame:
    """`smooth`: the moving average of a track's vectors, each set to length 1 before, the average after each step; zero vectors stay zero.

    A track's rows come sorted and a batch at a time; only its average is held.
    """
    key = list(track)

    def unit(v: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(v)
        return v / n if n else v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in key)))
            out = []
            for own, v in zip(keys, batch.column(vector).to_pylist()):
                look = unit(np.asarray(v, float))
                held = look if held is None or own != last else unit(alpha * held + (1 - alpha) * look)
                last = own
                out.append(held)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*key, order]), pa.array(out, pa.list_(pa.float64()))], names=[*key, order, "smooth"])

    rows = df.where(F.col(vector).isNotNull()).select(*key, order, vector).repartition(*key).sortWithinPartitions(*key, order)
    kinds = dict(df.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in [*key, order]) + ", smooth array<double>")
