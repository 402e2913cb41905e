"""Streaming forms: windows with late rows, sessions, and online tracking as keyed state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.online import OUTPUT, PRESETS, Config, Tracker, as_rows, frames_in_order


def section_counts(events: DataFrame, time: str, by: list[str], size: str, late: str = "2 seconds", slide: str | None = None) -> DataFrame:
    """Rows of each window of event time; rows later than `late` are dropped and counted in the progress of the stream."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n_rows")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n_rows")


def track_sessions(events: DataFrame, time: str, by: list[str], gap: str, late: str = "2 seconds") -> DataFrame:
    """A session of each track ends when `gap` passes without a row."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), *by).agg(F.count("*").alias("n_rows")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *by, "n_rows")


def online_tracks(detections: DataFrame, sensor: str = "camera", config: str | Config = "appearance", idle_ms: int | None = None, **changes) -> DataFrame:
    """R2 as a stream: one tracker a sensor, kept as state; a micro-batch hands over whole frames in order.

    Frames at or before the last one of a sensor are late and dropped.  With `idle_ms`
    a sensor without rows for so long loses its state (such a query has work at
    any time, so it does not end by itself under an available-now trigger).
    """
    chosen = replace(PRESETS[config] if isinstance(config, str) else config, **changes)
    kind = detections.schema[sensor].dataType.simpleString()
    names = [sensor, *(c.split()[0] for c in OUTPUT.split(", "))]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if idle_ms is not None and state.hasTimedOut:
            state.remove()
            return
        tracker = pickle.loads(state.get[0]) if state.exists else Tracker(chosen)
        rows = pd.concat(list(batches), ignore_index=True)
        out = []
        for frame, found in frames_in_order(rows):
            if frame > tracker.frame or not tracker.seen:
                out += [(key[0], *r) for r in as_rows(frame, tracker.update(frame, found))]
        state.update((pickle.dumps(tracker),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=names)

    return detections.groupBy(sensor).applyInPandasWithState(run, f"{sensor} {kind}, {OUTPUT}", "tracker binary", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
