"""Online tracking as state of a stream, a row a track, with timers and counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.online import OUTPUT, PRESETS, Config, Track, Tracker, as_rows, frames_in_order

_TRACK = "mean array<double>, cov array<double>, score double, first long, last long, state string, hits long, feature array<double>, looks array<array<double>>, class_ids array<long>, class_scores array<double>"
_CLOCK = "next_id long, frame long, seen long, rows long, late long, boxes long"
#: Columns of a row of counts; `kind` tells it (`counts`, or `closed` for a sensor's last) from a box.
COUNTS = "n_frames long, n_rows long, n_late long, n_tracks long, n_boxes long"
_BOX = [c.split()[0] for c in OUTPUT.split(", ")]
_COUNT = [c.split()[0] for c in COUNTS.split(", ")]


def packed(t: Track) -> tuple:
    """A track as a row of plain values."""
    return (t.mean.tolist(), t.cov.ravel().tolist(), float(t.score), int(t.first), int(t.last), t.state, int(t.hits), None if t.feature is None else t.feature.tolist(), [x.tolist() for x in t.looks], [int(k) for k in t.classes], [float(v) for v in t.classes.values()])


def unpacked(number: int, row) -> Track:
    mean, cov, score, first, last, state, hits, feature, looks, ids, scores = row
    return Track(int(number), np.array(mean, float), np.array(cov, float).reshape(8, 8), score, first, last, state, hits, None if feature is None else np.array(feature, float), [np.array(x, float) for x in looks or []], Counter(dict(zip(ids or [], scores or []))))


class SensorState(StatefulProcessor):
    """A sensor's tracks, each a row of a map, and its clock and counts.

    A micro-batch loads the tracks, takes its frames in order and writes back the
    tracks that changed.  Rows of a frame at or before the last one are late: they
    are counted and change nothing.  When event time passes the sensor's last row
    by `idle_ms`, a timer gives out its last counts and clears it.
    """

    def __init__(self, config: Config, time: str, idle_ms: int):
        self.config, self.time, self.idle_ms = config, time, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracks = handle.getMapState("tracks", "id long", _TRACK)
        self.clock = handle.getValueState("clock", _CLOCK)

    def _rows(self, key: tuple, kind: str, boxes: list[tuple], counts: tuple) -> pd.DataFrame:
        none = [None] * len(_COUNT)
        rows = [(key[0], "box", *b, *none) for b in boxes] + [(key[0], kind, *[None] * len(_BOX), *counts)]
        out = pd.DataFrame(rows, columns=["sensor", "kind", *_BOX, *_COUNT])
        return out.astype({c: "Int64" for c in ("frame", "track_id", *_COUNT)} | {"class_id": "Int32"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows), ignore_index=True)
        next_id, frame, seen, total, late, n_boxes = self.clock.get() if self.clock.exists() else (1, 0, 0, 0, 0, 0)
        tracker = Tracker(self.config)
        tracker.next_id, tracker.frame, tracker.seen = next_id, frame, seen
        before = {int(k[0]) for k in self.tracks.keys()} if self.tracks.exists() else set()
        tracker.tracks = [unpacked(k, self.tracks.getValue((k,))) for k in sorted(before)]
        fresh = own if not seen else own[own["frame"] > frame]
        boxes: list[tuple] = []
        for at, found in frames_in_order(fresh):
            boxes += as_rows(at, tracker.update(at, found))
        for t in tracker.tracks:
            self.tracks.updateValue((t.id,), packed(t))
        for k in before - {t.id for t in tracker.tracks}:
            self.tracks.removeKey((k,))
        total, late, n_boxes = total + len(fresh), late + len(own) - len(fresh), n_boxes + len(boxes)
        self.clock.update((tracker.next_id, tracker.frame, tracker.seen, total, late, n_boxes))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        end = int(pd.Timestamp(own[self.time].max()).value // 1_000_000) + self.idle_ms
        self.handle.registerTimer(max(end, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._rows(key, "counts", boxes, (tracker.seen, total, late, tracker.next_id - 1, n_boxes))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.clock.exists():
            next_id, _, seen, total, late, n_boxes = self.clock.get()
            self.clock.clear()
            self.tracks.clear()
            yield self._rows(key, "closed", [], (seen, total, late, next_id - 1, n_boxes))

    def close(self) -> None:
        pass


def tracked_stream(detections: DataFrame, time: str, sensor: str = "camera", config: str | Config = "appearance", late: str = "10 seconds", idle_ms: int = 60_000, **changes) -> DataFrame:
    """Boxes of tracks and running counts of each sensor, from a stream of detections.

    `detections` has the columns that `online.track` takes and `time`, a timestamp; a
    micro-batch hands over whole frames.  Result: `sensor`, `kind`, the columns of
    `online.track` in rows of kind `box`, and in one row of kind `counts` a sensor and
    micro-batch its frames, rows, late rows, tracks begun and boxes up to then; `closed`
    is a sensor's last row of counts, when no row came for `idle_ms` of event
    time.  Rows older than the watermark (`late` behind the latest) do not reach
    the state; the stream's progress counts them (`numRowsDroppedByWatermark`).
    """
    chosen = replace(PRESETS[config] if isinstance(config, str) else config, **changes)
    kind = detections.schema[sensor].dataType.simpleString()
    rows = detections.withColumnRenamed(sensor, "sensor").withWatermark(time, late)
    schema = f"sensor {kind}, kind string, {OUTPUT}, {COUNTS}"
    out = rows.groupBy("sensor").transformWithStateInPandas(SensorState(chosen, time, idle_ms), schema, "Append", "EventTime")
    return out.withColumnRenamed("sensor", sensor)
