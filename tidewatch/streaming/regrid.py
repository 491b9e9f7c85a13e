"""Gapped windows with a moving grid on a stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.regrid import next_phase, window_start
from tidewatch.operators.windows import to_micros

OUTPUT = "series string, ts_us long, win_start_us long"


class MovingGrid(StatefulProcessor):
    """Remembers, per series, the first event, the grid phase, the latest placed event, and events that still wait."""

    def __init__(self, width: int, stride: int, late: str) -> None:
        self.width, self.stride, self.late = width, stride, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.grid = handle.getValueState("grid", "anchor long, phase long, latest long")
        self.waiting = handle.getListState("waiting", "times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = np.concatenate([batch["ts_us"].to_numpy() for batch in rows])
        if self.grid.exists():
            latest = self.grid.get()[2]
            if self.late == "error" and (times < latest).any():
                raise ValueError(f"events of series {key[0]} are not sorted by time within the delay")
            times = times[times >= latest]
        if len(times):
            self.waiting.appendValue((times.tolist(),))
        yield from self._place(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._place(key, timerValues)

    def _place(self, key, timerValues) -> Iterator[pd.DataFrame]:
        """Advance the grid over the waiting events that the watermark has passed, in order of time."""
        mark = timerValues.getCurrentWatermarkInMs()
        found = [np.asarray(chunk[0], dtype=np.int64) for chunk in self.waiting.get()] if self.waiting.exists() else []
        if not found:
            return
        times = np.sort(np.concatenate(found))
        ready, rest = times[times // 1000 <= mark], times[times // 1000 > mark]
        if len(rest):
            self.handle.registerTimer(int(rest[0]) // 1000 - 1)  # fires at the first watermark from there on
        if not len(ready):
            return
        if len(rest):
            self.waiting.put([(rest.tolist(),)])
        else:
            self.waiting.clear()
        anchor, phase, latest = self.grid.get() if self.grid.exists() else (int(ready[0]), 0, int(ready[0]))
        starts = np.empty(len(ready), dtype=np.int64)
        for i, time in enumerate(ready.tolist()):
            starts[i] = anchor + window_start(phase, time - anchor, self.width, self.stride)
            phase = next_phase(phase, time - anchor, self.width, self.stride)
            latest = time
        self.grid.update((anchor, phase, latest))
        yield pd.DataFrame({"series": key[0], "ts_us": ready, "win_start_us": starts})

    def close(self) -> None:
        pass


def stream_regrid(events: DataFrame, width: float, stride: float, keys: Sequence[str] = (),
                  late: str = "error", delay: str = "0 seconds") -> DataFrame:
    """Window start of every event time of a stream, re-anchored at gap events.

    Events wait in the state until the watermark, `delay` behind the newest event of all series, has passed them (in
    whole milliseconds); only then the grid goes on, so files may overlap by `delay` however they fall into triggers. An
    event that comes later still counts where it isn't older than its series' latest placed one; else it is an error, or
    with `late="drop"` left out. Only series and time travel to the state: three numbers per series and the times that wait.
    A trigger's size (files_per_trigger of the source) and the delay bound what is ordered at once.
    """
    size, step = to_micros(width), to_micros(stride, "stride")
    if step < size:
        raise ValueError("gapped windows need stride >= width")
    if late not in ("drop", "error"):
        raise ValueError("late must be 'drop' or 'error'")
    series = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    timed = events.where("ts_us is not null").withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", delay)
    # Without the watermark's column late rows reach the state, where each series judges them by itself.
    times = timed.select(series.alias("series"), "ts_us")
    return times.groupBy("series").transformWithStateInPandas(
        MovingGrid(size, step, late), OUTPUT, outputMode="append", timeMode="EventTime")
