"""Window features on an unbounded stream of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.features import window_features
from tidewatch.operators.windows import to_micros
from tidewatch.schema import ONLINE, FeatureOptions
from tidewatch.streaming.late import on_time


def _timed(events: DataFrame, delay: str, late: str | None) -> DataFrame:
    if late is not None:
        return on_time(events, delay, late)
    return events.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", delay)


def _features(events: DataFrame, width: float, stride: float, delay: str, keys: Sequence[str], anchor: int,
              options: FeatureOptions, late: str | None) -> DataFrame:
    size, step = to_micros(width), to_micros(stride, "stride")
    span = F.window("event_time", f"{size} microseconds", f"{step} microseconds",
                    f"{anchor % step} microseconds")
    rows = _timed(events, delay, late).withColumn("window", span)
    table = window_features(rows, [*keys, "window"], options)
    return table.select(*keys, F.col("window.start").alias("win_start"), F.col("window.end").alias("win_end"),
                        *[c for c in table.columns if c not in (*keys, "window")])


def stream_tumbling(events: DataFrame, width: float, delay: str = "0 seconds", keys: Sequence[str] = (),
                    anchor: int = 0, options: FeatureOptions = ONLINE, late: str | None = None) -> DataFrame:
    """Features of back-to-back windows, each emitted once the watermark has passed its end.

    `events` are canonical events of a streaming source. A stream has no first event to anchor
    at, so the grid starts at `anchor` microseconds. State per open window is one row of sums and
    one BIGINT per 63 neighbouring ports. By default events later than `delay` still count while their
    window is open and are dropped then, judged by the watermark the previous trigger started with. With
    late="drop" every event older than the watermark is left out (`late_events` tells which), with
    late="error" it ends the stream.
    """
    return _features(events, width, width, delay, keys, anchor, options, late)


def stream_sliding(events: DataFrame, width: float, stride: float, delay: str = "0 seconds",
                   keys: Sequence[str] = (), anchor: int = 0, options: FeatureOptions = ONLINE,
                   late: str | None = None) -> DataFrame:
    """Features of overlapping windows on a stream; `late` as in `stream_tumbling`."""
    return _features(events, width, stride, delay, keys, anchor, options, late)
