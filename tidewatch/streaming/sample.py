"""The last few events of every window of a stream."""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.windows import to_micros

STREAM_KEYS = ("series", "win_start_us")
SLICES = 16  # parts that a window's events of one trigger are spread over
BUCKETS = 256  # groups that the parts of all windows share; the work per group is a few calls, not a few per window

Windows = dict[tuple[str, int], list[tuple]]


def _rank(event: tuple) -> list[tuple]:
    """Nulls and NaN come after all values in descending order."""
    return [(True, v) if v is not None and v == v else (False, 0) for v in event]


def _latest(events: Iterable[tuple], size: int) -> Windows:
    """The last `size` of the (series, win_start_us, columns...) of every window, cut down while they come."""
    windows: Windows = defaultdict(list)
    for event in events:
        held = windows[event[:2]]
        held.append(event[2:])
        if len(held) >= 2 * size + 64:
            held.sort(key=_rank, reverse=True)
            del held[size:]
    for held in windows.values():
        if len(held) > size:
            held.sort(key=_rank, reverse=True)
            del held[size:]
    return windows


def _flat(windows: Windows) -> list[tuple]:
    return [(*window, *event) for window, held in windows.items() for event in held]


def _tuples(rows: Iterator[Row], names: Sequence[str]) -> Iterator[tuple]:
    at = None
    for row in rows:
        at = at or [row.__fields__.index(name) for name in names]
        yield tuple([row[i] for i in at])


class LatestEvents(StatefulProcessor):
    """Holds at most `size` events of each slice of the open windows of a bucket and hands them out when a window closes.

    What a trigger brings is appended to the state; it is read again when a window closes, or when more was appended than was
    held, so that the work of a trigger follows its events and not all that is open.
    """

    def __init__(self, size: int, width: int, columns: list[str]) -> None:
        self.size, self.width, self.names = size, width, [*STREAM_KEYS, "slice", *columns]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "part binary")
        self.book = handle.getValueState("book", "held long, added long, closes long")

    def _closes(self, start: int) -> int:
        return -(-(start + self.width) // 1_000)

    def _events(self) -> Iterator[tuple]:
        for (part,) in self.parts.get():
            yield from pickle.loads(part)

    def _by_slice(self, events: Iterable[tuple]) -> list[tuple]:
        """(series, (start, slice), columns...) cut down to `size` a slice."""
        return _flat(_latest(events, self.size))

    def _rewrite(self, events: list[tuple]) -> None:
        self.parts.put([(pickle.dumps(events),)])
        closes = min(self._closes(start) for _, (start, _), *_ in events)
        self.book.update((len(events), 0, closes))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        come = self._by_slice((series, (start, piece), *event) for series, start, piece, *event in _tuples(rows, self.names)
                              if self._closes(start) > mark)
        if not come:
            return iter(())
        closes = min(self._closes(start) for _, (start, _), *_ in come)
        held, added, timer = self.book.get() if self.book.exists() else (0, 0, None)
        if timer is None or closes < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(closes)
        else:
            closes = timer
        self.parts.appendValue((pickle.dumps(come),))
        self.book.update((held, added + len(come), closes))
        if held and added + len(come) > held:
            self._rewrite(self._by_slice(self._events()))
        elif not held:
            self.book.update((len(come), 0, closes))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark, still = timerValues.getCurrentWatermarkInMs(), []
        for event in self._by_slice(self._events()):
            series, (start, _), *rest = event
            if self._closes(start) > mark:
                still.append(event)
            else:
                yield Row(**dict(zip((*STREAM_KEYS, *self.names[3:]), (series, start, *rest))))
        if still:
            self._rewrite(still)
            self.handle.registerTimer(min(self._closes(start) for _, (start, _), *_ in still))
        else:
            self.parts.clear()
            self.book.clear()

    def close(self) -> None:
        pass


class LatestOfSlices(StatefulProcessor):
    """The last `size` of the events that windows' slices hand out; all of a window's do so in the trigger that closes it."""

    def __init__(self, size: int, columns: list[str]) -> None:
        self.size, self.names = size, [*STREAM_KEYS, *columns]

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for event in _flat(_latest(_tuples(rows, self.names), self.size)):
            yield Row(**dict(zip(self.names, event)))

    def close(self) -> None:
        pass


def stream_sample(events: DataFrame, width: float, size: int, delay: str = "0 seconds", keys: Sequence[str] = (),
                  keep: Sequence[str] = (), anchor: int = 0, slices: int = SLICES, buckets: int = BUCKETS) -> DataFrame:
    """Rows of the last `size` events of every window, emitted when the watermark passes its end.

    A window's events are spread over `slices` by a hash, each with `size` events at most; when the window closes, the slices'
    events meet, `size` times `slices` at most. The slices of all windows are dealt out to `buckets` groups: Python and the
    state are called per group and trigger, however many windows there are. A task holds one bucket's open events at a
    time. Ties in time are broken by `keep`.
    """
    if size < 1:
        raise ValueError("sample size must be positive")
    step = to_micros(width)
    series = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    columns = ["ts_us", *keep]
    start = F.col("ts_us") - F.pmod(F.col("ts_us") - F.lit(anchor), F.lit(step))
    rows = events.where("ts_us is not null").withColumn("event_time", F.timestamp_micros("ts_us")) \
        .withWatermark("event_time", delay).select(series.alias("series"), start.alias("win_start_us"),
                                                   F.pmod(F.xxhash64(*columns), F.lit(slices)).alias("slice"), "event_time", *columns)
    out = T.StructType([rows.schema[c] for c in (*STREAM_KEYS, *columns)])
    by_slice = rows.withColumn("bucket", F.pmod(F.xxhash64("series", "slice"), F.lit(buckets))).groupBy("bucket").transformWithState(
        LatestEvents(size, step, columns), out, outputMode="append", timeMode="EventTime")
    return by_slice.withColumn("bucket", F.pmod(F.xxhash64(*STREAM_KEYS), F.lit(buckets))).groupBy("bucket").transformWithState(
        LatestOfSlices(size, columns), out, outputMode="append", timeMode="None")
