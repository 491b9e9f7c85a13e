"""Telling late events of a stream from those on time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SLICES = 64


class Gate(StatefulProcessor):
    """Compares batches of events with the watermark and lets one kind through; it remembers nothing."""

    def __init__(self, columns: list[str], late: str) -> None:
        self.columns, self.late = columns, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        for packed in rows:
            for part in packed["events"]:
                events = pa.ipc.open_stream(part).read_all()
                late = pc.less(events["ts_us"], mark)
                if self.late == "error" and pc.any(late).as_py():
                    first = events["ts_us"].filter(late)[0].as_py()
                    raise ValueError(f"an event at {first} microseconds is older than the watermark, {mark}")
                through = events.filter(late if self.late == "only" else pc.invert(late))
                if through.num_rows:
                    moment = pa.timestamp("us", tz="UTC")
                    time = pa.nulls(through.num_rows, moment) if self.late == "only" else through["ts_us"].cast(moment)
                    yield _frame(through.append_column("event_time", time))

    def close(self) -> None:
        pass


def _frame(events: pa.Table) -> pd.DataFrame:
    """Columns under Arrow's own types, nested ones as Python values, so that numbers, nulls and lists stay what they are."""
    return pd.DataFrame({name: pd.Series(column.to_pylist(), dtype=object) if pa.types.is_nested(column.type)
                         else pd.Series(pd.arrays.ArrowExtensionArray(column)) for name, column in zip(events.column_names, events.columns)})


def _packer(slices: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, batch in enumerate(b for b in batches if b.num_rows):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.record_batch({"_slice": pa.array([(task + i) % slices], pa.int64()),
                                   "events": pa.array([out.getvalue().to_pybytes()], pa.binary())})
    return pack


def _gated(events: DataFrame, delay: str, late: str, slices: int) -> DataFrame:
    columns = events.columns
    timed = events.where("ts_us is not null").withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", delay)
    # Without the watermark's column Spark leaves late rows in. An Arrow batch of events is one row of a slice.
    sliced = timed.select(*columns).mapInArrow(_packer(slices), "_slice long, events binary")
    out = T.StructType([*(timed.schema[c] for c in columns), T.StructField("event_time", T.TimestampType())])
    return sliced.groupBy("_slice").transformWithStateInPandas(
        Gate(columns, late), out, outputMode="append", timeMode="EventTime",
        **({} if late == "only" else {"eventTimeColumnName": "event_time"}))


def on_time(events: DataFrame, delay: str, late: str, slices: int = SLICES) -> DataFrame:
    """The events no older than the watermark, with `event_time`; others are left out ("drop") or end the stream ("error").

    The watermark is `delay` behind the newest event of all earlier triggers, in whole milliseconds. All columns pass
    through Python as Arrow batches, so that numbers, nulls and lists keep their types. Rows without a time go.
    """
    if late not in ("drop", "error"):
        raise ValueError("late must be 'drop' or 'error'")
    return _gated(events, delay, late, slices)


def late_events(events: DataFrame, delay: str = "0 seconds", keep: Sequence[str] = (), slices: int = SLICES) -> DataFrame:
    """(ts_us, keep...) of the events that `on_time` leaves out, given the same triggers: a stream to count or store on its own."""
    columns = list(dict.fromkeys(["ts_us", *keep]))
    return _gated(events.select(*columns), delay, "only", slices).select(*columns)
