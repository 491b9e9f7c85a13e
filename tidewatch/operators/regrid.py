"""Gapped windows whose grid moves with the data.

Windows are `width` long and start every `stride` >= width. An event that falls between two
windows opens one at the end of the window before it, and the grid goes on from there. Where a
window starts thus depends on every earlier gap event, but only through the grid's phase: with
both lengths measured in their greatest common divisor there are stride / gcd phases. Events are
first reduced to cells of that size; each chunk of cells is then turned into a map "place of its first
event in the window -> place of its last one", kept as runs of neighbouring places that move together. The
maps are chained per series, and every chunk is resolved on its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numbers import int_div
from tidewatch.operators.features import (
    MERGED, SUMS, finish, merged_panes, moment_inputs, pane_aggregates, port_masks, with_port_rows,
)
from tidewatch.operators.windows import to_micros, with_anchor
from tidewatch.schema import ONLINE, FeatureOptions

CELLS = 65_536  # cells of a chunk at least
STRIDES = 4  # strides of a chunk at least, so that long strides don't make a chunk of every event


def next_phase(phase, cell, width: int, stride: int):
    """Phase after the event in `cell`; arrays of phases work as well."""
    late = (cell - phase) % stride
    return (phase + width * (late // width)) % stride


def window_start(phase: int, cell: int, width: int, stride: int) -> int:
    """First cell of the window the event in `cell` falls into."""
    return cell - ((cell - phase) % stride) % width


def _walk(width: int, stride: int):
    """Window starts of sorted cells; the phase starts at `entry` wherever a new (series, chunk) begins."""
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, phase = None, 0
        for batch in batches:
            starts = np.empty(len(batch), dtype=np.int64)
            rows = zip(batch["series"].tolist(), batch["chunk"].tolist(), batch["cell"].tolist(), batch["entry"].tolist())
            for i, (series, chunk, cell, entry) in enumerate(rows):
                if (series, chunk) != at:
                    at, phase = (series, chunk), entry
                starts[i] = window_start(phase, cell, width, stride)
                phase = next_phase(phase, cell, width, stride)
            yield pd.DataFrame({"series": batch["series"], "cell": batch["cell"], "start": starts})

    return walk


STARTS = "series string, cell long, start long"


def moved(starts: np.ndarray, values: np.ndarray, gap: int, width: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """A map of places in the window, carried on to an event `gap` cells later.

    A map is made of runs: places from starts[k] up to the next run go to values[k], values[k] + 1 and so on. An event at place x
    is followed by one at ((x + gap) % stride) % width, so a run breaks only at the window's end and at the stride's;
    there are never more runs than places.
    """
    shift = gap % stride
    if not shift:
        return starts, values
    at = values + shift
    window_end = (shift // width + 1) * width
    for end in {window_end, stride}:
        if shift < end < shift + width and end <= stride:
            cut = np.flatnonzero((at < end) & (end < at + np.diff(starts, append=width)))
            starts, at = np.insert(starts, cut + 1, starts[cut] + end - at[cut]), np.insert(at, cut + 1, end)
    values = (at % stride) % width
    new = np.append(True, np.diff(values) != np.diff(starts))
    return starts[new], values[new]


def grid_starts(cells: DataFrame, width: int, stride: int) -> DataFrame:
    """Window start (in cells) of every distinct (series, cell); both lengths in cells.

    Every step below streams through sorted partitions: no group is ever held as a whole, whatever the lengths.
    """
    chunked = cells.withColumn("chunk", int_div(F.col("cell"), max(CELLS, STRIDES * stride)))
    whole = np.zeros(1, np.int64)

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, first, last, runs = None, 0, 0, (whole, whole)
        names = ["series", "chunk", "first", "last", "starts", "values"]
        for batch in batches:
            done = []
            for series, chunk, cell in zip(batch["series"].tolist(), batch["chunk"].tolist(), batch["cell"].tolist()):
                if (series, chunk) != at:
                    if at is not None:
                        done.append((*at, first, last, *runs))
                    at, first, last, runs = (series, chunk), cell, cell, (whole, whole)
                runs, last = moved(*runs, cell - last, width, stride), cell
            yield pd.DataFrame(done, columns=names)
        if at is not None:
            yield pd.DataFrame([(*at, first, last, *runs)], columns=names)

    by_chunk = chunked.repartition("series", "chunk")
    tables = by_chunk.sortWithinPartitions("series", "chunk", "cell") \
        .mapInPandas(maps, "series string, chunk long, first long, last long, starts array<long>, values array<long>")

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, phase = None, 0
        for batch in batches:
            entries = []
            for series, first, last, starts, values in zip(*(batch[c] for c in ("series", "first", "last", "starts", "values"))):
                if series != at:
                    at, phase = series, 0
                entries.append(phase)
                place = (first - phase) % stride % width
                run = int(np.searchsorted(starts, place, "right")) - 1
                phase = int(last - values[run] - place + starts[run]) % stride
            yield pd.DataFrame({"series": batch["series"], "chunk": batch["chunk"], "entry": entries})

    entries = tables.repartition("series").sortWithinPartitions("series", "chunk") \
        .mapInPandas(chain, "series string, chunk long, entry long")
    return by_chunk.join(entries, ["series", "chunk"]).repartition("series", "chunk") \
        .sortWithinPartitions("series", "chunk", "cell").mapInPandas(_walk(width, stride), STARTS)


def regrid_features(events: DataFrame, width: float, stride: float, keys: Sequence[str] = (),
                    options: FeatureOptions = ONLINE) -> DataFrame:
    """24 features of gapped windows with a moving grid, anchored at each series' first event."""
    size, step = to_micros(width), to_micros(stride, "stride")
    if step < size:
        raise ValueError("gapped windows need stride >= width; use sliding_features for overlapping windows")
    unit = math.gcd(size, step)
    series = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    placed = with_anchor(events, keys).withColumns({
        "series": series, "cell": int_div(F.col("ts_us") - F.col("_anchor"), unit)})
    by = [*keys, "series", "_anchor", "cell"]
    panes = moment_inputs(placed, options).groupBy(*by).agg(*pane_aggregates())
    starts = grid_starts(panes.select("series", "cell"), size // unit, step // unit)
    group = [*keys, "_anchor", "start"]
    rows = panes.join(starts, ["series", "cell"]).select(*group, *SUMS, "duration", *MERGED, "_n", "stage", "risk")
    masks = None
    if "ports" in events.columns:
        masks = port_masks(placed, by).join(starts, ["series", "cell"]) \
            .groupBy(*group, "block").agg(F.bit_or("mask").alias("mask"))
    table = finish(merged_panes(with_port_rows(rows, masks, group), group, ports=masks is not None), group, options)
    start_us = F.col("_anchor") + F.col("start") * F.lit(unit)
    return table.select(
        *keys, int_div(F.col("start") * F.lit(unit), size).alias("win_idx"),
        F.timestamp_micros(start_us).alias("win_start"), F.timestamp_micros(start_us + F.lit(size)).alias("win_end"),
        *[c for c in table.columns if c not in group])
