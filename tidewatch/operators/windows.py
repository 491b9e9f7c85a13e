"""Cutting events into time windows and row groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.numbers import int_div
from tidewatch.operators.features import (
    MERGED, SUMS, finish, merged_panes, moment_inputs, pane_aggregates, port_masks, window_features, with_port_rows,
)
from tidewatch.schema import ONLINE, ROWS_PER_GROUP, FeatureOptions
from tidewatch.session import join_small

Anchor = str | int


def to_micros(seconds: float, name: str = "width") -> int:
    value = round(seconds * 1_000_000)
    if value <= 0:
        raise ValueError(f"{name} must be positive")
    return value


def with_anchor(events: DataFrame, keys: Sequence[str], anchor: Anchor = "series") -> DataFrame:
    """Add `_anchor`, the start of the window grid, in microseconds.

    "series"   the first event of each series (the first event of all, without keys)
    "dataset"  the first event of all series together
    integer    a fixed instant
    """
    events = events.where(F.col("ts_us").isNotNull())
    if isinstance(anchor, int):
        return events.withColumn("_anchor", F.lit(anchor).cast("long"))
    first = F.min("ts_us").alias("_anchor")
    if anchor == "dataset" or not keys:
        return events.withColumn("_anchor", events.agg(first).scalar())
    if anchor != "series":
        raise ValueError("anchor must be 'series', 'dataset' or microseconds")
    return join_small(events, events.groupBy(*keys).agg(first), list(keys))


def assign_windows(events: DataFrame, width: float, keys: Sequence[str] = (), anchor: Anchor = "series") -> DataFrame:
    """Give every event its tumbling window: win_idx and win_start_us."""
    step = to_micros(width)
    return (
        with_anchor(events, keys, anchor)
        .withColumn("win_idx", int_div(F.col("ts_us") - F.col("_anchor"), step))
        .withColumn("win_start_us", F.col("_anchor") + F.col("win_idx") * F.lit(step))
        .drop("_anchor")
    )


def assign_sliding(events: DataFrame, width: float, stride: float, keys: Sequence[str] = (),
                   anchor: Anchor = "series") -> DataFrame:
    """One row per event and window holding it; events between windows (stride > width) have none."""
    size, step = to_micros(width), to_micros(stride, "stride")
    return _explode_windows(with_anchor(events, keys, anchor), size, step, "ts_us").drop("_anchor")


def _explode_windows(rows: DataFrame, size: int, step: int, at: str) -> DataFrame:
    offset = F.col(at) - F.col("_anchor")
    low = F.greatest(int_div(offset - size, step) + 1, F.lit(0).cast("long"))
    high = int_div(offset, step)
    return (
        rows.withColumns({"_low": low, "_high": high}).where("_low <= _high")
        .withColumn("win_idx", F.explode(F.sequence("_low", "_high")))
        .withColumn("win_start_us", F.col("_anchor") + F.col("win_idx") * F.lit(step))
        .drop("_low", "_high")
    )


def _with_bounds(table: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    rest = [c for c in table.columns if c not in (*keys, "win_idx", "win_start_us")]
    return table.select(
        *keys, "win_idx",
        F.timestamp_micros("win_start_us").alias("win_start"),
        F.timestamp_micros(F.col("win_start_us") + F.lit(size)).alias("win_end"),
        *rest,
    )


def tumbling_features(events: DataFrame, width: float, keys: Sequence[str] = (), anchor: Anchor = "series",
                      options: FeatureOptions = ONLINE) -> DataFrame:
    """Features of back-to-back windows; windows without events are absent."""
    by = [*keys, "win_idx", "win_start_us"]
    return _with_bounds(window_features(assign_windows(events, width, keys, anchor), by, options, bool(keys)), keys,
                        to_micros(width))


def sliding_features(events: DataFrame, width: float, stride: float, keys: Sequence[str] = (),
                     anchor: Anchor = "series", options: FeatureOptions = ONLINE) -> DataFrame:
    """Features of windows [start, start + width) every `stride`, from the first event on.

    Overlapping windows share panes as wide as the greatest common divisor of width and stride:
    events are reduced to panes first and only panes are copied into the windows holding them.
    """
    size, step = to_micros(width), to_micros(stride, "stride")
    by = [*keys, "win_idx", "win_start_us"]
    if step >= size:
        rows = assign_sliding(events, width, stride, keys, anchor)
        return _with_bounds(window_features(rows, by, options, bool(keys)), keys, size)
    pane = math.gcd(size, step)
    anchored = with_anchor(events, keys, anchor)
    anchored = anchored.withColumn("_pane", F.col("_anchor") + F.lit(pane) *
                                   int_div(F.col("ts_us") - F.col("_anchor"), pane))
    cells = [*keys, "_anchor", "_pane"]
    panes = moment_inputs(anchored, options).groupBy(*cells).agg(*pane_aggregates())
    rows = _explode_windows(panes, size, step, "_pane") \
        .select(*by, *SUMS, "duration", *MERGED, "_n", "stage", "risk")
    masks = None
    if "ports" in events.columns:
        masks = _explode_windows(port_masks(anchored, cells), size, step, "_pane") \
            .groupBy(*by, "block").agg(F.bit_or("mask").alias("mask"))
    table = merged_panes(with_port_rows(rows, masks, by), by, ports=masks is not None)
    return _with_bounds(finish(table, by, options), keys, size)


def rowgroup_features(events: DataFrame, row: str, file: str | None = None, rows: int = ROWS_PER_GROUP,
                      options: FeatureOptions = ONLINE) -> DataFrame:
    """Features of every `rows` consecutive records of a file; a group never crosses a file.

    `row` is the record's position in its file (or in the whole table, without `file`).
    win_start and win_end count records over all files in path order.
    """
    if rows < 1:
        raise ValueError("rows must be positive")
    by = ([file] if file else []) + ["win_idx"]
    grouped = window_features(events.withColumn("win_idx", int_div(F.col(row), rows)), by, options)
    local = F.col("win_idx") * F.lit(rows)
    if not file:
        return grouped.withColumns({"win_start": local, "win_end": local + F.col("event_count")})
    # One row per file: small enough to be ordered in one place.
    files = grouped.groupBy(file).agg(F.sum("event_count").alias("_rows"))
    before = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select(F.col(file).alias("_of_file"),
                           F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    joined = grouped.join(offsets, F.col(file) == F.col("_of_file"))
    return (
        joined.withColumns({"win_start": F.col("_before") + local,
                            "win_end": F.col("_before") + local + F.col("event_count")})
        .drop("_of_file", "_before")
    )


def window_sample(members: DataFrame, size: int, by: Sequence[str], ts: str = "ts_us",
                  order: Sequence[str] = ()) -> DataFrame:
    """The last `size` events of every window, oldest first within the window's array.

    Each task keeps at most `size` events per window before anything is shuffled; large samples
    are cut down per slice of a window first.
    """
    if size < 0:
        raise ValueError("sample size cannot be negative")
    latest = [F.col(c).desc() for c in (ts, *order)]
    if size >= 1000:
        flat = [c for c, t in members.dtypes if not t.startswith(("array", "map", "struct"))]
        members = members.withColumn("_slice", F.pmod(F.xxhash64(*flat), F.lit(64)))
        part = Window.partitionBy(*by, "_slice").orderBy(*latest)
        members = members.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= size).drop("_slice")
    rest = [c for c in members.columns if c not in (*by, "_rank")]
    ranked = members.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*latest)))
    item = F.struct(F.col("_rank"), F.struct(*rest).alias("event"))
    return (
        ranked.where(F.col("_rank") <= size).groupBy(*by)
        .agg(F.sort_array(F.collect_list(item), asc=False).alias("_items"))
        .select(*by, F.transform("_items", lambda i: i["event"]).alias("sample"))
    )
