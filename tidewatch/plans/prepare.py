"""Traffic files -> stored, standardised windows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.labels import with_clean_stage
from tidewatch.operators.canonical import canonical_events
from tidewatch.operators.features import features_array
from tidewatch.operators.profile import profile
from tidewatch.operators.scaling import Scaler, scale
from tidewatch.operators.series import series_index
from tidewatch.operators.windows import rowgroup_features, tumbling_features
from tidewatch.schema import COLUMNAR, ONLINE, ROWS_PER_GROUP, WINDOW_SECONDS, FeatureOptions
from tidewatch.sources.flows import read_flows, with_file_row
from tidewatch.sources.store import read_features, write_features


def model_input(windows: DataFrame, keys: Sequence[str] = (), scaler: Scaler | DataFrame | None = None,
                order: str | None = None) -> DataFrame:
    """Window table -> (keys, idx, features, stage): positions and packed, standardised features.

    Positions follow `order`, by default the windows' starts, which also hold across files; numbers of windows
    begin anew in every file. Missing labels (NULL, NaN, -1) become NULL.
    """
    order = order or ("win_start" if "win_start" in windows.columns else "win_idx")
    if scaler is not None:
        windows = scale(windows, scaler)
    indexed = windows if "idx" in windows.columns else series_index(windows, keys, order)
    return with_clean_stage(features_array(indexed).select(*keys, "idx", "features", "stage"))


def time_windows(records: DataFrame, width: float = WINDOW_SECONDS, keys: Sequence[str] = (), labels: str = "columns",
                 options: FeatureOptions = ONLINE) -> DataFrame:
    """Raw records -> tumbling window features."""
    return tumbling_features(canonical_events(records, keys=keys, labels=labels, options=options), width, keys,
                             options=options)


def row_groups(records: DataFrame, rows: int = ROWS_PER_GROUP) -> DataFrame:
    """Raw records read with `position` -> features of consecutive rows of each file, labels read as benign/attack."""
    events = canonical_events(records, keep=["_file", "_row"], labels="binary", options=COLUMNAR, timed=False)
    return rowgroup_features(events, "_row", "_file", rows, COLUMNAR)


def prepare(spark: SparkSession, path: str, output: str, *, by_rows: bool | None = None, width: float = WINDOW_SECONDS,
            keys: Sequence[str] = (), labels: str = "columns", scaler: Scaler | None = None) -> dict[str, Any]:
    """Read a file or folder, cut it into windows, store them standardised; returns the metadata.

    `by_rows` groups consecutive rows instead of using time; it is the default for Parquet files.
    """
    by_rows = path.lower().endswith((".parquet", ".pq")) if by_rows is None else by_rows
    if by_rows:
        records = read_flows(spark, path, project=True, position=True)
        if not path.lower().endswith((".parquet", ".pq")):
            records = with_file_row(records, "_row")
        windows = row_groups(records)
        meta = {"method": "fixed_source_order_row_groups", "timestamp_used": False, "rows_per_window": ROWS_PER_GROUP}
        return write_features(windows, output, semantics="binary_attack", windowing=meta, scaler=scaler, source=path)
    windows = time_windows(read_flows(spark, path, project=True, keep=keys), width, keys, labels)
    # Windows do not depend on the order of records, so nothing here checks that order.
    meta = {"method": "streamed_event_timestamps", "timestamp_used": True, "timestamp_order_verified": False,
            "window_seconds": width, "stride_seconds": width}
    return write_features(windows, output, semantics="source_stage", windowing=meta, scaler=scaler, source=path)


def dataset_report(spark: SparkSession, output: str) -> DataFrame:
    """Profile of a prepared table."""
    return profile(read_features(spark, output, raw=True))
