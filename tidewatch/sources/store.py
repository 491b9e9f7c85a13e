"""The compact feature table: standardised windows plus one metadata record."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.scaling import Scaler, collect_scaler, fit_scaler, scale
from tidewatch.schema import FEATURES


def write_features(windows: DataFrame, path: str, *, semantics: str = "source_stage",
                   windowing: dict[str, Any] | None = None, scaler: Scaler | None = None, pooled: bool = False,
                   partition_by: Sequence[str] = (), source: str | None = None) -> dict[str, Any]:
    """Standardise and write a window table; returns its metadata.

    Raw windows are written once; counting, fitting and scaling read that reduced table.
    """
    spark = windows.sparkSession
    raw = f"{path}/raw"
    windows.write.mode("overwrite").parquet(raw)
    windows = spark.read.parquet(raw)
    count = windows.count()
    if not count:
        raise ValueError("input contains no usable traffic windows")
    scaler = scaler or collect_scaler(fit_scaler(windows, pooled=pooled))
    writer = scale(windows, scaler).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/features")
    meta = {
        "source": source,
        "window_count": count,
        "feature_count": len(FEATURES),
        "feature_names": list(FEATURES),
        "features_normalized": True,
        "normalizer": {"mean": list(scaler.mean), "scale": list(scaler.scale)},
        "label_semantics": semantics,
        "windowing": windowing or {"method": "streamed_event_timestamps", "timestamp_used": True,
                                   "timestamp_order_verified": False},
    }
    record = json.dumps(meta, allow_nan=False, sort_keys=True)
    spark.range(1).select(F.lit(record).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return meta


def read_metadata(spark: SparkSession, path: str) -> dict[str, Any]:
    meta = json.loads(spark.read.option("wholetext", True).text(f"{path}/metadata").first()[0])
    if meta["feature_count"] != len(FEATURES):
        raise ValueError(f"table has {meta['feature_count']} features, expected {len(FEATURES)}")
    meta.setdefault("windowing", {"method": "legacy_unknown"})
    return meta


def stored_scaler(meta: dict[str, Any]) -> Scaler:
    return Scaler(tuple(meta["normalizer"]["mean"]), tuple(meta["normalizer"]["scale"]))


def read_features(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """The standardised windows (or the raw ones), after a check of the feature columns."""
    read_metadata(spark, path)
    table = spark.read.parquet(f"{path}/raw" if raw else f"{path}/features")
    missing = [f for f in FEATURES if f not in table.columns]
    if missing:
        raise ValueError(f"feature table lacks {', '.join(missing)}")
    return table
