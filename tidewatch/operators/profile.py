"""What a table of windows holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.schema import FEATURES, STAGES


def profile(windows: DataFrame) -> DataFrame:
    """One row: events, windows, time span, events per window stage, risk range."""
    by_stage = windows.groupBy("stage").agg(
        F.sum("event_count").alias("events"), F.count("*").alias("windows"),
        F.min("win_start").alias("first_time"), F.max("win_end").alias("last_time"),
        F.min("risk").alias("low"), F.max("risk").alias("high"))
    pairs = F.collect_list(F.struct(F.col("stage").cast("string"), "events"))
    empty = F.col("event_count") == 0
    return by_stage.agg(
        F.coalesce(F.sum("events"), F.lit(0)).alias("event_count"),
        F.coalesce(F.sum("windows"), F.lit(0)).alias("window_count"),
        F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"),
        F.map_from_entries(F.array_sort(pairs)).alias("stage_counts"),
        F.least(F.lit(1.0), F.min("low")).alias("risk_min"),
        F.greatest(F.lit(0.0), F.max("high")).alias("risk_max"),
    ).select(
        "event_count", "window_count", F.lit(len(FEATURES)).alias("feature_count"), "first_time", "last_time",
        "stage_counts", F.when(~empty, F.col("risk_min")).alias("risk_min"),
        F.when(~empty, F.col("risk_max")).alias("risk_max"), F.lit(0).alias("malformed_labels"),
    )


def declared_semantics(*declared: str | None) -> str | None:
    """The first declared meaning that is a known one."""
    for meaning in declared:
        if meaning in ("binary_attack", "stage_id"):
            return meaning
        if meaning in ("source_stage", "mitre_stage"):
            return "stage_id"
    return None


def label_semantics(windows: DataFrame, *declared: str | None, label: str = "stage") -> DataFrame:
    """One row with what the labels mean: as declared, else judged by the labels that occur."""
    known = declared_semantics(*declared)
    if known:
        return windows.sparkSession.range(1).select(F.lit(known).alias("semantics"))
    number = F.col(label).try_cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (number >= 0) & (number < float("inf"))
    value = F.when(usable, number)
    stats = windows.agg(F.count(value).alias("n"), F.bool_and(value.isin(0.0, 1.0)).alias("binary"),
                        F.bool_and(value.isin(*map(float, STAGES))).alias("stages"))
    return stats.select(
        F.when(F.col("n") == 0, "unknown").when(F.col("binary"), "binary_attack")
        .when(F.col("stages"), "stage_id").otherwise("unknown").alias("semantics"))


def assess(meta: DataFrame, windowing: str = "windowing", supervision: str = "supervision") -> DataFrame:
    """Judgements a report states about its data: is the time order verified, what may be concluded."""
    from tidewatch.schema import SUPERVISION_MARK

    used = F.coalesce(F.col(windowing)["timestamp_used"], F.lit(False))
    checked = F.coalesce(F.col(windowing)["timestamp_order_verified"], F.lit(False))
    verified = used & checked
    return meta.withColumns({
        "windowing_method": F.coalesce(F.col(windowing)["method"], F.lit("legacy_unknown")),
        "verified_temporal_order": verified,
        "interpretation": F.when(verified, "chronological_forecast_evaluation")
        .otherwise("row_order_label_replay_not_validated_as_temporal_forecasting"),
        "horizon_supervision_valid": F.coalesce(F.col(supervision) == SUPERVISION_MARK, F.lit(False)),
    })
