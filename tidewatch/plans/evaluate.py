"""Held-out evaluation of a forecaster and of the static baseline."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.labels import with_clean_stage
from tidewatch.operators.forecast import score, supervised
from tidewatch.operators.heads import ForecastModel, fit_baseline, predict
from tidewatch.operators.metrics import binary_metrics, calibrate, compare, probability_metrics, stage_accuracy
from tidewatch.operators.series import at_origins, require_history, sample_origins
from tidewatch.session import staged


@dataclass(frozen=True)
class Evaluation:
    """Metrics of both models on the test windows; every table has one row, comparison one per metric."""

    forecaster: DataFrame
    calibrated: DataFrame
    baseline: DataFrame
    stages: DataFrame
    comparison: DataFrame
    threshold: float
    samples: int


def next_window_scores(windows: DataFrame, model: ForecastModel, keys: Sequence[str] = ()) -> DataFrame:
    """Score and label of the next window at every origin, with the origin's own features."""
    pairs = supervised(windows, model.sequence_length, 1, keys)
    scored = score(pairs, model, 1)
    return scored.select(*keys, "origin_idx", F.element_at("history", -1).alias("features"),
                         F.col("scored.risk")[0].alias("score"), F.col("scored.stage")[0].alias("pred_stage"),
                         F.col("labels")[0].alias("actual_stage"), (F.col("labels")[0] > 0).cast("int").alias("y"))


def evaluate(train: DataFrame, test: DataFrame, model: ForecastModel, threshold: float = 0.5,
             keys: Sequence[str] = (), semantics: str = "stage_id",
             calibration_origins: int | None = None) -> Evaluation:
    """Baseline and threshold come from `train`, all metrics from `test`.

    Both are (keys, idx, features, stage) in the model's units. The threshold is calibrated on all origins of
    `train`, or on `calibration_origins` evenly spaced ones per series. Windows with a missing label (NULL, NaN,
    -1) train nothing and count nowhere.
    """
    train, test = with_clean_stage(train), with_clean_stage(test)
    test = require_history(test, model.sequence_length, 1, keys)
    scored = staged(next_window_scores(test, model, keys))
    labelled = train.where(F.col("stage").isNotNull()).withColumn("y", (F.col("stage") > 0).cast("int"))
    baseline = fit_baseline(labelled)
    base = binary_metrics(predict(scored.drop("score"), baseline))
    origins = sample_origins(train, calibration_origins, model.sequence_length, 1, keys)
    chosen = at_origins(next_window_scores(train, model, keys), origins, keys)
    best = calibrate(chosen).first()
    cut = best["threshold"] if best else 0.5
    at_default = probability_metrics(scored, threshold)
    if semantics != "stage_id":
        scored_stage = scored.withColumn("actual_stage", F.lit(None).cast("int"))
    else:
        scored_stage = scored
    return Evaluation(at_default, probability_metrics(scored, min(max(cut, 0.0), 1.0)), base,
                      stage_accuracy(scored_stage, []), compare(base, at_default), cut, scored.count())
