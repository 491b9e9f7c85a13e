"""Replaying forecasts at past origins and comparing them with what came."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.labels import with_clean_stage
from tidewatch.operators.forecast import forecast, forecast_steps
from tidewatch.operators.heads import ForecastModel
from tidewatch.operators.metrics import replay_metrics
from tidewatch.operators.profile import label_semantics
from tidewatch.operators.series import at_origins, attach_labels, histories_at, require_history, sample_origins, sequences
from tidewatch.schema import ForecastOptions
from tidewatch.session import staged
from tidewatch.sources.reports import write_report

SCHEMA = "tidewatch.forecast-replay.v1"


@dataclass(frozen=True)
class Replay:
    """Settings (one row), one row per origin, one row per origin and step, one row per step."""

    settings: DataFrame
    predictions: DataFrame
    aligned: DataFrame
    metrics: DataFrame

    def report(self) -> DataFrame:
        """Settings and metrics as one nested row; there is one metric row per step."""
        ordered = F.array_sort(F.collect_list(F.struct("step", *[c for c in self.metrics.columns if c != "step"])))
        per_step = self.metrics.agg(ordered.alias("forecast_vs_actual"))
        return self.settings.select(F.struct("*").alias("replay"), F.lit(SCHEMA).alias("schema"),
                                    per_step.scalar().alias("forecast_vs_actual"))

    def write(self, path: str) -> None:
        """Report and predictions as JSON; predictions one line per origin, however many there are."""
        write_report(self.report(), f"{path}/report")
        write_report(self.predictions, f"{path}/predictions")


def replay(windows: DataFrame, model: ForecastModel, options: ForecastOptions, keys: Sequence[str] = (),
           semantics: str | None = None, forecaster: Callable[[DataFrame], DataFrame] | None = None) -> Replay:
    """Forecast at evenly spaced origins of (keys, idx, features, stage) and measure every step.

    `forecaster` maps histories to forecast summaries; the model's own forecast is the default.
    """
    if semantics is None:
        semantics = label_semantics(windows, None, model.label_semantics).first()["semantics"]
    table = require_history(staged(with_clean_stage(windows)), options.sequence_length, options.horizon, keys)
    origins = sample_origins(table, options.max_origins, options.sequence_length, options.horizon, keys)
    # The model looks at its lags only; a caller's own forecaster gets whole histories.
    length = options.sequence_length if forecaster else model.transition.lags
    if options.max_origins is None:
        histories = at_origins(sequences(table, length, keys), origins, keys)
    else:
        histories = histories_at(table, origins, length, keys)
    make = forecaster or (lambda rows: forecast(rows, model, options.horizon, keys, options.trend_tolerance))
    predictions = staged(make(histories))
    aligned = attach_labels(forecast_steps(predictions, keys), table, keys, semantics=semantics)
    metrics = replay_metrics(aligned, options.threshold)
    settings = predictions.agg(F.count("*").alias("origins_evaluated")).select(
        F.lit(options.sequence_length).alias("sequence_length"), F.lit(options.horizon).alias("horizon"),
        F.lit(float(options.threshold)).alias("threshold"), F.lit(float(options.step_seconds)).alias("step_seconds"),
        F.lit("all" if options.max_origins is None else "evenly_spaced").alias("origin_selection"),
        F.lit(options.max_origins).cast("int").alias("max_origins"), "origins_evaluated",
        F.lit(semantics).alias("label_semantics"))
    return Replay(settings, predictions, aligned, metrics)
