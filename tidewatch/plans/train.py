"""Fitting a forecaster on stored windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.forecast import fit_heads
from tidewatch.operators.heads import ForecastModel, fit_transition, model_from_json, model_to_json
from tidewatch.operators.profile import declared_semantics
from tidewatch.operators.scaling import Scaler, collect_scaler, fit_scaler
from tidewatch.operators.series import require_history
from tidewatch.plans.prepare import model_input
from tidewatch.schema import SUPERVISION_MARK, ForecastOptions
from tidewatch.session import staged


def train(windows: DataFrame, options: ForecastOptions = ForecastOptions(), keys: Sequence[str] = (),
          semantics: str = "stage_id", lags: int = 1, ridge: float = 1.0, scaler: Scaler | None = None,
          max_iter: int = 100) -> ForecastModel:
    """Raw window features and stages -> a model: standardise, fit the transition, fit each step's scores.

    The transition sees only adjacent windows; the scores of step k see the first k predicted
    windows and the label of step k.
    """
    scaler = scaler or collect_scaler(fit_scaler(windows))
    table = staged(model_input(windows, keys, scaler))
    table = require_history(table, options.sequence_length, options.horizon, keys)
    transition = fit_transition(table, lags, ridge, keys)
    meaning = declared_semantics(semantics) or "unknown"
    risk, stage = fit_heads(table, transition, options.sequence_length, options.horizon, keys,
                            meaning, max_iter)
    return ForecastModel(transition, risk, stage, options.sequence_length, scaler.mean, scaler.scale, meaning,
                         SUPERVISION_MARK, {"lags": lags, "ridge": ridge})


def save_model(spark: SparkSession, model: ForecastModel, path: str) -> None:
    spark.range(1).select(F.lit(model_to_json(model)).alias("value")).coalesce(1) \
        .write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> ForecastModel:
    return model_from_json(spark.read.option("wholetext", True).text(path).first()[0])


def model_scaler(model: ForecastModel) -> Scaler:
    return Scaler(model.mean, model.scale)
