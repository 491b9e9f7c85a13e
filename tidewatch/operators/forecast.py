"""K-step forecasts for every origin of every series at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.labels import risk_target, stage_name, stage_target
from tidewatch.operators.heads import (
    ForecastModel, LinearScore, StageScore, Transition, fit_scores, list_values, no_stages,
)
from tidewatch.operators.scan import drop_halo, with_halo
from tidewatch.operators.series import latest_context, sequences
from tidewatch.schema import STAGES
from tidewatch.session import staged

NO_STAGE = "Unavailable (stage labels unverified)"
SCORED = "current_risk double, current_stage int, risk array<double>, stage array<int>, " \
         "probabilities array<array<double>>, states array<array<double>>"


def step_forward(recent: np.ndarray, transition: Transition, steps: int) -> np.ndarray:
    """(rows, lags, size) -> (rows, steps, size): predict, append, drop the oldest, repeat."""
    weights = np.asarray(transition.weights)
    rows = recent.shape[0]
    out = np.empty((rows, steps, transition.size))
    for k in range(steps):
        out[:, k] = weights[0] + recent.reshape(rows, -1) @ weights[1:]
        recent = np.concatenate([recent[:, 1:], out[:, k:k + 1]], axis=1)
    return out


def _recent(history: Column, lags: int) -> Column:
    return F.flatten(F.slice(history, -lags, lags))


def _lists(values: np.ndarray) -> pa.Array:
    """(rows, n) or (rows, n, m) numbers as list cells."""
    out = pa.array(values.reshape(-1))
    for axis in range(values.ndim - 1, 0, -1):
        length = values.shape[axis]
        out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, length, dtype=np.int32)), out)
    return out


def rollout(histories: DataFrame, transition: Transition, steps: int, history: str = "history") -> DataFrame:
    """Add `states`, the predicted next `steps` windows of every history."""
    if steps < 1:
        raise ValueError("steps must be at least 1")
    lags, size = transition.lags, transition.size

    @F.arrow_udf("array<array<double>>")
    def predict_states(recent: pa.Array) -> pa.Array:
        seen = list_values(recent, lags * size).reshape(-1, lags, size)
        return _lists(step_forward(seen, transition, steps))

    return histories.withColumn("states", predict_states(_recent(F.col(history), lags)))


def prefix_max(df: DataFrame, value: str, by: Sequence[str], step: str = "step", name: str = "prefix_max") -> DataFrame:
    """Largest value over steps 1..k of each rollout."""
    so_far = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.max(value).over(so_far))


def supervised(windows: DataFrame, length: int, horizon: int, keys: Sequence[str] = (), idx: str = "idx",
               value: str = "features", stage: str = "stage") -> DataFrame:
    """History and the labels of the next `horizon` windows of every origin that has both, in one pass."""
    rows, order = with_halo(windows.select(*keys, idx, value, stage), keys, idx, before=length - 1, after=horizon)
    rows = rows.withColumns({
        "history": F.collect_list(value).over(order.rowsBetween(-(length - 1), 0)),
        "labels": F.array(*[F.lead(stage, k).over(order) for k in range(1, horizon + 1)]),
        "_last": F.lead(idx, horizon).over(order),
    })
    rows = drop_halo(rows).where((F.size("history") == length) & F.col("_last").isNotNull())
    return rows.select(*keys, F.col(idx).alias("origin_idx"), "history", "labels")


def head_inputs(pairs: DataFrame, transition: Transition, horizon: int, keys: Sequence[str] = (),
                semantics: str = "stage_id") -> DataFrame:
    """One row per origin and step: elementwise maximum of the first k predicted windows, label at step k."""
    size = transition.size

    @F.arrow_udf("array<array<double>>")
    def so_far(states: pa.Array) -> pa.Array:
        return _lists(np.maximum.accumulate(list_values(states.flatten(), size).reshape(-1, horizon, size), axis=1))

    # Both functions share one trip of the Arrow batches through Python.
    rolled = rollout(pairs, transition, horizon).withColumn("_pooled", so_far("states"))
    pooled = F.array(*[F.struct(F.lit(k).alias("step"), F.col("_pooled")[k - 1].alias("x"), F.col("labels")[k - 1].alias("label"))
                       for k in range(1, horizon + 1)])
    rows = rolled.select(*keys, "origin_idx", F.inline(pooled))
    return rows.withColumns({"y": risk_target(F.col("label"), semantics),
                             "y_stage": stage_target(F.col("label"), semantics)})


def fit_heads(windows: DataFrame, transition: Transition, length: int, horizon: int, keys: Sequence[str] = (),
              semantics: str = "stage_id", max_iter: int = 100) -> tuple[tuple[LinearScore, ...], tuple[StageScore, ...]]:
    """Scores of every step, each trained with the labels of its own step, all in the same passes."""
    pairs = supervised(windows, length, horizon, keys)
    # Labels of unknown meaning still tell attack from benign; only known stage ids train stages.
    known = "binary_attack" if semantics == "unknown" else semantics
    inputs = staged(head_inputs(pairs, transition, horizon, keys, known))
    risk, stages = fit_scores(inputs, "x", "y", "y_stage" if known == "stage_id" else None, range(1, horizon + 1), max_iter=max_iter)
    return risk, stages or (no_stages(transition.size),) * horizon


def _sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))


def _softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def score(histories: DataFrame, model: ForecastModel, horizon: int | None = None, history: str = "history") -> DataFrame:
    """Add `scored`: risk, stage, stage probabilities and state of every step, and of the last observed window.

    Rollout and scoring share one trip of the Arrow batches through Python.
    """
    steps = horizon or model.horizon
    if not 1 <= steps <= model.horizon:
        raise ValueError(f"horizon must be between 1 and {model.horizon}")
    transition = model.transition

    lags, size = transition.lags, transition.size

    @F.arrow_udf(SCORED)
    def run(recent: pa.Array) -> pa.Array:
        seen = list_values(recent, lags * size).reshape(-1, lags, size)
        states = step_forward(seen, transition, steps)
        pooled = np.maximum.accumulate(states, axis=1)
        risk = np.empty((len(seen), steps))
        shares = np.empty((len(seen), steps, len(STAGES)))
        for k in range(steps):
            risk[:, k] = _sigmoid(pooled[:, k] @ np.asarray(model.risk[k].coef) + model.risk[k].intercept)
            shares[:, k] = _softmax(pooled[:, k] @ np.asarray(model.stage[k].coef).T
                                    + np.asarray(model.stage[k].intercept))
        now = seen[:, -1]
        now_risk = _sigmoid(now @ np.asarray(model.risk[0].coef) + model.risk[0].intercept)
        now_stage = now @ np.asarray(model.stage[0].coef).T + np.asarray(model.stage[0].intercept)
        return pa.StructArray.from_arrays([
            pa.array(now_risk), pa.array(now_stage.argmax(axis=1).astype(np.int32)), _lists(risk),
            _lists(shares.argmax(axis=2).astype(np.int32)), _lists(shares), _lists(states),
        ], names=["current_risk", "current_stage", "risk", "stage", "probabilities", "states"])

    return histories.withColumn("scored", run(_recent(F.col(history), lags)))


def slope(values: Column, count: int) -> Column:
    """Least-squares slope over positions 0..count-1; 0 for a single value."""
    if count == 1:
        return F.lit(0.0)
    centre = (count - 1) / 2
    spread = sum((i - centre) ** 2 for i in range(count))
    terms = [values[i] * F.lit((i - centre) / spread) for i in range(count)]
    return sum(terms[1:], terms[0])


def trend_name(slope_value: Column, tolerance: float = 1e-6) -> Column:
    return F.when(slope_value > tolerance, "increasing").when(slope_value < -tolerance, "decreasing") \
        .otherwise("stable")


def trend(steps: DataFrame, by: Sequence[str], risk: str = "risk", step: str = "step",
          tolerance: float = 1e-6) -> DataFrame:
    """Slope and trend of each trajectory given as rows."""
    value = F.coalesce(F.regr_slope(F.col(risk), F.col(step).cast("double")), F.lit(0.0))
    return steps.groupBy(*by).agg(value.alias("slope")).withColumn("trend", trend_name(F.col("slope"), tolerance))


def forecast(histories: DataFrame, model: ForecastModel, horizon: int | None = None, keys: Sequence[str] = (),
             tolerance: float = 1e-6, history: str = "history") -> DataFrame:
    """Summary of each forecast: current state, trajectory, slope, trend and change to the last step."""
    steps = horizon or model.horizon
    supported = model.label_semantics == "stage_id"

    def name(stage: Column) -> Column:
        return stage_name(stage) if supported else F.lit(NO_STAGE)

    def known(value: Column) -> Column:
        return F.when(F.lit(supported), value)

    s = F.col("scored")
    step_rows = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda k: F.struct(
        k.alias("step"), s["risk"][k - 1].alias("risk"), known(s["stage"][k - 1]).alias("stage"),
        name(s["stage"][k - 1]).alias("stage_name"), known(s["probabilities"][k - 1]).alias("probabilities"),
        s["states"][k - 1].alias("state")))
    return score(histories, model, steps, history).select(
        *keys, "origin_idx", s["current_risk"].alias("current_risk"), known(s["current_stage"]).alias("current_stage"),
        name(s["current_stage"]).alias("current_stage_name"), F.lit(steps).alias("horizon"),
        slope(s["risk"], steps).alias("slope"), trend_name(slope(s["risk"], steps), tolerance).alias("trend"),
        (s["risk"][steps - 1] - s["current_risk"]).alias("change"), step_rows.alias("trajectory"))


def forecast_steps(forecasts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per origin and step."""
    return forecasts.select(*keys, "origin_idx", F.inline("trajectory")).withColumnRenamed("stage", "pred_stage")


def forecast_all(windows: DataFrame, model: ForecastModel, horizon: int | None = None,
                 keys: Sequence[str] = ()) -> DataFrame:
    """Forecast from every window that ends a full history, of which the model's lags are gathered."""
    recent = sequences(windows, model.transition.lags, keys).where(F.col("origin_idx") >= model.sequence_length - 1)
    return forecast(recent, model, horizon, keys)


def forecast_latest(windows: DataFrame, model: ForecastModel, horizon: int | None = None,
                    keys: Sequence[str] = (), idx: str = "idx") -> DataFrame:
    """Forecast from the end of each series; series shorter than a history have none."""
    recent = latest_context(windows.select(*keys, idx, "features"), model.sequence_length, keys, idx)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), "features"))),
                          lambda w: w["features"])
    histories = recent.groupBy(*keys).agg(F.max(idx).alias("origin_idx"), ordered.alias("history")) \
        .where(F.size("history") == model.sequence_length)
    return forecast(histories, model, horizon, keys)


def persistence(windows: DataFrame, horizon: int, keys: Sequence[str] = (), idx: str = "idx",
                carry: Sequence[str] = ("features",)) -> DataFrame:
    """The naive forecast: every step repeats the origin's values."""
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    rows = windows.select(*keys, F.col(idx).alias("origin_idx"), *carry)
    return rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))) \
        .withColumn("target_idx", F.col("origin_idx") + F.col("step"))


def forecast_with(histories: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
                  schema: T.StructType | str) -> DataFrame:
    """Run the user's own forecaster over batches of histories."""
    return histories.mapInPandas(function, schema)
