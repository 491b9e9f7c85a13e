"""Standardising features with statistics of a training table."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.schema import FEATURES

FLAT = 1e-8


@dataclass(frozen=True)
class Scaler:
    """Mean and scale of each feature."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]

    def __post_init__(self) -> None:
        if len(self.mean) != len(self.scale):
            raise ValueError("scaler has different numbers of means and scales")

    def column(self) -> Column:
        return F.struct(F.array(*map(F.lit, map(float, self.mean))).alias("mean"),
                        F.array(*map(F.lit, map(float, self.scale))).alias("scale"))


def scaler_to_json(scaler: Scaler) -> str:
    return json.dumps({"mean": list(scaler.mean), "scale": list(scaler.scale)}, allow_nan=False)


def scaler_from_json(text: str, size: int = len(FEATURES)) -> Scaler:
    state = json.loads(text)
    scaler = Scaler(tuple(map(float, state["mean"])), tuple(map(float, state["scale"])))
    if len(scaler.mean) != size:
        raise ValueError(f"scaler has {len(scaler.mean)} features, expected {size}")
    return scaler


def _guarded(scale: Column) -> Column:
    clean = F.coalesce(F.nanvl(scale, F.lit(0.0)), F.lit(0.0))
    return F.when(clean < FLAT, F.lit(1.0)).otherwise(clean)


def _clean(mean: Column) -> Column:
    return F.coalesce(F.nanvl(mean, F.lit(0.0)), F.lit(0.0))


def fit_scaler(windows: DataFrame, features: Sequence[str] = FEATURES, pooled: bool = False) -> DataFrame:
    """One row (mean ARRAY, scale ARRAY); `pooled` gives all features one mean and one scale."""
    if pooled:
        total = sum((F.col(f) for f in features[1:]), F.col(features[0]))
        squares = sum((F.col(f) * F.col(f) for f in features[1:]), F.col(features[0]) * F.col(features[0]))
        table = windows.agg(F.avg(total).alias("m"), F.avg(squares).alias("q"))
        scale = F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0)))
        return table.select(F.array_repeat(_clean(F.col("m")), len(features)).alias("mean"),
                            F.array_repeat(_guarded(scale), len(features)).alias("scale"))
    return windows.agg(F.array(*[_clean(F.avg(f)) for f in features]).alias("mean"),
                       F.array(*[_guarded(F.stddev_pop(f)) for f in features]).alias("scale"))


def collect_scaler(fitted: DataFrame) -> Scaler:
    row = fitted.first()
    return Scaler(tuple(row["mean"]), tuple(row["scale"]))


def _state(scaler: Scaler | DataFrame) -> Column:
    """A fitted one-row table enters the plan as a scalar subquery, a collected one as literals."""
    if isinstance(scaler, Scaler):
        return scaler.column()
    return scaler.select(F.struct("mean", "scale")).scalar()


def _with_state(windows: DataFrame, scaler: Scaler | DataFrame) -> tuple[DataFrame, Column]:
    # Held in a column so that the subquery is planned once, not once per feature.
    return windows.withColumn("_scaler", _state(scaler)), F.col("_scaler")


def scale(windows: DataFrame, scaler: Scaler | DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """(x - mean) / scale for every feature."""
    rows, state = _with_state(windows, scaler)
    return rows.withColumns({f: (F.col(f) - state["mean"][i]) / state["scale"][i]
                             for i, f in enumerate(features)}).drop("_scaler")


def unscale(windows: DataFrame, scaler: Scaler | DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Back to source units."""
    rows, state = _with_state(windows, scaler)
    return rows.withColumns({f: F.col(f) * state["scale"][i] + state["mean"][i]
                             for i, f in enumerate(features)}).drop("_scaler")


def rescale(windows: DataFrame, stored: Scaler | DataFrame, wanted: Scaler | DataFrame,
            features: Sequence[str] = FEATURES) -> DataFrame:
    """From one scaler's units to another's."""
    return scale(unscale(windows, stored, features), wanted, features)
