"""Why a window was scored as it was, and which records stand behind it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.heads import LinearScore, list_values
from tidewatch.schema import FEATURE_NOTES, FEATURES
from tidewatch.session import join_small


def _named(values: Column, names: Sequence[str]) -> Column:
    return F.zip_with(F.array(*map(F.lit, names)), values,
                      lambda n, c: F.struct(n.alias("name"), c.alias("contribution")))


def by_size(contributions: Column) -> Column:
    """Contributions, largest absolute value first; equal ones by name."""
    keyed = F.transform(contributions, lambda c: F.struct(
        (-F.abs(c["contribution"])).alias("k"), c["name"].alias("name"), c["contribution"].alias("contribution")))
    return F.transform(F.array_sort(keyed), lambda c: F.struct(c["name"].alias("name"),
                                                               c["contribution"].alias("contribution")))


def attribute(df: DataFrame, model: LinearScore, mean: Sequence[float], features: str = "features",
              names: Sequence[str] = FEATURES) -> DataFrame:
    """Add `contributions`: coefficient times distance from the training mean, largest first."""
    weights = F.array(*[F.lit(float(w)) for w in model.coef])
    centre = F.array(*[F.lit(float(m)) for m in mean])
    moved = F.zip_with(F.col(features), centre, lambda x, m: x - m)
    return df.withColumn("contributions", by_size(_named(F.zip_with(moved, weights, lambda x, w: x * w), names)))


def attribute_with(df: DataFrame, predictor: Callable[[np.ndarray], np.ndarray], background: Sequence[float],
                   features: str = "features", names: Sequence[str] = FEATURES) -> DataFrame:
    """Add `contributions` for any predictor: how the score falls when one feature takes its background value."""
    base = np.asarray(background, dtype=float)

    @F.arrow_udf("array<double>")
    def occlude(x: pa.Array) -> pa.Array:
        values = list_values(x, len(base))
        full = np.asarray(predictor(values), dtype=float)
        parts = np.empty_like(values)
        for i in range(len(base)):
            without = values.copy()
            without[:, i] = base[i]
            parts[:, i] = full - np.asarray(predictor(without), dtype=float)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, parts.size + 1, len(base), dtype=np.int32)),
                                        pa.array(parts.reshape(-1)))

    return df.withColumn("contributions", by_size(_named(occlude(features), names)))


def top_features(df: DataFrame, count: int, contributions: str = "contributions") -> DataFrame:
    """Keep the `count` largest contributions of every row, with their rank from 1."""
    top = F.slice(contributions, 1, count)
    rows = df.withColumn("_top", F.transform(top, lambda c, i: F.struct(
        (i + 1).alias("rank"), c["name"].alias("feature"), c["contribution"].alias("contribution"))))
    return rows.select(*[c for c in df.columns if c != contributions], F.inline("_top"))


def percent(value: Column, pattern: str) -> Column:
    return F.format_string(pattern, value * 100)


def alert_text(df: DataFrame, risk: str = "risk", contributions: str = "contributions") -> DataFrame:
    """One sentence per row: the risk and the two largest contributions with their signs."""
    parts = F.transform(F.slice(by_size(F.col(contributions)), 1, 2), lambda c: F.concat(
        c["name"], F.lit(" ("), percent(c["contribution"], "%+.1f%%"), F.lit(")")))
    drivers = F.when(F.size(parts) > 0, F.concat(F.lit(" driven by "), F.array_join(parts, " and "), F.lit(".")))
    head = F.concat(F.lit("Infiltration risk "), percent(F.col(risk), "%.0f%%"))
    return df.withColumn("alert", F.concat(head, F.coalesce(drivers, F.lit("."))))


def describe_latest(windows: DataFrame, keys: Sequence[str] = (), idx: str = "idx") -> DataFrame:
    """Every feature of each series' latest window with its meaning."""
    recent = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.col(idx).desc())
    last = windows.withColumn("_r", F.row_number().over(recent)).where("_r = 1")
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f).alias("feature"), F.col(f).alias("latest_value"),
                              F.lit(FEATURE_NOTES[f]).alias("meaning")) for i, f in enumerate(FEATURES)])
    return last.select(*keys, F.inline(rows))


def flagged_records(scores: DataFrame, members: DataFrame, threshold: float, length: int, keys: Sequence[str] = (),
                    position: str = "position", score: str = "score", window: str = "idx") -> DataFrame:
    """Records of the windows behind every flagged score.

    Score n belongs to the history ending at window n + length - 1, or to the series' last window
    if that lies beyond it. `members` are records carrying their window's position.
    """
    last = members.groupBy(*keys).agg(F.max(window).alias("_last"))
    flagged = scores.where(F.col(score) >= F.lit(threshold)).select(*keys, F.col(position).alias("flag_position"))
    placed = join_small(flagged, last, list(keys)) if keys else flagged.withColumn("_last", last.scalar())
    target = F.least(F.col("flag_position") + (length - 1), F.col("_last"))
    wanted = placed.withColumn(window, target).drop("_last")
    return join_small(members, wanted, [*keys, window])
