"""Series of windows: positions, histories, origins, targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.labels import risk_target, stage_target
from tidewatch.operators.scan import chunk_of, drop_halo, running_by_index, with_halo
from tidewatch.session import join_small


def series_index(windows: DataFrame, keys: Sequence[str] = (), order: str = "win_idx", name: str = "idx") -> DataFrame:
    """Position of every window among the non-empty windows of its series, from 0."""
    one = F.lit(1).cast("long")
    counted = running_by_index(windows, keys, order, {name: ("sum", one)}, inclusive=True)
    return counted.withColumn(name, F.col(name) - 1)


def row_time(df: DataFrame, row: str, name: str = "ts_us") -> DataFrame:
    """Use a row position as time: record n happens at second n."""
    return df.withColumn(name, F.col(row).cast("long") * F.lit(1_000_000).cast("long"))


def backward_steps(events: DataFrame, arrival: str, keys: Sequence[str] = (), ts: str = "ts_us") -> DataFrame:
    """How many events are older than the event that arrived before them in their series.

    `arrival` is unique. Neighbours are compared inside chunks of it, and the first event of a
    chunk with the last one of the series' chunk before.
    """
    chunk = events.select(*keys, F.col(arrival).alias("_a"), F.col(ts).alias("_t")).withColumn("_c", chunk_of("_a"))
    inside = Window.partitionBy(*keys, "_c").orderBy("_a")
    compared = chunk.withColumn("_back", (F.col("_t") < F.lag("_t").over(inside)).cast("long"))
    edges = compared.groupBy(*keys, "_c").agg(
        F.sum("_back").alias("_back"), F.min_by("_t", "_a").alias("_first"), F.max_by("_t", "_a").alias("_last"))
    across = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_c")
    crossing = (F.col("_first") < F.lag("_last").over(across)).cast("long")
    steps = edges.withColumn("_cross", crossing)
    total = F.coalesce(F.sum(F.coalesce("_back", F.lit(0)) + F.coalesce("_cross", F.lit(0))), F.lit(0))
    return steps.groupBy(*keys).agg(total.alias("backward_steps"))


def assert_sorted(events: DataFrame, arrival: str, keys: Sequence[str] = (), ts: str = "ts_us") -> None:
    """Fail when any event is older than its predecessor."""
    bad = backward_steps(events, arrival, keys, ts).agg(F.sum("backward_steps")).first()[0] or 0
    if bad:
        raise ValueError(f"events are not sorted by time: {bad} steps go backwards")


def sequences(windows: DataFrame, length: int, keys: Sequence[str] = (), idx: str = "idx",
              value: str = "features") -> DataFrame:
    """Every run of `length` consecutive windows, named by its last window (origin_idx)."""
    if length < 1:
        raise ValueError("sequence length must be at least 1")
    rows, order = with_halo(windows.select(*keys, idx, value), keys, idx, before=length - 1)
    past = order.rowsBetween(-(length - 1), 0)
    rows = rows.withColumn("history", F.collect_list(value).over(past))
    return drop_halo(rows).where(F.size("history") == length) \
        .select(*keys, F.col(idx).alias("origin_idx"), "history")


def align(windows: DataFrame, horizon: int, keys: Sequence[str] = (), idx: str = "idx", stage: str = "stage",
          semantics: str = "stage_id", first_origin: int = 0, complete: bool = True) -> DataFrame:
    """One row per origin and step 1..horizon with the label found that many windows later.

    With `complete`, only origins with all their targets inside the series are kept.
    """
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    rows, order = with_halo(windows.select(*keys, idx, stage), keys, idx, after=horizon)
    ahead = F.array(*[F.struct(F.lit(k).alias("step"), F.lead(idx, k).over(order).alias("target_idx"),
                               F.lead(stage, k).over(order).alias("label")) for k in range(1, horizon + 1)])
    rows = drop_halo(rows.withColumn("_ahead", ahead)).where(F.col(idx) >= first_origin)
    if complete:
        rows = rows.where(F.col("_ahead")[horizon - 1]["target_idx"].isNotNull())
    steps = rows.select(*keys, F.col(idx).alias("origin_idx"), F.inline("_ahead"))
    return with_targets(steps.where("target_idx is not null"), semantics)


def with_targets(df: DataFrame, semantics: str, label: str = "label") -> DataFrame:
    return df.withColumns({"actual_risk": risk_target(F.col(label), semantics),
                           "actual_stage": stage_target(F.col(label), semantics)})


def attach_labels(forecasts: DataFrame, windows: DataFrame, keys: Sequence[str] = (), idx: str = "idx",
                  stage: str = "stage", semantics: str = "stage_id") -> DataFrame:
    """Label of the window a forecast row speaks about; unlabelled targets stay NULL."""
    labels = windows.select(*[F.col(k).alias(f"_l_{k}") for k in keys], F.col(idx).alias("_l_idx"),
                            F.col(stage).alias("label"))
    on: Column = F.col("origin_idx") + F.col("step") == F.col("_l_idx")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_l_{k}"))
    joined = forecasts.join(labels, on, "left").drop(*[f"_l_{k}" for k in keys], "_l_idx")
    joined = joined.withColumn("target_idx", F.col("origin_idx") + F.col("step"))
    return with_targets(joined, semantics)


def require_history(windows: DataFrame, length: int, horizon: int = 0, keys: Sequence[str] = (),
                    idx: str = "idx") -> DataFrame:
    """Keep series with at least length + horizon windows; a single short series is an error."""
    needed = length + horizon
    if not keys:
        found = windows.limit(needed).count()
        if found < needed:
            raise ValueError(f"at least {needed} windows are required ({length} of history and {horizon} ahead); "
                             f"found {found}")
        return windows
    # A long enough series has a window at position needed - 1: no series needs to be counted.
    enough = windows.where(F.col(idx) == needed - 1).select(*keys)
    return join_small(windows, enough, list(keys), "left_semi")


def latest_context(windows: DataFrame, count: int, keys: Sequence[str] = (), idx: str = "idx") -> DataFrame:
    """The last `count` windows of every series, whose positions run from 0 without gaps; nothing is sorted."""
    last = windows.groupBy(*keys).agg(F.max(idx).alias("_last"))
    if not keys:
        return windows.where(F.col(idx) > last.scalar() - count)
    return join_small(windows, last, list(keys)).where(F.col(idx) > F.col("_last") - count).drop("_last")


def sample_origins(windows: DataFrame, most: int | None, length: int, horizon: int, keys: Sequence[str] = (),
                   idx: str = "idx") -> DataFrame:
    """Evenly spaced forecast origins of every series: at most `most`, all of them when None."""
    if most is not None and most < 1:
        raise ValueError("the number of origins must be positive or None")
    first = length - 1
    if most is None:
        rows, order = with_halo(windows.select(*keys, idx), keys, idx, after=horizon)
        kept = drop_halo(rows.withColumn("_target", F.lead(idx, horizon).over(order)))
        return kept.where((F.col(idx) >= first) & F.col("_target").isNotNull()) \
            .select(*keys, F.col(idx).alias("origin_idx"))
    size = windows.groupBy(*keys).agg((F.max(idx) + 1).alias("_n"))
    available = size.withColumn("_avail", F.col("_n") - F.lit(horizon) - F.lit(first)).where("_avail > 0")
    count = F.least(F.col("_avail"), F.lit(most).cast("long"))
    step = (F.col("_avail") - 1).cast("double") / F.greatest(count - 1, F.lit(1))
    picked = available.withColumns({"_count": count, "_step": step}) \
        .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_count") - 1)))
    place = F.when((F.col("_i") == F.col("_count") - 1) & (F.col("_count") > 1), F.col("_avail") - 1) \
        .otherwise(F.floor(F.col("_i").cast("double") * F.col("_step")))
    return picked.select(*keys, (place + first).alias("origin_idx"))


def histories_at(windows: DataFrame, origins: DataFrame, length: int, keys: Sequence[str] = (),
                 idx: str = "idx") -> DataFrame:
    """(keys, origin_idx, history) of the picked origins alone: only the windows they look back on are gathered."""
    back = origins.select(*[F.col(k).alias(f"_o_{k}") for k in keys], "origin_idx", F.explode(F.sequence(
        F.col("origin_idx") - (length - 1), F.col("origin_idx"))).alias("_o_idx"))
    on: Column = F.col(idx) == F.col("_o_idx")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    rows = windows.select(*keys, idx, "features").join(back, on)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), "features"))), lambda w: w["features"])
    return rows.groupBy(*keys, "origin_idx").agg(ordered.alias("history")).where(F.size("history") == length)


def at_origins(rows: DataFrame, origins: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Keep rows whose (series, origin_idx) was picked."""
    right = origins.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("origin_idx").alias("_o_idx"))
    on: Column = F.col("origin_idx") == F.col("_o_idx")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    return rows.join(right, on, "left_semi")
