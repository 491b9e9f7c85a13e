"""Attack events as runs of positive labels, alerts before them, lead time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.metrics import checked_score
from tidewatch.operators.scan import drop_halo, running_by_index, with_halo


def label_runs(df: DataFrame, keys: Sequence[str] = (), idx: str = "idx", label: str = "y") -> DataFrame:
    """One row per contiguous run of positive labels: run number, onset, end.

    Only the first and last rows of runs take part after the neighbours were compared, so a long
    run is never gathered anywhere.
    """
    rows, order = with_halo(df.select(*keys, idx, label), keys, idx, before=1, after=1)
    positive = F.coalesce(F.col(label) == 1, F.lit(False))
    before = F.coalesce(F.lag(label).over(order) == 1, F.lit(False))
    after = F.coalesce(F.lead(label).over(order) == 1, F.lit(False))
    marks = drop_halo(rows.withColumns({"_onset": positive & ~before, "_end": positive & ~after})) \
        .where("_onset or _end")
    numbered = running_by_index(marks, keys, idx, {"run": ("sum", F.col("_onset").cast("long"))})
    return numbered.groupBy(*keys, "run").agg(
        F.min(F.when(F.col("_onset"), F.col(idx))).alias("onset"),
        F.max(F.when(F.col("_end"), F.col(idx))).alias("end"))


def last_alert(df: DataFrame, threshold: float = 0.5, keys: Sequence[str] = (), idx: str = "idx", label: str = "y",
               score: str = "score") -> DataFrame:
    """For every onset the latest alert before it that follows the previous run; NULL when there is none."""
    rows = df.select(*keys, idx, label, checked_score(F.col(label), F.col(score)).alias(score))
    alert = F.when(F.col(score) >= F.lit(threshold), F.col(idx))
    positive = F.when(F.col(label) == 1, F.col(idx))
    seen = running_by_index(rows, keys, idx, {"_alert": ("max", alert), "_positive": ("max", positive)},
                            inclusive=False)
    # An onset is a positive row whose direct predecessor is not positive.
    onsets = seen.where((F.col(label) == 1) & (F.coalesce(F.col("_positive"), F.lit(-2)) < F.col(idx) - 1))
    valid = F.col("_alert") > F.coalesce(F.col("_positive"), F.lit(-1))
    return onsets.select(*keys, F.col(idx).alias("onset"), F.when(valid, F.col("_alert")).alias("alert_idx"))


def lead_times(df: DataFrame, threshold: float = 0.5, step_seconds: float = 1.0, issue_offset: int = 0,
               keys: Sequence[str] = (), idx: str = "idx", label: str = "y", score: str = "score") -> DataFrame:
    """Seconds between the alert and the onset it precedes, one row per event.

    Scores stand at the window they speak about; `issue_offset` is how many windows earlier they
    were issued.
    """
    if not 0 < step_seconds < float("inf"):
        raise ValueError("step_seconds must be finite and positive")
    if issue_offset < 0:
        raise ValueError("issue_offset cannot be negative")
    events = last_alert(df, threshold, keys, idx, label, score)
    windows = F.col("onset") - (F.col("alert_idx") - F.lit(issue_offset))
    return events.withColumn("lead_seconds", windows.cast("double") * F.lit(float(step_seconds)))


def lead_summary(leads: DataFrame, keys: Sequence[str] = (), with_list: bool = False) -> DataFrame:
    """Events, warned events, rate and mean lead; optionally the leads in onset order for a report."""
    events, warned = F.count("*"), F.count("lead_seconds")
    columns = [events.alias("events"), warned.alias("warned"),
               F.try_divide(warned.cast("double"), events).alias("warning_rate"),
               F.avg("lead_seconds").alias("mean_lead_seconds")]
    if with_list:
        ordered = F.array_sort(F.collect_list(F.struct("onset", "lead_seconds")))
        columns.append(F.transform(ordered, lambda x: x["lead_seconds"]).alias("lead_times"))
    return leads.groupBy(*keys).agg(*columns)
