"""Scores against labels: confusion counts, ranking quality, thresholds, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numbers import double_path
from tidewatch.operators.scan import running

# Thresholds always tried besides the scores themselves, in this order after them.
FIXED_THRESHOLDS = (0.0, 0.5, 0.7, 0.9, 1.0)


def _check_threshold(threshold: float) -> None:
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be in [0, 1]")


def score_problems(df: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """One row counting labels other than 0/1 (or missing) and scores outside [0, 1]."""
    s = F.col(score).cast("double")
    bad_score = s.isNull() | F.isnan(s) | (s < 0) | (s > 1)
    bad_label = F.col(label).isNotNull() & ~F.col(label).isin(0, 1)
    return df.agg(F.count_if(bad_label).alias("bad_labels"), F.count_if(bad_score).alias("bad_scores"),
                  F.count_if(F.col(label).isNull()).alias("missing_labels"), F.count("*").alias("rows"))


def validate_scores(df: DataFrame, label: str = "y", score: str = "score") -> None:
    """Fail on labels other than 0/1 and scores that are not finite numbers in [0, 1]."""
    row = score_problems(df, label, score).first()
    if row["bad_labels"]:
        raise ValueError(f"{row['bad_labels']} labels are not 0 or 1")
    if row["bad_scores"]:
        raise ValueError(f"{row['bad_scores']} scores are not finite values in [0, 1]")


def checked_score(label: Column, score: Column, unit: bool = True) -> Column:
    """The score; an error where a labelled row's label isn't 0 or 1 or its score no finite number (in [0, 1])."""
    s = score.cast("double")
    bad = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))
    if unit:
        bad = bad | (s < 0) | (s > 1)
    said = "labels must be 0, 1 or missing, scores finite" + (" values in [0, 1]" if unit else "")
    return F.when(label.isNotNull() & (~label.isin(0, 1) | bad), F.raise_error(F.lit(said)).cast("double")).otherwise(s)


def _share(part: Column, whole: Column, undefined: float | None) -> Column:
    value = F.try_divide(part.cast("double"), whole)
    return value if undefined is None else F.coalesce(value, F.lit(undefined))


def rates(df: DataFrame, undefined: float | None = None) -> DataFrame:
    """Precision, recall, F1 and false positive rate from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns({
        "precision": _share(tp, tp + fp, undefined),
        "recall": _share(tp, tp + fn, undefined),
        "f1": _share(2 * tp, 2 * tp + fp + fn, undefined),
        "fpr": _share(fp, fp + tn, undefined),
    })


def confusion(predicted: Column, label: str = "y") -> list[Column]:
    y = F.col(label)
    return [F.count_if((y == 1) & predicted).alias("tp"), F.count_if((y == 0) & predicted).alias("fp"),
            F.count_if((y == 1) & ~predicted).alias("fn"), F.count_if((y == 0) & ~predicted).alias("tn")]


def binary_metrics(df: DataFrame, by: Sequence[str] = (), label: str = "y", predicted: str = "predicted") -> DataFrame:
    """Metrics of 0/1 predictions, 0 where undefined."""
    return rates(df.groupBy(*by).agg(*confusion(F.col(predicted) == 1, label)), undefined=0.0)


def score_table(df: DataFrame, by: Sequence[str], label: str, score: str, extra: Sequence[Column] = ()) -> DataFrame:
    """Positives and negatives per different score, with both counts over all scores at least as high."""
    y = F.col(label)
    counts = df.groupBy(*by, checked_score(y, F.col(score)).alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"), *extra)
    falling = -F.col("score")
    return running(counts, by, falling, double_path(falling),
                   {"tp_at": ("sum", F.col("pos")), "fp_at": ("sum", F.col("neg"))})


def _ranking(undefined: float | None) -> tuple[list[Column], dict[str, Column]]:
    """Aggregates over a score table and the ranking metrics made of them."""
    pos, neg = F.col("pos"), F.col("neg")
    aggregates = [
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
        # Negatives ranked above each positive, ties counting half.
        F.sum(pos.cast("double") * (F.col("fp_at") - neg / 2)).alias("_above"),
        F.sum(pos * F.try_divide(F.col("tp_at").cast("double"), F.col("tp_at") + F.col("fp_at"))).alias("_gain"),
    ]
    p, n = F.col("_p").cast("double"), F.col("_n").cast("double")
    auc = F.when((p > 0) & (n > 0), 1 - F.col("_above") / (p * n))
    ap = F.when(p > 0, F.col("_gain") / p)
    if undefined is not None:
        # Without both classes the zero convention gives up on both numbers.
        ap = F.coalesce(F.when(n > 0, ap), F.lit(undefined))
        auc = F.coalesce(auc, F.lit(undefined))
    return aggregates, {"roc_auc": auc, "pr_auc": ap}


def ranking_metrics(df: DataFrame, by: Sequence[str] = (), label: str = "y", score: str = "score",
                    undefined: float | None = None) -> DataFrame:
    """ROC-AUC (ties averaged) and average precision (ties grouped)."""
    aggregates, metrics = _ranking(undefined)
    table = score_table(df, by, label, score).groupBy(*by).agg(*aggregates)
    return table.select(*by, *[value.alias(name) for name, value in metrics.items()])


def horizon_metrics(df: DataFrame, threshold: float = 0.5, by: Sequence[str] = ("horizon",), label: str = "y",
                    score: str = "score", undefined: float | None = None) -> DataFrame:
    """All binary metrics per horizon; rows without a label count nowhere but in missing_labels.

    Everything is read off one table of different scores, so labels and scores are shuffled once.
    """
    _check_threshold(threshold)
    missing = F.count_if(F.col(label).isNull()).alias("_missing")
    return _horizon(score_table(df, by, label, score, [missing]), threshold, by, undefined, [])


def _horizon(table: DataFrame, threshold: float, by: Sequence[str], undefined: float | None,
             extra: Sequence[str]) -> DataFrame:
    aggregates, metrics = _ranking(undefined)
    over = F.col("score") >= F.lit(float(threshold))
    nothing = F.lit(0).cast("long")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), nothing)

    counted = table.groupBy(*by).agg(
        total(F.when(over, F.col("pos"))).alias("tp"), total(F.when(over, F.col("neg"))).alias("fp"),
        total(F.when(~over, F.col("pos"))).alias("fn"), total(F.when(~over, F.col("neg"))).alias("tn"),
        total(F.col("_missing")).alias("missing_labels"), *aggregates, *[total(F.col(c)).alias(c) for c in extra])
    counted = rates(counted.withColumn("samples", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), undefined)
    return counted.withColumns(metrics).select(
        *by, "samples", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "fpr", "roc_auc", "pr_auc",
        "missing_labels", *extra)


def probability_metrics(df: DataFrame, threshold: float, by: Sequence[str] = (), label: str = "y",
                        score: str = "score") -> DataFrame:
    """As horizon_metrics, with 0 where a metric is undefined."""
    return horizon_metrics(df, threshold, by, label, score, undefined=0.0)


def stage_accuracy(df: DataFrame, by: Sequence[str] = ("horizon",), predicted: str = "pred_stage",
                   actual: str = "actual_stage") -> DataFrame:
    """Share of right stages over known stages, and how many are known or missing."""
    known = F.col(actual).isNotNull()
    return df.groupBy(*by).agg(
        F.avg(F.when(known, (F.col(predicted) == F.col(actual)).cast("double"))).alias("stage_accuracy"),
        F.count(actual).alias("stage_samples"), F.count_if(~known).alias("missing_stages"))


def replay_metrics(df: DataFrame, threshold: float = 0.5, by: Sequence[str] = ("step",), risk: str = "actual_risk",
                   score: str = "risk", predicted: str = "pred_stage", actual: str = "actual_stage") -> DataFrame:
    """Binary metrics and stage accuracy of aligned forecasts in one pass."""
    _check_threshold(threshold)
    known = F.col(actual).isNotNull()
    table = score_table(df, by, risk, score, [
        F.count_if(F.col(risk).isNull()).alias("_missing"), F.count(actual).alias("stage_samples"),
        F.count_if(known & (F.col(predicted) == F.col(actual))).alias("_hits")])
    out = _horizon(table, threshold, by, None, ["stage_samples", "_hits"])
    hits = F.col("_hits").cast("double")
    return out.withColumn("stage_accuracy", F.try_divide(hits, F.col("stage_samples"))).drop("_hits")


def threshold_table(df: DataFrame, by: Sequence[str] = (), label: str = "y", score: str = "score") -> DataFrame:
    """Precision, recall, F1 at every candidate threshold (clipped scores and the fixed ones)."""
    s = checked_score(F.col(label), F.col(score), unit=False)
    # Scores below 0 reach no threshold; -1 keeps them apart from real candidates.
    clipped = F.when(s < 0, F.lit(-1.0)).otherwise(F.least(s, F.lit(1.0)))
    rows = df.select(*by, clipped.alias("_s"), F.col(label).alias("_y"))
    y = F.col("_y")
    counts = rows.groupBy(*by, "_s").agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"),
                                         F.lit(1).alias("_seen"))
    groups = counts.select(*by).distinct() if by else counts.sparkSession.range(1).select()
    zero = F.lit(0).cast("long")
    fixed = groups.select(*by, F.explode(F.array(*map(F.lit, FIXED_THRESHOLDS))).alias("_s"),
                          zero.alias("pos"), zero.alias("neg"), F.lit(0).alias("_seen"))
    candidates = counts.unionByName(fixed).groupBy(*by, "_s").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("_seen").alias("_seen"))
    falling = -F.col("_s")
    table = running(candidates, by, falling, double_path(falling), {
        "tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg")),
        "_p": ("total", F.col("pos")), "_n": ("total", F.col("neg"))})
    table = table.withColumns({"fn": F.col("_p") - F.col("tp"), "tn": F.col("_n") - F.col("fp")})
    order = F.when(F.col("_s") == 0, 0).when(F.col("_seen") == 1, 1).otherwise(2)
    return rates(table.where("_s >= 0"), undefined=0.0) \
        .select(*by, F.col("_s").alias("threshold"), order.alias("rank"), "tp", "fp", "fn", "tn", "precision", "recall",
                "f1", "fpr")


def calibrate(df: DataFrame, minimum_recall: float = 0.0, by: Sequence[str] = (), label: str = "y",
              score: str = "score") -> DataFrame:
    """Threshold with the best F1 among those reaching the recall; the earliest candidate wins ties."""
    table = threshold_table(df, by, label, score)
    allowed = F.col("recall") >= F.lit(float(minimum_recall))
    best = F.max_by("threshold", F.when(allowed, F.struct(F.col("f1"), -F.col("rank"), -F.col("threshold"))))
    usable = F.count_if(allowed)
    return table.groupBy(*by).agg(F.when(usable > 0, best).otherwise(0.5).alias("threshold"),
                                  F.when(usable > 0, F.max(F.when(allowed, F.col("f1")))).alias("f1"))


METRICS = ("f1", "precision", "recall", "fpr")


def compare(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("logistic_regression", "forecaster"),
            by: Sequence[str] = (), metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per metric with both models' values side by side."""
    def long(df: DataFrame, name: str) -> DataFrame:
        values = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
        rows = df.select(*by, F.inline(F.array(*values)))
        return rows.select(*by, "metric", *[(F.col("value") if n == name else F.lit(None).cast("double")).alias(n)
                                            for n in names])

    # Both sides hold one row per group and metric, so a grouped merge serves as the join.
    return long(first, names[0]).unionByName(long(second, names[1])) \
        .groupBy(*by, "metric").agg(*[F.max(n).alias(n) for n in names])
