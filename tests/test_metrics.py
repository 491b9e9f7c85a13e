import math
import random

import pytest

from tidewatch.operators.metrics import (
    calibrate, compare, horizon_metrics, probability_metrics, ranking_metrics, replay_metrics, validate_scores,
)


def brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(pairs):
    p = sum(y for y, _ in pairs)
    if not p:
        return None
    total, before = 0.0, 0
    for t in sorted({s for _, s in pairs}, reverse=True):
        tp = sum(y for y, s in pairs if s >= t)
        total += (tp - before) / p * tp / sum(1 for _, s in pairs if s >= t)
        before = tp
    return total


def brute_threshold(pairs, recall):
    scores = sorted({min(max(s, 0.0), 1.0) for _, s in pairs})
    best, best_f1 = 0.5, -1.0
    for t in [0.0, *scores, 0.5, 0.7, 0.9, 1.0]:
        tp = sum(1 for y, s in pairs if y == 1 and s >= t)
        fp = sum(1 for y, s in pairs if y == 0 and s >= t)
        fn = sum(1 for y, s in pairs if y == 1 and s < t)
        r = tp / (tp + fn) if tp + fn else 0.0
        f1 = 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0
        if r >= recall and f1 > best_f1:
            best, best_f1 = t, f1
    return best


def test_horizons_use_only_their_own_targets(spark):
    rows = [(h, y, s) for h, ys, ss in [(1, (0, 1, 0, 1), (.1, .8, .4, .6)), (2, (0, 1, 1, 0), (.1, .7, .9, .2))]
            for y, s in zip(ys, ss)]
    out = {r["horizon"]: r for r in
           horizon_metrics(spark.createDataFrame(rows, "horizon int, y int, score double")).collect()}
    assert [out[h]["samples"] for h in (1, 2)] == [4, 4]
    assert (out[1]["tp"], out[1]["fp"], out[1]["roc_auc"]) == (2, 0, 1.0)
    assert (out[2]["tp"], out[2]["fn"]) == (2, 0)


def test_undefined_metrics_are_null_or_zero(spark):
    none = spark.createDataFrame([(1, 0, .1), (1, 0, .9)], "horizon int, y int, score double")
    row = horizon_metrics(none).first()
    assert row["roc_auc"] is None and row["pr_auc"] is None and row["recall"] is None and row["fpr"] == 0.5
    allpos = spark.createDataFrame([(1, 1, 0.0), (1, 1, 0.0)], "horizon int, y int, score double")
    row = horizon_metrics(allpos).first()
    assert row["precision"] is None and row["recall"] == 0.0 and row["f1"] == 0.0 and row["fpr"] is None
    zero = probability_metrics(none, 0.5).first()
    assert (zero["roc_auc"], zero["pr_auc"], zero["recall"]) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ranking_and_threshold_against_brute_force(spark, seed):
    rng = random.Random(seed)
    tiny = [rng.random() * 1e-9 for _ in range(20)]
    rows = [(g, int(rng.random() < 0.4), rng.choice([round(rng.random(), 1), rng.random(), rng.choice(tiny), 0.0, 1.0]))
            for g in range(3) for _ in range(150)]
    df = spark.createDataFrame(rows, "g int, y int, score double")
    ranked = {r["g"]: r for r in ranking_metrics(df, ["g"]).collect()}
    chosen = {r["g"]: r["threshold"] for r in calibrate(df, 0.6, ["g"]).collect()}
    for g in range(3):
        pairs = [(y, s) for h, y, s in rows if h == g]
        assert math.isclose(ranked[g]["roc_auc"], brute_auc(pairs), rel_tol=1e-12)
        assert math.isclose(ranked[g]["pr_auc"], brute_ap(pairs), rel_tol=1e-12)
        assert chosen[g] == brute_threshold(pairs, 0.6)
    pairs = [(y, s) for _, y, s in rows]
    assert calibrate(df).first()["threshold"] == brute_threshold(pairs, 0.0)


def test_scores_outside_the_unit_interval_and_no_positives(spark):
    rows = [(1, -0.5), (0, -0.2), (1, 1.5), (0, 0.3), (1, 0.3)]
    df = spark.createDataFrame(rows, "y int, score double")
    assert calibrate(df).first()["threshold"] == brute_threshold(rows, 0.0)
    negatives = spark.createDataFrame([(0, .2), (0, .3)], "y int, score double")
    assert calibrate(negatives).first()["threshold"] == 0.0
    assert calibrate(negatives, 0.1).first()["threshold"] == 0.5


def test_ties_share_their_rank(spark):
    df = spark.createDataFrame(list(zip((0, 0, 1, 1, 1, 0), (.5, .9, .5, .8, .9, .1))), "y int, score double")
    row = ranking_metrics(df).first()
    assert round(row["roc_auc"], 6) == 0.666667 and round(row["pr_auc"], 6) == 0.588889


def test_validation(spark):
    validate_scores(spark.createDataFrame([(0, .5), (None, 1.0)], "y int, score double"))
    for bad in [(2, .1), (0, float("nan")), (0, 1.1)]:
        with pytest.raises(ValueError):
            validate_scores(spark.createDataFrame([bad], "y int, score double"))
    with pytest.raises(ValueError):
        horizon_metrics(spark.createDataFrame([(1, 0, .1)], "horizon int, y int, score double"), 1.5)


def test_replay_metrics_count_missing_labels(spark):
    rows = [(1, 1, .8, 1, 1), (1, None, .8, 1, None), (1, 0, .2, 1, 0)]
    row = replay_metrics(spark.createDataFrame(
        rows, "step int, actual_risk int, risk double, pred_stage int, actual_stage int")).first()
    assert (row["samples"], row["missing_labels"], row["stage_samples"], row["stage_accuracy"]) == (2, 1, 2, 0.5)


def test_compare_places_models_side_by_side(spark):
    a = spark.createDataFrame([(.5, .4, .3, .2)], "f1 double, precision double, recall double, fpr double")
    b = spark.createDataFrame([(.6, None, .8, .9)], "f1 double, precision double, recall double, fpr double")
    out = {r["metric"]: (r["logistic_regression"], r["forecaster"]) for r in compare(a, b).collect()}
    assert out == {"f1": (.5, .6), "precision": (.4, None), "recall": (.3, .8), "fpr": (.2, .9)}
