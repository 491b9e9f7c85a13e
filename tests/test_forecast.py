import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.labels import clean_stage
from tidewatch.operators.explain import alert_text, attribute, attribute_with, flagged_records, top_features
from tidewatch.operators.forecast import (
    fit_heads, forecast, forecast_latest, forecast_steps, head_inputs, persistence, prefix_max, rollout, supervised, trend,
)
from tidewatch.operators.heads import (
    ForecastModel, LinearScore, StageScore, Transition, compress, evaluate_baseline, fit_baseline, fit_transition,
    model_from_json, model_to_json,
)
from tidewatch.operators.profile import label_semantics
from tidewatch.operators.series import align, require_history, sample_origins, sequences
from tidewatch.plans.evaluate import evaluate
from tidewatch.plans.replay import replay
from tidewatch.plans.train import load_model, save_model, train
from tidewatch.schema import FEATURES, SUPERVISION_MARK, ForecastOptions


def fixed_model(risk=0.8, stage=1, length=2, horizon=2, semantics="stage_id"):
    """Repeats the last window, always scores `risk` and `stage`."""
    logit = float(np.log(risk / (1 - risk)))
    scores = tuple(1.0 if s == stage else 0.0 for s in range(6))
    return ForecastModel(Transition(1, ((0.0,), (1.0,))), (LinearScore((0.0,), logit),) * horizon,
                         (StageScore(((0.0,),) * 6, scores),) * horizon, length, label_semantics=semantics)


def series(spark, stages):
    rows = [(i, [float(i)], None if s is None else float(s)) for i, s in enumerate(stages)]
    return spark.createDataFrame(rows, "idx long, features array<double>, stage double")


def test_replay_aligns_and_leaves_missing_labels_out(spark):
    windows = series(spark, [0, 0, 1, None, -1, 2, None, 0])
    options = ForecastOptions(sequence_length=2, horizon=2, max_origins=2)
    result = replay(windows, fixed_model(), options, semantics="stage_id")
    first = sorted((r["origin_idx"], r["step"], r["target_idx"], r["actual_stage"], r["actual_risk"])
                   for r in result.aligned.collect())[:2]
    assert first == [(1, 1, 2, 1, 1), (1, 2, 3, None, None)]
    metrics = {r["step"]: r for r in result.metrics.collect()}
    assert (metrics[2]["samples"], metrics[2]["missing_labels"], metrics[2]["roc_auc"]) == (1, 1, None)
    settings = result.settings.first()
    assert (settings["origins_evaluated"], settings["origin_selection"]) == (2, "evenly_spaced")
    report = result.report().first()
    assert report["schema"] and [m["step"] for m in report["forecast_vs_actual"]] == [1, 2]
    again = replay(windows, fixed_model(), options, semantics="stage_id").report().first()
    assert again == report


def test_binary_replay_claims_no_stage_accuracy(spark, tmp_path):
    result = replay(series(spark, [0, 0, 1, 0, 1, 1]), fixed_model(semantics="unknown"),
                    ForecastOptions(sequence_length=2, horizon=2, max_origins=None))
    assert result.settings.first()["label_semantics"] == "binary_attack"
    assert {r["actual_stage"] for r in result.aligned.collect()} == {None}
    assert all(r["stage_accuracy"] is None and r["samples"] > 0 for r in result.metrics.collect())
    result.write(str(tmp_path / "replay"))
    assert spark.read.json(str(tmp_path / "replay" / "predictions")).count() == 3


def test_replay_without_labels_measures_nothing(spark):
    result = replay(series(spark, [None] * 5), fixed_model(), ForecastOptions(sequence_length=2, horizon=2), semantics="unknown")
    assert result.settings.first()["origins_evaluated"] == 2
    assert all(r["samples"] == 0 and r["stage_accuracy"] is None for r in result.metrics.collect())


def test_short_series_and_bad_labels(spark):
    with pytest.raises(ValueError, match="at least"):
        replay(series(spark, [0, 0, 0]), fixed_model(), ForecastOptions(sequence_length=2, horizon=2), semantics="stage_id")
    with pytest.raises(Exception, match="integers 0-5"):
        series(spark, [7]).select(clean_stage(F.col("stage"))).collect()
    for bad in ({"horizon": 0}, {"threshold": 2.0}, {"sequence_length": 0}, {"step_seconds": 0.0}, {"max_origins": 0}):
        with pytest.raises(ValueError):
            ForecastOptions(**bad)


def test_require_history_per_series(spark):
    rows = [("long", i) for i in range(6)] + [("short", i) for i in range(3)] + [(None, i) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, idx long")
    kept = require_history(df, 3, 2, ["k"]).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in kept} == {"long": 6, None: 5}


def test_label_semantics(spark):
    def meaning(values, *declared):
        df = spark.createDataFrame([(v,) for v in values], "stage int")
        return label_semantics(df, *declared).first()["semantics"]

    assert meaning([0, 1, 0], None, "unknown") == "binary_attack"
    assert meaning([0, 2], "source_stage", "unknown") == "stage_id"
    assert meaning([-1, -1], None, None) == "unknown"
    assert meaning([0, 3]) == "stage_id" and meaning([0, 9]) == "unknown"


def test_evenly_spaced_origins(spark):
    df = spark.range(51_546).withColumnRenamed("id", "idx")
    picked = sample_origins(df, 5, 12, 14).collect()
    assert sorted(r["origin_idx"] for r in picked) == [11, 12891, 25771, 38651, 51531]
    small = spark.range(9).withColumnRenamed("id", "idx")
    assert sorted(r["origin_idx"] for r in sample_origins(small, 100, 2, 2).collect()) == [1, 2, 3, 4, 5, 6]
    assert sorted(r["origin_idx"] for r in sample_origins(small, None, 2, 2).collect()) == [1, 2, 3, 4, 5, 6]
    assert [r["origin_idx"] for r in sample_origins(small, 1, 2, 2).collect()] == [1]


def test_transition_learns_the_adjacent_window(spark):
    rng = random.Random(5)
    rows = []
    for k in ("a", None):
        x = np.array([rng.random(), rng.random()])
        for i in range(60):
            rows.append((k, i, x.tolist()))
            x = np.array([0.3 + 0.5 * x[0] - 0.2 * x[1], 0.1 + 0.7 * x[1]]) + np.array([rng.gauss(0, 1e-4) for _ in "12"])
    df = spark.createDataFrame(rows, "k string, idx long, features array<double>")
    model = fit_transition(df, 1, 0.0, ["k"])
    assert np.allclose(model.weights, [[0.3, 0.1], [0.5, 0.0], [-0.2, 0.7]], atol=0.05)
    two = fit_transition(df, 2, 1.0, ["k"])
    assert np.asarray(two.weights).shape == (5, 2)
    rolled = rollout(sequences(df, 3, ["k"]), model, 3).where("k = 'a' and origin_idx = 2").first()
    state = np.array(rows[2][2])
    for step in range(3):
        state = np.asarray(model.weights)[0] + state @ np.asarray(model.weights)[1:]
        assert np.allclose(rolled["states"][step], state)


def test_each_step_is_trained_with_its_own_label(spark):
    df = spark.createDataFrame([(i, [float(i)], i % 4) for i in range(8)], "idx long, features array<double>, stage int")
    rows = head_inputs(supervised(df, 2, 3), Transition(1, ((0.0,), (1.0,))), 3).collect()
    assert {(r["origin_idx"], r["step"]): r["label"] for r in rows} == \
        {(o, k): (o + k) % 4 for o in range(1, 5) for k in (1, 2, 3)}
    assert all(r["y"] == int(r["label"] > 0) for r in rows)


def test_align_at_series_ends(spark):
    df = spark.createDataFrame([(k, i, i) for k in "ab" for i in range(4)], "k string, idx long, stage int")
    rows = [(r["k"], r["origin_idx"], r["step"], r["label"]) for r in align(df, 2, ["k"]).collect()]
    assert sorted(rows) == [(k, o, s, o + s) for k in "ab" for o in (0, 1) for s in (1, 2)]
    assert align(df, 2, ["k"], complete=False).count() == 10


def test_trend_and_prefix_maximum(spark):
    rows = [("up", k, 0.1 * k) for k in (1, 2, 3)] + [("flat", k, 0.5) for k in (1, 2)] + [("one", 1, 0.9)] + \
        [("down", k, -0.1 * k) for k in (1, 2)]
    df = spark.createDataFrame(rows, "g string, step int, risk double")
    assert {r["g"]: r["trend"] for r in trend(df, ["g"]).collect()} == \
        {"up": "increasing", "flat": "stable", "one": "stable", "down": "decreasing"}
    assert [r["prefix_max"] for r in prefix_max(df, "risk", ["g"]).where("g = 'down'").orderBy("step").collect()] == [-0.1, -0.1]


def test_forecast_summary(spark):
    histories = sequences(series(spark, [0] * 4), 2)
    out = forecast(histories, fixed_model()).orderBy("origin_idx").collect()
    assert len(out) == 3 and out[0]["trend"] == "stable" and abs(out[0]["change"]) < 1e-12
    assert [s["step"] for s in out[0]["trajectory"]] == [1, 2] and out[0]["current_stage_name"] == "Reconnaissance"
    assert out[2]["trajectory"][1]["state"] == [3.0]
    hidden = forecast_latest(series(spark, [0] * 4), fixed_model(semantics="binary_attack")).collect()
    assert [r["origin_idx"] for r in hidden] == [3] and "Unavailable" in hidden[0]["current_stage_name"]
    assert forecast_latest(series(spark, [0]), fixed_model()).count() == 0
    with pytest.raises(ValueError, match="horizon"):
        forecast(histories, fixed_model(), 3)
    naive = persistence(series(spark, [0] * 2), 2).collect()
    assert {(r["origin_idx"], r["step"], r["features"][0]) for r in naive} == {(0, 1, 0.0), (0, 2, 0.0), (1, 1, 1.0), (1, 2, 1.0)}


@pytest.fixture(scope="module")
def windows(spark):
    """Two series whose attack stages follow high byte counts by one window."""
    rng = random.Random(11)
    rows = []
    for k in ("a", "b"):
        level = 0.0
        for i in range(80):
            stage = (1 + (i % 2)) if level > 0.6 else 0
            level = rng.random()
            rows.append((k, i, stage, level * 100, float(i % 3)))
    df = spark.createDataFrame(rows, "k string, idx long, stage int, flow_bytes double, flow_packets double")
    return df.withColumns({f: F.lit(0.0) for f in FEATURES if f not in df.columns}).cache()


OPTIONS = ForecastOptions(sequence_length=3, horizon=2, max_origins=10)


def test_train_evaluate_and_store(spark, windows, tmp_path):
    model = train(windows, OPTIONS, ["k"], max_iter=20)
    assert model.supervision == SUPERVISION_MARK and model.horizon == 2 and len(model.mean) == 24
    assert model_from_json(model_to_json(model)) == model
    save_model(spark, model, str(tmp_path / "model"))
    assert load_model(spark, str(tmp_path / "model")) == model
    from tidewatch.plans.prepare import model_input
    from tidewatch.plans.train import model_scaler

    table = model_input(windows, ["k"], model_scaler(model))
    result = evaluate(table.where("k = 'a'"), table.where("k = 'b'"), model, keys=["k"])
    assert result.samples == 77 and 0 <= result.threshold <= 1
    assert {r["metric"] for r in result.comparison.collect()} == {"f1", "precision", "recall", "fpr"}
    assert result.forecaster.first()["samples"] == 77
    steps = forecast_steps(forecast(sequences(table, 3, ["k"]), model, keys=["k"]), ["k"])
    assert steps.where("risk < 0 or risk > 1 or pred_stage not in (0, 1, 2)").count() == 0


def test_baseline_needs_both_classes(spark):
    rows = [([float(i), 0.5], int(i > 5)) for i in range(12)]
    df = spark.createDataFrame(rows, "features array<double>, y int")
    row = evaluate_baseline(df).first()
    assert row["f1"] > 0.9 and row["tp"] + row["fp"] + row["fn"] + row["tn"] == 12
    with pytest.raises(ValueError, match="both"):
        fit_baseline(df.where("y = 0"))


def test_attribution(spark):
    df = spark.createDataFrame([(1, [3.0, 1.0, 0.0])], "id int, features array<double>")
    model, names = LinearScore((1.0, -4.0, 2.0), 0.0), ("a", "b", "c")
    want = [("b", -4.0), ("a", 2.0), ("c", 0.0)]
    exact = attribute(df, model, (1.0, 0.0, 0.0), names=names)
    assert [(c["name"], c["contribution"]) for c in exact.first()["contributions"]] == want
    weights = np.array([1.0, -4.0, 2.0])
    occluded = attribute_with(df, lambda x: x @ weights, (1.0, 0.0, 0.0), names=names)
    assert [(c["name"], round(c["contribution"], 9)) for c in occluded.first()["contributions"]] == want
    top = top_features(exact.drop("features"), 2).collect()
    assert [(r["rank"], r["feature"]) for r in top] == [(1, "b"), (2, "a")]
    text = alert_text(spark.createDataFrame([(0.8, [("a", 0.051), ("b", -0.2), ("c", 0.01)]), (0.5, [])],
                                            "risk double, contributions array<struct<name string, contribution double>>"))
    assert [r["alert"] for r in text.collect()] == \
        ["Infiltration risk 80% driven by b (-20.0%) and a (+5.1%).", "Infiltration risk 50%."]


def test_flagged_records(spark):
    members = spark.createDataFrame([(i, f"e{i}") for i in range(5)], "idx long, event string")
    scores = spark.createDataFrame([(0, .9), (1, .1), (3, .9)], "position long, score double")
    rows = flagged_records(scores, members, 0.5, 3).collect()
    assert sorted((r["flag_position"], r["event"]) for r in rows) == [(0, "e2"), (3, "e4")]


def test_compression_restores_a_plane(spark):
    rng = random.Random(2)
    rows = [(i, [a, b, a + b]) for i, (a, b) in enumerate((rng.random(), rng.random()) for _ in range(40))]
    df = spark.createDataFrame(rows, "id int, features array<double>")
    assert compress(df, 2).agg(F.max("restore_error")).first()[0] < 1e-12
    assert compress(df, 1).agg(F.max("restore_error")).first()[0] > 1e-4


def test_single_class_heads(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(10)], "idx long, features array<double>, stage int")
    risk, stage = fit_heads(df, fit_transition(df), 2, 2)
    assert all(r.intercept < 0 for r in risk) and all(s.intercept[0] == 0.0 and s.intercept[1] < -100 for s in stage)


def test_head_inputs_pool_where_they_predict(spark):
    rows = [(1, i, [float(i), float(-i)], i % 2) for i in range(8)]
    windows = spark.createDataFrame(rows, "k long, idx long, features array<double>, stage int")
    transition = Transition(1, ((1.0, -1.0), (1.0, 0.0), (0.0, 2.0)))
    found = head_inputs(supervised(windows, 2, 3, ["k"]), transition, 3, ["k"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "zip_with" not in plan  # no element by element work in the plan
    got = {(r.origin_idx, r.step): list(r.x) for r in found.collect()}
    assert len(got) == 12 and got[4, 1] == [5.0, -9.0] and got[4, 3] == [7.0, -9.0]
