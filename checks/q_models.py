"""Inventory G8, G10, H and U: models, forecasts, explanations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.adapters import USER_DAYS, r4, rounded, rounded_sql, sql_r4, table, user_days
from checks.q_metrics import SHARES, confusion_sql, ranking_sql
from tidewatch.operators.explain import attribute, attribute_with, top_features
from tidewatch.operators.forecast import (
    fit_heads, forecast, forecast_all, forecast_latest, forecast_steps, forecast_with, head_inputs, persistence, rollout,
    supervised,
)
from tidewatch.operators.heads import ForecastModel, LinearScore, compress, fit_baseline, fit_transition, predict
from tidewatch.operators.scaling import fit_scaler, scale
from tidewatch.operators.series import sequences
from tidewatch.plans.evaluate import evaluate
from tidewatch.plans.prepare import model_input
from tidewatch.plans.replay import replay
from tidewatch.plans.train import model_scaler, train
from tidewatch.schema import FEATURES, ForecastOptions
from tidewatch.session import staged

KEY = ["user_id"]
OPTIONS = ForecastOptions(sequence_length=5, horizon=3, step_seconds=86_400.0)
WEIGHTS = tuple(round(0.03 * (i - 11), 2) for i in range(len(FEATURES)))
CENTRE = tuple(float(i) for i in range(len(FEATURES)))


@lru_cache(maxsize=4)
def trained(spark: SparkSession, sf: str) -> ForecastModel:
    return train(user_days(spark, sf), OPTIONS, KEY, max_iter=30)


def _scaled(spark: SparkSession, sf: str) -> DataFrame:
    return staged(model_input(user_days(spark, sf), KEY, model_scaler(trained(spark, sf))))


def _single(spark: SparkSession, sf: str) -> DataFrame:
    return staged(user_days(spark, sf).select("user_id", "idx", F.array(F.col("flow_bytes") / 100).alias("features")))


AR1 = f"""{USER_DAYS},
pairs AS (SELECT flow_bytes / 100 AS x, lead(flow_bytes) OVER (PARTITION BY user_id ORDER BY idx) / 100 AS z FROM days),
fit AS (SELECT regr_intercept(z, x) AS a, regr_slope(z, x) AS b FROM pairs WHERE z IS NOT NULL)"""


def h1_transition(spark: SparkSession, sf: str) -> DataFrame:
    """Intercept and slope of the next day's bytes on this day's."""
    model = fit_transition(_single(spark, sf), 1, 0.0, KEY, size=1)
    (intercept,), (slope,) = model.weights
    return spark.range(1).select(r4(F.lit(intercept)).alias("intercept"), r4(F.lit(slope)).alias("slope"))


def h1_transition_wide(spark: SparkSession, sf: str) -> DataFrame:
    weights = trained(spark, sf).transition.weights
    rows = [(i, j, float(w)) for i, row in enumerate(weights) for j, w in enumerate(row)]
    return spark.createDataFrame(rows, "input int, output int, weight double")


def h2_rollout(spark: SparkSession, sf: str) -> DataFrame:
    days = _single(spark, sf)
    rolled = rollout(sequences(days, 3, KEY), fit_transition(days, 1, 0.0, KEY, size=1), 3)
    return rolled.select("user_id", "origin_idx", F.posexplode("states").alias("at", "s")).select(
        "user_id", "origin_idx", (F.col("at") + 1).alias("step"), r4(F.col("s")[0]).alias("state"))


H2 = f"""WITH {AR1}, origin AS (SELECT user_id, idx AS origin_idx, flow_bytes / 100 AS x FROM days WHERE idx >= 2),
s AS (SELECT user_id, origin_idx, a + b * x AS s1, a + b * (a + b * x) AS s2, a + b * (a + b * (a + b * x)) AS s3 FROM origin, fit)
SELECT user_id, origin_idx, 1 AS step, {sql_r4("s1")} AS state FROM s UNION ALL SELECT user_id, origin_idx, 2, {sql_r4("s2")} FROM s
UNION ALL SELECT user_id, origin_idx, 3, {sql_r4("s3")} FROM s"""


def h3_head_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """What each step's risk score is trained on: prefix maxima and the label of that step."""
    days = user_days(spark, sf).select("user_id", "idx", F.array(F.col("flow_bytes") / 100).alias("features"), "stage")
    days = staged(days)
    model = fit_transition(days, 1, 0.0, KEY, size=1)
    rows = head_inputs(supervised(days, 3, 3, KEY), model, 3, KEY)
    return rows.select("user_id", "origin_idx", "step", r4(F.col("x")[0]).alias("x"), "label", "y", "y_stage")


H3 = f"""WITH {AR1}, size AS (SELECT user_id, max(idx) AS last FROM days GROUP BY user_id),
origin AS (SELECT user_id, idx AS origin_idx, flow_bytes / 100 AS x FROM days JOIN size USING (user_id) WHERE idx >= 2 AND idx + 3 <= last),
s AS (SELECT user_id, origin_idx, a + b * x AS s1, a + b * (a + b * x) AS s2, a + b * (a + b * (a + b * x)) AS s3 FROM origin, fit),
steps AS (SELECT user_id, origin_idx, 1 AS step, s1 AS x FROM s UNION ALL SELECT user_id, origin_idx, 2, greatest(s1, s2) FROM s
          UNION ALL SELECT user_id, origin_idx, 3, greatest(s1, s2, s3) FROM s)
SELECT user_id, origin_idx, step, {sql_r4("x")} AS x, d.stage AS label, CAST(d.stage > 0 AS INTEGER) AS y, d.stage AS y_stage
FROM steps JOIN days d USING (user_id) WHERE d.idx = origin_idx + step"""


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    return forecast_steps(forecast_all(_scaled(spark, sf), trained(spark, sf), keys=KEY), KEY)


def h3_risk(spark: SparkSession, sf: str) -> DataFrame:
    return _steps(spark, sf).select("user_id", "origin_idx", "step", r4(F.col("risk")).alias("risk"))


def h4_stage(spark: SparkSession, sf: str) -> DataFrame:
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p)
    return _steps(spark, sf).select("user_id", "origin_idx", "step", "pred_stage", "stage_name", r4(total).alias("total"),
                                    r4(F.array_max("probabilities")).alias("probability"))


def _summary(df: DataFrame) -> DataFrame:
    return rounded(df.select("user_id", "origin_idx", "current_risk", "current_stage", "current_stage_name", "horizon", "slope",
                             "trend", "change", F.size("trajectory").alias("steps")), "current_risk", "slope", "change")


def h5_forecast(spark: SparkSession, sf: str) -> DataFrame:
    model = trained(spark, sf)
    return _summary(forecast(sequences(_scaled(spark, sf), model.sequence_length, KEY), model, 2, KEY))


def h6_latest(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(forecast_latest(_scaled(spark, sf), trained(spark, sf), keys=KEY))


def h7_all(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(forecast_all(_scaled(spark, sf), trained(spark, sf), keys=KEY))


def h8_persistence(spark: SparkSession, sf: str) -> DataFrame:
    out = persistence(user_days(spark, sf), 3, KEY, carry=["flow_bytes", "stage"])
    return rounded(out, "flow_bytes")


H8 = f"""WITH {USER_DAYS}
SELECT user_id, idx AS origin_idx, CAST(k AS INTEGER) AS step, idx + k AS target_idx, {sql_r4("flow_bytes")} AS flow_bytes, stage
FROM days, generate_series(1, 3) g(k)"""


def _feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    return user_days(spark, sf).select("user_id", "idx", F.array(*FEATURES).alias("features"))


def _ranked(rows: DataFrame) -> DataFrame:
    out = top_features(rows.drop("features"), len(FEATURES))
    return out.select("user_id", "idx", "feature", r4(F.col("contribution")).alias("contribution"))


def h9_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(attribute(_feature_rows(spark, sf), LinearScore(WEIGHTS, 0.1), CENTRE))


H9 = f"WITH {USER_DAYS} " + " UNION ALL ".join(
    f"SELECT user_id, idx, '{f}' AS feature, {sql_r4(f'({f} - {c}::DOUBLE) * ({w}::DOUBLE)')} AS contribution FROM days"
    for f, c, w in zip(FEATURES, CENTRE, WEIGHTS))


def h10_compress(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings squeezed into 8 numbers."""
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    return compress(vectors, 8).select("vec_id", r4(F.col("restore_error")).alias("restore_error"), F.size("latent").alias("size"))


def u1_custom(spark: SparkSession, sf: str) -> DataFrame:
    """A user's own forecaster: repeat the last window."""
    histories = sequences(_single(spark, sf), 3, KEY)

    def repeat_last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            last = np.array([h[-1][0] for h in batch["history"]])
            for step in (1, 2, 3):
                yield pd.DataFrame({"user_id": batch["user_id"], "origin_idx": batch["origin_idx"], "step": step, "value": last})

    return rounded(forecast_with(histories, repeat_last, "user_id long, origin_idx long, step int, value double"), "value")


U1 = f"""WITH {USER_DAYS} SELECT user_id, idx AS origin_idx, CAST(k AS INTEGER) AS step, {sql_r4("flow_bytes / 100")} AS value
FROM days, generate_series(1, 3) g(k) WHERE idx >= 2"""


def u2_custom_attribution(spark: SparkSession, sf: str) -> DataFrame:
    weights = np.asarray(WEIGHTS)
    return _ranked(attribute_with(_feature_rows(spark, sf), lambda x: x @ weights, CENTRE))


def g8_replay(spark: SparkSession, sf: str) -> DataFrame:
    metrics = replay(_scaled(spark, sf), trained(spark, sf), OPTIONS, KEY).metrics
    return rounded(metrics, *SHARES, "stage_accuracy")


def g8_replay_report(spark: SparkSession, sf: str) -> DataFrame:
    return replay(_scaled(spark, sf), trained(spark, sf), OPTIONS, KEY).report().select("schema", "replay.*", F.size("forecast_vs_actual").alias("steps"))


def g10_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    """Days before position 18 of each user train, the days from there on test."""
    days = user_days(spark, sf)
    before, after = days.where("idx < 18"), days.where("idx >= 18").withColumn("idx", F.col("idx") - 18)
    model = train(before, OPTIONS, KEY, max_iter=30)
    sides = [staged(model_input(part, KEY, model_scaler(model))) for part in (before, after)]
    result = evaluate(*sides, model, keys=KEY)
    return rounded(result.comparison.withColumn("samples", F.lit(result.samples)), "logistic_regression", "forecaster")


# --- fitted scores against SQL: one feature, so that Newton's steps fit into a recursive query ------------------------

ONE = ForecastOptions(sequence_length=3, horizon=3, step_seconds=86_400.0)


def _one_feature(spark: SparkSession, sf: str) -> DataFrame:
    """Days with a single feature, a hundredth of their bytes."""
    return staged(user_days(spark, sf).select("user_id", "idx", F.array(F.col("flow_bytes") / 100).alias("features"), "stage"))


def _fitted(days: DataFrame, semantics: str = "binary_attack") -> ForecastModel:
    transition = fit_transition(days, 1, 0.0, KEY, size=1)
    risk, stage = fit_heads(days, transition, ONE.sequence_length, ONE.horizon, KEY, semantics)
    return ForecastModel(transition, risk, stage, ONE.sequence_length, label_semantics=semantics)


def h3_risk_fitted(spark: SparkSession, sf: str) -> DataFrame:
    days = _one_feature(spark, sf)
    return forecast_steps(forecast_all(days, _fitted(days), keys=KEY), KEY).select("user_id", "origin_idx", "step", r4(F.col("risk")).alias("risk"))


def newton_sql(rows: str, by: str, weight: str = "1.0") -> str:
    """CTE `coef`: intercept b0 and slope b1 of each `by` after 30 Newton steps over rows (by, x, y), half of b1's square added to the loss."""
    return f"""
newton AS (
  SELECT DISTINCT {by}, 0 AS turn, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM {rows}
  UNION ALL
  SELECT {by}, turn + 1, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (SELECT {by}, turn, b0, b1, sum(w * (p - y)) AS g0, sum(w * (p - y) * x) + b1 AS g1, sum(w * p * (1 - p)) AS h00,
               sum(w * p * (1 - p) * x) AS h01, sum(w * p * (1 - p) * x * x) + 1 AS h11
        FROM (SELECT n.{by}, n.turn, n.b0, n.b1, r.x, r.y, {weight} AS w, 1 / (1 + exp(-(n.b0 + n.b1 * r.x))) AS p
              FROM newton n JOIN {rows} r ON n.{by} = r.{by} WHERE n.turn < 30) GROUP BY {by}, turn, b0, b1)),
coef AS (SELECT {by}, b0, b1 FROM newton WHERE turn = 30)"""


ONE_FEATURE = f"""{AR1}, size AS (SELECT user_id, max(idx) AS last FROM days GROUP BY user_id),
seen AS (SELECT user_id, idx AS origin_idx, idx + 3 <= last AS followed, idx = last AS latest, flow_bytes / 100 AS x FROM days JOIN size USING (user_id) WHERE idx >= 2),
ahead AS (SELECT user_id, origin_idx, followed, latest, x AS now, a + b * x AS s1, a + b * (a + b * x) AS s2, a + b * (a + b * (a + b * x)) AS s3 FROM seen, fit),
inputs AS (SELECT user_id, origin_idx, followed, latest, now, 1 AS step, s1 AS x FROM ahead
           UNION ALL SELECT user_id, origin_idx, followed, latest, now, 2, greatest(s1, s2) FROM ahead
           UNION ALL SELECT user_id, origin_idx, followed, latest, now, 3, greatest(s1, s2, s3) FROM ahead),
labelled AS (SELECT i.step, i.x, CAST(d.stage > 0 AS INTEGER) AS y, d.stage, i.user_id, i.origin_idx
             FROM inputs i JOIN days d ON d.user_id = i.user_id AND d.idx = i.origin_idx + i.step WHERE followed),
{newton_sql("labelled", "step").strip()},
risks AS (SELECT i.*, 1 / (1 + exp(-(b0 + b1 * x))) AS risk FROM inputs i JOIN coef USING (step))"""
H3_FITTED = f"WITH RECURSIVE {ONE_FEATURE} SELECT user_id, origin_idx, step, {sql_r4('risk')} AS risk FROM risks"


def _summary_sql(steps: int, where: str) -> str:
    slope = "max(risk) FILTER (step = 2) - max(risk) FILTER (step = 1)" if steps == 2 else "(max(risk) FILTER (step = 3) - max(risk) FILTER (step = 1)) / 2"
    return f"""WITH RECURSIVE {ONE_FEATURE},
summary AS (SELECT user_id, origin_idx, max(1 / (1 + exp(-(b0 + b1 * now)))) AS now_risk, {slope} AS slope, max(risk) FILTER (step = {steps}) AS last_risk
            FROM risks, (SELECT b0, b1 FROM coef WHERE step = 1) first WHERE {where} GROUP BY user_id, origin_idx)
SELECT user_id, origin_idx, {sql_r4("now_risk")} AS current_risk, 'Unavailable (stage labels unverified)' AS current_stage_name,
       {steps} AS horizon, {sql_r4("slope")} AS slope, CASE WHEN slope > 1e-6 THEN 'increasing' WHEN slope < -1e-6 THEN 'decreasing' ELSE 'stable' END AS trend,
       {sql_r4("last_risk - now_risk")} AS change, {steps} AS steps FROM summary"""


def h5_fitted(spark: SparkSession, sf: str) -> DataFrame:
    days = _one_feature(spark, sf)
    return _summary(forecast(sequences(days, 3, KEY), _fitted(days), 2, KEY)).drop("current_stage")


def h6_fitted(spark: SparkSession, sf: str) -> DataFrame:
    days = _one_feature(spark, sf)
    return _summary(forecast_latest(days, _fitted(days), keys=KEY)).drop("current_stage")


def h7_fitted(spark: SparkSession, sf: str) -> DataFrame:
    days = _one_feature(spark, sf)
    return _summary(forecast_all(days, _fitted(days), keys=KEY)).drop("current_stage")


def g8_fitted(spark: SparkSession, sf: str) -> DataFrame:
    days = _one_feature(spark, sf)
    return rounded(replay(days, _fitted(days), ONE, KEY).metrics, *SHARES, "stage_accuracy")


G8_FITTED = f"""WITH RECURSIVE {ONE_FEATURE},
scored AS (SELECT l.step, l.y, r.risk AS score FROM labelled l JOIN risks r USING (user_id, origin_idx, step)),
{confusion_sql("scored", "step", f"score >= {ONE.threshold}").strip()}, {ranking_sql("scored", "step").replace("steps AS", "levels AS").replace("FROM steps", "FROM levels").strip()}
SELECT step, tp + fp + fn + tn AS samples, tp, fp, fn, tn, {", ".join(f"{sql_r4(c)} AS {c}" for c in SHARES)}, CAST(0 AS BIGINT) AS missing_labels,
       CAST(0 AS BIGINT) AS stage_samples, CAST(NULL AS DOUBLE) AS stage_accuracy FROM shares JOIN ranking USING (step)"""


def h4_score_equations(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of the equations that the best stage scores solve, per step, stage and coefficient, and the rows behind them."""
    days = _one_feature(spark, sf)
    model = _fitted(days, "stage_id")
    rows = staged(head_inputs(supervised(days, 3, 3, KEY), model.transition, 3, KEY).where("y_stage IS NOT NULL"))
    out = None
    for k, fitted in enumerate(model.stage, 1):
        margins = F.array(*[F.lit(c[0]) * F.col("x")[0] + F.lit(i) for c, i in zip(fitted.coef, fitted.intercept)])
        odds = F.transform(margins, lambda m: F.exp(m - F.array_max(margins)))
        total = F.aggregate(odds, F.lit(0.0), lambda a, o: a + o)
        wrong = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(c[0]).alias("coef"), (odds[s] / total - (F.col("y_stage") == s).cast("double")).alias("error"))
                          for s, c in enumerate(fitted.coef)])
        errors = rows.where(F.col("step") == k).select(F.col("x")[0].alias("at"), "y_stage", F.inline(wrong))
        left = errors.groupBy("stage").agg(F.count_if(F.col("y_stage") == F.col("stage")).alias("samples"), F.sum("error").alias("intercept"),
                                           (F.sum(F.col("error") * F.col("at")) + F.max("coef")).alias("slope")).where("samples > 0")
        left = left.select(F.lit(k).alias("step"), "stage", "samples", *[r4(F.abs(F.col(c))).alias(c) for c in ("intercept", "slope")])
        out = left if out is None else out.unionByName(left)
    return out


H4_EQUATIONS = f"""WITH RECURSIVE {ONE_FEATURE}
SELECT step, stage, count(*) AS samples, 0.0::DOUBLE AS intercept, 0.0::DOUBLE AS slope FROM labelled GROUP BY step, stage"""


def g7_fitted(spark: SparkSession, sf: str) -> DataFrame:
    """The class-balanced baseline on one feature: is a document of quality 1, by its length?"""
    labels, docs = table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", "n_chars")
    rows = staged(labels.join(docs, "doc_id").select("doc_id", F.array(F.col("n_chars") / 1000.0).alias("features"), F.col("quality").cast("int").alias("y")))
    return predict(rows, fit_baseline(rows)).select("doc_id", "y", r4(F.col("score")).alias("score"), "predicted")


G7_FITTED = f"""WITH RECURSIVE given AS (SELECT doc_id, n_chars / 1000.0 AS x, CAST(quality AS INTEGER) AS y, 1 AS one FROM labels JOIN documents USING (doc_id)
  WHERE quality IS NOT NULL),
sizes AS (SELECT count(*) / (2.0 * sum(y)) AS w1, count(*) / (2.0 * sum(1 - y)) AS w0 FROM given),
weighted AS (SELECT one, x, y, CASE y WHEN 1 THEN w1 ELSE w0 END AS w FROM given, sizes),
{newton_sql("weighted", "one", "r.w").strip()}
SELECT doc_id, y, {sql_r4("1 / (1 + exp(-(b0 + b1 * x)))")} AS score, CAST(b0 + b1 * x > 0 AS INTEGER) AS predicted FROM given, coef"""


def h10_components(spark: SparkSession, sf: str) -> DataFrame:
    """The squared error of all restored vectors, against what the kept axes can't hold: total spread less the spread of the latent numbers."""
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    out = compress(vectors, 8)
    error = F.aggregate(F.zip_with("features", "restored", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, p: t + p)
    kept = F.aggregate("latent", F.lit(0.0), lambda t, p: t + p * p)
    return out.agg(F.count("*").alias("vectors"), r4((F.sum(error) + F.sum(kept)) / F.count("*")).alias("spread"))


H10 = f"""WITH cells AS (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
axis AS (SELECT i, var_pop(v) AS spread FROM cells GROUP BY i)
SELECT (SELECT count(*) FROM embeddings) AS vectors, {sql_r4("sum(spread)")} AS spread FROM axis"""


ENTRIES = {
    "G7_baseline_fitted": (g7_fitted, G7_FITTED),
    "G8_replay_fitted": (g8_fitted, G8_FITTED),
    "H3_risk_fitted": (h3_risk_fitted, H3_FITTED),
    "H4_score_equations": (h4_score_equations, H4_EQUATIONS),
    "H5_forecast_fitted": (h5_fitted, _summary_sql(2, "step <= 2")),
    "H6_latest_fitted": (h6_fitted, _summary_sql(3, "latest")),
    "H7_all_fitted": (h7_fitted, _summary_sql(3, "true")),
    "H10_components": (h10_components, H10),
    "G8_replay": (g8_replay, None),
    "G8_replay_report": (g8_replay_report, None),
    "G10_evaluate": (g10_evaluate, None),
    "H1_transition": (h1_transition, f"WITH {AR1} SELECT {sql_r4('a')} AS intercept, {sql_r4('b')} AS slope FROM fit"),
    "H1_transition_wide": (h1_transition_wide, None),
    "H2_rollout": (h2_rollout, H2),
    "H3_head_inputs": (h3_head_inputs, H3),
    "H3_risk": (h3_risk, None),
    "H4_stage": (h4_stage, None),
    "H5_forecast": (h5_forecast, None),
    "H6_forecast_latest": (h6_latest, None),
    "H7_forecast_all": (h7_all, None),
    "H8_persistence": (h8_persistence, H8),
    "H9_attribution": (h9_attribution, H9),
    "H10_compress": (h10_compress, None),
    "U1_custom_forecaster": (u1_custom, U1),
    "U2_custom_attribution": (u2_custom_attribution, H9),
}
