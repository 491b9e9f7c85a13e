"""Inventory G: metrics and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.adapters import SCORED_EVENTS, r4, rounded, scored_events, sql_r4, table
from tidewatch.operators.heads import evaluate_baseline, fit_baseline, predict
from tidewatch.operators.metrics import (
    binary_metrics, calibrate, compare, horizon_metrics, probability_metrics, ranking_metrics, replay_metrics,
    stage_accuracy, threshold_table,
)
from tidewatch.operators.profile import assess
from tidewatch.schema import SUPERVISION_MARK

SHARES = ("precision", "recall", "f1", "fpr", "roc_auc", "pr_auc")


def confusion_sql(source: str, by: str, predicted: str) -> str:
    return f"""
counts AS (SELECT {by}, count(*) FILTER (WHERE y = 1 AND {predicted}) AS tp, count(*) FILTER (WHERE y = 0 AND {predicted}) AS fp,
                  count(*) FILTER (WHERE y = 1 AND NOT ({predicted})) AS fn, count(*) FILTER (WHERE y = 0 AND NOT ({predicted})) AS tn
           FROM {source} GROUP BY {by}),
shares AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1,
                  fp / nullif(fp + tn, 0) AS fpr FROM counts)"""


def ranking_sql(source: str, by: str) -> str:
    return f"""
steps AS (SELECT {by}, score, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM {source} WHERE y IS NOT NULL GROUP BY {by}, score),
falling AS (SELECT *, sum(pos) OVER w AS tp_at, sum(neg) OVER w AS fp_at FROM steps WINDOW w AS (PARTITION BY {by} ORDER BY score DESC)),
ranking AS (SELECT {by}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN 1 - sum(pos * (fp_at - neg / 2)) / (sum(pos) * sum(neg)) END AS roc_auc,
                   CASE WHEN sum(pos) > 0 THEN sum(pos * tp_at / (tp_at + fp_at)) / sum(pos) END AS pr_auc FROM falling GROUP BY {by})"""


def g1_horizon_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(horizon_metrics(scored_events(spark, sf), 0.5), *SHARES)


G1 = f"""WITH {SCORED_EVENTS}, {confusion_sql("pairs", "horizon", "score >= 0.5")}, {ranking_sql("pairs", "horizon")}
SELECT horizon, tp + fp + fn + tn AS samples, tp, fp, fn, tn, {", ".join(f"{sql_r4(c)} AS {c}" for c in SHARES)}, CAST(0 AS BIGINT) AS missing_labels
FROM shares JOIN ranking USING (horizon)"""


def g2_binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    pairs = scored_events(spark, sf).withColumn("predicted", (F.col("score") >= 0.9).cast("int"))
    return rounded(binary_metrics(pairs, ["horizon"]), *SHARES[:4])


G2 = f"""WITH {SCORED_EVENTS}, {confusion_sql("pairs", "horizon", "score >= 0.9")}
SELECT horizon, tp, fp, fn, tn, {", ".join(f"{sql_r4(f'coalesce({c}, 0)')} AS {c}" for c in SHARES[:4])} FROM shares"""


def g2_probability_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(probability_metrics(scored_events(spark, sf), 0.3), *SHARES).drop("missing_labels")


G2_PROB = f"""WITH {SCORED_EVENTS}, one AS (SELECT 1 AS g, * FROM pairs), {confusion_sql("one", "g", "score >= 0.3")}, {ranking_sql("one", "g")}
SELECT tp + fp + fn + tn AS samples, tp, fp, fn, tn, {", ".join(f"{sql_r4(c)} AS {c}" for c in SHARES)} FROM shares JOIN ranking USING (g)"""


def g3_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranking_metrics(scored_events(spark, sf), ["horizon"]), "roc_auc", "pr_auc")


def g3_ranking_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Does the length of a document rank its quality and toxicity labels?"""
    labels, documents = table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", "n_chars")
    joined = labels.join(documents, "doc_id").withColumn("score", F.col("n_chars") / (F.col("n_chars") + 1000))
    kinds = F.array(F.struct(F.lit("quality").alias("target"), F.col("quality").alias("y")),
                    F.struct(F.lit("toxic").alias("target"), F.col("toxic").alias("y")))
    pairs = joined.select("score", F.inline(kinds))
    return rounded(ranking_metrics(pairs, ["target"]), "roc_auc", "pr_auc")


G3_DOCS = f"""WITH joined AS (SELECT quality, toxic, n_chars / (n_chars + 1000) AS score FROM labels JOIN documents USING (doc_id)),
pairs AS (SELECT 'quality' AS target, quality AS y, score FROM joined UNION ALL SELECT 'toxic', toxic, score FROM joined),
{ranking_sql("pairs", "target")} SELECT target, {sql_r4("roc_auc")} AS roc_auc, {sql_r4("pr_auc")} AS pr_auc FROM ranking"""


def g4_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    out = threshold_table(scored_events(spark, sf), ["horizon"])
    return rounded(out.drop("rank"), "precision", "recall", "f1", "fpr")


CANDIDATES = f"""WITH {SCORED_EVENTS},
seen AS (SELECT DISTINCT horizon, score AS threshold FROM pairs),
cand AS (SELECT horizon, threshold, min(r) AS r FROM (
  SELECT horizon, threshold, CASE WHEN threshold = 0 THEN 0 ELSE 1 END AS r FROM seen
  UNION ALL SELECT horizon, f, CASE WHEN f = 0 THEN 0 ELSE 2 END FROM (SELECT DISTINCT horizon FROM pairs), (VALUES (0.0), (0.5), (0.7), (0.9), (1.0)) v(f))
  GROUP BY horizon, threshold),
c AS (SELECT horizon, threshold, r, sum(y) AS tp, sum(1 - y) AS fp, any_value(p) - coalesce(sum(y), 0) AS fn, any_value(n) - coalesce(sum(1 - y), 0) AS tn
      FROM (SELECT cand.*, t.p, t.n, e.y FROM cand JOIN (SELECT horizon, sum(y) AS p, sum(1 - y) AS n FROM pairs GROUP BY horizon) t USING (horizon)
            LEFT JOIN pairs e ON e.horizon = cand.horizon AND e.score >= cand.threshold) GROUP BY ALL),
thr AS (SELECT horizon, threshold, r, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(fp, 0) AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn FROM c),
rated AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
                 coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr FROM thr)"""
G4_TABLE = f"""{CANDIDATES} SELECT horizon, threshold, tp, fp, fn, tn, {", ".join(f"{sql_r4(c)} AS {c}" for c in SHARES[:4])} FROM rated"""


def g4_calibrate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(calibrate(scored_events(spark, sf), 0.2, ["horizon"]), "f1")


G4 = f"""{CANDIDATES} SELECT horizon, threshold, {sql_r4("f1")} AS f1 FROM rated WHERE recall >= 0.2
QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY f1 DESC, r, threshold) = 1"""


def g5_stage_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stage_accuracy(scored_events(spark, sf)), "stage_accuracy")


G5 = f"""WITH {SCORED_EVENTS}
SELECT horizon, {sql_r4("avg(CAST(pred_stage = actual_stage AS DOUBLE))")} AS stage_accuracy, count(actual_stage) AS stage_samples,
       count(*) - count(actual_stage) AS missing_stages FROM pairs GROUP BY horizon"""


def g5_replay_metrics(spark: SparkSession, sf: str) -> DataFrame:
    aligned = scored_events(spark, sf).select(
        F.col("horizon").alias("step"), F.when(F.col("actual_stage").isNotNull(), F.col("y")).alias("actual_risk"),
        F.col("score").alias("risk"), "pred_stage", "actual_stage")
    return rounded(replay_metrics(aligned, 0.5), *SHARES, "stage_accuracy")


G5_REPLAY = f"""WITH {SCORED_EVENTS}, aligned AS (SELECT * REPLACE (CASE WHEN actual_stage IS NOT NULL THEN y END AS y) FROM pairs),
{confusion_sql("aligned", "horizon", "score >= 0.5")}, {ranking_sql("aligned", "horizon")},
stages AS (SELECT horizon, avg(CAST(pred_stage = actual_stage AS DOUBLE)) AS a, count(actual_stage) AS stage_samples, count(*) - count(actual_stage) AS missing_labels
           FROM pairs GROUP BY horizon)
SELECT horizon AS step, tp + fp + fn + tn AS samples, tp, fp, fn, tn, {", ".join(f"{sql_r4(c)} AS {c}" for c in SHARES)}, missing_labels, stage_samples,
       {sql_r4("a")} AS stage_accuracy FROM shares JOIN ranking USING (horizon) JOIN stages USING (horizon)"""


def g6_compare(spark: SparkSession, sf: str) -> DataFrame:
    pairs = scored_events(spark, sf)
    high, low = (binary_metrics(pairs.withColumn("predicted", (F.col("score") >= t).cast("int")), ["horizon"]) for t in (0.8, 0.2))
    return rounded(compare(high, low, ("strict", "lax"), ["horizon"]), "strict", "lax")


def _g6() -> str:
    sides = {}
    for name, t in (("strict", 0.8), ("lax", 0.2)):
        sides[name] = confusion_sql("pairs", "horizon", f"score >= {t}").replace("counts", f"counts_{name}").replace("shares AS", f"shares_{name} AS")
    rows = " UNION ALL ".join(
        f"SELECT horizon, '{m}' AS metric, {sql_r4(f'coalesce(a.{m}, 0)')} AS strict, {sql_r4(f'coalesce(b.{m}, 0)')} AS lax FROM shares_strict a JOIN shares_lax b USING (horizon)"
        for m in ("f1", "precision", "recall", "fpr"))
    return f"WITH {SCORED_EVENTS}, {sides['strict']}, {sides['lax']} {rows}"


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("features"), (F.col("label") >= 5).cast("int").alias("y"))


def g7_baseline(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _vectors(spark, sf)
    return predict(vectors, fit_baseline(vectors)).select("vec_id", "y", r4(F.col("score")).alias("score"), "predicted")


def g7_evaluate_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate_baseline(_vectors(spark, sf)), *SHARES[:4])


def g9_assess(spark: SparkSession, sf: str) -> DataFrame:
    """Data assessment of one metadata record per customer."""
    customers = table(spark, sf, "customer")
    odd = F.col("c_custkey") % 2 == 1
    windowing = F.when(F.col("c_custkey") % 3 != 0, F.struct(
        F.col("c_mktsegment").alias("method"), odd.alias("timestamp_used"),
        F.when(F.col("c_custkey") % 5 != 0, F.lit(True)).alias("timestamp_order_verified")))
    meta = customers.select("c_custkey", windowing.alias("windowing"), F.when(F.col("c_nationkey") < 12, SUPERVISION_MARK).alias("supervision"))
    return assess(meta).drop("windowing", "supervision")


G9 = """
SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE 'legacy_unknown' END AS windowing_method, v AS verified_temporal_order,
       CASE WHEN v THEN 'chronological_forecast_evaluation' ELSE 'row_order_label_replay_not_validated_as_temporal_forecasting' END AS interpretation,
       c_nationkey < 12 AS horizon_supervision_valid
FROM (SELECT *, c_custkey % 3 <> 0 AND c_custkey % 2 = 1 AND c_custkey % 5 <> 0 AS v FROM customer)"""

ENTRIES = {
    "G1_horizon_metrics": (g1_horizon_metrics, G1),
    "G2_binary_metrics": (g2_binary_metrics, G2),
    "G2_probability_metrics": (lambda spark, sf: g2_probability_metrics(spark, sf), G2_PROB),
    "G3_ranking": (g3_ranking, f"WITH {SCORED_EVENTS}, {ranking_sql('pairs', 'horizon')} SELECT horizon, {sql_r4('roc_auc')} AS roc_auc, {sql_r4('pr_auc')} AS pr_auc FROM ranking"),
    "G3_ranking_documents": (g3_ranking_documents, G3_DOCS),
    "G4_thresholds": (g4_thresholds, G4_TABLE),
    "G4_calibrate": (g4_calibrate, G4),
    "G5_stage_accuracy": (g5_stage_accuracy, G5),
    "G5_replay_metrics": (g5_replay_metrics, G5_REPLAY),
    "G6_compare": (g6_compare, _g6()),
    "G7_baseline": (g7_baseline, None),
    "G7_evaluate_baseline": (g7_evaluate_baseline, None),
    "G9_assess": (g9_assess, G9),
}
