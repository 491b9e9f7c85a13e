"""Events -> daily windows per user -> standardised features -> alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.adapters import DAY, DAY_US, TRAFFIC, feature_sql, r4, sql_r4, traffic_events
from tidewatch.functions.labels import alerts
from tidewatch.operators.scaling import fit_scaler, scale
from tidewatch.operators.windows import tumbling_features
from tidewatch.session import staged

SCORE = ("flow_bytes", "rst_count", "port_diversity")


def abnormal_days(spark: SparkSession, sf: str) -> DataFrame:
    windows = staged(tumbling_features(traffic_events(spark, sf), DAY, ["user_id"], anchor="dataset"))
    scaled = scale(windows, fit_scaler(windows, SCORE), SCORE)
    loud = sum((F.abs(F.col(f)) for f in SCORE[1:]), F.abs(F.col(SCORE[0])))
    scored = scaled.withColumn("score", 1 - 1 / (1 + loud / 3))
    return alerts(scored, 0.5).select("user_id", "win_idx", "event_count", "stage",
                                      *[r4(F.col(f)).alias(f) for f in SCORE], r4(F.col("shown_score")).alias("score"))


def _z(f: str) -> str:
    return f"({f} - (SELECT avg({f}) FROM feat)) / (SELECT CASE WHEN stddev_pop({f}) < 1e-8 THEN 1 ELSE stddev_pop({f}) END FROM feat)"


SQL = f"""WITH {TRAFFIC},
placed AS (SELECT t.*, (us - t0) // {DAY_US} AS win_idx FROM traffic t, (SELECT min(us) AS t0 FROM traffic)),
{feature_sql("placed", "user_id, win_idx").strip()},
z AS (SELECT user_id, win_idx, event_count, stage, {", ".join(f"{_z(f)} AS {f}" for f in SCORE)} FROM feat),
scored AS (SELECT *, 1 - 1 / (1 + ({" + ".join(f"abs({f})" for f in SCORE)}) / 3) AS score FROM z)
SELECT user_id, win_idx, event_count, stage, {", ".join(f"{sql_r4(f)} AS {f}" for f in SCORE)}, {sql_r4("score")} AS score
FROM scored WHERE score >= 0.5"""

ENTRIES = {"flagship_abnormal_days": (abnormal_days, SQL)}
