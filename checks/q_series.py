"""Inventory E and F: ordered operators, positional joins, sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.adapters import (
    DAY, HOUR, SCORED_DAYS, TRAFFIC, USER_DAYS, r4, scored_days, sql_r4, staged, table, traffic_events, user_days,
)
from checks.q_windows import HOURS
from tidewatch.operators.explain import by_size, flagged_records, top_features
from tidewatch.operators.features import features_array
from tidewatch.operators.metrics import FIXED_THRESHOLDS
from tidewatch.operators.runs import label_runs, last_alert, lead_summary, lead_times
from tidewatch.operators.series import (
    align, at_origins, attach_labels, latest_context, require_history, sample_origins, sequences, series_index,
)
from tidewatch.operators.windows import assign_windows, tumbling_features
from tidewatch.schema import FEATURES
from tidewatch.session import join_small
from tidewatch.sources.flows import union_sources

L, K = 5, 3


def _pairs(days: DataFrame) -> DataFrame:
    return days.withColumn("features", F.array("flow_bytes", F.col("event_count").cast("double")))


def e1_sequences(spark: SparkSession, sf: str) -> DataFrame:
    histories = sequences(_pairs(user_days(spark, sf)), L, ["user_id"])
    return histories.select("user_id", "origin_idx", F.posexplode("history").alias("at", "f")) \
        .select("user_id", "origin_idx", "at", r4(F.col("f")[0]).alias("flow_bytes"), F.col("f")[1].alias("events"))


E1 = f"""WITH {USER_DAYS}
SELECT o.user_id, o.idx AS origin_idx, CAST(d.idx - o.idx + {L - 1} AS INTEGER) AS at, {sql_r4("d.flow_bytes")} AS flow_bytes,
       CAST(d.event_count AS DOUBLE) AS events
FROM days o JOIN days d ON o.user_id = d.user_id AND d.idx BETWEEN o.idx - {L - 1} AND o.idx WHERE o.idx >= {L - 1}"""


def e1_sequences_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Histories of one single series of hourly windows."""
    hours = staged(series_index(tumbling_features(traffic_events(spark, sf, keys=()), HOUR)))
    histories = sequences(hours.withColumn("features", F.array("flow_bytes")), 12)
    return histories.select("origin_idx", r4(F.aggregate("history", F.lit(0.0), lambda a, x: a + x[0])).alias("bytes"))


E1_WHOLE = f"""WITH {HOURS},
hours AS (SELECT row_number() OVER (ORDER BY win_idx) - 1 AS idx, b FROM (SELECT win_idx, sum(bytes) AS b FROM placed GROUP BY win_idx))
SELECT o.idx AS origin_idx, {sql_r4("sum(h.b)")} AS bytes FROM hours o JOIN hours h ON h.idx BETWEEN o.idx - 11 AND o.idx
WHERE o.idx >= 11 GROUP BY o.idx"""


def e2_align(spark: SparkSession, sf: str) -> DataFrame:
    return align(user_days(spark, sf), K, ["user_id"], first_origin=L - 1)


E2 = f"""WITH {USER_DAYS}, size AS (SELECT user_id, max(idx) AS last FROM days GROUP BY user_id)
SELECT o.user_id, o.idx AS origin_idx, CAST(t.idx - o.idx AS INTEGER) AS step, t.idx AS target_idx, t.stage AS label,
       CAST(t.stage > 0 AS INTEGER) AS actual_risk, t.stage AS actual_stage
FROM days o JOIN days t ON o.user_id = t.user_id AND t.idx BETWEEN o.idx + 1 AND o.idx + {K} JOIN size s ON s.user_id = o.user_id
WHERE o.idx >= {L - 1} AND o.idx + {K} <= s.last"""


def e2_attach_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Forecast rows of every origin, also those running past the end of the series."""
    days = user_days(spark, sf)
    rows = days.select("user_id", F.col("idx").alias("origin_idx"), F.explode(F.array(*map(F.lit, range(1, K + 1)))).alias("step"))
    return attach_labels(rows, days, ["user_id"], semantics="binary_attack")


E2_ATTACH = f"""WITH {USER_DAYS}
SELECT o.user_id, o.idx AS origin_idx, CAST(k AS INTEGER) AS step, o.idx + k AS target_idx, t.stage AS label,
       CAST(t.stage > 0 AS INTEGER) AS actual_risk, CAST(NULL AS INTEGER) AS actual_stage
FROM days o, generate_series(1, {K}) g(k) LEFT JOIN days t ON o.user_id = t.user_id AND t.idx = o.idx + k"""


def e3_flagged(spark: SparkSession, sf: str) -> DataFrame:
    days = user_days(spark, sf)
    events = assign_windows(traffic_events(spark, sf, keep=["event_id"]), DAY, ["user_id"])
    members = join_small(events.select("user_id", "event_id", "win_idx"), days.select("user_id", "win_idx", "idx"),
                         ["user_id", "win_idx"]).select("user_id", "event_id", "idx")
    scores = days.select("user_id", F.col("idx").alias("position"), (F.round("flow_bytes", 2) / 200).alias("score"))
    return flagged_records(scores, members, 0.5, L, ["user_id"]).select("user_id", "flag_position", "idx", "event_id")


E3 = f"""WITH {USER_DAYS}, size AS (SELECT user_id, max(idx) AS last FROM days GROUP BY user_id)
SELECT d.user_id, d.idx AS flag_position, t.idx, p.event_id
FROM days d JOIN size s ON s.user_id = d.user_id JOIN days t ON t.user_id = d.user_id AND t.idx = least(d.idx + {L - 1}, s.last)
JOIN placed p ON p.user_id = t.user_id AND p.win_idx = t.win_idx WHERE round(d.flow_bytes, 2) / 200 >= 0.5"""


def e4_runs(spark: SparkSession, sf: str) -> DataFrame:
    return label_runs(scored_days(spark, sf), ["user_id"])


RUNS = f"""{SCORED_DAYS},
edges AS (SELECT *, y = 1 AND coalesce(lag(y) OVER w, 0) = 0 AS onset FROM scored WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
numbered AS (SELECT *, sum(CAST(onset AS INTEGER)) OVER (PARTITION BY user_id ORDER BY idx) AS run FROM edges),
runs AS (SELECT user_id, CAST(run AS BIGINT) AS run, min(idx) AS onset, max(idx) AS "end" FROM numbered WHERE y = 1 GROUP BY user_id, run),
bounded AS (SELECT *, lag("end") OVER (PARTITION BY user_id ORDER BY run) AS previous FROM runs),
alerts AS (SELECT r.user_id, r.onset, max(s.idx) AS alert_idx FROM bounded r LEFT JOIN scored s
           ON s.user_id = r.user_id AND s.score >= 0.25 AND s.idx < r.onset AND s.idx > coalesce(r.previous, -1) GROUP BY r.user_id, r.onset)"""


def e5_last_alert(spark: SparkSession, sf: str) -> DataFrame:
    return last_alert(scored_days(spark, sf), 0.25, ["user_id"])


def e6_lead_time(spark: SparkSession, sf: str) -> DataFrame:
    summary = lead_summary(lead_times(scored_days(spark, sf), 0.25, 86_400.0, 1, ["user_id"]), ["user_id"])
    return summary.select("user_id", "events", "warned", r4(F.col("warning_rate")).alias("warning_rate"),
                          r4(F.col("mean_lead_seconds")).alias("mean_lead_seconds"))


E6 = f"""WITH {RUNS}
SELECT user_id, count(*) AS events, count(alert_idx) AS warned, {sql_r4("count(alert_idx) / count(*)")} AS warning_rate,
       {sql_r4("avg((onset - (alert_idx - 1)) * 86400.0::DOUBLE)")} AS mean_lead_seconds FROM alerts GROUP BY user_id"""


def e7_latest(spark: SparkSession, sf: str) -> DataFrame:
    return latest_context(user_days(spark, sf), 7, ["user_id"]).select("user_id", "idx", r4(F.col("flow_bytes")).alias("flow_bytes"))


E7 = f"""WITH {USER_DAYS} SELECT user_id, idx, {sql_r4("flow_bytes")} AS flow_bytes FROM days
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY idx DESC) <= 7"""


def e8_origins(spark: SparkSession, sf: str) -> DataFrame:
    return sample_origins(user_days(spark, sf), 4, L, K, ["user_id"])


ORIGINS = f"""
avail AS (SELECT user_id, max(idx) + 1 - {K} - {L - 1} AS n FROM days GROUP BY user_id),
origins AS (SELECT user_id, {L - 1} + CASE WHEN i = least(n, 4) - 1 AND n > 1 THEN n - 1
                   ELSE CAST(floor(CAST(i AS DOUBLE) * (CAST(n - 1 AS DOUBLE) / greatest(least(n, 4) - 1, 1))) AS BIGINT) END AS origin_idx
            FROM avail, generate_series(0, 3) g(i) WHERE n > 0 AND i < least(n, 4))"""


def e8_at_origins(spark: SparkSession, sf: str) -> DataFrame:
    days = user_days(spark, sf)
    histories = sequences(_pairs(days), L, ["user_id"])
    picked = at_origins(histories, sample_origins(days, 4, L, K, ["user_id"]), ["user_id"])
    return picked.select("user_id", "origin_idx", r4(F.element_at("history", -1)[0]).alias("flow_bytes"))


E8_AT = f"""WITH {USER_DAYS}, {ORIGINS}
SELECT user_id, origin_idx, {sql_r4("flow_bytes")} AS flow_bytes FROM origins JOIN days USING (user_id) WHERE idx = origin_idx"""


def e9_history(spark: SparkSession, sf: str) -> DataFrame:
    """Users with at least 25 + 3 days."""
    return require_history(user_days(spark, sf), 25, K, ["user_id"]).select("user_id", "idx")


E9 = f"""WITH {USER_DAYS}
SELECT user_id, idx FROM days WHERE user_id IN (SELECT user_id FROM days GROUP BY user_id HAVING count(*) >= {25 + K})"""


def f1_sort(spark: SparkSession, sf: str) -> DataFrame:
    return traffic_events(spark, sf, keep=["event_id"]).select("event_id", "ts_us", "bytes").orderBy("ts_us", "event_id")


def f2_top_features(spark: SparkSession, sf: str) -> DataFrame:
    days = user_days(spark, sf)
    parts = F.array(*[F.struct(F.lit(f).alias("name"), r4(F.col(f)).alias("contribution")) for f in FEATURES])
    rows = days.select("user_id", "idx", by_size(parts).alias("contributions"))
    return top_features(rows, 5)


F2 = f"""WITH {USER_DAYS}, long AS (UNPIVOT (SELECT user_id, idx, {", ".join(f"{sql_r4(f)} AS {f}" for f in FEATURES)} FROM days)
  ON {", ".join(FEATURES)} INTO NAME feature VALUE contribution),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, idx ORDER BY abs(contribution) DESC, feature) AS r FROM long)
SELECT user_id, idx, CAST(r AS INTEGER) AS rank, feature, contribution FROM ranked WHERE r <= 5"""


def f3_union(spark: SparkSession, sf: str) -> DataFrame:
    """Events and line items as one set of records; what only one of them has is NULL in the other."""
    first = table(spark, sf, "events").select(F.col("value").alias("Tot Bytes"), "event_type")
    second = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("tot-bytes"), F.col("l_quantity").alias("packets"))
    both = union_sources([first, second])
    return both.groupBy("event_type").agg(F.count("*").alias("records"), r4(F.sum("tot_bytes")).alias("bytes"),
                                          r4(F.sum("packets")).alias("packets"))


F3 = f"""
SELECT event_type, count(*) AS records, {sql_r4("sum(b)")} AS bytes, {sql_r4("sum(p)")} AS packets
FROM (SELECT event_type, value AS b, CAST(NULL AS DOUBLE) AS p FROM events
      UNION ALL SELECT NULL, l_extendedprice, l_quantity FROM lineitem) GROUP BY event_type"""


def f4_candidates(spark: SparkSession, sf: str) -> DataFrame:
    scores = table(spark, sf, "events").select(F.least(F.col("value") / 50, F.lit(1.0)).alias("threshold"))
    fixed = spark.createDataFrame([(t,) for t in FIXED_THRESHOLDS], "threshold double")
    return scores.unionByName(fixed).distinct()


ENTRIES = {
    "E1_sequences": (e1_sequences, E1),
    "E1_sequences_whole": (e1_sequences_whole, E1_WHOLE),
    "E2_align": (e2_align, E2),
    "E2_attach_labels": (e2_attach_labels, E2_ATTACH),
    "E3_flagged_records": (e3_flagged, E3),
    "E4_label_runs": (e4_runs, f'WITH {RUNS} SELECT user_id, run, onset, "end" FROM runs'),
    "E5_last_alert": (e5_last_alert, f"WITH {RUNS} SELECT user_id, onset, alert_idx FROM alerts"),
    "E6_lead_time": (e6_lead_time, E6),
    "E7_latest_context": (e7_latest, E7),
    "E8_origins": (e8_origins, f"WITH {USER_DAYS}, {ORIGINS} SELECT user_id, origin_idx FROM origins"),
    "E8_at_origins": (e8_at_origins, E8_AT),
    "E9_history": (e9_history, E9),
    "F1_sort": (f1_sort, f"WITH {TRAFFIC} SELECT event_id, us AS ts_us, bytes FROM traffic ORDER BY us, event_id"),
    "F2_top_features": (f2_top_features, F2),
    "F3_union": (f3_union, F3),
    "F4_candidates": (f4_candidates, "SELECT DISTINCT threshold FROM (SELECT least(value / 50, 1.0) AS threshold FROM events UNION ALL VALUES (0.0), (0.5), (0.7), (0.9), (1.0))"),
}
