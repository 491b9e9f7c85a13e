"""Inventory C and D: windows and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.adapters import (
    DAY, DAY_US, FLOWS, HOUR, SUPPLIER_MONTHS, TRAFFIC, USER_DAYS, feature_sql, flows, r4, rounded, rounded_features,
    rounded_sql, sql_r4, supplier_months, table, traffic, traffic_events, user_days,
)
from tidewatch.operators.canonical import canonical_events
from tidewatch.operators.forecast import prefix_max, trend
from tidewatch.operators.profile import label_semantics, profile
from tidewatch.operators.regrid import regrid_features
from tidewatch.operators.scaling import (
    collect_scaler, fit_scaler, rescale, scale, scaler_from_json, scaler_to_json, unscale,
)
from tidewatch.operators.series import align, row_time, series_index
from tidewatch.operators.windows import (
    assign_windows, rowgroup_features, sliding_features, tumbling_features, window_sample,
)
from tidewatch.schema import BATCH, COLUMNAR, FEATURES, ONLINE

HOUR_US = 3_600_000_000


def c1_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_features(tumbling_features(traffic_events(spark, sf, keys=()), HOUR), "win_idx")


HOURS = f"""{TRAFFIC},
placed AS (SELECT t.*, (us - t0) // {HOUR_US} AS win_idx, t0 + (us - t0) // {HOUR_US} * {HOUR_US} AS start_us
           FROM traffic t, (SELECT min(us) AS t0 FROM traffic))"""
C1 = f"""WITH {HOURS}, {feature_sql("placed", "win_idx, start_us").strip()}
SELECT win_idx, start_us, start_us + {HOUR_US} AS end_us, {rounded_sql()}, event_count, stage, risk FROM feat"""


def c1_tumbling_by_user(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_features(tumbling_features(traffic_events(spark, sf), DAY, ["user_id"]), "user_id", "win_idx")


C1_USER = f"""WITH {USER_DAYS}
SELECT user_id, win_idx, start_us, start_us + {DAY_US} AS end_us, {rounded_sql()}, event_count, stage, risk FROM days"""


def c1_tumbling_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Batch semantics: missing values are left out, list cells count in full."""
    events = canonical_events(flows(spark, sf), keys=["l_suppkey"], options=BATCH)
    return rounded_features(tumbling_features(events, 90 * DAY, ["l_suppkey"], anchor="dataset", options=BATCH), "l_suppkey", "win_idx")


C1_BATCH = f"""WITH {FLOWS},
placed AS (SELECT t.*, (us - t0) // {90 * DAY_US} AS win_idx, t0 + (us - t0) // {90 * DAY_US} * {90 * DAY_US} AS start_us
           FROM traffic t, (SELECT min(us) AS t0 FROM traffic)),
{feature_sql("placed", "l_suppkey, win_idx, start_us", skip=True).strip()}
SELECT l_suppkey, win_idx, start_us, start_us + {90 * DAY_US} AS end_us, {rounded_sql()}, event_count, stage, risk FROM feat"""


def c2_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_features(sliding_features(traffic_events(spark, sf, keys=()), 3 * HOUR, HOUR / 2), "win_idx")


def _sliding_sql(width: int, stride: int) -> str:
    return f"""WITH {TRAFFIC},
span AS (SELECT min(us) AS t0, max(us) AS t1 FROM traffic),
grid AS (SELECT i AS win_idx, t0 + i * {stride} AS start_us FROM span, generate_series(0, (t1 - t0) // {stride}) g(i)),
placed AS (SELECT t.*, win_idx, start_us FROM grid JOIN traffic t ON us >= start_us AND us < start_us + {width}),
{feature_sql("placed", "win_idx, start_us").strip()}
SELECT win_idx, start_us, start_us + {width} AS end_us, {rounded_sql()}, event_count, stage, risk FROM feat"""


def c2_gapped_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_features(sliding_features(traffic_events(spark, sf, keys=()), HOUR, 2 * HOUR), "win_idx")


def c3_regrid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_features(regrid_features(traffic_events(spark, sf), 6 * HOUR, 15 * HOUR, ["user_id"]), "user_id")


WIDTH, STRIDE = 6 * HOUR_US, 15 * HOUR_US
GRID = f"""
grid AS (
  SELECT user_id, min(us) AS start_us FROM traffic GROUP BY user_id
  UNION ALL
  SELECT n.user_id, n.us - ((n.us - n.start_us) % {STRIDE}) % {WIDTH}
  FROM (SELECT g.user_id, g.start_us, (SELECT min(t.us) FROM traffic t WHERE t.user_id = g.user_id AND t.us >= g.start_us + {WIDTH}) AS us
        FROM grid g) n WHERE n.us IS NOT NULL)"""
C3 = f"""WITH RECURSIVE {TRAFFIC}, {GRID},
placed AS (SELECT t.*, g.start_us FROM traffic t JOIN grid g ON t.user_id = g.user_id AND us >= start_us AND us < start_us + {WIDTH}),
{feature_sql("placed", "user_id, start_us").strip()}
SELECT user_id, start_us, start_us + {WIDTH} AS end_us, {rounded_sql()}, event_count, stage, risk FROM feat"""


def _large(spark: SparkSession, sf: str, lists: bool = False) -> DataFrame:
    """Traffic whose gaps and window sizes lie around 1e12 and 1e9 and differ little; with `lists` three gaps in a cell."""
    rows = traffic(table(spark, sf, "events"))
    gap = F.lit(1e12) + F.col("iat") * 1e6
    return canonical_events(rows.withColumns({
        "window_size": F.lit(1e9) + F.col("iat"), "iat": F.array(gap, gap + 1e6, gap + 5e6) if lists else gap}), keys=["user_id"], options=BATCH if lists else ONLINE)


def _spread(windows: DataFrame) -> DataFrame:
    """Means and variances of large numbers, to six figures or more."""
    return windows.select("user_id", F.unix_micros("win_start").alias("start_us"), "event_count",
                          r4(F.col("iat_mean") / 1e12).alias("gap_mean"), F.round(F.col("iat_variance") / 1e12 + 1e-5, 3).alias("gap_variance"),
                          r4(F.col("iat_max") / 1e12).alias("gap_max"), r4(F.col("tcp_window_mean") / 1e9).alias("size_mean"),
                          F.round(F.col("tcp_window_variance") + 1e-5, 3).alias("size_variance"), r4(F.col("flow_bytes")).alias("bytes"))


# Variances don't change with what is added to all numbers: the SQL takes those of the small parts.
def _spread_sql(member: str, gaps: str = "[iat]") -> str:
    return f"""
large AS (SELECT user_id, start_us, iat, bytes, unnest({gaps}) AS gap, unnest(range(len({gaps}))) AS part FROM {member})
SELECT user_id, start_us, count(*) FILTER (part = 0) AS event_count, {sql_r4("1 + avg(gap) / 1e6")} AS gap_mean,
       round(var_pop(gap) + 1e-5, 3) AS gap_variance, {sql_r4("1 + max(gap) / 1e6")} AS gap_max,
       {sql_r4("1 + avg(iat) FILTER (part = 0) / 1e9")} AS size_mean, round(var_pop(iat) FILTER (part = 0) + 1e-5, 3) AS size_variance,
       {sql_r4("sum(bytes) FILTER (part = 0)")} AS bytes FROM large GROUP BY user_id, start_us"""


def c1_list_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _spread(tumbling_features(_large(spark, sf, lists=True), DAY, ["user_id"], options=BATCH))


def c2_sliding_large(spark: SparkSession, sf: str) -> DataFrame:
    return _spread(sliding_features(_large(spark, sf), 3 * DAY, DAY / 2, ["user_id"], anchor=0))


HALF = DAY_US // 2
C2_LARGE = f"""WITH {TRAFFIC},
placed AS (SELECT t.*, (us // {HALF} - i) * {HALF} AS start_us FROM traffic t, generate_series(0, 5) g(i)), {_spread_sql("placed").strip()}"""


def c2_sliding_lists(spark: SparkSession, sf: str) -> DataFrame:
    return _spread(sliding_features(_large(spark, sf, lists=True), 3 * DAY, DAY / 2, ["user_id"], anchor=0, options=BATCH))


def c3_regrid_large(spark: SparkSession, sf: str) -> DataFrame:
    return _spread(regrid_features(_large(spark, sf), 6 * HOUR, 15 * HOUR, ["user_id"]))


C3_LARGE = f"""WITH RECURSIVE {TRAFFIC}, {GRID},
placed AS (SELECT t.*, g.start_us FROM traffic t JOIN grid g ON t.user_id = g.user_id AND us >= start_us AND us < start_us + {WIDTH}),
{_spread_sql("placed").strip()}"""
LISTED = "[iat, iat + 1, iat + 5]"


def c4_row_groups(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    rows = traffic(events).drop("stage", "risk").withColumn("label", F.when(F.col("rst_count") == 1, "Attack").otherwise("Benign"))
    groups = rowgroup_features(canonical_events(rows, keep=["event_id"], labels="binary", options=COLUMNAR, timed=False),
                               "event_id", rows=512, options=COLUMNAR)
    return rounded(groups, *FEATURES)


C4 = f"""WITH {TRAFFIC.replace("traffic AS", "seen AS")},
placed AS (SELECT * REPLACE (0.0 AS fragments, 0.0 AS retransmissions, 0 AS port_a, 0 AS port_b, CAST(risk AS INTEGER) AS stage),
                  event_id // 512 AS win_idx FROM seen),
{feature_sql("placed", "win_idx", ratio_guard="floor1").strip()}
SELECT win_idx, win_idx * 512 AS win_start, win_idx * 512 + event_count AS win_end, {rounded_sql()}, event_count, stage, risk FROM feat"""


def c5_window_sample(spark: SparkSession, sf: str) -> DataFrame:
    members = assign_windows(traffic_events(spark, sf, keep=["event_id"]), DAY, ["user_id"])
    by = ["user_id", "win_idx"]
    sample = window_sample(members.select(*by, "ts_us", "event_id"), 3, by, order=["event_id"])
    return sample.select(*by, F.posexplode("sample").alias("at", "event")).select(*by, "at", "event.event_id")


C5 = f"""WITH {USER_DAYS},
late AS (SELECT user_id, win_idx, event_id, row_number() OVER (PARTITION BY user_id, win_idx ORDER BY us DESC, event_id DESC) AS r FROM placed)
SELECT user_id, win_idx, event_id, CAST(row_number() OVER (PARTITION BY user_id, win_idx ORDER BY r DESC) - 1 AS INTEGER) AS at FROM late WHERE r <= 3"""


def c6_members(spark: SparkSession, sf: str) -> DataFrame:
    members = assign_windows(traffic_events(spark, sf, keep=["event_id"]), DAY, ["user_id"])
    return members.select("user_id", "win_idx", "event_id", "bytes")


def c7_row_time(spark: SparkSession, sf: str) -> DataFrame:
    return row_time(table(spark, sf, "events").select("event_id", "value"), "event_id")


def c8_series_index(spark: SparkSession, sf: str) -> DataFrame:
    return user_days(spark, sf).select("user_id", "win_idx", "idx")


def c8_series_index_whole(spark: SparkSession, sf: str) -> DataFrame:
    """One single series over all users: hourly windows."""
    return series_index(tumbling_features(traffic_events(spark, sf, keys=()), HOUR)).select("win_idx", "idx")


C8_WHOLE = f"""WITH {HOURS} SELECT win_idx, row_number() OVER (ORDER BY win_idx) - 1 AS idx FROM (SELECT DISTINCT win_idx FROM placed)"""


def _months(*features: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return supplier_months(spark, sf).select("l_suppkey", "win_idx", *[r4(F.col(f)).alias(f) for f in features])
    return query, f"WITH {SUPPLIER_MONTHS} SELECT l_suppkey, win_idx, {rounded_sql(features)} FROM feat"


def d3_floor_ratio(spark: SparkSession, sf: str) -> DataFrame:
    events = canonical_events(flows(spark, sf), keys=["l_suppkey"], options=COLUMNAR)
    windows = tumbling_features(events, 30 * DAY, ["l_suppkey"], anchor="dataset", options=COLUMNAR)
    return windows.select("l_suppkey", "win_idx", r4(F.col("bidirectional_byte_ratio")).alias("byte_ratio"))


D3 = f"""WITH {FLOWS}
SELECT l_suppkey, (us - t0) // {30 * DAY_US} AS win_idx, {sql_r4("sum(src_bytes) / greatest(sum(dst_bytes), 1.0)")} AS byte_ratio
FROM traffic, (SELECT min(us) AS t0 FROM traffic) GROUP BY 1, 2"""


def d6_profile(spark: SparkSession, sf: str) -> DataFrame:
    report = profile(user_days(spark, sf))
    return report.select(
        "event_count", "window_count", F.unix_micros("first_time").alias("first_us"), F.unix_micros("last_time").alias("last_us"),
        "risk_min", "risk_max", "malformed_labels", F.explode("stage_counts").alias("stage", "stage_events"))


D6 = f"""WITH {USER_DAYS},
whole AS (SELECT CAST(sum(event_count) AS BIGINT) AS event_count, count(*) AS window_count, min(start_us) AS first_us,
                 max(start_us) + {DAY_US} AS last_us, least(1.0::DOUBLE, min(risk)) AS risk_min, greatest(0.0::DOUBLE, max(risk)) AS risk_max FROM days)
SELECT whole.*, 0 AS malformed_labels, CAST(stage AS VARCHAR) AS stage, CAST(sum(days.event_count) AS BIGINT) AS stage_events
FROM days, whole GROUP BY ALL"""


def _scaler_rows(fitted: DataFrame) -> DataFrame:
    pairs = F.arrays_zip("mean", "scale")
    return fitted.select(F.posexplode(pairs).alias("position", "s")).select(
        "position", r4(F.col("s.mean")).alias("mean"), r4(F.col("s.scale")).alias("scale"))


def d7_fit_scaler(spark: SparkSession, sf: str) -> DataFrame:
    return _scaler_rows(fit_scaler(user_days(spark, sf)))


def _flat(e: str) -> str:
    return f"CASE WHEN {e} < 1e-8 THEN 1 ELSE {e} END"


D7 = f"WITH {USER_DAYS} " + " UNION ALL ".join(
    f"SELECT {i} AS position, {sql_r4(f'avg({f})')} AS mean, {sql_r4(_flat(f'stddev_pop({f})'))} AS scale FROM days"
    for i, f in enumerate(FEATURES))


def d8_fit_scaler_pooled(spark: SparkSession, sf: str) -> DataFrame:
    return _scaler_rows(fit_scaler(supplier_months(spark, sf), pooled=True))


D8 = f"""WITH {SUPPLIER_MONTHS},
row_sums AS (SELECT {" + ".join(FEATURES)} AS s, {" + ".join(f"{f} * {f}" for f in FEATURES)} AS q FROM feat),
fit AS (SELECT avg(s) AS m, sqrt(greatest(avg(q) - avg(s) * avg(s), 0)) AS d FROM row_sums)
SELECT CAST(i AS INTEGER) AS position, {sql_r4("m")} AS mean, {sql_r4(_flat("d"))} AS scale FROM fit, generate_series(0, 23) g(i)"""


def d9_scale(spark: SparkSession, sf: str) -> DataFrame:
    windows = supplier_months(spark, sf)
    return rounded(scale(windows, fit_scaler(windows)).select("l_suppkey", "win_idx", *FEATURES), *FEATURES)


MONTH_SCALER = f"""{SUPPLIER_MONTHS},
scaler AS (SELECT {", ".join(f"avg({f}) AS m_{f}, {_flat(f'stddev_pop({f})')} AS s_{f}" for f in FEATURES)} FROM feat)"""
D9 = f"""WITH {MONTH_SCALER} SELECT l_suppkey, win_idx, {", ".join(f"{sql_r4(f'({f} - m_{f}) / s_{f}')} AS {f}" for f in FEATURES)} FROM feat, scaler"""


def d9_unscale(spark: SparkSession, sf: str) -> DataFrame:
    windows = user_days(spark, sf)
    scaler = collect_scaler(fit_scaler(windows))
    return rounded(unscale(scale(windows, scaler), scaler).select("user_id", "idx", *FEATURES), *FEATURES)


def d9_rescale(spark: SparkSession, sf: str) -> DataFrame:
    """Windows stored in pooled units, brought to per-feature units."""
    windows = user_days(spark, sf)
    stored, wanted = collect_scaler(fit_scaler(windows, pooled=True)), collect_scaler(fit_scaler(windows))
    return rounded(rescale(scale(windows, stored), stored, wanted).select("user_id", "idx", *FEATURES), *FEATURES)


D9_RESCALE = f"""WITH {USER_DAYS},
scaler AS (SELECT {", ".join(f"avg({f}) AS m_{f}, {_flat(f'stddev_pop({f})')} AS s_{f}" for f in FEATURES)} FROM days)
SELECT user_id, idx, {", ".join(f"{sql_r4(f'({f} - m_{f}) / s_{f}')} AS {f}" for f in FEATURES)} FROM days, scaler"""


def d10_scaler_json(spark: SparkSession, sf: str) -> DataFrame:
    scaler = scaler_from_json(scaler_to_json(collect_scaler(fit_scaler(user_days(spark, sf)))))
    return _scaler_rows(spark.range(1).select(scaler.column().alias("s")).select("s.mean", "s.scale"))


def d11_semantics(spark: SparkSession, sf: str) -> DataFrame:
    days = user_days(spark, sf)
    shaped = [("stages", days), ("binary", days.withColumn("stage", (F.col("stage") > 0).cast("int"))),
              ("missing", days.withColumn("stage", F.lit(-1))), ("other", days.withColumn("stage", F.col("idx")))]
    parts = [label_semantics(df).withColumn("case", F.lit(name)) for name, df in shaped]
    parts.append(label_semantics(days, None, "mitre_stage").withColumn("case", F.lit("declared")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _meaning(v: str) -> str:
    return f"""CASE WHEN count(*) FILTER (WHERE {v} >= 0) = 0 THEN 'unknown' WHEN bool_and({v} IN (0, 1)) FILTER (WHERE {v} >= 0) THEN 'binary_attack'
 WHEN bool_and({v} BETWEEN 0 AND 5) FILTER (WHERE {v} >= 0) THEN 'stage_id' ELSE 'unknown' END AS semantics"""


D11 = f"""WITH {USER_DAYS}
SELECT 'stages' AS "case", {_meaning("stage")} FROM days UNION ALL SELECT 'binary', {_meaning("CAST(stage > 0 AS INTEGER)")} FROM days
UNION ALL SELECT 'missing', {_meaning("(-1)")} FROM days UNION ALL SELECT 'other', {_meaning("idx")} FROM days
UNION ALL SELECT 'declared', 'stage_id'"""


def d12_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Trend of the bytes of each user's days."""
    out = trend(user_days(spark, sf), ["user_id"], risk="flow_bytes", step="idx", tolerance=0.05)
    return out.select("user_id", r4(F.col("slope")).alias("slope"), "trend")


D12 = f"""WITH {USER_DAYS},
fit AS (SELECT user_id, coalesce(regr_slope(flow_bytes, idx), 0) AS s FROM days GROUP BY user_id)
SELECT user_id, {sql_r4("s")} AS slope, CASE WHEN s > 0.05 THEN 'increasing' WHEN s < -0.05 THEN 'decreasing' ELSE 'stable' END AS trend FROM fit"""


def d13_prefix_max(spark: SparkSession, sf: str) -> DataFrame:
    """Most events on any of the next 1..3 days of every origin."""
    ahead = align(user_days(spark, sf), 3, ["user_id"], stage="event_count").select("user_id", "origin_idx", "step", "label")
    return prefix_max(ahead, "label", ["user_id", "origin_idx"])


D13 = f"""WITH {USER_DAYS}, size AS (SELECT user_id, max(idx) AS last FROM days GROUP BY user_id)
SELECT o.user_id, o.idx AS origin_idx, CAST(t.idx - o.idx AS INTEGER) AS step, t.event_count AS label,
       max(t.event_count) OVER (PARTITION BY o.user_id, o.idx ORDER BY t.idx) AS prefix_max
FROM days o JOIN days t ON o.user_id = t.user_id AND t.idx BETWEEN o.idx + 1 AND o.idx + 3 JOIN size s ON s.user_id = o.user_id
WHERE o.idx + 3 <= s.last"""

ROUND_TRIP = f"WITH {USER_DAYS} SELECT user_id, idx, {rounded_sql()} FROM days"

ENTRIES = {
    "C1_tumbling": (c1_tumbling, C1),
    "C1_tumbling_by_user": (c1_tumbling_by_user, C1_USER),
    "C1_tumbling_batch": (c1_tumbling_batch, C1_BATCH),
    "C2_sliding": (c2_sliding, _sliding_sql(3 * HOUR_US, HOUR_US // 2)),
    "C2_gapped_grid": (c2_gapped_grid, _sliding_sql(HOUR_US, 2 * HOUR_US)),
    "C3_regrid": (c3_regrid, C3),
    "C1_list_cells": (c1_list_cells, f"WITH {USER_DAYS}, {_spread_sql('placed', LISTED).strip()}"),
    "C2_sliding_large": (c2_sliding_large, C2_LARGE),
    "C2_sliding_lists": (c2_sliding_lists, C2_LARGE.replace("[iat]", LISTED)),
    "C3_regrid_large": (c3_regrid_large, C3_LARGE),
    "C4_row_groups": (c4_row_groups, C4),
    "C5_window_sample": (c5_window_sample, C5),
    "C6_members": (c6_members, f"WITH {USER_DAYS} SELECT user_id, win_idx, event_id, bytes FROM placed"),
    "C7_row_time": (c7_row_time, "SELECT event_id, value, event_id * 1000000 AS ts_us FROM events"),
    "C8_series_index": (c8_series_index, f"WITH {USER_DAYS} SELECT user_id, win_idx, idx FROM days"),
    "C8_series_index_whole": (c8_series_index_whole, C8_WHOLE),
    "D1_sums": _months("flow_bytes", "flow_packets", "syn_count", "ack_count", "fin_count", "fragment_count"),
    "D2_moments": _months("flow_duration", "iat_mean", "iat_variance", "iat_max", "ttl_mean", "ttl_variance",
                          "tcp_window_mean", "tcp_window_variance", "payload_mean", "payload_variance"),
    "D3_ratios": _months("bidirectional_byte_ratio", "bidirectional_packet_ratio"),
    "D3_floor_ratio": (d3_floor_ratio, D3),
    "D4_port_diversity": _months("port_diversity"),
    "D5_sequential_ports": _months("sequential_port_score"),
    "D6_profile": (d6_profile, D6),
    "D7_fit_scaler": (d7_fit_scaler, D7),
    "D8_fit_scaler_pooled": (d8_fit_scaler_pooled, D8),
    "D9_scale": (d9_scale, D9),
    "D9_unscale": (d9_unscale, ROUND_TRIP),
    "D9_rescale": (d9_rescale, D9_RESCALE),
    "D10_scaler_json": (d10_scaler_json, D7),
    "D11_label_semantics": (d11_semantics, D11),
    "D12_trend": (d12_trend, D12),
    "D13_prefix_max": (d13_prefix_max, D13),
}
