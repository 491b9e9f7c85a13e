"""The given tables read as traffic, on the Spark side and as SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.canonical import canonical_events
from tidewatch.operators.series import series_index
from tidewatch.operators.windows import tumbling_features
from tidewatch.schema import FEATURES, ONLINE, FeatureOptions
from tidewatch.session import checkpoint_dir, staged

HOUR = 3_600.0
DAY = 86_400.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, where every executor can write."""
    return f"{checkpoint_dir(spark)}/checks-{name}-{uuid.uuid4().hex}"


def r4(value: Column) -> Column:
    return F.round(value + F.lit(1e-7), 4) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r4(F.col(n)) for n in names})


def sql_r4(expression: str) -> str:
    return f"(round({expression} + 1e-7, 4) + 0.0::DOUBLE)"


# --- events as traffic records ---------------------------------------------------------------

CATEGORIES = ("normal", "benign", "background", "reconnaissance", "analysis", "exploits", "fuzzers", "shellcode",
              "backdoor", "dos", "worms", "generic", "botnet", "other")


def traffic(events: DataFrame) -> DataFrame:
    """`events` with the column names traffic files use; batch or stream."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    even = F.col("user_id") % 2 == 0
    return events.select(
        "event_id", "user_id", F.col("ts").alias("Timestamp"),
        F.col("value").alias("Tot Bytes"), F.lit(1).alias("packets"), (k / 10.0).alias("Flow-Duration"),
        k.cast("double").alias("iat"), F.when(kind == "view", 128).otherwise(64).alias("ttl"),
        (F.col("value") * 100).alias("window_size"), F.col("value").alias("payload_size"),
        F.when(even, F.col("value")).alias("src_bytes"), F.when(~even, F.col("value")).alias("dst_bytes"),
        F.when(even, 1).alias("spkts"), F.when(~even, 1).alias("dpkts"),
        (kind == "click").cast("int").alias("syn_count"), (kind == "view").cast("int").alias("ack_flag_count"),
        (kind == "signup").cast("int").alias("fin_count"), (kind == "error").cast("int").alias("rst_count"),
        (kind == "purchase").cast("int").alias("fwd_psh_flags"), F.lit(0).alias("urg_count"),
        (k % 7 == 0).cast("int").alias("ip_fragments"), (k % 11 == 0).cast("int").alias("retransmissions"),
        k.alias("dst_port"), (k + F.col("user_id") % 5).cast("string").alias("src_port"),
        F.when(kind == "error", 1 + k % 5).otherwise(0).alias("stage"), (kind == "error").cast("double").alias("risk"),
    )


# The same records in SQL, under the canonical names.
TRAFFIC = """
raw AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, epoch_us(ts) AS us FROM events),
traffic AS (
  SELECT event_id, user_id, us, value AS bytes, 1.0 AS packets, k / 10.0 AS duration, CAST(k AS DOUBLE) AS iat,
         CASE WHEN event_type = 'view' THEN 128.0 ELSE 64.0 END AS ttl, value * 100 AS tcp_window, value AS payload,
         CASE WHEN user_id % 2 = 0 THEN value ELSE 0 END AS src_bytes,
         CASE WHEN user_id % 2 = 1 THEN value ELSE 0 END AS dst_bytes,
         CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0 END AS src_packets,
         CASE WHEN user_id % 2 = 1 THEN 1.0 ELSE 0 END AS dst_packets,
         CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END AS syn, CASE WHEN event_type = 'view' THEN 1.0 ELSE 0 END AS ack,
         CASE WHEN event_type = 'signup' THEN 1.0 ELSE 0 END AS fin, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END AS rst,
         CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0 END AS psh, 0.0 AS urg,
         CASE WHEN k % 7 = 0 THEN 1.0 ELSE 0 END AS fragments, CASE WHEN k % 11 = 0 THEN 1.0 ELSE 0 END AS retransmissions,
         k AS port_a, k + user_id % 5 AS port_b,
         CASE WHEN event_type = 'error' THEN CAST(1 + k % 5 AS INTEGER) ELSE 0 END AS stage,
         CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END AS risk
  FROM raw)"""


def traffic_events(spark: SparkSession, sf: str, keys=("user_id",), keep=(), options: FeatureOptions = ONLINE) -> DataFrame:
    return canonical_events(traffic(table(spark, sf, "events")), keys=keys, keep=keep, options=options)


def feature_sql(member: str, by: str, ratio_guard: str = "zero", skip: bool = False) -> str:
    """CTEs ending in `feat`: all features of the rows of `member` grouped by the columns `by`."""
    names = [c.strip() for c in by.split(",")]
    same = " AND ".join(f"s.{c} IS NOT DISTINCT FROM p.{c}" for c in names)

    def ratio(n: str, d: str) -> str:
        if ratio_guard == "floor1":
            return f"sum({n}) / greatest(sum({d}), 1.0)"
        return f"CASE WHEN sum({d}) > 0 THEN sum({n}) / sum({d}) ELSE 0 END"

    def only(c: str) -> str:
        return f"CASE WHEN {c} > 0 THEN {c} END" if skip else c

    def moment(c: str, skippable: bool = True) -> tuple[str, str, str]:
        x = only(c) if skippable else c
        return f"coalesce(avg({x}), 0)", f"coalesce(var_pop({x}), 0)", f"greatest(coalesce(max({x}), 0), 0)"

    iat, ttl, win, pay = moment("iat"), moment("ttl"), moment("tcp_window"), moment("payload", False)
    exprs = {
        "flow_bytes": "sum(bytes)", "flow_packets": "sum(packets)", "flow_duration": "greatest(max(duration), 0)",
        "iat_mean": iat[0], "iat_variance": iat[1], "iat_max": iat[2],
        "bidirectional_byte_ratio": ratio("src_bytes", "dst_bytes"),
        "bidirectional_packet_ratio": ratio("src_packets", "dst_packets"),
        "syn_count": "sum(syn)", "ack_count": "sum(ack)", "fin_count": "sum(fin)", "rst_count": "sum(rst)",
        "psh_count": "sum(psh)", "urg_count": "sum(urg)", "ttl_mean": ttl[0], "ttl_variance": ttl[1],
        "tcp_window_mean": win[0], "tcp_window_variance": win[1], "fragment_count": "sum(fragments)",
        "payload_mean": pay[0], "payload_variance": pay[1], "retransmission_count": "sum(retransmissions)",
    }
    sums = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in exprs.items())
    s_by = ", ".join(f"s.{c}" for c in names)
    cols = ", ".join(f"s.{n}" if n in exprs else f"coalesce(p.{n}, 0) AS {n}" for n in FEATURES)
    return f"""
sums AS (SELECT {by}, {sums}, count(*) AS event_count, greatest(max(stage), 0) AS stage, CAST(greatest(max(risk), 0) AS DOUBLE) AS risk
         FROM {member} GROUP BY {by}),
port AS (SELECT DISTINCT {by}, p FROM (SELECT {by}, port_a AS p FROM {member} UNION ALL SELECT {by}, port_b FROM {member}) WHERE p > 0),
step AS (SELECT {by}, p, p - lag(p) OVER (PARTITION BY {by} ORDER BY p) AS gap FROM port),
ports AS (SELECT {by}, CAST(count(*) AS DOUBLE) AS port_diversity,
                 CASE WHEN count(*) > 1 THEN CAST(count(*) FILTER (WHERE gap = 1) AS DOUBLE) / (count(*) - 1) ELSE 0 END AS sequential_port_score
          FROM step GROUP BY {by}),
feat AS (SELECT {s_by}, {cols}, s.event_count, s.stage, s.risk FROM sums s LEFT JOIN ports p ON {same})"""


def rounded_sql(names=FEATURES) -> str:
    return ", ".join(f"{sql_r4(n)} AS {n}" for n in names)


def rounded_features(windows: DataFrame, *lead: str) -> DataFrame:
    """Window key columns, rounded features, counts; times as microseconds."""
    times = [F.unix_micros("win_start").alias("start_us"), F.unix_micros("win_end").alias("end_us")]
    return windows.select(*lead, *times, *[r4(F.col(f)).alias(f) for f in FEATURES], "event_count", "stage", "risk")


# --- daily windows per user: the series most ordered operators run on -------------------------

def user_days(spark: SparkSession, sf: str) -> DataFrame:
    """Indexed daily windows of every user, written once for the branches that follow."""
    windows = tumbling_features(traffic_events(spark, sf), DAY, ["user_id"])
    return staged(series_index(windows, ["user_id"]))


DAY_US = 86_400_000_000

USER_DAYS = f"""{TRAFFIC},
first_seen AS (SELECT user_id, min(us) AS t0 FROM traffic GROUP BY user_id),
placed AS (SELECT t.*, (us - t0) // {DAY_US} AS win_idx, t0 + (us - t0) // {DAY_US} * {DAY_US} AS start_us
           FROM traffic t JOIN first_seen USING (user_id)),
{feature_sql("placed", "user_id, win_idx, start_us").strip()},
days AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY win_idx) - 1 AS idx FROM feat)"""


def scored_days(spark: SparkSession, sf: str) -> DataFrame:
    """User days as (user_id, idx, y, score): did an error occur, and the day's bytes as a score."""
    return user_days(spark, sf).select(
        "user_id", "idx", F.col("risk").cast("int").alias("y"),
        F.least(F.round("flow_bytes", 2) / 200, F.lit(1.0)).alias("score"), "stage")


SCORED_DAYS = f"""{USER_DAYS},
scored AS (SELECT user_id, idx, CAST(risk AS INTEGER) AS y, least(round(flow_bytes, 2) / 200, 1.0) AS score, stage FROM days)"""


def scored_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a label/score pair of one of five horizons."""
    events = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select((k % 5 + 1).alias("horizon"), (F.col("event_type") == "error").cast("int").alias("y"),
                         F.least(F.col("value") / 50, F.lit(1.0)).alias("score"), (k % 6).cast("int").alias("pred_stage"),
                         F.when(k % 9 != 0, (F.col("user_id") % 6).cast("int")).alias("actual_stage"))


SCORED_EVENTS = """
pairs AS (SELECT k % 5 + 1 AS horizon, CAST(event_type = 'error' AS INTEGER) AS y, least(value / 50, 1.0) AS score,
                 CAST(k % 6 AS INTEGER) AS pred_stage, CASE WHEN k % 9 <> 0 THEN CAST(user_id % 6 AS INTEGER) END AS actual_stage
          FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events))"""


# --- lineitem as flow records -----------------------------------------------------------------

def flows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_suppkey", F.col("l_shipdate").alias("timestamp"), F.col("l_extendedprice").alias("bytes"),
        F.col("l_quantity").alias("packets"), F.col("l_linenumber").alias("dur"), F.col("l_discount").alias("iat"),
        F.col("l_linenumber").alias("ttl"), F.col("l_quantity").alias("tcp_window"), F.col("l_tax").alias("payload_size"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).alias("src_bytes"),
        F.when(F.col("l_linestatus") != "O", F.col("l_quantity")).alias("dst_bytes"),
        F.when(F.col("l_returnflag") == "R", 1).alias("src_packets"),
        F.when(F.col("l_returnflag") == "N", 1).alias("dst_packets"),
        (F.col("l_linenumber") == 1).cast("int").alias("syn_count"),
        (F.col("l_linenumber") == 2).cast("int").alias("ack_count"),
        F.col("l_partkey").alias("dst_port"), F.col("l_returnflag").alias("Label"),
    )


FLOWS = """
traffic AS (
  SELECT l_suppkey, epoch_us(l_shipdate) AS us, l_extendedprice AS bytes, l_quantity AS packets, CAST(l_linenumber AS DOUBLE) AS duration,
         l_discount AS iat, CAST(l_linenumber AS DOUBLE) AS ttl, l_quantity AS tcp_window, l_tax AS payload,
         CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END AS src_bytes,
         CASE WHEN l_linestatus <> 'O' THEN l_quantity ELSE 0 END AS dst_bytes,
         CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END AS src_packets, CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0 END AS dst_packets,
         CASE WHEN l_linenumber = 1 THEN 1.0 ELSE 0 END AS syn, CASE WHEN l_linenumber = 2 THEN 1.0 ELSE 0 END AS ack,
         0.0 AS fin, 0.0 AS rst, 0.0 AS psh, 0.0 AS urg, 0.0 AS fragments, 0.0 AS retransmissions,
         l_partkey AS port_a, l_partkey AS port_b, 0 AS stage, 0.0 AS risk
  FROM lineitem)"""

MONTH = 30 * DAY
MONTH_US = 30 * DAY_US

SUPPLIER_MONTHS = f"""{FLOWS},
first_seen AS (SELECT l_suppkey, min(us) AS t0 FROM traffic GROUP BY l_suppkey),
placed AS (SELECT t.*, (us - t0) // {MONTH_US} AS win_idx FROM traffic t JOIN first_seen USING (l_suppkey)),
{feature_sql("placed", "l_suppkey, win_idx").strip()}"""


def supplier_months(spark: SparkSession, sf: str) -> DataFrame:
    return tumbling_features(canonical_events(flows(spark, sf), keys=["l_suppkey"]), MONTH, ["l_suppkey"])
