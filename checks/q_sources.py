"""Inventory A and B: sources, sinks, projections, predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.adapters import (
    SCORED_DAYS, TRAFFIC, USER_DAYS, r4, rounded_sql, scored_days, scored_events, scratch, sql_r4, table, traffic,
    traffic_events, user_days,
)
from tidewatch.functions.labels import (
    alerts, binary_label, clean_stage, parse_stage, stage_from_label, stage_name, targets,
)
from tidewatch.functions.numbers import first_column, first_number, normalize_columns, number_list, to_number
from tidewatch.operators.canonical import canonical_events
from tidewatch.operators.explain import alert_text, by_size, describe_latest
from tidewatch.operators.metrics import score_problems
from tidewatch.operators.profile import profile
from tidewatch.operators.scaling import fit_scaler, scale
from tidewatch.operators.series import backward_steps
from tidewatch.schema import FEATURES
from tidewatch.session import staged
from tidewatch.sources.flows import project_recognized, read_flows, with_row_number, with_row_time
from tidewatch.sources.packets import packets_to_events
from tidewatch.sources.reports import file_digests, report_json
from tidewatch.sources.store import read_features, stored_scaler, read_metadata, write_features
from tidewatch.sources.streams import stream_flows
from tidewatch.operators.scaling import unscale

EVENT_BYTES = "SELECT event_id, value AS bytes FROM events"


def _text_copy(spark: SparkSession, sf: str, separator: str, name: str) -> str:
    path = scratch(spark, name)
    events = table(spark, sf, "events").select("event_id", F.col("value").alias("Tot Bytes"), "event_type")
    events.write.option("header", True).option("sep", separator).csv(path)
    return path


def a1_csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    records = read_flows(spark, _text_copy(spark, sf, ",", "csv"), same_header=True)
    return records.select(F.col("event_id").cast("long").alias("event_id"), first_number(records, "tot_bytes").alias("bytes"))


def a1_quoted_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of many lines in quoted cells, cut into byte ranges and read by many tasks."""
    path = scratch(spark, "quoted")
    texts = table(spark, sf, "documents").select("doc_id", F.col("source").alias("Label"), "text")
    texts.write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").csv(path)
    records = read_flows(spark, path, "csv")
    return records.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


def a2_tsv_scan(spark: SparkSession, sf: str) -> DataFrame:
    records = read_flows(spark, _text_copy(spark, sf, "\t", "tsv"), "tsv")
    return records.select(F.col("event_id").cast("long").alias("event_id"), first_number(records, "tot_bytes").alias("bytes"))


def a3_row_scan(spark: SparkSession, sf: str) -> DataFrame:
    records = with_row_time(read_flows(spark, f"{sf}/events.parquet", position=True), position="_row")
    records = records.withColumnRenamed("ts", "seen_at").withColumns({
        "Label": F.when(F.col("event_type") == "error", "Attack").otherwise("Benign"),
        "Family": F.when(F.get_json_object("props", "$.k").cast("long") % 2 == 0, "Botnet").otherwise("")})
    events = canonical_events(records, keep=["event_id"], labels="text")
    return events.select("event_id", (F.col("ts_us") / 1_000_000).alias("ts_seconds"), "stage", "risk")


A3 = """
SELECT event_id, CAST(event_id AS DOUBLE) AS ts_seconds,
       CASE WHEN event_type <> 'error' THEN 0 WHEN k % 2 = 0 THEN 4 ELSE 1 END AS stage,
       CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS risk
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)"""


def a4_projected_scan(spark: SparkSession, sf: str) -> DataFrame:
    records = traffic(table(spark, sf, "events")).withColumn("comment", F.lit("not a measure"))
    return normalize_columns(project_recognized(records, keep=["event_id"])).select(
        "event_id", "tot_bytes", "flow_duration", "iat", "window_size", "dst_port", "src_port", "stage", "risk")


A4 = f"""WITH {TRAFFIC}
SELECT event_id, bytes AS tot_bytes, duration AS flow_duration, iat, tcp_window AS window_size, port_a AS dst_port,
       CAST(port_b AS VARCHAR) AS src_port, stage, CAST(risk AS DOUBLE) AS risk FROM traffic"""


def a5_folder_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The whole events table, half of it as CSV, half as Parquet, in nested folders."""
    folder = scratch(spark, "folder")
    events = table(spark, sf, "events").select("event_id", "user_id", F.col("value").alias("bytes"))
    odd = F.col("user_id") % 2 == 1
    events.where(odd).write.option("header", True).csv(f"{folder}/text/day1")
    events.where(~odd).write.parquet(f"{folder}/columns")
    numbered = with_row_number(read_flows(spark, folder, position=True, same_header=True))
    return numbered.agg(F.count("*").alias("records"), F.countDistinct("row_number").alias("positions"),
                        F.min("row_number").alias("first"), F.max("row_number").alias("last"),
                        F.countDistinct(F.col("event_id").cast("long")).alias("event_ids"),
                        r4(F.sum(F.col("bytes").cast("double"))).alias("bytes"))


A5 = f"""SELECT count(*) AS records, count(*) AS positions, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last,
       count(DISTINCT event_id) AS event_ids, {sql_r4("sum(value)")} AS bytes FROM events"""


def a5_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Files of three headers, comma and tab separated, in one folder; cells find their columns by their own file's header."""
    folder = scratch(spark, "headers")
    events = table(spark, sf, "events").select("event_id", "user_id", F.col("value").alias("Tot Bytes"), F.lit("a, b").alias("note"))
    kind = F.col("event_id") % 4
    events.where(kind == 0).write.option("header", True).csv(f"{folder}/a")
    events.where(kind == 1).select("note", "Tot Bytes", "event_id").write.option("header", True).csv(f"{folder}/b")
    events.where(kind == 2).select(F.col("Tot Bytes").alias("tot_bytes"), "event_id").write.option("header", True).csv(f"{folder}/c")
    events.where(kind == 3).write.parquet(f"{folder}/d")
    records = read_flows(spark, folder)
    return records.select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"),
                          r4(first_number(records, "tot_bytes")).alias("bytes"), "note")


A5_HEADERS = f"""SELECT event_id, CASE WHEN event_id % 4 IN (0, 3) THEN user_id END AS user_id, {sql_r4("value")} AS bytes,
       CASE WHEN event_id % 4 <> 2 THEN 'a, b' END AS note FROM events"""


def a6_packets(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    packets = events.select(
        "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"), F.col("value").alias("length"),
        F.when(kind != "signup", F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"))).alias("ip_src"),
        F.lit("10.1.1.1").alias("ip_dst"), (k + 30).alias("ttl"), (k % 3).alias("ip_flags"), (k % 4).alias("ip_frag"),
        (F.col("value") / 2).alias("payload_length"), F.when(kind != "view", k).alias("sport"),
        F.when(kind != "view", k + 1).alias("dport"), F.when(kind == "click", k * 10).alias("window"),
        F.when(kind == "click", "S").when(kind == "purchase", "PA").when(kind == "error", "RU").alias("flags"))
    return packets_to_events(packets).select(
        F.round(F.col("timestamp") * 1e6).cast("long").alias("time_us"), "bytes", "packets", "ttl", "fragment_count", "payload_size", "src_ip",
        "dst_ip", "src_port", "dst_port", "tcp_window", "syn_count", "ack_count", "fin_count", "rst_count", "psh_count",
        "urg_count")


A6 = f"""
WITH raw AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, event_type AS t,
                    CASE event_type WHEN 'click' THEN 'S' WHEN 'purchase' THEN 'PA' WHEN 'error' THEN 'RU' ELSE '' END AS f
             FROM events WHERE event_type <> 'signup')
SELECT epoch_us(ts) AS time_us, value AS bytes, 1 AS packets, k + 30 AS ttl,
       CASE WHEN k % 3 <> 0 AND k % 4 <> 0 THEN 1 ELSE 0 END AS fragment_count, value / 2 AS payload_size,
       '10.0.0.' || user_id AS src_ip, '10.1.1.1' AS dst_ip,
       CASE WHEN t <> 'view' THEN k END AS src_port, CASE WHEN t <> 'view' THEN k + 1 END AS dst_port,
       CASE WHEN t = 'click' THEN k * 10 WHEN t <> 'view' THEN 0 END AS tcp_window,
       {", ".join(f"CASE WHEN t <> 'view' THEN CAST(contains(f, '{c}') AS INTEGER) END AS {n}_count" for n, c in
                  (("syn", "S"), ("ack", "A"), ("fin", "F"), ("rst", "R"), ("psh", "P"), ("urg", "U")))}
FROM raw"""


def a7_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    return read_flows(spark, f"{sf}/events.parquet").select("event_id", "user_id", "event_type", "value")


def _stored(spark: SparkSession, sf: str) -> str:
    path = scratch(spark, "features")
    write_features(user_days(spark, sf), path)
    return path


def a8_feature_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Standardised windows as stored."""
    stored = read_features(spark, _stored(spark, sf))
    return stored.select("user_id", "idx", *[r4(F.col(f)).alias(f) for f in FEATURES], "stage")


SCALER = f"""{USER_DAYS},
scaler AS (SELECT {", ".join(f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) < 1e-8 THEN 1 ELSE stddev_pop({f}) END AS s_{f}" for f in FEATURES)} FROM days)"""

A8 = f"""WITH {SCALER}
SELECT user_id, idx, {", ".join(f"{sql_r4(f'({f} - m_{f}) / s_{f}')} AS {f}" for f in FEATURES)}, stage FROM days, scaler"""


def a9_feature_source(spark: SparkSession, sf: str) -> DataFrame:
    """Stored windows taken back to source units with the stored scaler."""
    path = _stored(spark, sf)
    stored = unscale(read_features(spark, path), stored_scaler(read_metadata(spark, path)))
    return stored.select("user_id", "idx", *[r4(F.col(f)).alias(f) for f in FEATURES], "stage")


A9 = f"WITH {USER_DAYS} SELECT user_id, idx, {rounded_sql()}, stage FROM days"


def a10_report(spark: SparkSession, sf: str) -> DataFrame:
    return report_json(profile(user_days(spark, sf)))


def a11_digests(spark: SparkSession, sf: str) -> DataFrame:
    return file_digests(spark, sf).withColumn("path", F.regexp_extract("path", "([^/]+)$", 1))


def a12_stream_source(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch(spark, "stream")
    schema = table(spark, sf, "events").schema
    arriving = stream_flows(spark, sf, schema, pattern="events.parquet").select("event_id", F.col("value").alias("bytes"))
    arriving.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True) \
        .start(f"{out}/rows").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def b1_names(spark: SparkSession, sf: str) -> DataFrame:
    renamed = normalize_columns(traffic(table(spark, sf, "events")))
    return renamed.select("event_id", "tot_bytes", "flow_duration", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"))


B1 = f"WITH {TRAFFIC} SELECT event_id, bytes AS tot_bytes, duration AS flow_duration, us FROM traffic"


def _messy(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    value = F.col("value")
    text = F.when(k % 5 == 0, "n/a").when(k % 5 == 1, "").when(k % 5 == 2, "nan").when(k % 5 == 3, F.concat(F.lit(" "), value.cast("string")))
    number = F.when(k % 3 == 0, F.lit(float("inf"))).when(k % 3 == 1, value)
    cells = F.concat_ws(";", k.cast("string"), F.lit("x"), (k + 1).cast("string"))
    return table(spark, sf, "events").select("event_id", text.alias("bytes"), number.alias("flow_bytes"),
                                             cells.alias("ports"), k.alias("k"), "value")


MESSY = """
messy AS (SELECT event_id, k, value, CASE WHEN k % 5 = 3 THEN value END AS a, CASE WHEN k % 3 = 1 THEN value END AS b
          FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events))"""


def b2_first_number(spark: SparkSession, sf: str) -> DataFrame:
    messy = _messy(spark, sf)
    return messy.select("event_id", first_number(messy, "bytes", "flow_bytes", "tot_bytes").alias("number"))


def b3_first_column(spark: SparkSession, sf: str) -> DataFrame:
    messy = _messy(spark, sf)
    return messy.select("event_id", first_column(messy, "total_bytes", "flow_bytes", "bytes").alias("number"))


def b4_number_list(spark: SparkSession, sf: str) -> DataFrame:
    messy = _messy(spark, sf)
    return messy.select("event_id", F.posexplode(number_list(F.col("ports"), messy.schema["ports"].dataType)).alias("at", "number"))


B4 = f"""WITH {MESSY} SELECT event_id, 0 AS at, CAST(k AS DOUBLE) AS number FROM messy
UNION ALL SELECT event_id, 1, CAST(k + 1 AS DOUBLE) FROM messy"""


def b5_binary_label(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("l_returnflag") == "N", " Normal ").when(F.col("l_returnflag") == "A", "DoS")
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum(binary_label(label)).alias("attacks"))


def b6_stage_from_label(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    category = F.when(k % 6 == 0, " Botnet").when(k % 6 == 1, "DoS").when(k % 6 == 2, "worms").when(k % 6 == 3, "Normal") \
        .when(k % 6 == 4, "something")
    label = F.when(F.col("event_type") == "view", "Benign").when(F.col("event_type") != "click", "Attack")
    return table(spark, sf, "events").select("event_id", stage_from_label(label, category).alias("stage"))


B6 = """
SELECT event_id, CASE WHEN event_type = 'view' OR k % 6 = 3 THEN 0 WHEN k % 6 = 0 THEN 4 WHEN k % 6 = 1 THEN 2
                      WHEN k % 6 = 2 THEN 3 ELSE 1 END AS stage
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)"""


def b7_stage_name(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").select("event_id", stage_name(k % 8).alias("name"))


B7 = """
SELECT event_id, CASE k % 8 WHEN 0 THEN 'Benign' WHEN 1 THEN 'Reconnaissance' WHEN 2 THEN 'Initial Access'
       WHEN 3 THEN 'Lateral Movement' WHEN 4 THEN 'Command and Control' WHEN 5 THEN 'Exfiltration'
       ELSE 'Unmapped forecast stage' END AS name
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)"""


def b8_parse_stage(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    text = F.when(k % 3 == 0, "?").when(k % 3 == 1, F.concat((k % 5).cast("string"), F.lit(".7")))
    events = table(spark, sf, "events").select("event_id", text.alias("stage"), (k / 4).cast("string").alias("risk"))
    types = events.schema
    return events.select("event_id", parse_stage(F.col("stage"), types["stage"].dataType).alias("stage"),
                         to_number(F.col("risk"), types["risk"].dataType).alias("risk"))


B8 = """
SELECT event_id, CASE WHEN k % 3 = 1 THEN CAST(k % 5 AS INTEGER) END AS stage, k / 4.0::DOUBLE AS risk
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)"""


def b9_clean_stage(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    raw = F.when(k % 4 == 0, F.lit(float("nan"))).when(k % 4 == 1, -1.0).when(k % 4 == 2, k % 6)
    return table(spark, sf, "events").select("event_id", clean_stage(raw).alias("stage"))


B9 = """
SELECT event_id, CASE WHEN k % 4 = 2 THEN CAST(k % 6 AS INTEGER) END AS stage
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)"""


def b10_targets(spark: SparkSession, sf: str) -> DataFrame:
    days = user_days(spark, sf).select("user_id", "idx", "stage")
    parts = [targets(days, s).withColumn("semantics", F.lit(s)) for s in ("stage_id", "binary_attack", "unknown")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


B10 = f"""WITH {USER_DAYS}
SELECT user_id, idx, stage, semantics, CASE WHEN semantics <> 'unknown' THEN CAST(stage > 0 AS INTEGER) END AS actual_risk,
       CASE WHEN semantics = 'stage_id' THEN stage END AS actual_stage
FROM days, (VALUES ('stage_id'), ('binary_attack'), ('unknown')) v(semantics)"""


def b11_alerts(spark: SparkSession, sf: str) -> DataFrame:
    scores = scored_days(spark, sf).withColumn("score", F.col("score") * 1.5)
    return alerts(scores, 0.75).select("user_id", "idx", r4(F.col("shown_score")).alias("shown_score"))


B11 = f"""WITH {SCORED_DAYS}
SELECT user_id, idx, {sql_r4("greatest(least(score * 1.5, 1.0), 0.0)")} AS shown_score FROM scored WHERE score * 1.5 >= 0.75"""


def b12_validation(spark: SparkSession, sf: str) -> DataFrame:
    pairs = scored_events(spark, sf).withColumn("score", F.when(F.col("score") > 0.9, F.col("score") * 2).otherwise(F.col("score")))
    return score_problems(pairs)


B12 = """
SELECT CAST(0 AS BIGINT) AS bad_labels, count(*) FILTER (WHERE s > 0.9 AND s * 2 > 1) AS bad_scores,
       CAST(0 AS BIGINT) AS missing_labels, count(*) AS rows FROM (SELECT least(value / 50, 1.0) AS s FROM events)"""


def b13_sorted_check(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer in key order: how often does the date go back?"""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts_us"))
    return backward_steps(orders, "o_orderkey", ["o_custkey"])


B13 = """
SELECT o_custkey, CAST(count(*) FILTER (WHERE o_orderdate < before) AS BIGINT) AS backward_steps
FROM (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) GROUP BY o_custkey"""


def b14_alert_text(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    parts = F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("contribution")) for n, c in (
        ("value", F.col("value") / 1000 + 0.000313), ("k", (k - 50) / 1000 + 0.000171), ("user", -F.col("user_id") / 1000 - 0.000233))])
    rows = events.select("event_id", (k / 101.0).alias("risk"), parts.alias("contributions"))
    return alert_text(rows).select("event_id", "alert")


B14 = """
WITH raw AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events),
parts AS (SELECT event_id, 'value' AS name, value / 1000 + 0.000313 AS c FROM raw
          UNION ALL SELECT event_id, 'k', (k - 50) / 1000.0::DOUBLE + 0.000171 FROM raw
          UNION ALL SELECT event_id, 'user', -user_id / 1000.0::DOUBLE - 0.000233 FROM raw),
ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(c) DESC, name) AS r FROM parts),
two AS (SELECT event_id, string_agg(name || ' (' || printf('%+.1f', c * 100) || '%)', ' and ' ORDER BY r) AS drivers
        FROM ranked WHERE r <= 2 GROUP BY event_id)
SELECT event_id, 'Infiltration risk ' || printf('%.0f', k / 101.0::DOUBLE * 100) || '% driven by ' || drivers || '.' AS alert
FROM raw JOIN two USING (event_id)"""


def b15_describe(spark: SparkSession, sf: str) -> DataFrame:
    return describe_latest(user_days(spark, sf), ["user_id"]).select("user_id", "position", "feature", r4(F.col("latest_value")).alias("latest_value"))


B15 = f"""WITH {USER_DAYS},
latest AS (SELECT * FROM days QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY idx DESC) = 1)
{" UNION ALL ".join(f"SELECT user_id, {i} AS position, '{f}' AS feature, {sql_r4(f)} AS latest_value FROM latest" for i, f in enumerate(FEATURES))}"""

ENTRIES = {
    "A1_csv_scan": (a1_csv_scan, EVENT_BYTES),
    "A1_quoted_scan": (a1_quoted_scan, "SELECT doc_id, length(nullif(text, '')) AS chars, md5(nullif(text, '')) AS text_md5 FROM documents"),
    "A2_tsv_scan": (a2_tsv_scan, EVENT_BYTES),
    "A3_row_scan": (a3_row_scan, A3),
    "A4_projected_scan": (a4_projected_scan, A4),
    "A5_folder_scan": (a5_folder_scan, A5),
    "A5_headers": (a5_headers, A5_HEADERS),
    "A6_packets": (a6_packets, A6),
    "A7_dispatch": (a7_dispatch, "SELECT event_id, user_id, event_type, value FROM events"),
    "A8_feature_sink": (a8_feature_sink, A8),
    "A9_feature_source": (a9_feature_source, A9),
    "A10_report": (a10_report, None),
    "A11_digests": (a11_digests, None),
    "A12_stream_source": (a12_stream_source, EVENT_BYTES),
    "B1_names": (b1_names, B1),
    "B2_first_number": (b2_first_number, f"WITH {MESSY} SELECT event_id, coalesce(a, b, 0) AS number FROM messy"),
    "B3_first_column": (b3_first_column, f"WITH {MESSY} SELECT event_id, coalesce(b, 0) AS number FROM messy"),
    "B4_number_list": (b4_number_list, B4),
    "B5_binary_label": (b5_binary_label, "SELECT l_suppkey, CAST(count(*) FILTER (WHERE l_returnflag <> 'N') AS BIGINT) AS attacks FROM lineitem GROUP BY l_suppkey"),
    "B6_stage_from_label": (b6_stage_from_label, B6),
    "B7_stage_name": (b7_stage_name, B7),
    "B8_parse_stage": (b8_parse_stage, B8),
    "B9_clean_stage": (b9_clean_stage, B9),
    "B10_targets": (b10_targets, B10),
    "B11_alerts": (b11_alerts, B11),
    "B12_validation": (b12_validation, B12),
    "B13_sorted_check": (b13_sorted_check, B13),
    "B14_alert_text": (b14_alert_text, B14),
    "B15_describe_latest": (b15_describe, B15),
}
