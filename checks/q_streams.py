"""Inventory S: the same windows from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.adapters import DAY, HOUR, TRAFFIC, feature_sql, rounded_features, rounded_sql, scratch, table, traffic
from checks.q_windows import GRID, HOUR_US
from tidewatch.functions.numbers import int_div
from tidewatch.operators.canonical import canonical_events
from tidewatch.session import SETTINGS
from tidewatch.sources.streams import stream_flows
from tidewatch.streaming.late import late_events
from tidewatch.streaming.regrid import stream_regrid
from tidewatch.streaming.sample import stream_sample
from tidewatch.streaming.windows import stream_sliding, stream_tumbling


def _arriving(spark: SparkSession, sf: str, keep=()) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return canonical_events(traffic(stream_flows(spark, sf, schema, pattern="events.parquet")), keys=["user_id"], keep=keep)


def _drained(spark: SparkSession, stream: DataFrame, out: str) -> DataFrame:
    """Run the stream over everything new that is there and read what it wrote to `out` so far."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, SETTINGS[provider])
    try:
        stream.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True) \
            .start(f"{out}/rows").awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def s1_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_features(_drained(spark, stream_tumbling(_arriving(spark, sf), DAY, "1 hour", ["user_id"]), scratch(spark, "s1")), "user_id")


def _stream_sql(width: int, stride: int) -> str:
    """Windows on the epoch grid that end no later than the last watermark, an hour before the last event."""
    return f"""WITH {TRAFFIC}, mark AS (SELECT (max(us) // 1000) * 1000 - {HOUR_US} AS w FROM traffic),
placed AS (SELECT t.*, us // {stride} * {stride} - i * {stride} AS start_us FROM traffic t, generate_series(0, {width // stride - 1}) g(i)),
{feature_sql("placed", "user_id, start_us").strip()}
SELECT user_id, start_us, start_us + {width} AS end_us, {rounded_sql()}, event_count, stage, risk FROM feat, mark WHERE start_us + {width} <= w"""


def s2_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_features(_drained(spark, stream_sliding(_arriving(spark, sf), DAY, DAY / 2, "1 hour", ["user_id"]), scratch(spark, "s2")), "user_id")


def s3_late(spark: SparkSession, sf: str) -> DataFrame:
    """Per user: events and number of closed days, and events left out as late, of files that overlap.

    The events come in three parts by time, every tenth event one part too late; an hour of delay is allowed.
    """
    events, folder = table(spark, sf, "events"), scratch(spark, "s3-in")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    span = events.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).first()
    part = F.least(int_div((us - F.lit(span["lo"])) * 3, span["hi"] - span["lo"] + 1) + (F.col("event_id") % 10 == 0).cast("long"), F.lit(2))
    events.where(part == 0).write.parquet(folder)
    arriving = canonical_events(traffic(stream_flows(spark, folder, events.schema)), keys=["user_id"])
    streams = [(stream_tumbling(arriving, DAY, "1 hour", ["user_id"], late="drop"), scratch(spark, "s3-days")),
               (late_events(arriving, "1 hour", ["user_id"]), scratch(spark, "s3-late"))]
    for k in range(3):
        if k:
            events.where(part == k).write.mode("append").parquet(folder)
        days, late = (_drained(spark, stream, out) for stream, out in streams)
    zero = F.lit(0).cast("long")
    both = days.select("user_id", F.col("event_count").cast("long").alias("events"), (zero + 1).alias("windows"), zero.alias("late")).unionByName(
        late.select("user_id", zero.alias("events"), zero.alias("windows"), (zero + 1).alias("late")))
    return both.groupBy("user_id").agg(*[F.sum(c).alias(c) for c in ("events", "windows", "late")])


S3 = f"""WITH {TRAFFIC}, span AS (SELECT min(us) AS lo, max(us) AS hi FROM traffic),
arrived AS (SELECT user_id, us, least((us - lo) * 3 // (hi - lo + 1) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END, 2) AS part FROM traffic, span),
marks AS (SELECT p, coalesce((SELECT max(us) FROM arrived WHERE part < p) // 1000 * 1000 - {HOUR_US}, 0) AS mark FROM range(3) r(p)),
judged AS (SELECT user_id, us, us < mark AS late FROM arrived JOIN marks ON part = p),
days AS (SELECT user_id, count(*) AS n FROM judged, (SELECT max(us) // 1000 * 1000 - {HOUR_US} AS w FROM traffic)
         WHERE NOT late GROUP BY user_id, us // {24 * HOUR_US}, w HAVING (us // {24 * HOUR_US} + 1) * {24 * HOUR_US} <= w),
both_kinds AS (SELECT user_id, n AS events, 1 AS windows, 0 AS late FROM days UNION ALL SELECT user_id, 0, 0, 1 FROM judged WHERE late)
SELECT user_id, CAST(sum(events) AS BIGINT) AS events, CAST(sum(windows) AS BIGINT) AS windows, CAST(sum(late) AS BIGINT) AS late FROM both_kinds GROUP BY user_id"""


def s4_regrid(spark: SparkSession, sf: str) -> DataFrame:
    rows = _drained(spark, stream_regrid(_arriving(spark, sf), 6 * HOUR, 15 * HOUR, ["user_id"]), scratch(spark, "s4"))
    return rows.groupBy(F.get_json_object("series", "$.user_id").cast("long").alias("user_id"), "win_start_us") \
        .agg(F.count("*").alias("events"))


S4 = f"""WITH RECURSIVE {TRAFFIC}, {GRID}
SELECT t.user_id, g.start_us AS win_start_us, count(*) AS events FROM traffic t
JOIN grid g ON t.user_id = g.user_id AND us >= start_us AND us < start_us + {6 * HOUR_US} GROUP BY ALL"""



def s5_sample(spark: SparkSession, sf: str) -> DataFrame:
    stream = stream_sample(_arriving(spark, sf, ["event_id"]), DAY, 3, "1 hour", ["user_id"], ["event_id"])
    return _drained(spark, stream, scratch(spark, "s5")).select(
        F.get_json_object("series", "$.user_id").cast("long").alias("user_id"), "win_start_us", "event_id")


S5 = f"""WITH {TRAFFIC}, mark AS (SELECT (max(us) // 1000) * 1000 - {HOUR_US} AS w FROM traffic),
placed AS (SELECT user_id, event_id, us, us // {24 * HOUR_US} * {24 * HOUR_US} AS win_start_us FROM traffic)
SELECT user_id, win_start_us, event_id FROM placed, mark WHERE win_start_us + {24 * HOUR_US} <= w
QUALIFY row_number() OVER (PARTITION BY user_id, win_start_us ORDER BY us DESC, event_id DESC) <= 3"""

ENTRIES = {
    "S1_stream_tumbling": (s1_tumbling, _stream_sql(24 * HOUR_US, 24 * HOUR_US)),
    "S2_stream_sliding": (s2_sliding, _stream_sql(24 * HOUR_US, 12 * HOUR_US)),
    "S3_late_events": (s3_late, S3),
    "S4_stream_regrid": (s4_regrid, S4),
    "S5_stream_sample": (s5_sample, S5),
}
