import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidewatch.operators.canonical import canonical_events
from tidewatch.operators.windows import tumbling_features
from tidewatch.sources.streams import stream_flows
from tidewatch.streaming.late import late_events
from tidewatch.streaming.regrid import stream_regrid
from tidewatch.streaming.sample import stream_sample
from tidewatch.streaming.windows import stream_sliding, stream_tumbling

SCHEMA = "k string, ts double, bytes double, dst_port int"


def feed(spark, tmp_path, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return canonical_events(stream_flows(spark, str(tmp_path / "in"), SCHEMA, files_per_trigger=1), keys=["k"])


def drain(spark, df, tmp_path, name):
    df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)) \
        .trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


ROWS = [("a" if i % 3 else "b", float(i), 1.0, 80 + i % 7) for i in range(60)]


def test_stream_windows_equal_batch_windows(spark, tmp_path):
    stream = stream_tumbling(feed(spark, tmp_path, ROWS[:30], ROWS[30:]), 10, "5 seconds", ["k"])
    got = drain(spark, stream, tmp_path, "tumbling")
    closed = got.agg(F.max("win_end")).first()[0]
    batch = tumbling_features(canonical_events(spark.createDataFrame(ROWS, SCHEMA), keys=["k"]), 10, ["k"], anchor=0)
    want = batch.where(F.col("win_end") <= F.lit(closed)).drop("win_idx")
    assert got.count() == 10
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and want.count() == got.count()


def test_overlapping_stream_windows(spark, tmp_path):
    got = drain(spark, stream_sliding(feed(spark, tmp_path, ROWS), 20, 10, "0 seconds", ["k"]), tmp_path, "sliding")
    counts = {(r["k"], r["s"]): r["event_count"] for r in got.withColumn("s", F.unix_seconds("win_start")).collect()}
    assert counts[("a", 0)] + counts[("b", 0)] == 20 and counts[("a", -10)] + counts[("b", -10)] == 10


def test_late_events_are_dropped(spark, tmp_path):
    # Spark judges lateness by the watermark known before the previous trigger, hence the event at 61.
    late, on_time, last = [("a", 1.0, 1.0, 80)], [("a", 61.0, 1.0, 80)], [("a", 500.0, 1.0, 80)]
    stream = stream_tumbling(feed(spark, tmp_path, ROWS, on_time, late, last), 10, "0 seconds", ["k"])
    got = drain(spark, stream, tmp_path, "late")
    assert got.agg(F.sum("event_count")).first()[0] == 61


def overlapping(spark, tmp_path):
    """The watermark is 30 s when the second file comes and 50 s when the third one does."""
    files = [[("a", 5.0, 1.0, 80), ("a", 30.0, None, None)], [("a", 29.0, 1.0, 80), (None, 12.0, 2.0, 443), ("a", 50.0, 1.0, 80)],
             [("b", 49.0, 1.0, 80), ("b", 50.0, 3.0, 80), ("b", 500.0, 1.0, 80)]]
    return feed(spark, tmp_path, *files)


@pytest.mark.parametrize("how", ["tumbling", "sliding"])
def test_events_older_than_the_watermark_are_left_out_and_told(spark, tmp_path, how):
    rows = overlapping(spark, tmp_path)
    stream = stream_tumbling(rows, 60, keys=["k"], late="drop") if how == "tumbling" else stream_sliding(rows, 60, 30, keys=["k"], late="drop")
    got = {(r["k"], r["s"]): r["event_count"] for r in drain(spark, stream, tmp_path, f"gate_{how}").withColumn("s", F.unix_seconds("win_start")).collect()}
    assert {g: n for g, n in got.items() if g[1] == 0} == {("a", 0): 3, ("b", 0): 1}
    late = drain(spark, late_events(rows, keep=["k"]), tmp_path, f"told_{how}")
    assert sorted((r["ts_us"] // 1_000_000, r["k"]) for r in late.collect()) == [(12, None), (29, "a"), (49, "b")]


def test_late_events_pass_in_batches_and_keep_their_types(spark, tmp_path):
    schema, path = "k string, ts double, n long, l array<bigint>", str(tmp_path / "in")
    late = [("a", 1.0, 2**53 + 1, [1, None, 2**60 + 1]), (None, 2.0, None, None), ("b", 3.0, None, [])]
    for rows in ([("a", 100.0, 1, [1])], late, [("a", 200.0, None, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    events = canonical_events(stream_flows(spark, path, schema, files_per_trigger=1), keys=["k"], keep=["n", "l"])
    told = late_events(events, keep=["k", "n", "l"])
    assert "MapInArrow" in told._jdf.queryExecution().logical().toString()
    got = drain(spark, told, tmp_path, "typed").collect()
    assert sorted(((r["k"], r["ts_us"] / 1e6, r["n"], r["l"]) for r in got), key=lambda r: r[1]) == late


def test_events_older_than_the_watermark_end_a_strict_stream(spark, tmp_path):
    with pytest.raises(StreamingQueryException, match="older than the watermark"):
        drain(spark, stream_tumbling(overlapping(spark, tmp_path), 60, keys=["k"], late="error"), tmp_path, "strict")
    with pytest.raises(ValueError):
        stream_tumbling(overlapping(spark, tmp_path), 60, late="maybe")


@pytest.mark.parametrize("late", ["drop", "error"])
def test_moving_grid_keeps_its_state_between_triggers(spark, tmp_path, late):
    rows = [("a", float(t), 1.0, 80) for t in (0, 6, 11, 14, 20)]
    stream = stream_regrid(feed(spark, tmp_path, rows[:2], rows[2:]), 5, 8, ["k"], late)
    got = drain(spark, stream, tmp_path, f"grid_{late}")
    starts = [r["win_start_us"] // 1_000_000 for r in got.orderBy("ts_us").collect()]
    assert starts == [0, 5, 10, 10, 18]


def test_overlapping_files_move_the_grid_as_sorted_ones_do(spark, tmp_path):
    files = [[("a", float(t), 1.0, 80) for t in part] for part in ((0, 14), (11, 20), (6, 19, 30))] + [[("b", 500.0, 1.0, 80)]]
    got = drain(spark, stream_regrid(feed(spark, tmp_path, *files), 5, 8, ["k"], delay="60 seconds"), tmp_path, "overlap")
    rows = [(r["ts_us"] // 1_000_000, r["win_start_us"] // 1_000_000) for r in got.orderBy("ts_us").collect()]
    assert rows == [(0, 0), (6, 5), (11, 10), (14, 10), (19, 18), (20, 18), (30, 26)]


@pytest.mark.parametrize("slices", [1, 5])
def test_samples_stay_bounded_over_triggers(spark, tmp_path, slices):
    rows = feed(spark, tmp_path, ROWS[:25], ROWS[25:], [("a", 200.0, 1.0, 80)])
    got = drain(spark, stream_sample(rows, 20, 2, keys=["k"], keep=["bytes"], slices=slices), tmp_path, f"sample_{slices}")
    kept = {}
    for r in got.collect():
        kept.setdefault((r["series"], r["win_start_us"]), []).append(r["ts_us"] // 1_000_000)
    assert {g: sorted(t) for g, t in kept.items() if "a" in g[0]} == \
        {('{"k":"a"}', 0): [17, 19], ('{"k":"a"}', 20_000_000): [37, 38], ('{"k":"a"}', 40_000_000): [58, 59]}


def test_samples_of_many_windows_share_few_groups(spark, tmp_path):
    rows = [(f"s{i % 40}", float(1 + i % 97 + 20 * (i // 200)), None if i % 7 == 0 else float(i % 5), None if i % 3 else 2**53 + i) for i in range(600)]
    schema, path = "k string, ts double, bytes double, n long", str(tmp_path / "in")
    for at in range(0, 600, 200):
        spark.createDataFrame(rows[at:at + 200] + ([("end", 900.0, 1.0, None)] if at == 400 else []), schema).coalesce(1).write.mode("append").parquet(path)
    events = canonical_events(stream_flows(spark, path, schema, files_per_trigger=1), keys=["k"], keep=["n"])
    stream = stream_sample(events, 20, 3, "500 seconds", ["k"], ["n"], slices=3, buckets=5)
    query = stream.writeStream.format("memory").queryName("few_groups").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = {}
    for k, ts, _, n in rows:
        want.setdefault((f'{{"k":"{k}"}}', int(ts) // 20 * 20_000_000), []).append((int(ts) * 1_000_000, n))
    want = {w: sorted(v, key=lambda e: (e[0], e[1] is not None, e[1] or 0), reverse=True)[:3] for w, v in want.items() if w[1] + 20_000_000 <= 400_000_000}
    got = {}
    for r in spark.table("few_groups").collect():
        got.setdefault((r["series"], r["win_start_us"]), []).append((r["ts_us"], r["n"]))
    assert len(want) > 100 and {w: sorted(v, key=str) for w, v in got.items()} == {w: sorted(v, key=str) for w, v in want.items()}
    # State rows (parts, book, timers) follow the groups, not the windows.
    assert max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]) <= 5 * 12


def test_stream_arguments(spark, tmp_path):
    with pytest.raises(ValueError):
        stream_flows(spark, str(tmp_path), SCHEMA, "xml")
    with pytest.raises(ValueError):
        stream_regrid(spark.range(1), 5, 3)
