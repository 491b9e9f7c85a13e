import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

import tidewatch.operators.regrid as regrid
from tidewatch.operators.canonical import canonical_events, unreadable_times
from tidewatch.operators.features import features_array, port_masks, with_port_rows
from tidewatch.operators.regrid import regrid_features
from tidewatch.operators.scaling import (
    Scaler, collect_scaler, fit_scaler, rescale, scale, scaler_from_json, scaler_to_json, unscale,
)
from tidewatch.operators.series import assert_sorted, sequences, series_index
from tidewatch.operators.windows import (
    assign_windows, rowgroup_features, sliding_features, tumbling_features, window_sample,
)
from tidewatch.schema import BATCH, COLUMNAR, FEATURE_NOTES, FEATURES, FeatureOptions


def events(spark, rows, schema, **options):
    return canonical_events(spark.createDataFrame(rows, schema), **options)


def test_missing_attributes_become_zero(spark):
    e = events(spark, [(0.0, 100, 2, 1, None), (1.0, 50, 1, None, 80)],
               "timestamp double, bytes int, packets int, syn_count int, dst_port int")
    row = tumbling_features(e, 5).first().asDict()
    assert row["flow_bytes"] == 150 and row["event_count"] == 2 and row["port_diversity"] == 1
    assert all(row[f] is not None for f in FEATURES)
    assert set(FEATURE_NOTES) == set(FEATURES)


def test_constant_feature_standardises_to_zero_and_sequences_overlap(spark):
    e = events(spark, [(float(i), i + 1, 1, 64) for i in range(6)], "timestamp double, bytes int, packets int, ttl int")
    windows = series_index(tumbling_features(e, 1))
    assert windows.count() == 6
    scaled = scale(windows, fit_scaler(windows))
    assert {r["ttl_mean"] for r in scaled.collect()} == {0.0}
    histories = sequences(features_array(scaled), 3)
    assert histories.count() == 4 and all(len(r["history"]) == 3 for r in histories.collect())
    assert sequences(features_array(scaled), 7).count() == 0


def test_streamed_example_has_two_windows_and_bounded_samples(spark):
    e = events(spark, [(float(i), 10, 1, int(i > 4)) for i in range(10)],
               "timestamp double, bytes int, packets int, stage int")
    rows = tumbling_features(e, 5).orderBy("win_idx").collect()
    assert [(r["event_count"], r["stage"]) for r in rows] == [(5, 0), (5, 1)]
    sample = window_sample(assign_windows(e, 5).select("win_idx", "ts_us"), 1, ["win_idx"]).orderBy("win_idx").collect()
    assert [[s["ts_us"] for s in r["sample"]] for r in sample] == [[4_000_000], [9_000_000]]
    big = window_sample(assign_windows(e, 5).select("win_idx", "ts_us"), 2000, ["win_idx"]).orderBy("win_idx").collect()
    assert [len(r["sample"]) for r in big] == [5, 5]


def test_supplied_scaler_is_used(spark):
    windows = tumbling_features(events(spark, [(0.0, 10), (5.0, 20)], "timestamp double, bytes int"), 5)
    scaler = Scaler((10.0,) + (0.0,) * 23, (10.0,) + (1.0,) * 23)
    assert [r["flow_bytes"] for r in scale(windows, scaler).orderBy("win_idx").collect()] == [0.0, 1.0]


def test_rescale_between_scalers(spark):
    df = spark.createDataFrame([(0.0, 1.0)], "a double, b double")
    stored, wanted = Scaler((100.0, 0.0), (10.0, 1.0)), Scaler((50.0, 2.0), (5.0, 2.0))
    assert tuple(rescale(df, stored, wanted, ["a", "b"]).first()) == (10.0, -0.5)
    assert tuple(unscale(scale(df, wanted, ["a", "b"]), wanted, ["a", "b"]).first()) == (0.0, 1.0)
    assert scaler_from_json(scaler_to_json(stored), 2) == stored
    with pytest.raises(ValueError):
        scaler_from_json(scaler_to_json(stored))


def test_pooled_scaler_is_one_pair(spark):
    df = spark.createDataFrame([(1.0, 3.0), (3.0, 5.0)], "a double, b double")
    fitted = collect_scaler(fit_scaler(df, ["a", "b"], pooled=True))
    # Row sums 4 and 8, row square sums 10 and 34: mean 6, variance 22 - 36 < 0 -> flat.
    assert fitted == Scaler((6.0, 6.0), (1.0, 1.0))


def test_text_labels_with_category(spark):
    rows = [(0.1, 2, 20, "Benign", ""), (0.2, 3, 30, "Attack", "Botnet"), (0.3, 4, 40, "Attack", "Botnet"), (0.1, 1, 1, None, None)]
    df = spark.createDataFrame(rows, "dur double, tot_pkts long, tot_bytes long, label string, Family string")
    e = canonical_events(df, labels="text", timed=False)
    assert [(r["stage"], r["risk"]) for r in e.collect()] == [(0, 0.0), (4, 1.0), (4, 1.0), (1, 1.0)]


def test_row_groups_of_two(spark):
    rows = [(0, 0.1, 2, 20, "Benign"), (1, 0.2, 3, 30, "Attack"), (2, 0.3, 4, 40, "Attack")]
    df = spark.createDataFrame(rows, "row long, dur double, tot_pkts long, tot_bytes long, label string")
    e = canonical_events(df, keep=["row"], labels="binary", options=COLUMNAR, timed=False)
    out = rowgroup_features(e, "row", rows=2, options=COLUMNAR).orderBy("win_idx").collect()
    assert [(r["event_count"], r["stage"], r["win_start"], r["win_end"]) for r in out] == [(2, 1, 0, 2), (1, 1, 2, 3)]


def test_row_groups_never_cross_files(spark):
    rows = [("b", i, 1.0) for i in range(3)] + [("a", i, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "file string, row long, bytes double")
    e = canonical_events(df, keep=["file", "row"], labels="binary", options=COLUMNAR, timed=False)
    out = rowgroup_features(e, "row", "file", rows=2, options=COLUMNAR).orderBy("win_start").collect()
    assert [(r["file"], r["win_start"], r["win_end"]) for r in out] == \
        [("a", 0, 2), ("a", 2, 4), ("a", 4, 5), ("b", 5, 7), ("b", 7, 8)]


def test_ports_over_block_borders_and_list_cells(spark):
    e = events(spark, [(0.0, "80;81;82;125", "126,127,189"), (1.0, "190", None), (9.0, "5", "x")],
               "timestamp double, dst_port string, src_port string")
    rows = tumbling_features(e, 5).orderBy("win_idx").collect()
    # 80 81 82 | 125 126 127 | 189 190 -> 2 + 2 + 1 of 7 neighbours
    assert rows[0]["port_diversity"] == 8 and rows[0]["sequential_port_score"] == pytest.approx(5 / 7)
    assert rows[1]["port_diversity"] == 1 and rows[1]["sequential_port_score"] == 0


def test_ports_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", None]), float(rng.randrange(40)), rng.randrange(0, 400), rng.randrange(1, 400)) for _ in range(600)]
    df = spark.createDataFrame(rows, "k string, ts double, dst_port int, src_port int")
    got = {(r["k"], r["win_idx"]): (r["port_diversity"], r["sequential_port_score"])
           for r in tumbling_features(canonical_events(df, keys=["k"]), 10, ["k"], anchor=0).collect()}
    sets = {}
    for k, ts, a, b in rows:
        sets.setdefault((k, int(ts // 10)), set()).update(p for p in (a, b) if p > 0)
    assert got == {g: (len(s), sum(p + 1 in s for p in s) / (len(s) - 1)) for g, s in sets.items()}


def test_batch_semantics_skip_missing_and_use_whole_cells(spark):
    df = spark.createDataFrame([(0.0, "1;3", 0, "2,4"), (1.0, None, 64, None)],
                               "timestamp double, iat string, ttl int, payload_size string")
    batch = tumbling_features(canonical_events(df, options=BATCH), 5, options=BATCH).first()
    assert (batch["iat_mean"], batch["iat_variance"], batch["iat_max"]) == (2.0, 1.0, 3.0)
    assert batch["ttl_mean"] == 64 and batch["payload_mean"] == 2.0
    online = tumbling_features(canonical_events(df), 5).first()
    assert (online["iat_mean"], online["ttl_mean"], online["payload_mean"]) == (0.5, 32.0, 1.0)
    sliding = sliding_features(canonical_events(df, options=BATCH), 5, 2.5, options=BATCH).orderBy("win_idx").first()
    assert sliding["iat_variance"] == pytest.approx(1.0)


def test_ratio_guards(spark):
    df = spark.createDataFrame([(0.0, 10.0, 0.0)], "timestamp double, src_bytes double, dst_bytes double")
    assert tumbling_features(canonical_events(df), 5).first()["bidirectional_byte_ratio"] == 0.0
    floor = FeatureOptions(ratio_guard="floor1")
    assert tumbling_features(canonical_events(df), 5, options=floor).first()["bidirectional_byte_ratio"] == 10.0


def test_sliding_windows_match_membership(spark):
    rng = random.Random(9)
    times = sorted(rng.uniform(0, 60) for _ in range(80))
    e = events(spark, [(t, 1.0) for t in times], "timestamp double, bytes double")
    for width, stride in ((10.0, 4.0), (4.0, 10.0), (5.0, 5.0)):
        got = {r["win_idx"]: r["event_count"] for r in sliding_features(e, width, stride).collect()}
        us = [round(t * 1e6) for t in times]
        want = {}
        for i in range(int(60 / stride) + 1):
            start = us[0] + round(i * stride * 1e6)
            n = sum(start <= t < start + round(width * 1e6) for t in us)
            if n:
                want[i] = n
        assert got == want


def moving_grid(times, width, stride):
    start, starts = None, []
    for t in times:
        start = t if start is None else start
        while t >= start + width:
            start = start + stride if t >= start + stride else start + width
        starts.append(start)
    return starts


@pytest.mark.parametrize("cells,strides", [(65_536, 4), (4, 0), (1, 2)])
def test_gap_events_move_the_grid(spark, monkeypatch, cells, strides):
    monkeypatch.setattr(regrid, "CELLS", cells)
    monkeypatch.setattr(regrid, "STRIDES", strides)
    rng = random.Random(3)
    series = {"a": [0, 6, 11, 14, 20], None: sorted(rng.randrange(0, 900) for _ in range(150))}
    e = events(spark, [(k, float(t), 1) for k, ts in series.items() for t in ts], "k string, ts double, bytes int", keys=["k"])
    for width, stride in ((5, 8), (3, 7)):
        got = sorted((str(r["k"]), int(r["s"]), r["event_count"]) for r in
                     regrid_features(e, width, stride, ["k"]).withColumn("s", F.unix_seconds("win_start")).collect())
        want = {}
        for k, ts in series.items():
            for s in moving_grid(ts, width, stride):
                want[(str(k), s)] = want.get((str(k), s), 0) + 1
        assert got == sorted((k, s, n) for (k, s), n in want.items())


@pytest.mark.parametrize("width,stride", [(5_001, 8_000), (1, 7), (4, 12), (9, 9), (997, 1_000)])
def test_maps_of_a_chunk_equal_steps_from_every_phase(width, stride):
    rng = random.Random(width)
    cells = sorted({rng.randrange(60 * stride) for _ in range(200)})
    runs, last = (np.zeros(1, np.int64),) * 2, cells[0]
    for cell in cells:
        runs, last = regrid.moved(*runs, cell - last, width, stride), cell
    starts, values = runs
    assert len(starts) <= width
    phases = np.arange(stride)
    place = (cells[0] - phases) % stride % width
    run = np.searchsorted(starts, place, "right") - 1
    for cell in cells:
        phases = regrid.next_phase(phases, cell, width, stride)
    assert ((last - (values[run] + place - starts[run])) % stride == phases).all()


def test_long_strides_move_the_grid_in_many_tasks(spark):
    rng = random.Random(8)
    times = sorted({rng.randrange(0, 4_000_000) for _ in range(300)})  # milliseconds, so 8,000 phases
    e = events(spark, [("a", t / 1000.0, 1) for t in times], "k string, ts double, bytes int", keys=["k"])
    got = {r["s"]: r["event_count"] for r in regrid_features(e, 5.001, 8, ["k"]).withColumn("s", F.unix_millis("win_start")).collect()}
    want = {}
    for s in moving_grid(times, 5_001, 8_000):
        want[s] = want.get(s, 0) + 1
    assert got == want


def test_times_are_read_from_text_numbers_and_timestamps(spark):
    df = spark.createDataFrame([("1.5",), ("2024-01-01 00:00:00",), ("never",)], "time string")
    e = canonical_events(df)
    assert [r["ts_us"] for r in e.collect()] == [1_500_000, 1_704_067_200_000_000, None]
    assert unreadable_times(e).first()["unreadable_times"] == 1
    typed = canonical_events(spark.createDataFrame([(datetime(1970, 1, 1, 0, 0, 1),)], "ts timestamp_ntz"))
    assert typed.first()["ts_us"] == 1_000_000


def test_backward_time_is_an_error(spark):
    df = spark.createDataFrame([(0, 1_000), (1, 3_000), (2, 2_000)], "n long, ts_us long")
    with pytest.raises(ValueError, match="sorted"):
        assert_sorted(df, "n")
    assert_sorted(df.where("n < 2"), "n")


def test_name_collisions_are_an_error(spark):
    with pytest.raises(ValueError, match="both read as"):
        canonical_events(spark.createDataFrame([(1, 2, 0.0)], "`Dst Port` int, dst_port int, ts double"))


def test_one_busy_series_beyond_the_broadcast_limit(spark, monkeypatch):
    import tidewatch.session as session

    monkeypatch.setattr(session.join_small, "__defaults__", ("inner", 1))
    e = events(spark, [("hot", float(i)) for i in range(300)] + [(None, 7.0), ("cold", 1.0)], "k string, ts double", keys=["k"])
    got = {r["k"]: r["n"] for r in tumbling_features(e, 1000, ["k"]).groupBy("k").agg(F.sum("event_count").alias("n")).collect()}
    assert got == {"hot": 300, None: 1, "cold": 1}


def test_groups_are_gathered_before_their_sums_open(spark):
    rows = [(None if i % 50 == 0 else "a", float(i % 40), float(i), 80 + i) for i in range(4_000)]
    events = canonical_events(spark.createDataFrame(rows, "k string, ts double, bytes double, dst_port int").repartition(4), keys=["k"])
    windows = tumbling_features(events, 10, ["k"])
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(advisory)
    spark.conf.set(advisory, "2k")  # the windows of "a" are cut into parts
    try:
        got = {(r["k"], r["win_idx"]): (r["event_count"], r["flow_bytes"], r["port_diversity"]) for r in windows.collect()}
    finally:
        spark.conf.set(advisory, before)
    want = {}
    for k, ts, size, port in rows:
        want.setdefault((k, int(ts) // 10), []).append((size, port))
    assert got == {w: (len(v), sum(s for s, _ in v), len({p for _, p in v})) for w, v in want.items()}

    def plan(table):
        return table._jdf.queryExecution().executedPlan().toString()
    # Records and their ports, each on their way to sums.
    assert plan(windows).split("Initial Plan")[1].count("REBALANCE_PARTITIONS_BY_COL") == 2 and "REBALANCE" not in plan(tumbling_features(events, 10))


def test_port_blocks_meet_the_wide_sums_as_one_row_per_group(spark):
    events = spark.createDataFrame([("a", [1, 2, 100, 700]), ("a", [2, 5_000]), (None, [7])], "k string, ports array<bigint>")
    rows = with_port_rows(spark.createDataFrame([("a",), (None,)], "k string"), port_masks(events, ["k"]), ["k"])
    ported = sorted((str(r["k"]), r["_ports"], r["_pairs"]) for r in rows.where("_ports IS NOT NULL").collect())
    assert rows.count() == 4 and ported == [("None", 1, 0), ("a", 5, 1)]
