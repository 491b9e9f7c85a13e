import random

import pytest

import tidewatch.operators.scan as scan
from tidewatch.operators.runs import label_runs, last_alert, lead_summary, lead_times


def series(spark, ys, scores):
    return spark.createDataFrame([(i, y, s) for i, (y, s) in enumerate(zip(ys, scores))],
                                 "idx long, y int, score double")


def test_events_without_warning_keep_a_null_lead(spark):
    df = series(spark, (0, 0, 1, 1, 0, 0, 1, 0), (.1, .8, .9, .9, .1, .1, .2, .9))
    row = lead_summary(lead_times(df, 0.5, 2.0), with_list=True).first()
    assert (row["events"], row["warned"], row["warning_rate"]) == (2, 1, 0.5)
    assert row["lead_times"] == [2.0, None] and row["mean_lead_seconds"] == 2.0
    runs = sorted((r["onset"], r["end"]) for r in label_runs(df).collect())
    assert runs == [(2, 3), (6, 6)]


def test_issue_offset_moves_the_alert_back(spark):
    df = series(spark, (0, 0, 1, 1), (.1, .8, .9, .9))
    assert lead_summary(lead_times(df, issue_offset=1), with_list=True).first()["lead_times"] == [2.0]


def test_no_events_no_alerts_no_rows(spark):
    row = lead_summary(lead_times(series(spark, (0, 0, 0), (0.0, 0.0, 0.0)))).first()
    assert row["events"] == 0 and row["warning_rate"] is None and row["mean_lead_seconds"] is None
    row = lead_summary(lead_times(series(spark, (0, 1, 1), (0.0, 0.0, 0.0))), with_list=True).first()
    assert row["lead_times"] == [None] and row["mean_lead_seconds"] is None
    assert lead_summary(lead_times(series(spark, (), ()))).first()["events"] == 0
    with pytest.raises(ValueError):
        lead_times(series(spark, (0,), (0.0,)), step_seconds=0)


def brute(ys, scores, thr):
    out, end = [], -1
    i = 0
    while i < len(ys):
        if ys[i] == 1 and (i == 0 or ys[i - 1] != 1):
            prior = [j for j in range(end + 1, i) if scores[j] >= thr]
            stop = i
            while stop + 1 < len(ys) and ys[stop + 1] == 1:
                stop += 1
            out.append((i, stop, prior[-1] if prior else None))
            end = stop
        i += 1
    return out


@pytest.mark.parametrize("chunk", [3, 7])
def test_runs_over_many_chunks_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(scan, "CHUNK", chunk)
    monkeypatch.setattr(scan.running_by_index, "__defaults__", (True, chunk))
    monkeypatch.setattr(scan.with_halo, "__defaults__", (0, 0, chunk))
    rng = random.Random(chunk)
    rows, expected = [], {}
    for key in ("a", None):
        ys = [int(rng.random() < 0.5) for _ in range(120)]
        ss = [rng.random() for _ in range(120)]
        rows += [(key, i, y, s) for i, (y, s) in enumerate(zip(ys, ss))]
        expected[key] = brute(ys, ss, 0.8)
    df = spark.createDataFrame(rows, "k string, idx long, y int, score double")
    runs = label_runs(df, ["k"]).collect()
    alerts = last_alert(df, 0.8, ["k"]).collect()
    for key in expected:
        assert sorted((r["onset"], r["end"]) for r in runs if r["k"] == key) == [(a, b) for a, b, _ in expected[key]]
        assert sorted((r["onset"], r["alert_idx"]) for r in alerts if r["k"] == key) == \
            [(a, c) for a, _, c in expected[key]]
