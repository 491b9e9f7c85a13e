import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.canonical import canonical_events
from tidewatch.operators.windows import tumbling_features
from tidewatch.plans.prepare import dataset_report, prepare, row_groups
from tidewatch.sources.flows import project_recognized, read_flows, union_sources, with_row_number, with_row_time
from tidewatch.sources.packets import packets_to_events
from tidewatch.sources.reports import file_digests, report_json, write_report
from tidewatch.sources.store import read_features, read_metadata, stored_scaler, write_features


def test_csv_with_byte_order_mark_and_blank_rows(spark, tmp_path):
    file = tmp_path / "flows.csv"
    file.write_text("﻿timestamp,bytes,packets,stage\n0,1,1,0\n,,,\n5,2,1,0\n10,3,1,1\n15,4,1,1\n", encoding="utf-8")
    records = read_flows(spark, str(file))
    assert records.columns == ["timestamp", "bytes", "packets", "stage"] and records.count() == 4
    windows = tumbling_features(canonical_events(records), 5).orderBy("win_idx").collect()
    assert [(r["flow_bytes"], r["stage"]) for r in windows] == [(1, 0), (2, 0), (3, 1), (4, 1)]


def test_tsv_by_extension_and_unknown_extension(spark, tmp_path):
    file = tmp_path / "flows.tsv"
    file.write_text("timestamp\tbytes\n0\t7\n")
    assert read_flows(spark, str(file)).first()["bytes"] == "7"
    with pytest.raises(ValueError, match="unsupported"):
        read_flows(spark, "flows.xlsx")


def test_malformed_row_is_reported(spark, tmp_path):
    file = tmp_path / "flows.csv"
    file.write_text('timestamp,bytes\n0,1\n1,2,3,4\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_flows(spark, str(file), strict=True).collect()


def test_folder_with_mixed_formats_and_headers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.csv").write_text("Time,Tot Bytes\n0,1\n1,2\n")
    (tmp_path / "two.csv").write_text("time,packets\n2,9\n")
    (tmp_path / "three.tsv").write_text("time\ttot_bytes\n3\t4\n")
    spark.createDataFrame([(4.0, 5.0)], "time double, tot_bytes double").coalesce(1).write.parquet(str(tmp_path / "b"))
    (tmp_path / "note.txt").write_text("not traffic")
    records = read_flows(spark, str(tmp_path), position=True)
    numbered = with_row_number(records)
    assert sorted(r["row_number"] for r in numbered.collect()) == [0, 1, 2, 3, 4]
    e = canonical_events(records)
    assert e.agg(F.sum("bytes"), F.sum("packets")).first()[:] == (12.0, 9.0)
    timed = with_row_time(records.drop("time"))
    assert sorted(r["timestamp"] for r in timed.collect()) == [0.0, 1.0, 2.0, 3.0, 4.0]
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no supported"):
        read_flows(spark, str(tmp_path / "empty"))


def test_projection_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "flows.parquet")
    spark.createDataFrame([(0.0, 1, "x")], "timestamp double, bytes int, comment string").write.parquet(path)
    df = project_recognized(read_flows(spark, path))
    assert "comment" not in df.columns
    plan = canonical_events(df)._jdf.queryExecution().executedPlan().toString()
    assert "comment" not in plan


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "bytes int, only_a string")
    b = spark.createDataFrame([("2",)], "Bytes string")
    out = union_sources([a, b])
    assert [tuple(r) for r in out.collect()] == [("1", "x"), ("2", None)]


def test_packets(spark):
    schema = ("time double, length int, ip_src string, ip_dst string, ttl int, ip_flags int, ip_frag int, payload_length int, "
              "sport int, dport int, window int, flags string")
    rows = [(1.0, 60, "a", "b", 64, 1, 8, 40, 1000, 80, 512, "SA"), (2.0, 70, "a", "b", 64, 1, 0, 50, None, None, None, None),
            (3.0, 42, None, None, None, None, None, None, None, None, None, None)]
    out = packets_to_events(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 2
    assert (out[0]["fragment_count"], out[0]["syn_count"], out[0]["ack_count"], out[0]["fin_count"]) == (1, 1, 1, 0)
    assert (out[1]["fragment_count"], out[1]["syn_count"], out[1]["dst_port"]) == (0, None, None)


def test_prepare_by_time_and_by_rows(spark, tmp_path):
    csv = tmp_path / "flows.csv"
    csv.write_text("timestamp,bytes,packets,stage\n" + "".join(f"{5 * i},{i + 1},1,{int(i > 1)}\n" for i in range(4)))
    meta = prepare(spark, str(csv), str(tmp_path / "out"))
    assert meta["window_count"] == 4 and meta["label_semantics"] == "source_stage"
    assert meta["windowing"]["timestamp_order_verified"] is False
    stored = read_features(spark, str(tmp_path / "out"))
    assert stored.count() == 4 and abs(stored.agg(F.avg("flow_bytes")).first()[0]) < 1e-12
    report = dataset_report(spark, str(tmp_path / "out")).first()
    assert (report["event_count"], report["window_count"], report["stage_counts"]) == (4, 4, {"0": 2, "1": 2})
    assert (report["risk_min"], report["risk_max"]) == (0.0, 0.0)

    parquet = str(tmp_path / "flows.parquet")
    rows = [(0.1, 2, 20, "Benign"), (0.2, 3, 30, "Attack"), (0.3, 4, 40, "Attack")]
    spark.createDataFrame(rows, "dur double, tot_pkts long, tot_bytes long, label string").coalesce(1).write.parquet(parquet)
    meta = prepare(spark, parquet, str(tmp_path / "rows"))
    assert meta["windowing"]["method"] == "fixed_source_order_row_groups" and meta["label_semantics"] == "binary_attack"
    groups = row_groups(read_flows(spark, parquet, position=True), 2).orderBy("win_start").collect()
    assert [(r["event_count"], r["stage"]) for r in groups] == [(2, 1), (1, 1)]


def test_feature_table_checks(spark, tmp_path):
    windows = tumbling_features(canonical_events(spark.createDataFrame([(0.0, 10), (5.0, 20)], "ts double, bytes int")), 5)
    path = str(tmp_path / "t")
    write_features(windows, path)
    scaler = stored_scaler(read_metadata(spark, path))
    assert scaler.mean[0] == 15.0 and scaler.scale[0] == 5.0
    with pytest.raises(ValueError, match="no usable"):
        write_features(windows.where("false"), str(tmp_path / "none"))


def test_report_is_sorted_and_rejects_nan(spark, tmp_path):
    df = spark.createDataFrame([(1.5, None, {"b": 1, "a": 2})], "z double, a int, m map<string,int>")
    text = report_json(df).first()["report"]
    assert text == '{"a":null,"m":{"a":2,"b":1},"z":1.5}'
    write_report(df, str(tmp_path / "report"))
    assert json.loads(spark.read.text(str(tmp_path / "report")).first()[0])["z"] == 1.5
    with pytest.raises(Exception, match="finite"):
        report_json(spark.createDataFrame([([float("nan")],)], "v array<double>")).collect()


def test_digests(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    row = file_digests(spark, str(tmp_path)).first()
    assert row["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad" and row["bytes"] == 3


def test_digests_of_files_of_any_size_and_name(spark, tmp_path):
    contents = {"a b%20#é.bin": b"x", "empty": b"", "deep/y.bin": bytes(range(256)) * 40_000}
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    with open(tmp_path / "sparse", "wb") as file:
        file.truncate(3 << 30)
    digest, zeros = hashlib.sha256(), bytes(1 << 20)
    for _ in range(3 << 10):
        digest.update(zeros)
    rows = file_digests(spark, str(tmp_path)).collect()
    assert sorted((r["bytes"], r["sha256"]) for r in rows) == sorted(
        [(len(c), hashlib.sha256(c).hexdigest()) for c in contents.values() if c] + [(3 << 30, digest.hexdigest())])
